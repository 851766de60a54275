import random

from quire.llm import line_dedup

SCHEMA = "d string, text string, _cut int, doc_id bigint, h string"


def line(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(n))


def run(spark, rows, **options):
    df = spark.createDataFrame([("x", t, 1, d, None) for d, t in rows], SCHEMA)
    got = line_dedup.dedup_lines(df, **options)
    assert got.columns == ["d", "text", "_cut", "doc_id", "h", "removed_lines", "removed_runs"]
    return sorted(((x.doc_id, x.text, x.removed_lines) for x in got.collect()), key=str)


def test_shared_passages_go_from_later_documents(spark):
    r = random.Random(1)
    passage, pair, short = line(r, 51), [line(r, 27), line(r, 28)], line(r, 12)
    own = [line(r, 40) for _ in range(12)]
    rows = [
        (1, "\n".join([own[0], passage, own[1]])),
        (2, "\n".join([own[2], short, passage, own[3]])),
        (3, "\n".join([passage, *pair, own[4]])),
        (4, "\n".join([own[5], pair[0], "", pair[1], own[6]])),
        (5, "\n".join([short, own[7], own[8], short])),
        (6, "\n".join([own[9], own[9], own[10]])),
        (7, None), (8, ""), (9, "\n\n"), (None, own[11]), (10, own[11] + "\n" + line(r, 15)),
    ]
    got = {d: (t, n) for d, t, n in run(spark, rows)}
    text = dict(rows)
    assert got[1] == (text[1], 0)
    assert got[2] == ("\n".join([own[2], short, own[3]]), 1)
    assert got[3] == ("\n".join([*pair, own[4]]), 1)
    assert got[4] == ("\n".join([own[5], own[6]]), 3)
    assert got[5] == (text[5], 0)
    assert got[7] == (None, 0) and got[8] == ("", 0) and got[9] == ("\n\n", 0)
    assert got[None] == (own[11], 0)


def test_repeated_rows_and_copies(spark):
    r = random.Random(2)
    a = "\n".join(line(r, 20) for _ in range(5))
    got = run(spark, [(1, a), (1, a), (2, a), (3, "short one"), (3, "short one"), (4, "short one")])
    assert sorted(t for d, t, n in got if d != 3 and d != 4) == ["", "", a]
    assert [t for d, t, n in got if d == 1].count(a) == 1
    assert all(t == "short one" for d, t, n in got if d in (3, 4))


def test_no_rows(spark):
    assert run(spark, []) == []


def brute_force(rows, run_words):
    """id -> the numbers of the lines that are in a run of run_words words or more that stands at an earlier place."""
    texts = sorted((d, [x for x in t.split("\n") if x.split()]) for d, t in rows if t)
    seen, gone = {}, {}
    for d, lines in texts:
        size = [len(x.split()) for x in lines]
        for i in range(len(lines)):
            n = 0
            for j in range(i, len(lines)):
                n += size[j]
                if n >= run_words:
                    key = tuple(lines[i : j + 1])
                    if seen.setdefault(key, (d, i)) != (d, i):
                        gone.setdefault(d, set()).update(range(i, j + 1))
    return gone


def expected(rows, run_words):
    gone = brute_force(rows, run_words)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in rows}


def test_equals_brute_force(spark):
    """Every line of every repeated run goes, and no other."""
    for seed in (3, 4):
        r = random.Random(seed)
        pool = [line(r, r.randint(1, 12)) for _ in range(60)]
        rows = []
        for d in range(80):
            parts = []
            while len(parts) < r.randint(1, 25):
                k = r.randrange(len(pool))
                parts += pool[k : k + r.randint(1, 6)] if r.random() < 0.5 else [line(r, r.randint(1, 12))]
            rows.append((d, "\n".join(parts)))
        got = {d: t for d, t, n in run(spark, rows, gram_words=12, run_words=20)}
        assert got == expected(rows, 20)


def test_runs_around_a_line_that_an_earlier_document_has(spark):
    """The first holder of the shared line doesn't hold the longer run, which two later documents share."""
    r = random.Random(5)
    rows = []
    for k in range(12):
        g, x, y = line(r, 30), line(r, r.randint(10, 15)), line(r, r.randint(10, 15))
        rows += [(10 * k, g + "\n" + line(r, 20)), (10 * k + 1, "\n".join([line(r, 9), x, g, y])), (10 * k + 2, "\n".join([x, g, y, line(r, 8)])), (10 * k + 3, "\n".join([x, g, line(r, 8), g, y]))]
    got = {d: t for d, t, n in run(spark, rows)}
    assert got == expected(rows, 50)
    assert sum(got[10 * k + 2].count("\n") == 0 for k in range(12)) == 12


def test_long_texts_and_names_that_clash(spark):
    r = random.Random(6)
    long = [line(r, 7) for _ in range(3000)]
    rows = [(1, "\n".join(long), 5, "x"), (2, "\n".join(long[1000:2500] + [line(r, 60)]), 6, "y"), (3, line(r, 5) * 20000, 7, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, removed_lines int, removed_runs string")
    got = {x.doc_id: x for x in line_dedup.dedup_lines(df).collect()}
    assert set(got[1].asDict()) == {"doc_id", "text", "removed_lines", "removed_runs"}
    assert [got[i].removed_lines for i in (1, 2, 3)] == [0, 1500, 0]
    assert got[2].text == rows[1][1].rsplit("\n", 1)[1] and got[3].text == rows[2][1]


def test_one_line_over_and_over(spark):
    x = "one two three four five six"
    rows = [(1, "\n".join([x] * 40)), (2, "\n".join(["start", *[x] * 30]))]
    got = {d: t for d, t, n in run(spark, rows)}
    assert got == {1: x, 2: "start"} == expected(rows, 50)
