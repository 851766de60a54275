"""Work that grows with the input: pairs of neighbours, slices of markup, and lines aligned once."""

import random

from pyspark.sql import functions as F

from quire.operators import markup, matching


def test_neighbours_do_not_pair_whole_pages(spark):
    lines = spark.createDataFrame([(1, i, f"t{i}") for i in range(60)] + [(2, 0, None)], "doc_id bigint, line_no int, text string")
    reference = lines.where("line_no % 7 <> 3")
    every = lines.join(reference.select("doc_id", F.col("line_no").alias("reference_line_no"), F.col("text").alias("truth")), "doc_id").where("abs(line_no - reference_line_no) <= 1")
    found = matching.neighbours(lines, reference, "doc_id")
    assert sorted(map(str, found.collect())) == sorted(map(str, every.select(*found.columns).collect()))
    assert "line_no" in next(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)


def test_markup_is_returned_in_slices(spark, monkeypatch):
    texts = [(i, "a <i>b</i> [**n] c" * i if i else None) for i in range(30)]
    df = spark.createDataFrame(texts, "id int, text string").coalesce(1)
    whole = sorted(map(str, markup.tokens(df, "id", "text").collect()))
    monkeypatch.setattr(markup, "SLICE", 300)
    assert sorted(map(str, markup.tokens(df, "id", "text").collect())) == whole
    assert len(whole) == sum(len(markup.lex(t or "")) for _, t in texts)


def test_edits_left_equal_edit_costs():
    a, b = ([matching.comparison(x) for x in y.split()] for y in ("ab\u00e9 c dd abc", "abe cd d ab x"))
    left = matching._edits_left(a, b)
    flat = lambda x: tuple(g for t in x for g in t)
    assert left == [[matching.edit_cost(flat(a[i:]), flat(b[j:]), matching.Policy()) for j in range(len(b) + 1)] for i in range(len(a) + 1)]


def test_alignment_looks_at_few_cells(monkeypatch):
    words = [f"word{i * i}" for i in range(100)]
    target = [w + "e" if i % 4 == 1 else w.upper() for i, w in enumerate(words) if i % 5 != 3]
    seen = []
    cost = matching.unit_cost
    monkeypatch.setattr(matching, "unit_cost", lambda s, t: seen.append(1) or cost(s, t))
    found = matching.align(words, target, matching.Policy())
    assert found["accepted"] is False or found["margin"] >= 1
    assert len(seen) < 20 * len(words)


def test_documents_of_one_side_and_null_ids_are_aligned(spark):
    schema = "doc string, pos int, text string"
    source = spark.createDataFrame([("a", 1, "two"), ("a", 0, "one"), (None, 0, "x"), ("s", 0, "only")], schema)
    target = spark.createDataFrame([("a", 0, "One"), ("a", 1, "two"), (None, 0, "x"), ("t", 0, "only")], schema)
    found = {r["doc"]: (r["cost"], [b["kind"] for b in r["best"]]) for r in matching.match_documents(source, target, "doc").collect()}
    assert found == {"a": (0.0, ["one_to_one"] * 2), None: (0.0, ["one_to_one"]), "s": (4.0, ["source_only"]), "t": (4.0, ["target_only"])}


def test_variants_that_cannot_win_are_not_scored(monkeypatch):
    tried = []
    score = matching.ratio
    monkeypatch.setattr(matching, "ratio", lambda a, b: tried.append(1) or score(a, b))
    found, previous, line = "ail This line is lon", "the tail", "this line is long"
    every = [max(score(found, v), score(found.lower(), v.lower())) for v in matching.hyphen_variants(previous, line)]
    assert matching.best_variant(found, previous, line) == (max(every), matching.hyphen_variants(previous, line)[every.index(max(every))])
    assert len(tried) < 2 * len(every)
    tried.clear()
    matching.best_variant("a whole line of words", "before it", "a whole line of words")
    assert len(tried) == 1


def test_alignment_of_a_long_line_makes_no_texts_of_ways(monkeypatch):
    """The ways of unit costs are the same as those of the search that keeps them as JSON, ties and all."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abß") for _ in range(r.randint(0, 3)))
    for _ in range(300):
        a, b = ([word() for _ in range(r.randint(0, 5))] for _ in range(2))
        x, y = ([tuple(matching.comparison(t)) for t in side] for side in (a, b))
        want = matching._ways(x, y, matching.Policy(), matching._edits_left(x, y), float("inf"))
        got = matching.align(a, b, matching.Policy())
        assert (got["cost"], got["best"], got["second"]) == (want[0][0], want[0][1], want[1][1] if len(want) > 1 else [])
    monkeypatch.setattr(matching.json, "loads", None)
    words = [f"word{i * i}" for i in range(120)]
    assert matching.align(words, [w + "e" if i % 4 == 1 else w for i, w in enumerate(words) if i % 5 != 3], matching.Policy())["margin"] is not None


def test_alignment_travels_without_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    matching.align(["one", "two"], ["One"], matching.Policy())
    sent = cloudpickle.dumps(lambda: matching.align(["ab"], ["ac"], matching.Policy())["cost"])
    assert len(sent) < 100_000
    (tmp_path / "sent").write_bytes(sent)
    code = "import pickle; print(pickle.load(open('sent', 'rb'))())"
    done = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "1.0", done.stderr
