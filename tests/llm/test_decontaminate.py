import random
import re
from collections import Counter

from quire.llm import decontaminate as dc


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n)]


def fixture(r):
    items = [(i, " ".join(words(r, r.randint(14, 59)))) for i in range(30)] + [(90, "too few words"), (91, None), (92, "")]
    docs = []
    for d in range(200):
        w = words(r, r.randint(0, 300))
        if d % 3 == 0:
            i = r.randrange(30)
            p = items[i][1].split()
            if d % 2:
                p[r.randrange(len(p))] = "changed"
            if d % 5 == 0:
                p = [x.upper() for x in p]
            at = r.randint(0, len(w))
            w[at:at] = p
        docs.append((d, " ".join(w)))
    return docs + [(500, None), (501, ""), (502, items[0][1]), (502, items[0][1])], items


def plain_shingles(words):
    return Counter(" ".join(words[i : i + 5]) for i in range(len(words) - 4))


def plain_similarity(a, b):
    weight = lambda s: len(s.encode())
    more = sum(weight(s) * max(a[s], b[s]) for s in a.keys() | b.keys())
    return sum(weight(s) * min(a[s], b[s]) for s in a.keys() & b.keys()) / more if more else 0.0


def fold(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute(docs, items, limit=0.8):
    """(doc, item) -> (similarity, first word, words): every item-sized window of every text against every item; nothing of
    the operator is used."""
    out = {}
    for d, t in docs:
        w = fold(t)
        for i, x in items:
            item = fold(x)
            bag, known = plain_shingles(item), set(item)
            if not bag or len(known & set(w)) < 3:
                continue
            best = (0.0, 0, 0)
            for at in range(1 - len(item), len(w)):
                a, b = max(0, at), min(len(w), at + len(item))
                s = plain_similarity(plain_shingles(w[a:b]), bag)
                if s > best[0]:
                    best = (s, a, b - a)
            if best[0] >= limit:
                out[d, i] = best
    return out


def test_equals_brute_force(spark):
    docs, items = fixture(random.Random(7))
    df = spark.createDataFrame([(t, "x", d, None) for d, t in docs], "text string, item_id string, doc_id bigint, similarity int")
    bench = spark.createDataFrame(items, "item_id bigint, text string").coalesce(1)
    want = brute(docs, items)
    assert len({d for d, _ in want}) > 40
    for size in (1 << 20, 500):
        got = dc.find_leaks(df, bench, block_bytes=size).collect()
        assert {(x.doc_id, x.item_id): (round(x.similarity, 9), x.first_word, x.n_words) for x in got} == {k: (round(s, 9), a, n) for k, (s, a, n) in want.items()}
        assert Counter(x.doc_id for x in got)[502] == 2
    left = dc.remove_leaks(df, bench, block_bytes=500)
    assert left.columns == df.columns
    assert {x.doc_id for x in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert dc.find_leaks(df.limit(0), bench).collect() == [] and dc.find_leaks(df, bench.limit(0)).collect() == []


def test_index_returns_all_within_the_radius():
    r = random.Random(8)
    index = dc.Index([(i, " ".join(words(r, 20))) for i in range(60)], radius=20)
    for _ in range(300):
        p = index.prints[r.randrange(60)]
        for b in r.sample(range(64), r.randint(0, 24)):
            p ^= 1 << b
        assert index.near(p) == [k for k, q in enumerate(index.prints) if (p ^ q).bit_count() <= 20]


def test_bitmap_holds_every_shingle_and_collisions_change_nothing(spark, monkeypatch):
    docs, items = fixture(random.Random(9))
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    bitmap, bits = dc.shingle_bitmap(bench, "text")
    hashes = dc.WordHashes()
    for _, t in items:
        codes = dc.shingle_hashes(t, hashes)
        assert len(dc.in_bitmap(codes, bitmap, bits)) == len(codes)
    clean = dc.shingle_hashes(" ".join(words(random.Random(1), 20000)), hashes)
    assert len(dc.in_bitmap(clean, bitmap, bits)) < 5
    want = sorted(map(tuple, dc.find_leaks(df, bench).collect()))
    monkeypatch.setattr(dc, "MIN_BITS", 15)
    monkeypatch.setattr(dc, "SPARE", 0)
    assert sorted(map(tuple, dc.find_leaks(df, bench).collect())) == want


def test_long_texts_ties_and_rows_without_an_id(spark):
    r = random.Random(10)
    item = " ".join(words(r, 30))
    long = " ".join(words(r, 40000))
    docs = [(1, f"{long} {item} {long} {item}"), (None, f"x {item}"), (2, long)]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, item), (8, item.upper())], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): (x.similarity, x.first_word, x.n_words) for x in dc.find_leaks(df, bench).collect()}
    assert got == {(d, i): (1.0, at, 30) for d, at in ((1, 40000), (None, 1)) for i in (7, 8)}
    assert [x.doc_id for x in dc.remove_leaks(df, bench).collect()] == [2]
