import random

from pyspark.sql import functions as F

from quire.llm import minhash
from quire.llm.components import components

SCHEMA = "bands string, doc_id bigint, text string, n int, digest string"


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent=80):
    """Least id reachable, by all pairs."""
    sets = [(d, shingles(t, n)) for d, t in rows]
    least = {d: d for d, _ in rows if d is not None}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {(d, len(s), root(d) if d is not None else None) for d, s in sets}


def corpus(r):
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 6)))
    rows = [(900, None), (901, ""), (902, " \n"), (903, "a"), (904, "A"), (905, "a b"), (905, "a b"), (None, "a b"), (906, "a\tb"), (907, "a b a b"), (908, "b a")]
    d = 0
    for _ in range(60):
        base = [word() for _ in range(r.choice([3, 20, 80, 200]))]
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0.01, 0.02, 0.05, 0.09]))):
                w[r.randrange(len(w))] = word()
            rows.append((d, " ".join(w)))
            d += 1
    hot = [word() for _ in range(150)]
    for _ in range(120):
        w = list(hot)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = word()
        rows.append((d, " ".join(w)))
        d += 1
    r.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    for n, seed in ((2, 1), (5, 2)):
        rows = corpus(random.Random(seed))
        df = spark.createDataFrame([("x", d, t, 1, None) for d, t in rows], SCHEMA)
        got = minhash.near_duplicates(df, shingle=n).collect()
        assert len(got) == len(rows)
        assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == brute(rows, n)
        assert all(x.kept is (x.doc_id is None or x.doc_id == x.component_id) for x in got)
        left = minhash.keep_one(df, shingle=n)
        assert left.columns == df.columns
        assert {x.doc_id for x in left.collect()} == {x.doc_id for x in got if x.kept}


def test_the_exact_way_needs_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 50)
    rows = corpus(random.Random(3))
    got = minhash.near_duplicates(spark.createDataFrame([("x", d, t, 1, None) for d, t in rows], SCHEMA), shingle=2, rounds=0).collect()
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == brute(rows, 2)


def test_no_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_chains(spark):
    n = 40
    edges = spark.range(n - 1).select((F.col("id") * 7 % n).alias("a"), ((F.col("id") + 1) * 7 % n).alias("b")).union(spark.createDataFrame([(100, 101), (101, 100), (102, 101)], "a bigint, b bigint"))
    got = {x.node: x.component for x in components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {100: 100, 101: 100, 102: 100}


def test_pruning_bounds():
    for n, m in minhash.least_matches(192, 0.8, 1e-6):
        assert 0 < m < 0.8 * n
