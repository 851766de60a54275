import random
import zlib

import numpy as np

from quire.llm import sharding


def test_every_row_has_a_slot(spark):
    r = random.Random(4)
    rows = [(i, "hot text") for i in range(900)] + [(i + 900, "x" * r.randint(0, 80)) for i in range(1500)] + [(5000, None), (5000, None), (None, ""), (5001, "é" * 50)]
    df = spark.createDataFrame([("t", d, 0, t) for d, t in rows], "shard string, doc_id bigint, slot int, text string")
    got = sharding.shard(df, items=256).collect()
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((str(x.doc_id), x["size"], x.text_crc32) for x in got) == want
    load = np.zeros(8)
    for s in range(8):
        mine = [x for x in got if x.shard == s]
        assert sorted(x.slot for x in mine) == list(range(len(mine)))
        load[s] = sum(x["size"] for x in mine)
    assert load.max() - load.min() <= 0.01 * load.mean() + 110


def test_equal_texts_stay_together_unless_hot(spark):
    df = spark.createDataFrame([(i, f"text number {i % 500}") for i in range(1500)], "doc_id bigint, text string")
    for items in (64, 4096):  # in buckets, and one by one
        where = {}
        for x in sharding.shard(df, items=items).collect():
            where.setdefault(x.text_crc32, set()).add(x.shard)
        assert all(len(s) == 1 for s in where.values())


def test_large_groups_stay_whole_and_huge_ones_are_split(spark):
    """Shards hold 500 rows: groups of 100 are no good part of a shard, a group of 1,300 is."""
    rows = [(i, f"copy {i // 100}") for i in range(1000)] + [(5000 + i, "the hot one") for i in range(1300)] + [(9000 + i, f"own {i}") for i in range(1700)]
    where, rows_of, size_of = {}, np.zeros(8), np.zeros(8)
    for x in sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        where.setdefault(x.text_crc32, set()).add(x.shard)
        rows_of[x.shard] += 1
        size_of[x.shard] += x["size"]
    hot = where.pop(zlib.crc32(b"the hot one"))
    assert len(hot) > 2 and all(len(s) == 1 for s in where.values())
    assert np.ptp(size_of) <= 0.003 * size_of.mean() and np.ptp(rows_of) <= 0.15 * rows_of.mean()


def test_tokens_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    from quire.llm import tokens

    texts = ["", None, "two words", "don't", "x" * 5000, "end <|endoftext|>"]
    library = Tokenizer.from_file(tokens.default_path())
    got = sharding.measured(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id", "text", None)
    assert {x._id: x._tokens for x in got.collect()} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_no_rows(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_place_balances_all_dimensions():
    r = np.random.default_rng(0)
    v = r.integers(1, 1000, (3000, 3)).astype(float)
    out = sharding.place(v, 8)
    for k in range(3):
        load = np.bincount(out, weights=v[:, k], minlength=8)
        assert load.max() / load.mean() < (1.001 if k == 0 else 1.01)


def test_exchanges_bring_all_dimensions_together():
    r = np.random.default_rng(3)
    share = r.integers(1, 1000, (400, 3)) / 50_000
    start = np.zeros(400, dtype=np.int64) + (np.arange(400) > 300)
    out = sharding._balanced(share, start.copy(), 4)
    weights = np.array(sharding.WEIGHTS)

    def cost(of):
        load = np.stack([np.bincount(of, weights=share[:, d], minlength=4) for d in range(3)], axis=1)
        return (((load - load.mean(axis=0)) ** 2) * weights).sum()

    assert cost(out) < 1e-4 * cost(start)
