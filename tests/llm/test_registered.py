"""Every registered operator query runs over its whole table at the smallest size."""

import zlib

import duckdb
import pytest

import __spark_entry__
from quire.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return {r[0]: r for r in duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()}


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", [n for n in QUERIES if n.split("_")[0] not in ("op2", "op3", "op5", "op9", "op13")])
def test_one_row_for_each_document(spark, documents, name):
    found = QUERIES[name](spark, DIR)
    got = found.collect()
    assert sorted(r.doc_id for r in got) == sorted(documents)
    if name in ORACLE_SQL:
        c = duckdb.connect()
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
        want = c.sql(ORACLE_SQL[name])
        assert sorted(tuple(r[k] for k in want.columns) for r in got) == sorted(want.fetchall())


def test_contract_columns(spark, documents):
    types = {n: dict(QUERIES[n](spark, DIR).dtypes) for n in ("op4_language_id", "op7_sharding", "op10_quality_rules")}
    assert types["op4_language_id"] == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    assert types["op7_sharding"] == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    assert {k: types["op10_quality_rules"][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} == dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "bigint")


def test_held_out_third(spark, documents):
    got = QUERIES["op4_language_id"](spark, DIR).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_shards_are_near_equal(spark, documents):
    load = [0] * 8
    for r in QUERIES["op7_sharding"](spark, DIR).collect():
        load[r.shard] += r["size"]
        assert r["size"] == len(documents[r.doc_id][1].encode()) + 1
    assert max(load) - min(load) <= 0.02 * sum(load) / 8


def test_trie_equals_its_twin(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DIR}/conversations.parquet'")
    got = QUERIES["op13_conversation_trie"](spark, DIR)
    want = c.sql(ORACLE_SQL["op13_conversation_trie"])
    assert set(dict(got.dtypes).values()) == {"bigint", "string"}
    key = lambda r: (r[0], r[1])
    assert sorted((tuple(r[k] for k in want.columns) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)
