"""Every registered query of the core runs at the smallest size, and equals its SQL twin where it has one."""

import duckdb
import pytest

import __spark_entry__
from quire.plans import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(float(v), 9) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(clean(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DIR)
    got = found.collect()
    assert got
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name])
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found.columns, got) == rows(want.columns, want.fetchall())


def test_seeds_change_the_text(spark):
    from pyspark.sql import functions as F

    from quire.plans.base import seeded, table

    assert table(spark, DIR, "documents").where(seeded(F.col("text")).contains("[*note]")).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
