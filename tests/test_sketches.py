from pyspark.sql import functions as F

from quire.operators import sketches


def test_pages_add_up_to_books(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("book"), (F.col("id") % 30).alias("page"), (F.col("id") % 20_000).cast("string").alias("word"), (F.col("id") % 1000).alias("size"))
    pages = sketches.sketches(rows, ["book", "page"], "word", F.col("size"))
    assert pages.count() == 30
    at_once = {r.book: r for r in sketches.estimates(sketches.sketches(rows, ["book"], "word", F.col("size")), ["book"], [0.1, 0.5, 0.99]).collect()}
    for r in sketches.estimates(sketches.rolled_up(pages, ["book"]), ["book"], [0.1, 0.5, 0.99]).collect():
        exact = rows.where(F.col("book") == r.book).select("word").distinct().count()
        assert r.n_values == 20_000
        for told in (r, at_once[r.book]):
            assert abs(told.n_distinct - exact) <= sketches.COUNT_ERROR * exact
            assert all(abs(q / 1000 - p) <= sketches.RANK_ERROR for q, p in zip(told.quantiles, [0.1, 0.5, 0.99], strict=True))


def test_nulls_and_no_rows(spark):
    schema = "page int, word string, size int"
    found = sketches.estimates(sketches.sketches(spark.createDataFrame([(1, None, None), (1, "a", 3), (1, "a", 3)], schema), ["page"], "word", F.col("size")), ["page"], [0.5]).collect()
    assert [(r.n_distinct, r.n_values, list(r.quantiles)) for r in found] == [(1, 2, [3.0])]
    empty = sketches.sketches(spark.createDataFrame([], schema), ["page"], "word", F.col("size"))
    assert sketches.rolled_up(empty, ["page"]).collect() == []
