"""Pages are rows of arrays: no frame of pandas for each page, and no line or word is dealt again."""

import __spark_entry__ as e
import pytest

from quire.operators import matching


def plan(spark, name):
    return e.queries()[name](spark, e.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["truth_diff_lines", "truth_match_lines", "fragments_rejoined"])
def test_pages_are_not_frames_of_pandas(spark, name):
    found = plan(spark, name)
    assert "InPandas" not in found and not [x for x in found.splitlines() if "Exchange hash" in x and "REPARTITION_BY_NUM" not in x]


def test_words_are_put_back_where_they_are(spark):
    assert not [x for x in plan(spark, "words_put_back").splitlines() if "Exchange hash" in x and "line#" in x]


def test_lines_of_no_page_are_one(spark):
    schema = "page int, line_no int, text string"
    a = spark.createDataFrame([(None, 0, "one line"), (None, 1, "two"), (1, 0, "only here")], schema)
    b = spark.createDataFrame([(None, 0, "one line"), (2, 0, "only there")], schema)
    got = {tuple(x) for x in matching.diff_lines(a, b, "page").collect()}
    assert got == {(None, 0, "equal", 0, 1, 0, 1), (None, 1, "delete", 1, 2, 1, 1), (1, 0, "delete", 0, 1, 0, 0), (2, 0, "insert", 0, 0, 0, 1)}
    assert [tuple(x) for x in matching.match_lines(a, b, "page").collect()] == [(None, 0, 0, 100, "equal")]
    assert matching.diff_lines(a.limit(0), b.limit(0), "page").collect() == []
