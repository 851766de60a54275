import pytest
from pyspark.sql import functions as F

from quire.operators import guarded

WORDS = "doc int, line int, pos long, word string, l double, t double, r double, b double, relation long, split boolean, kept boolean, seen boolean"


def word(pos, text, relation, line=0, split=None, kept=None, seen=None):
    return (1, line, pos, text, 10.0 * pos, float(pos), 10.0 * pos + 8, 12.0, relation, split, kept, seen)


def projected(spark, rows, tokens):
    df = spark.createDataFrame(rows, WORDS)
    found = guarded.project(df, spark.createDataFrame(tokens, "doc int, relation long, k int, text string"), "doc", "line", "relation", F.col("split"), F.col("kept"), F.col("seen"))
    return {(r.line, r.pos): r for r in found.collect()}


def test_reasons_in_their_order(spark):
    rows = [
        word(0, "one", 1, kept=True), word(1, "to", 2), word(2, "day", 2), word(3, "a", 3, split=True, kept=True), word(4, "b", 3),
        word(5, "c", 4, kept=True, seen=True), word(6, "d", 4), word(7, "e", 5, seen=True), word(8, "f", 5), word(9, "g", 6), word(10, "h", 6, line=1),
        word(11, "i", 7, line=1), word(12, "alone", None, line=1), word(13, "j", 7, line=1), word(14, "nothing", 8, line=1),
    ]
    tokens = [(1, n, k, t) for n, texts in {1: ["ONE"], 2: ["to", "day"], 3: ["ab"], 4: ["cd"], 5: ["ef"], 6: ["gh"], 7: ["ij"], 9: ["none"]}.items() for k, t in reversed(list(enumerate(texts)))]
    got = projected(spark, rows, tokens)
    assert {k[1]: r.mutation for k, r in got.items()} == {
        0: guarded.IN_PLACE, 1: guarded.COMBINED, 3: guarded.SPLIT, 4: guarded.SPLIT, 5: guarded.PROTECTED, 6: guarded.PROTECTED, 7: guarded.REVIEWED, 8: guarded.REVIEWED,
        9: guarded.FRAGMENTS, 10: guarded.FRAGMENTS, 11: guarded.FRAGMENTS, 13: guarded.FRAGMENTS, 12: None, 14: None,
    }
    assert (got[0, 1].word, got[0, 1].truth, got[0, 1].l, got[0, 1].r, got[0, 1].t) == ("today", "today", 10.0, 28.0, 1.0)
    assert got[0, 0].truth == "ONE" and all(got[k].truth is None for k in got if k[1] > 1)
    assert projected(spark, [], []) == {}


@pytest.fixture(scope="module")
def book(spark):
    rows = [(d, p, w, f"{d}-{p}-{w}") for d in range(3) for p in range(4) for w in range(5)]
    return spark.createDataFrame(rows, "book int, page int, word int, text string")


LEVELS = ["book", "page", "word"]


def test_one_changed_word_is_found_from_the_root(spark, book):
    was = guarded.hash_tree(book, LEVELS, ["text"])
    assert [t.columns for t in was] == [[*LEVELS, "hash"], ["book", "page", "hash"], ["book", "hash"]]
    assert guarded.changes(was, guarded.hash_tree(book.repartition(7), LEVELS, ["text"]), LEVELS).collect() == []
    other = book.withColumn("text", F.when((F.col("book") == 1) & (F.col("page") == 2) & (F.col("word") == 3), "x").otherwise(F.col("text")))
    now = guarded.hash_tree(other, LEVELS, ["text"])
    roots = [{r.book: r.hash for r in t[-1].collect()} for t in (was, now)]
    assert [b for b in roots[0] if roots[0][b] != roots[1][b]] == [1]
    assert [tuple(r) for r in guarded.changes(was, now, LEVELS).collect()] == [(1, 2, 3, "changed")]


def test_words_and_books_that_come_and_go(spark, book):
    rows = [r for r in book.collect() if r.book != 0 and (r.book, r.page, r.word) != (1, 0, 0)] + [(9, 0, 0, None), (2, 0, 9, ""), (2, 9, 0, "late")]
    now = spark.createDataFrame(rows, book.schema)
    got = {tuple(r) for r in guarded.changes(guarded.hash_tree(book, LEVELS, ["text"]), guarded.hash_tree(now, LEVELS, ["text"]), LEVELS).collect()}
    assert got == {(0, p, w, "removed") for p in range(4) for w in range(5)} | {(1, 0, 0, "removed"), (9, 0, 0, "added"), (2, 0, 9, "added"), (2, 9, 0, "added")}
    null, empty = (guarded.hash_tree(spark.createDataFrame([(1, 1, 1, t)], book.schema), LEVELS, ["text"]) for t in (None, ""))
    assert [r.change for r in guarded.changes(null, empty, LEVELS).collect()] == ["changed"]


def pages(df):
    words = df.groupBy("book", "page").agg(F.sort_array(F.collect_list(F.struct("word", "text"))).alias("words"))
    return words.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("page", "words"))).alias("lines"))


def test_whole_pages_change_as_trees_do(spark, book):
    gone = book.where("book <> 0 and not (book = 1 and page = 0 and word = 0) and not (book = 1 and page = 3)")
    other = gone.withColumn("text", F.when((F.col("book") == 2) & (F.col("page") == 2) & (F.col("word") == 3), None).otherwise(F.col("text")))
    now = other.union(spark.createDataFrame([(9, 0, 0, None), (2, 0, 9, ""), (2, 9, 0, "late")], book.schema))
    trees = guarded.changes(guarded.hash_tree(book, LEVELS, ["text"]), guarded.hash_tree(now, LEVELS, ["text"]), LEVELS)
    got = guarded.page_changes(pages(book), pages(now), *LEVELS, "text")
    assert got.columns == trees.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, trees.collect()))
    assert guarded.page_changes(pages(book), pages(book.repartition(5)), *LEVELS, "text").collect() == []
    null, empty = (pages(spark.createDataFrame([(1, 1, 1, t)], book.schema)) for t in (None, ""))
    assert [r.change for r in guarded.page_changes(null, empty, *LEVELS, "text").collect()] == ["changed"]


def test_words_are_rows_only_where_lines_differ(spark):
    import __spark_entry__ as e

    plan = e.queries()["changes_by_hash_tree"](spark, e.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange" in x]
    # pages are dealt as texts, the same for both sides; then only words of lines that differ are
    assert plan.count("SortMergeJoin") == 1 and plan.count("Window") == 0 and sum("REPARTITION_BY_NUM" in x for x in moved) == 2 and len(moved) == 3
    assert "isnotnull(filter" not in plan


def test_only_pages_and_lines_that_differ_go_on(spark, book):
    now = book.withColumn("text", F.when((F.col("book") == 1) & (F.col("page") == 2) & (F.col("word") == 3), "x").otherwise(F.col("text")))
    plan = guarded.page_changes(pages(book), pages(now), *LEVELS, "text")
    plan.collect()
    nodes, rows = [plan._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        node = node.finalPhysicalPlan() if "AdaptiveSparkPlan" in node.getClass().getName() else node
        node = node.plan() if "QueryStageExec" in node.getClass().getName() else node
        if "GenerateExec" in node.getClass().getName():
            rows.append(node.metrics().apply("numOutputRows").value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert sorted(rows) == [2, 10]  # the line on both sides, and its words


def test_words_meet_their_truth_once(spark):
    import __spark_entry__ as e

    plan = e.queries()["guarded_projection"](spark, e.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert sum("Join [" in x for x in plan.splitlines()) == 1


def test_many_words_without_a_relation_make_no_list(spark):
    rows = spark.range(60_000).select(F.lit(1).alias("doc"), F.lit(0).alias("line"), F.col("id").alias("pos"), F.lit("w").alias("word"), *[F.lit(1.0).alias(c) for c in "ltrb"], F.when(F.col("id") < 2, 5).cast("long").alias("relation"))
    tokens = spark.createDataFrame([(1, 5, 0, "ww")], "doc int, relation long, k int, text string")
    no = F.lit(False)
    found = guarded.project(rows, tokens, "doc", "line", "relation", no, no, no)
    assert found.count() == 59_999 and [(r.pos, r.word, r.truth, r.mutation) for r in found.where("mutation is not null").collect()] == [(0, "ww", "ww", guarded.COMBINED)]
