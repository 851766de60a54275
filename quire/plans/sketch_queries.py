"""The query on sketches of pages that are rolled up to books, held against exact values."""

from pyspark.sql import functions as F

from quire.operators import sketches

from .base import WORDS_SQL, query, words

RANKS = [0.25, 0.5, 0.9]


# Exact counts, and whether the estimates are within the stated errors of them: all have to be.
@query(f"WITH {WORDS_SQL} SELECT doc_id % 10 AS book, count(DISTINCT word) AS n_distinct, count(*) AS n_words, true AS counts_hold, true AS quantiles_hold FROM words GROUP BY 1")
def sketches_of_books(spark, d):
    found = words(spark, d).withColumns({"book": F.col("doc_id") % 10, "size": F.length("word")})
    pages = sketches.sketches(found, ["book", "doc_id"], "word", F.col("size"))
    told = sketches.estimates(sketches.rolled_up(pages, ["book"]), ["book"], RANKS).withColumnRenamed("n_distinct", "told")
    exact = found.groupBy("book").agg(F.count_distinct("word").alias("n_distinct"), F.count("*").alias("n_words"))
    counts = told.join(exact, "book")
    # the words below a quantile, and up to it, enclose its rank
    ranks = counts.select("book", "quantiles", "n_words").join(found.groupBy("book", "size").agg(F.count("*").alias("n")), "book")
    share = lambda k, at: F.sum(F.when(F.col("size") < at if k else F.col("size") <= at, F.col("n")).otherwise(0)) / F.first("n_words")
    holds = [(share(1, F.col("quantiles")[i]) <= r + sketches.RANK_ERROR) & (share(0, F.col("quantiles")[i]) >= r - sketches.RANK_ERROR) for i, r in enumerate(RANKS)]
    within = ranks.groupBy("book").agg((holds[0] & holds[1] & holds[2]).alias("quantiles_hold"))
    close = (F.abs(F.col("told") - F.col("n_distinct")) <= sketches.COUNT_ERROR * F.col("n_distinct")) & (F.col("n_values") == F.col("n_words"))
    return counts.join(within, "book").select("book", "n_distinct", "n_words", close.alias("counts_hold"), "quantiles_hold")
