"""Registration of queries, and the tables of pages that they derive from the driver's tables in both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.functions.geometry import union_boxes
from quire.work import by_page

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: Session settings, which change plans and never results: joins may be on more keys than their sides are dealt by; unions
#: count as not dealt (else Spark 4.1 zips a union of dealt frames, whose partitions add up, with a dealt one, and fails).
DEALT = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.unionOutputPartitioning": "false"}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Text with markup in it, made the same way in both engines: (what, by what).
SEEDS = [(", ", " -- "), (" an", " [=a]n"), (" the ", " [*note] [12] "), (" in", ' "in'), (" de ", " ---- [`a] ")]


def seeded(c):
    for a, b in SEEDS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit(" *"), c, F.lit("* "))


def seeded_sql(c: str = "text") -> str:
    for a, b in SEEDS:
        c = f"replace({c}, '{a}', '{b}')"
    return f"concat(' *', {c}, '* ')"


def documents(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """(doc_id, text), dealt by doc_id."""
    for name, value in DEALT.items():
        spark.conf.set(name, value)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return by_page(docs, "doc_id") if dealt else docs


def lines(spark: SparkSession, sf_dir: str, page: Column | None = None) -> DataFrame:
    """(doc_id, line_no, line), and page if that is given.  Documents are dealt by their id while they are whole, or lines by
    their page: what is done by page with lines and words then finds them in place, where a shuffle of words, with their
    keys and boxes, moves many times the text.  Joins on a page and more keys use that deal too."""
    docs = documents(spark, sf_dir, dealt=page is None)
    found = docs.select("doc_id", F.posexplode(text.split_lines(F.col("text"))).alias("line_no", "line"))
    return found if page is None else by_page(found.withColumn("page", page), "page")


def words(spark: SparkSession, sf_dir: str, page: Column | None = None) -> DataFrame:
    """(doc_id, line_no, word_no, word), behind page if that is given"""
    return lines(spark, sf_dir, page).select(*["page"] * (page is not None), "doc_id", "line_no", F.posexplode(text.split_words(F.col("line"))).alias("word_no", "word"))


def word_boxes(spark: SparkSession, sf_dir: str, page: Column | None = None) -> DataFrame:
    """Words set in rows of twelve; a paragraph for each line of text, every other one indented."""
    return boxed(words(spark, sf_dir, page), *["page"] * (page is not None))


def boxed(found: DataFrame, *first: str) -> DataFrame:
    """word_boxes() of words, behind the first columns."""
    row = F.floor(F.col("word_no") / 12).cast("int")
    size = F.length("word")
    left = 60 * (F.col("word_no") % 12) + F.when((row == 0) & (F.col("line_no") % 2 == 0), 20).otherwise(0)
    top = 400 * F.col("line_no") + 20 * row
    return found.select(
        *first, "doc_id", "line_no", row.alias("row"), "word_no", "word",
        left.cast("double").alias("l"), top.cast("double").alias("t"),
        (left + 6 * F.least(size, F.lit(9))).cast("double").alias("r"), (top + 12 + size % 4).cast("double").alias("b"),
        F.when(size % 11 != 0, (size * 7 % 100) / 100).alias("conf"),
    )


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of word_boxes() as lines: their boxes, numbers of words and texts."""
    found = word_boxes(spark, sf_dir).groupBy("doc_id", "line_no", "row").agg(*union_boxes(), F.count("*").alias("n_words"), F.sort_array(F.collect_list(F.struct("word_no", "word"))).alias("_w"))
    return found.withColumn("text", F.array_join(F.transform("_w", lambda x: x["word"]), " ")).drop("_w")


#: Regions of a page, by its id: type, left, top, right, bottom (each a number and a factor and modulus of the id).
REGIONS = [
    ("header", 0, 0, 720, 40, 0.9), ("figure", 100, 100, 400, 300, 0.8), ("caption", 120, 310, 380, 340, 0.7),
    ("text", 90, 330, 420, 700, 0.6), ("text", 440, 100, 700, 900, 0.9), ("sidenote", 600, 500, 700, 560, 0.4), ("figure", 100, 400, 380, 480, 0.55),
]


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, type, l, t, r, b, confidence); moved down by 7 * (doc_id mod 13) but for headers."""
    fixed = [F.struct(F.lit(i).alias("pos"), F.lit(x[0]).alias("type"), *[F.lit(float(v)).alias(c) for c, v in zip("ltrb", x[1:5], strict=True)], F.lit(x[5]).alias("confidence")) for i, x in enumerate(REGIONS)]
    down = F.when(F.col("type") == "header", 0.0).otherwise(7.0 * F.pmod("doc_id", F.lit(13)))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(*fixed))).select("doc_id", "pos", "type", "l", (F.col("t") + down).alias("t"), "r", (F.col("b") + down).alias("b"), "confidence")


LINES_SQL = "lines AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INT) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"
WORDS_SQL = LINES_SQL + ", words AS (SELECT doc_id, line_no, CAST(unnest(range(len(ws))) AS INT) AS word_no, unnest(ws) AS word FROM (SELECT doc_id, line_no, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') AS ws FROM lines))"
BOXES_SQL = (
    WORDS_SQL
    + """, boxes AS (SELECT doc_id, line_no, w_row AS row, word_no, word, x AS l, y AS t, x + 6 * least(length(word), 9) AS r, y + 12 + length(word) % 4 AS b,
 CASE WHEN length(word) % 11 <> 0 THEN CAST(length(word) * 7 % 100 AS DOUBLE) / 100 END AS conf
 FROM (SELECT *, CAST(60 * (word_no % 12) + CASE WHEN word_no < 12 AND line_no % 2 = 0 THEN 20 ELSE 0 END AS DOUBLE) AS x, CAST(400 * line_no + 20 * (word_no // 12) AS DOUBLE) AS y, CAST(word_no // 12 AS INT) AS w_row FROM words))"""
)
LINE_BOXES_SQL = BOXES_SQL + ", line_boxes AS (SELECT doc_id, line_no, row, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, count(*) AS n_words, string_agg(word, ' ' ORDER BY word_no) AS text FROM boxes GROUP BY ALL)"
REGIONS_SQL = (
    "regions AS (SELECT doc_id, pos, type, l, t + down AS t, r, b + down AS b, confidence FROM (SELECT doc_id, pos, type, l, t, r, b, confidence, CASE WHEN type = 'header' THEN 0.0 ELSE 7.0 * (doc_id % 13) END AS down FROM documents, (VALUES "
    + ", ".join(f"({i}, '{x[0]}', {', '.join(f'CAST({v} AS DOUBLE)' for v in x[1:])})" for i, x in enumerate(REGIONS))
    + ") AS fixed(pos, type, l, t, r, b, confidence)))"
)
