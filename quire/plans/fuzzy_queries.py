"""Queries on alike texts by their index: displaced lines, combined words, variants of lines; held against all pairs in tests."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import fuzzy

from .base import lines, query, words


@query()
def truth_displaced_lines(spark, d):
    """Lines of a document against the same from last to first, one in two with letters changed."""
    found = lines(spark, d).withColumnRenamed("line", "text")
    changed = F.when(F.col("line_no") % 2 == 0, F.translate("text", "qzj,", "gsi.")).otherwise(F.concat(F.col("text"), F.lit(" x")))
    last = F.max("line_no").over(Window.partitionBy("doc_id"))
    return fuzzy.displaced_lines(found, found.select("doc_id", (last - F.col("line_no")).alias("line_no"), changed.alias("text")), "doc_id")


@query()
def truth_combined_words(spark, d):
    """Words of each line, one in nine cut in two, against the words themselves."""
    whole = words(spark, d, F.concat_ws(":", "doc_id", "line_no")).select("page", "word_no", "word")
    cut = F.when((F.col("word_no") % 9 == 4) & (F.length("word") > 3), F.array(F.substring("word", 1, 2), F.expr("substring(word, 3)"))).otherwise(F.array("word"))
    parts = whole.select("page", "word_no", F.posexplode(cut).alias("part", "word"))
    numbered = parts.select("page", (F.row_number().over(Window.partitionBy("page").orderBy("word_no", "part")) - 1).alias("word_no"), "word")
    return fuzzy.words_combined(numbered, whole.select("page", "word_no", "word"), "page")


@query()
def truth_line_variants(spark, d):
    """Lines that begin with the end of the line before and lack their own last two letters, read with their reference."""
    before = F.lag("line", 1, "").over(Window.partitionBy("doc_id").orderBy("line_no"))
    found = lines(spark, d).withColumn("previous", before)
    cut = F.when(F.col("line_no") % 2 == 1, F.concat(F.expr("right(previous, 3)"), "line")).otherwise(F.expr("left(line, greatest(length(line) - 2, 0))"))
    return found.select("doc_id", "line_no", fuzzy.variant_of(cut, F.col("previous"), F.col("line")).alias("v")).select("doc_id", "line_no", "v.score", "v.variant")
