"""Edits of the page tree as changes of keys in flat tables: merge, split, regroup, delete, renumber, copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import union_boxes


def merge_words(words: DataFrame, group: list[str]) -> DataFrame:
    """One word per group: texts joined from left to right, boxes united, confidences averaged where known, labels once."""
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("l", "word_no", c))), lambda x: x[c])
    return words.groupBy(*group).agg(F.array_join(ordered("word"), "").alias("word"), *union_boxes(), F.avg("conf").alias("conf"), F.min("word_no").alias("word_no"))


def split_words(words: DataFrame, at: Column) -> DataFrame:
    """Two rows for a word cut after `at` characters (whole words where that is null or outside), boxes cut in proportion,
    confidences dropped; part is 0 or 1."""
    n = F.length("word")
    cut = (at > 0) & (at < n)
    x = F.col("l") + (F.col("r") - F.col("l")) * at / n
    rest = [c for c in words.columns if c not in ("word", "l", "r", "conf")]
    whole = F.struct(F.lit(0).alias("part"), F.col("word"), F.col("l"), F.col("r"), F.col("conf"))
    left = F.struct(F.lit(0).alias("part"), F.substring("word", F.lit(1), at).alias("word"), F.col("l"), x.alias("r"), F.lit(None).cast("double").alias("conf"))
    right = F.struct(F.lit(1).alias("part"), F.substring("word", at + 1, n).alias("word"), x.alias("l"), F.col("r"), F.lit(None).cast("double").alias("conf"))
    return words.select(*rest, F.inline(F.when(F.coalesce(cut, F.lit(False)), F.array(left, right)).otherwise(F.array(whole))))


def renumber(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """name counts from 0 within each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def merge_lines(words: DataFrame, page: str, chosen: Column, line: str = "line_no") -> DataFrame:
    """words with the chosen lines of each page folded into the first of them; words are numbered anew."""
    first = F.min(F.when(chosen, F.col(line))).over(Window.partitionBy(page))
    moved = words.withColumn("_from", F.col(line)).withColumn(line, F.when(chosen, first).otherwise(F.col(line)))
    return renumber(moved, [page, line], ["_from", "word_no"], "word_no").drop("_from")


def split_line(words: DataFrame, page: str, after: Column, line: str = "line_no") -> DataFrame:
    """words with each line cut after a word (`after` is its number, null for none); lines and words are numbered anew."""
    part = F.when(F.col("word_no") > after, 1).otherwise(0)
    cut = words.withColumn("_part", part)
    numbered = cut.withColumn("_line", F.dense_rank().over(Window.partitionBy(page).orderBy(line, "_part")) - 1)
    return renumber(numbered.drop(line).withColumnRenamed("_line", line), [page, line], ["word_no"], "word_no").drop("_part")


def set_truth(words: DataFrame, value: Column, where: Column | None = None) -> DataFrame:
    return words.withColumn("truth", F.when(where, value).otherwise(F.col("truth")) if where is not None else value)


def nudge(df: DataFrame, dl: float = 0, dt: float = 0, dr: float = 0, db: float = 0) -> DataFrame:
    return df.withColumns({"l": F.col("l") - dl, "t": F.col("t") - dt, "r": F.col("r") + dr, "b": F.col("b") + db})


def closest_line(lines: DataFrame, page: str, x: Column, y: Column, line: str = "line_no") -> DataFrame:
    """(page, line) nearest to a point: lines at its height first, then by distance across, then in order."""
    middle_x, middle_y = (F.col("l") + F.col("r")) / 2, (F.col("t") + F.col("b")) / 2
    at_height = y.between(F.col("t"), F.col("b"))
    away = F.when(at_height, F.abs(middle_x - x)).otherwise(F.abs(middle_y - y))
    return lines.groupBy(page).agg(F.min(F.struct((~at_height).alias("a"), away.alias("b"), F.col(line).alias("c"))).alias("_m")).select(page, F.col("_m.c").alias(line))


def baselines(words: DataFrame, line: list[str]) -> DataFrame:
    """(line, slope, intercept) of the straight line through the bottoms of a line's words."""
    x = (F.col("l") + F.col("r")) / 2
    return words.groupBy(*line).agg(F.regr_slope("b", x).alias("slope"), F.regr_intercept("b", x).alias("intercept"))


def corners(width: Column, height: Column) -> Column:
    """The four corners of a box in unit coordinates, clockwise from the top left."""
    return F.array(*[F.array(F.col(a) / width, F.col(b) / height) for a, b in (("l", "t"), ("r", "t"), ("r", "b"), ("l", "b"))])
