"""Dropped words put back where they stood: into the nearest line of their page, at their place in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import interval_gap, union_boxes


def nearest_lines(lines: DataFrame, words: DataFrame, page: str, line: str, key: list[str]) -> DataFrame:
    """(page, key, line) of words (page, key, l, t, r, b): the line least far above or below the word, of those the least far
    aside, of those the first.  Lines at the word's height meet it by the rows of a grid; for words beside none, the
    nearest edges above and below come from running extremes down and up the page.  No word meets all lines.  Words of pages
    without lines have none."""
    tall = lambda df, name: df.groupBy(page).agg(F.max(F.col("b") - F.col("t")).alias(name))
    sizes = tall(lines, "_hl").join(tall(words, "_hw"), page).select(page, F.greatest("_hl", "_hw", F.lit(1e-9)).alias("_h"))
    rows = F.explode(F.sequence(F.floor(F.col("t") / F.col("_h")), F.floor(F.col("b") / F.col("_h")))).alias("_row")
    held = lines.join(sizes, page).select(F.col(page).alias("_page"), F.col(line).alias("_line"), *[F.col(c).alias(f"_{c}") for c in "ltrb"], rows).withColumnRenamed("_row", "_at_row")
    nearest = lambda where: F.min(F.when(where, F.struct(interval_gap(F.col("l"), F.col("r"), F.col("_l"), F.col("_r")).alias("aside"), F.col("_line").alias("line"))))
    beside = (F.col(page) == F.col("_page")) & (F.col("_row") == F.col("_at_row")) & (F.col("_t") <= F.col("b")) & (F.col("_b") >= F.col("t"))
    met = words.join(sizes, page).select(page, *key, *"ltrb", rows).join(held, beside, "left")
    met = met.groupBy(page, *key).agg(nearest(F.col("_line").isNotNull()).alias("_best"), *[F.first(c).alias(c) for c in "ltrb"])
    level = met.where("_best is not null").select(page, *key, F.col("_best")["line"].alias(line))
    rest = met.where("_best is null").select(page, *key, *"ltrb")

    # one pass down and one up, in which lines give their edges and words take the last one
    none = [F.lit(None).cast(rest.schema[c].dataType).alias(c) for c in (*key, *"ltrb")]
    both = lines.select(page, *none, F.col("b").alias("_down"), F.col("t").alias("_up"), F.lit(0).alias("_kind")).unionByName(rest.select(page, *key, *"ltrb", F.col("t").alias("_down"), F.col("b").alias("_up"), F.lit(1).alias("_kind")))
    so_far = lambda *order: Window.partitionBy(page).orderBy(*order, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_lines = lambda c: F.when(F.col("_kind") == 0, F.col(c))
    both = both.withColumn("_above", F.max(of_lines("_down")).over(so_far(F.asc("_down")))).withColumn("_below", F.min(of_lines("_up")).over(so_far(F.desc("_up")))).where("_kind = 1")
    up, down = F.col("_down") - F.col("_above"), F.col("_below") - F.col("_up")
    sides = F.array(*[F.when(away == F.least(up, down), F.struct(F.lit(above).alias("_side"), F.col(edge).alias("_edge"))) for above, edge, away in ((True, "_above", up), (False, "_below", down))])
    near = both.select(page, *key, "l", "r", F.inline(F.filter(sides, lambda x: x.isNotNull())))
    edges = F.inline(F.array(F.struct(F.lit(True).alias("_side"), F.col("b").alias("_edge")), F.struct(F.lit(False).alias("_side"), F.col("t").alias("_edge"))))
    boxes = lines.select(page, F.col(line).alias("_line"), F.col("l").alias("_l"), F.col("r").alias("_r"), edges)
    aside = near.join(boxes, [page, "_side", "_edge"]).groupBy(page, *key).agg(nearest(F.lit(True)).alias("_best"))
    return level.unionByName(aside.select(page, *key, F.col("_best")["line"].alias(line)))


def put_back(kept: DataFrame, dropped: DataFrame, page: str, line: str, key: list[str]) -> DataFrame:
    """(page, line, place, key, word, l, t, r, b, recovered): the kept words and the dropped ones in the lines nearest to
    them, places counted from the left; on a page without any line the dropped words are one line, -1.  No word is lost.
    A line's words are one array, so that kept and dropped ones meet by a join of lines and aren't dealt again."""
    lines = kept.groupBy(page, line).agg(*union_boxes())
    found = nearest_lines(lines, dropped, page, line, key)
    back = dropped.drop(line) if line in dropped.columns and line not in key else dropped
    back = back.join(found, [page, *key], "left").withColumn(line, F.coalesce(line, F.lit(-1)))
    own = [c for c in (*key, "word", "t", "b") if c != line]
    held = lambda df, recovered, name: df.groupBy(page, line).agg(F.collect_list(F.struct("l", "r", *own, F.lit(recovered).alias("recovered"))).alias(name))
    every = held(kept, False, "_kept").join(held(back, True, "_back"), [page, line], "full")
    words = F.sort_array(F.concat(F.coalesce("_kept", F.array()), F.coalesce("_back", F.array())))
    placed = every.select(page, line, F.posexplode(words).alias("place", "_w"))
    return placed.select(page, line, *[F.col(f"_w.{c}").alias(c) for c in (*own[:-3], "word", *"ltrb", "recovered")], "place")
