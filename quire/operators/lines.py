"""Lines of a page before blocks: noise, fragments to rejoin, lines that mix caption and body, words grown into blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import seeded

# Shares of the page's width and ratios of heights.
SPLIT_GAP, NEAR_GAP, NEAR, SPLIT_RATIO, NEAR_RATIO = 0.022, 0.014, 0.06, 1.20, 1.02


def is_weak(text: Column, n_words: Column, longest: Column, height: Column, word_height: Column, protect: bool = True) -> Column:
    """One or two words of three letters at most, two letters or digits in all; a tall single letter may be a drop cap."""
    clean = F.trim(text)
    alphanumeric = F.length(F.regexp_replace(clean, r"[^\p{L}\p{N}]", ""))
    weak = n_words.between(1, 2) & (clean != "") & (alphanumeric <= 2) & (longest <= 3)
    tall = (n_words == 1) & (F.length(clean) <= 2) & clean.rlike(r"\p{L}") & (word_height > 0) & (height >= 1.8 * word_height)
    return weak & ~tall if protect else weak


def is_gibberish(text: Column) -> Column:
    """One token of three to five letters and digits that mixes the two, has no vowel, or is oddly capitalized."""
    clean = F.trim(text)
    token = clean.rlike(r"^[\p{L}\p{N}]{3,5}$")
    letters, digits = clean.rlike(r"\p{L}"), clean.rlike(r"\p{Nd}")
    odd = ~clean.rlike(r"^(?:\p{Lu}+|\p{Ll}+|\p{Lu}\p{Ll}+)$")
    return token & letters & (digits | ~F.lower(clean).rlike("[aeiouy]") | odd)


def is_punctuation(text: Column) -> Column:
    return F.trim(text).rlike(r"^[^\p{L}\p{N}\s]+$")


def noise_clusters(lines: DataFrame, page: str, keys: list[str], weak: Column, height: Column, chain: float = 8.0, least: int = 3) -> DataFrame:
    """lines less the runs of at least `least` weak lines that follow one another within `chain` heights."""
    order = Window.partitionBy(page).orderBy("t", *keys)
    marked = lines.withColumn("_weak", weak).withColumn("_h", height)
    near = F.col("t") - F.lag("b").over(order) <= chain * F.col("_h")
    new = F.when(F.col("_weak") & F.coalesce(F.lag("_weak").over(order), F.lit(False)) & near, 0).otherwise(1)
    run = marked.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    size = F.count("*").over(Window.partitionBy(page, "_run"))
    return run.withColumn("_size", size).where(~(F.col("_weak") & (F.col("_size") >= least))).drop("_weak", "_h", "_new", "_run", "_size")


def split_mixed(words: DataFrame, page: str, line: list[str], width: Column, preferred: Column | None = None) -> DataFrame:
    """(page, line, last_left): lines of four words or more that fall in two at a wide gap where the letters' height changes;
    near a preferred place smaller differences do.  Elsewhere the right part must begin in lower case, or the left part
    end in a hyphen or comma."""
    group = Window.partitionBy(page, *line)
    order = group.orderBy("l", "word_no")
    count = F.count("*").over(group)
    gap = F.greatest(F.lead("l").over(order) - F.col("r"), F.lit(0.0))
    middle = (F.col("r") + F.lead("l").over(order)) / 2
    found = words.withColumn("_n", count).withColumn("_at", F.row_number().over(order)).withColumn("_gap", F.when(F.lead("l").over(order).isNotNull(), gap)).withColumn("_mid", middle).withColumn("_w", width).where("_n >= 4")
    widest = F.max(F.when(F.col("_gap").isNotNull(), F.struct("_gap", (-F.col("_at")).alias("first"), "_at"))).over(group)
    found = found.withColumn("_far", widest)
    if preferred is not None:
        away = F.when(F.col("_gap").isNotNull(), F.struct(F.abs(F.col("_mid") - preferred).alias("away"), "_at", "_gap"))
        found = found.withColumn("_near", F.min(away).over(group))
        near = (F.col("_near.away") <= NEAR * F.col("_w")) & (F.col("_near._gap") >= NEAR_GAP * F.col("_w"))
    else:
        found, near = found.withColumn("_near", F.lit(None).cast("struct<away:double,_at:int,_gap:double>")), F.lit(False)
    found = found.withColumn("_close", F.coalesce(near, F.lit(False)))
    cut = F.when(F.col("_close"), F.col("_near._at")).when(F.col("_far._gap") >= SPLIT_GAP * F.col("_w"), F.col("_far._at"))
    found = found.withColumn("_cut", cut).where(F.col("_cut").isNotNull())
    left, height = F.col("_at") <= F.col("_cut"), F.col("b") - F.col("t")
    sides = found.groupBy(page, *line).agg(
        F.max("_cut").alias("cut"), F.max("_n").alias("n"), F.max("_close").alias("close"), F.avg(F.when(left, height)).alias("hl"), F.avg(F.when(~left, height)).alias("hr"),
        F.max(F.when(left, F.col("r"))).alias("edge"), F.min(F.when(~left, F.col("l"))).alias("next"), F.max(F.when(F.col("_at") == F.col("_cut"), F.col("word_no"))).alias("last_left"),
        F.max(F.when(F.col("_at") == F.col("_cut"), F.col("word"))).alias("end"), F.max(F.when(F.col("_at") == F.col("_cut") + 1, F.col("word"))).alias("start"),
    )
    ratio = F.greatest("hl", "hr") / F.least("hl", "hr")
    runs_on = F.col("start").rlike(r"^\p{Ll}") | F.col("end").rlike("[-,]$")
    ok = (F.col("cut") >= 2) & (F.col("n") - F.col("cut") >= 2) & (F.least("hl", "hr") > 0) & (F.col("edge") <= F.col("next"))
    ok = ok & F.when(F.col("close"), ratio >= NEAR_RATIO).otherwise((ratio >= SPLIT_RATIO) & runs_on)
    return sides.where(ok).select(page, *line, "last_left")


def rejoin(lines: DataFrame, page: str, line: str = "line_no") -> DataFrame:
    """(page, line, joined): the line that each one joins, itself if none.  A line joins the one before if they share most of
    their height, hardly any width, are close, and of like letters; what has grown is held against the next.  A page's
    boxes are one row, and many rows one batch."""

    @F.pandas_udf("array<int>")
    def heads(numbers: pd.Series, *sides: pd.Series) -> pd.Series:
        return pd.Series([_heads(n.tolist(), *(x.tolist() for x in box)) for n, *box in zip(numbers, *sides, strict=True)])

    boxes = F.sort_array(F.collect_list(F.struct(F.col(line).cast("int").alias("line"), *[F.col(c).cast("double").alias(c) for c in "ltrb"])))
    found = lines.groupBy(page).agg(boxes.alias("_x")).withColumn("_head", heads(*[f"_x.{c}" for c in ("line", *"ltrb")]))
    return found.select(page, F.inline(F.arrays_zip(F.col("_x.line").alias(line), F.col("_head").alias("joined"))))


def _heads(numbers: list[int], left: list[float], up: list[float], right: list[float], down: list[float]) -> list[int]:
    limit = 0.10 * float(np.median([b - a for a, b in zip(left, right, strict=True)]))
    out, head, grown = [], 0, None
    for n, *box in zip(numbers, left, up, right, down, strict=True):
        if grown is not None and _joins(grown, box, limit):
            grown = [min(grown[0], box[0]), min(grown[1], box[1]), max(grown[2], box[2]), max(grown[3], box[3])]
        else:
            head, grown = n, box
        out.append(head)
    return out


def _joins(a: list[float], b: list[float], limit: float) -> bool:
    # fixed values: shares of height and width that fragments may and may not share (0.2, 0.1, 0.5)
    ha, hb = a[3] - a[1], b[3] - b[1]
    shared_y, shared_x = min(a[3], b[3]) - max(a[1], b[1]), min(a[2], b[2]) - max(a[0], b[0])
    if max(0, shared_y) < 0.2 * (ha + hb) or max(0, shared_x) > 0.1 * (a[2] - a[0]) or abs(ha - hb) > 0.5 * ha:
        return False
    first, second = (a, b) if a[0] <= b[0] else (b, a)
    return max(second[0] - first[2], 0) < limit


def _blocks_of_pages(words: DataFrame, page: str, keys: list[str], reach_x: float, reach_y: float) -> DataFrame:
    """(page, _words, _blocks): a page's words in order, and the block of each."""
    found = words.groupBy(page).agg(F.sort_array(F.collect_list(F.struct(*keys, *[F.col(c).cast("double").alias(c) for c in "ltrb"]))).alias("_words"))

    @F.pandas_udf("array<int>")
    def blocks(*box: pd.Series) -> pd.Series:
        joined = lambda given: seeded.joined_words([np.asarray(x, np.float64) for x in given], np.zeros(len(given[0]), bool), reach_x, reach_y)
        # runs are numbered in order of the words, so the least run of a block has its first word
        return pd.Series([np.unique(joined(given), return_inverse=True)[1].astype(np.int32) for given in zip(*box, strict=True)])

    return found.select(page, "_words", blocks(*[f"_words.{c}" for c in "ltrb"]).alias("_blocks"))


def grown_blocks(words: DataFrame, page: str, keys: list[str], reach_x: float, reach_y: float) -> DataFrame:
    """(page, keys, block): words whose boxes come within reach of one another are of one block, transitively; blocks count
    from 0 in order of their first word.  A page's words are one row."""
    found = _blocks_of_pages(words, page, keys, reach_x, reach_y)
    return found.select(page, F.inline(F.arrays_zip(*[F.col(f"_words.{c}") for c in keys], F.col("_blocks").alias("block"))))


def grown_sizes(words: DataFrame, page: str, keys: list[str], reach_x: float, reach_y: float) -> DataFrame:
    """(page, block, n_words, keys of the first word) of grown_blocks(), without a row for each word."""

    @F.pandas_udf("block array<int>, n_words array<bigint>, first array<int>")
    def sizes(blocks: pd.Series) -> pd.DataFrame:
        out = [np.unique(x, return_index=True, return_counts=True) for x in blocks]
        return pd.DataFrame({"block": [x.astype(np.int32) for x, _, _ in out], "n_words": [n for _, _, n in out], "first": [at.astype(np.int32) for _, at, _ in out]})

    found = _blocks_of_pages(words, page, keys, reach_x, reach_y).withColumn("_s", sizes("_blocks"))
    found = found.select(page, "_words", F.inline(F.arrays_zip("_s.block", "_s.n_words", "_s.first")))
    return found.select(page, "block", "n_words", *[F.get(f"_words.{c}", F.col("first")).alias(c) for c in keys])


def floated(lines: DataFrame, page: str, keys: list[str], width: Column) -> DataFrame:
    """lines with flow: of pages with eight lines or more, those in two clusters of narrow lines far enough apart are 'left'
    and 'right', lines above and below the right cluster's band 'pre' and 'post', the rest 'body'."""
    # fixed values: what is narrow for the page, steps and spreads of clusters, and how far apart they are (0.86, 0.12, 0.09, 0.14)
    whole = Window.partitionBy(page)
    wide = F.col("r") - F.col("l")
    found = lines.withColumn("_n", F.count("*").over(whole)).withColumn("_narrow", wide <= 0.86 * F.median(wide).over(whole)).withColumn("_w", width)
    inside = Window.partitionBy(page, "_narrow")
    order = inside.orderBy("l", *keys)
    step = F.when(F.col("l") - F.lag("l").over(order) > 0.12 * F.col("_w"), 1).otherwise(0)
    found = found.withColumn("_step", step).withColumn("_cluster", F.sum("_step").over(order)).withColumn("_narrows", F.count_if("_narrow").over(whole))
    cluster = Window.partitionBy(page, "_narrow", "_cluster")
    good = F.col("_narrow") & (F.count("*").over(cluster) >= 3) & (F.stddev_pop("l").over(cluster) <= 0.09 * F.col("_w")) & (F.col("_narrows") >= 6) & (F.col("_n") >= 8)
    found = found.withColumn("_good", good).withColumn("_at", F.avg("l").over(cluster))
    first = F.min(F.when(F.col("_good"), F.col("_at"))).over(whole)
    found = found.withColumn("_first", first)
    second = F.min(F.when(F.col("_good") & (F.col("_at") > F.col("_first")), F.col("_at"))).over(whole)
    found = found.withColumn("_second", F.when(second - F.col("_first") >= 0.14 * F.col("_w"), second))
    right = F.col("_good") & (F.col("_at") == F.col("_second"))
    top, bottom = F.min(F.when(right, F.col("t"))).over(whole), F.max(F.when(right, F.col("b"))).over(whole)
    flow = (
        F.when(F.col("_second").isNull(), "body").when(right, "right").when(F.col("b") <= top, "pre").when(F.col("t") >= bottom, "post")
        .when(F.col("_good") & (F.col("_at") == F.col("_first")), "left").otherwise("body")
    )
    return found.withColumn("flow", flow).select(*lines.columns, "flow")
