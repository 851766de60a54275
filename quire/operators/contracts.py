"""Integrity of labelled data as queries that return what breaks a rule; an empty result is a valid table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of child whose reference (child column -> parent column) no row of parent has."""
    keys = parent.select(*[F.col(p).alias(f"_{c}") for c, p in on.items()]).distinct()
    return child.join(keys, [F.col(c) == F.col(f"_{c}") for c in on], "left_anti")


def not_dense(df: DataFrame, group: list[str], index: str, first: int = 0) -> DataFrame:
    """Groups whose index isn't first, first + 1, ... without gaps or repeats."""
    found = df.groupBy(*group).agg(F.count("*").alias("n"), F.count_distinct(index).alias("n_distinct"), F.min(index).alias("low"), F.max(index).alias("high"))
    return found.where((F.col("n") != F.col("n_distinct")) | (F.col("low") != first) | (F.col("high") != F.col("n") + first - 1))


def mixed(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Groups with more than one value where one is asked for."""
    return df.groupBy(*group).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def wrong_hash(df: DataFrame, content: str, claimed: str) -> DataFrame:
    return df.where(~F.coalesce(F.sha2(F.col(content), 256) == F.col(claimed), F.lit(False)))


def bad_spans(spans: DataFrame, length: str) -> DataFrame:
    """Spans outside their text, or empty."""
    return spans.where((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.col(length)))


def whole_labels(spans: DataFrame, word: list[str], length: str) -> DataFrame:
    """(word, label) of labels whose spans cover the whole word without a gap."""
    order = Window.partitionBy(*word, "label").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_gap", F.col("start") > F.coalesce(reach, F.lit(0)))
    found = marked.groupBy(*word, "label").agg(F.max("end").alias("_end"), F.max(length).alias("_n"), F.count_if("_gap").alias("_gaps"))
    return found.where("_gaps = 0 and _end >= _n").select(*word, "label")


def labels_at(spans: DataFrame, points: DataFrame, page: str) -> DataFrame:
    """(page, at, labels) of the spans around each point."""
    hit = (F.col("start") <= F.col("at")) & (F.col("at") < F.col("end"))
    return points.join(spans, page).where(hit).groupBy(page, "at").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def coverage_errors(relations: DataFrame, tokens: DataFrame, doc: str, first: str = "s0", last: str = "s1") -> DataFrame:
    """(doc, used, n) of documents whose relations don't use each token once."""
    used = relations.groupBy(doc).agg(F.sum(F.col(last) - F.col(first)).alias("used"), F.max(last).alias("reach"))
    return tokens.groupBy(doc).agg(F.count("*").alias("n")).join(used, doc, "left").where((F.coalesce("used", F.lit(0)) != F.col("n")) | (F.coalesce("reach", F.lit(0)) != F.col("n"))).select(doc, "used", "n")


def verdict(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, n_broken) of all rules in one frame."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_broken")).select(F.lit(name).alias("rule"), "n_broken") for name, df in rules.items()])


def decided(decision: Column, replacement: Column, digest: Column) -> Column:
    """Whether an accepted decision has its replacement and hash, and a rejected one neither."""
    return F.when(decision == "accepted", replacement.isNotNull() & digest.isNotNull()).otherwise(replacement.isNull() & digest.isNull())


def unknown_values(df: DataFrame, column: str, known: DataFrame, value: str) -> DataFrame:
    """Rows whose value is not in a vendored list (licenses, tags, taxonomies)."""
    return df.join(known.select(F.col(value).alias("_known")).distinct(), F.col(column) == F.col("_known"), "left_anti")


def with_blobs(df: DataFrame, digest: str, blobs: DataFrame, content: str = "content") -> DataFrame:
    """df with the content whose SHA-256 it names, null where there is none; the join is pruned where content isn't read."""
    found = blobs.select(F.sha2(F.col(content), 256).alias(digest), F.col(content)).dropDuplicates([digest])
    return df.join(found, digest, "left")


def glyphs_fit(text: Column, ligatures: Column, long_s: Column) -> Column:
    """Whether ligature spans (start, end) lie inside the text and the long-s positions hold an s; null lists are not
    reviewed and fit."""
    n = F.length(text)
    inside = F.forall(ligatures, lambda x: (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= n))
    on_s = F.forall(long_s, lambda p: (p >= 0) & (p < n) & F.substring(text, p + 1, F.lit(1)).isin("s", "ſ"))
    return F.coalesce(inside, F.lit(True)) & F.coalesce(on_s, F.lit(True))
