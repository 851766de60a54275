"""Words that run on across lines and pages, marked by stars in two proofing rounds.

Tokens are (doc, round, token_index, page_id, page_index, line_id, line_index, text); edges come from lead and lag over a
document's tokens.  Page numbers, where both are known, must follow one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What tells where an edge's two fragments stand.
LOCUS = ("page_id", "line_id")


def page_number(page_id: Column) -> Column:
    """The last run of digits of a page id, or null."""
    return F.nullif(F.regexp_extract(page_id, r"(\d+)\D*$", 1), F.lit("")).cast("bigint")


def boundary(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """'same_line', 'line' or 'page' from one token to another, or null if they aren't neighbours."""
    follows = F.coalesce(page_number(right["page_id"]) == page_number(left["page_id"]) + 1, F.lit(True))
    return (
        F.when((left["page_id"] == right["page_id"]) & (left["line_id"] == right["line_id"]), "same_line")
        .when((left["page_id"] == right["page_id"]) & (right["line_index"] == left["line_index"] + 1), "line")
        .when((left["page_id"] != right["page_id"]) & (right["page_index"] == left["page_index"] + 1) & follows, "page")
    )


def candidates(left: Column, right: Column) -> Column:
    """The texts that two fragments may stand for: three after a single hyphen, else one."""
    hyphen = left.rlike(r"(?<!-)-$")
    bare = F.regexp_replace(left, "-$", "")
    return F.when(hyphen, F.array(F.concat(bare, right), F.concat(left, right), F.concat_ws(" ", left, right))).otherwise(F.array(F.concat(left, right)))


def decision(left: Column) -> Column:
    return F.when(left.rlike(r"(?<!-)-$"), "ambiguous").otherwise("preserve_punctuation")


def _judged(tokens: DataFrame, doc: str, keys: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """tokens with the place, marker, fragments, boundary and reason of those that have a marker (else without a place), and where the fragments
    stand; one pass over a document's tokens."""
    order = Window.partitionBy(doc, *keys).orderBy("token_index")
    ids = ("page_id", "page_index", "line_id", "line_index", "text", "token_index")
    near = tokens.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in ids], *[F.lag(c).over(order).alias(f"last_{c}") for c in ids])
    text, after, before = F.col("text"), F.col("next_text"), F.col("last_text")
    inside, trailing = text.rlike(r"^[^*]+\*[^*]+$"), text.rlike(r"^[^*].*\*$")
    leading = text.rlike(r"^\*[^*]") & ~F.coalesce(before.endswith("*"), F.lit(False))
    lone = text == "*"
    place = F.when(inside, "inside").when(trailing | lone, "trailing").when(leading, "leading")
    star = F.instr(text, "*")
    left = F.when(inside, F.substring_index(text, "*", 1)).when(trailing, F.expr("substring(text, 1, length(text) - 1)")).when(leading, before)
    right = F.when(inside, F.substring_index(text, "*", -1)).when(trailing, F.regexp_replace(after, r"^\*", "")).when(leading, F.expr("substring(text, 2)"))
    own, coming, gone = ({c: F.col(f"{p}{c}") for c in ids} for p in ("", "next_", "last_"))
    link = F.when(inside, "same_line").when(trailing, boundary(own, coming)).when(leading, boundary(gone, own))
    marked = near.withColumn("place", place).withColumn("marker", star)
    marked = marked.withColumn("left", left).withColumn("right", right).withColumn("boundary", link)
    reason = (
        F.when(lone, "empty_fragment")
        .when((F.col("place") == "trailing") & after.isNull(), "orphan_trailing_marker")
        .when((F.col("place") == "leading") & before.isNull(), "orphan_leading_marker")
        .when(F.col("boundary").isNull(), "nonadjacent_markers")
        .when((F.col("right") == "") | (F.col("left") == ""), "empty_fragment")
    )
    is_place = lambda name: F.col("place") == name
    locus = [F.when(is_place("leading"), gone[c]).otherwise(own[c]).alias(f"left_{c}") for c in LOCUS] + [F.when(is_place("trailing"), coming[c]).otherwise(own[c]).alias(f"right_{c}") for c in LOCUS]
    return marked.withColumn("reason", F.when(F.col("place").isNotNull(), reason)), locus


def edges(tokens: DataFrame, doc: str, keys: tuple[str, ...] = ("round",)) -> DataFrame:
    """A row per marker: its place ('inside', 'trailing', 'leading'), the two fragments, their boundary, the candidate texts
    and decision; reason says why a marker gives no edge.  A leading marker after a trailing one belongs to that."""
    judged, locus = _judged(tokens, doc, keys)
    found, ok = judged.where(F.col("place").isNotNull()), F.col("reason").isNull()
    return found.select(doc, *keys, "token_index", "place", "marker", F.when(ok, F.col("left")).alias("left"), F.when(ok, F.col("right")).alias("right"), F.when(ok, F.col("boundary")).alias("boundary"), F.when(ok, candidates(F.col("left"), F.col("right"))).alias("candidates"), F.when(ok, decision(F.col("left"))).alias("decision"), "reason", *locus)


def ordinals(found: DataFrame, doc: str, keys: tuple[str, ...] = ("round",)) -> DataFrame:
    """Edges with ordinal, their number from 0 among those between the same two lines over the same kind of boundary."""
    between = Window.partitionBy(doc, *keys, "boundary", *[f"{side}_{c}" for side in ("left", "right") for c in LOCUS])
    return found.where("reason is null").withColumn("ordinal", F.row_number().over(between.orderBy("token_index")) - 1)


def reconcile(first: DataFrame, second: DataFrame, anchor: list[str]) -> DataFrame:
    """Edges of two rounds by anchor: 'agreed', 'conflict', 'first_only' or 'second_only'."""
    side = lambda df, name: df.where("reason is null").select(*anchor, F.col("left").alias(f"{name}_left"), F.col("right").alias(f"{name}_right"))
    both = side(first, "first").join(side(second, "second"), anchor, "full_outer")
    status = (
        F.when(F.col("second_left").isNull(), "first_only").when(F.col("first_left").isNull(), "second_only")
        .when((F.col("first_left") == F.col("second_left")) & (F.col("first_right") == F.col("second_right")), "agreed").otherwise("conflict")
    )
    return both.withColumn("status", status)


def surface(tokens: DataFrame, found: DataFrame, doc: str, keys: tuple[str, ...] = ("round",)) -> DataFrame:
    """tokens without the stars that gave an edge."""
    proven = found.where("reason is null").select(doc, *keys, "token_index", F.lit(True).alias("_proven"))
    joined = tokens.join(proven, [doc, *keys, "token_index"], "left")
    return joined.withColumn("text", F.when(F.col("_proven"), F.regexp_replace("text", r"\*", "")).otherwise(F.col("text"))).drop("_proven")


def surfaced(tokens: DataFrame, doc: str, keys: tuple[str, ...] = ("round",), into: str = "clean") -> DataFrame:
    """tokens and `into`, their text as surface() gives it by the tokens' own edges; no token is joined to another."""
    judged, _ = _judged(tokens, doc, keys)
    proven = F.col("place").isNotNull() & F.col("reason").isNull()
    return judged.select(*tokens.columns, F.when(proven, F.regexp_replace("text", r"\*", "")).otherwise(F.col("text")).alias(into))
