"""Sinks: nested documents, training sets, schemas."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested_pages(words: DataFrame, page: list[str], line: list[str]) -> DataFrame:
    """One row per page with its lines and their words as nested arrays in order."""
    item = F.struct("word_no", "word", "l", "t", "r", "b", "conf")
    lines = words.groupBy(*page, *line).agg(F.sort_array(F.collect_list(item)).alias("words"))
    return lines.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct(*line, "words"))).alias("lines"))


def write_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("errorifexists").json(path)


def detection_labels(words: DataFrame, image: str, chosen: Column | None = None) -> DataFrame:
    """(image, polygons): the corners of each chosen word, for a detector's training set."""
    corners = F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("l", "t"), ("r", "t"), ("r", "b"), ("l", "b"))])
    kept = words.where(chosen) if chosen is not None else words
    return kept.groupBy(image).agg(F.transform(F.sort_array(F.collect_list(F.struct("word_no", corners.alias("polygon")))), lambda x: x["polygon"]).alias("polygons"))


def recognition_labels(words: DataFrame, image: str, truth: str = "truth") -> DataFrame:
    """(image, crop, box, label) of each word that has a reference text."""
    return words.where(F.coalesce(F.col(truth), F.lit("")) != "").select(image, F.concat_ws("_", image, "line_no", "word_no").alias("crop"), F.array("l", "t", "r", "b").alias("box"), F.col(truth).alias("label"))


def schema_manifest(frames: dict[str, DataFrame]) -> dict[str, str]:
    """Name -> SHA-256 of the frame's schema as canonical JSON."""
    return {name: hashlib.sha256(json.dumps(json.loads(df.schema.json()), sort_keys=True, separators=(",", ":")).encode()).hexdigest() for name, df in sorted(frames.items())}
