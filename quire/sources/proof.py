"""Proof exports: one JSON object per file, page name -> text; whole, or page by page with byte offsets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STRING = re.compile(rb'"(?:[^"\\]|\\.)*"', re.DOTALL)
PAIR = re.compile(rb'("(?:[^"\\]|\\.)*")\s*:\s*("(?:[^"\\]|\\.)*")', re.DOTALL)
UNIT = re.compile(rb"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|[\x00-\x7f]|[\xc0-\xdf].|[\xe0-\xef]..|[\xf0-\xf7]...", re.DOTALL)


def project(path: Column) -> Column:
    """The name of the file without its suffix."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def pages_of_json(text: Column) -> Column:
    """Entries of a JSON object of strings in document order: array<struct<key,value>>."""
    return F.map_entries(F.from_json(text, "map<string,string>"))


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """(project, pos, page, text) of every file under a path."""
    files = spark.read.text(path, wholetext=True).select(project(F.input_file_name()).alias("project"), "value")
    return files.select("project", F.posexplode(pages_of_json(F.col("value"))).alias("pos", "entry")).select("project", "pos", F.col("entry.key").alias("page"), F.col("entry.value").alias("text"))


def lexical_index(raw: bytes) -> list[tuple[str, int, int]]:
    """(page, begin, end) in bytes of each page's text in a JSON object, quotes aside; no text is decoded."""
    import json

    return [(json.loads(m[1]), m.start(2) + 1, m.end(2) - 1) for m in PAIR.finditer(raw)]


def characters(raw: bytes, begin: int, end: int) -> list[tuple[str, int, int]]:
    """(character, begin, end) of a JSON string's body, each with its bytes: escapes and surrogate pairs are one."""
    import json

    return [(json.loads(b'"' + m[0] + b'"'), m.start(), m.end()) for m in UNIT.finditer(raw, begin, end)]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, page, byte_start, byte_end) over binary files; filter pages before decoding them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, hashlib.sha256(c).hexdigest(), k, a, b) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for k, a, b in lexical_index(c)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], names=["path", "sha256", "page", "byte_start", "byte_end"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, sha256 string, page string, byte_start bigint, byte_end bigint")


def read_pages(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """(path, page, text, slices) of the indexed pages: each character with the bytes that it came from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("char", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [characters(c, a, b) for c, a, b in zip(*(batch.column(n).to_pylist() for n in ("content", "byte_start", "byte_end")), strict=True)]
            texts = ["".join(c for c, _, _ in x) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("page"), pa.array(texts, pa.string()), pa.array([[{"char": c, "start": a, "end": b} for c, a, b in x] for x in found], kind)], names=["path", "page", "text", "slices"])

    content = spark.read.format("binaryFile").load(path).select("path", "content")
    return index.join(content, "path").select("path", "page", "content", "byte_start", "byte_end").mapInArrow(run, "path string, page string, text string, slices array<struct<char:string,start:bigint,end:bigint>>")
