"""Recognized pages: nested document JSON of fixed depth, the flat level-coded table, layout JSON, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.images import sniff

POINT = "struct<x:double,y:double,is_normalized:boolean>"
BOX = f"struct<top_left:{POINT},bottom_right:{POINT},is_normalized:boolean>"
WORD = f"struct<type:string,text:string,bounding_box:{BOX},ocr_confidence:double,word_labels:array<string>,text_style_labels:array<string>,ground_truth_text:string>"
BLOCK = "struct<type:string,child_type:string,block_category:string,block_role_labels:array<string>,override_page_sort_order:int,bounding_box:%s,items:array<%s>>"
LINE = BLOCK % (BOX, WORD)
PARAGRAPH = BLOCK % (BOX, LINE)
PAGE = f"struct<type:string,width:int,height:int,page_index:int,bounding_box:{BOX},items:array<{BLOCK % (BOX, PARAGRAPH)}>>"
DOCUMENT = f"source_lib string, source_identifier string, source_path string, pages array<{PAGE}>"
REGION = "struct<type:string,L:int,R:int,T:int,B:int,confidence:double,raw_label:string>"
LAYOUT = f"regions array<{REGION}>, image_width int, image_height int, detector string, inference_ms int"
# Levels of the flat table.
LEVELS = {"page": 1, "block": 2, "paragraph": 3, "line": 4, "word": 5}


def box_columns(c: Column) -> list[Column]:
    return [c["top_left"]["x"].alias("l"), c["top_left"]["y"].alias("t"), c["bottom_right"]["x"].alias("r"), c["bottom_right"]["y"].alias("b"), c["is_normalized"].alias("is_normalized")]


def words_of_documents(docs: DataFrame, key: str = "source_identifier") -> DataFrame:
    """The words of nested documents (page, block, paragraph, line, word) as flat rows."""
    level = docs.select(key, F.posexplode("pages").alias("page_pos", "page"))
    level = level.select(key, F.col("page.page_index").alias("page_index"), F.col("page.width").alias("page_width"), F.col("page.height").alias("page_height"), F.posexplode("page.items").alias("block_no", "x"))
    keys = [key, "page_index", "page_width", "page_height", "block_no"]
    for name in ("paragraph_no", "line_no", "word_no"):
        level = level.select(*keys, F.posexplode("x.items").alias(name, "x"))
        keys.append(name)
    return level.select(*keys, F.col("x.text").alias("word"), *box_columns(F.col("x.bounding_box")), F.col("x.ocr_confidence").alias("conf"), F.col("x.word_labels").alias("labels"), F.col("x.text_style_labels").alias("styles"), F.col("x.ground_truth_text").alias("truth"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path)


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(file, image_width, image_height, detector, pos, type, l, t, r, b, confidence)"""
    files = spark.read.schema(LAYOUT).option("multiLine", True).json(path).select(F.input_file_name().alias("file"), "*")
    return files.select("file", "image_width", "image_height", "detector", F.posexplode("regions").alias("pos", "x")).select("file", "image_width", "image_height", "detector", "pos", F.col("x.type").alias("type"), F.col("x.L").alias("l"), F.col("x.T").alias("t"), F.col("x.R").alias("r"), F.col("x.B").alias("b"), F.col("x.confidence").alias("confidence"))


def lenient(c: Column) -> Column:
    """A number, or null for anything that is none (NaN too)."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def flat_words(rows: DataFrame, level: str = "word") -> DataFrame:
    """The rows of one level of the flat table with clean text, box and confidence; -1 and the like become null."""
    conf = lenient(F.col("conf"))
    left, top, width, height = (lenient(F.col(c)) for c in ("left", "top", "width", "height"))
    text = F.when(F.col("text").isNull() | (F.col("text") == "NaN"), "").otherwise(F.col("text"))
    keys = [c for c in ("page_num", "block_num", "par_num", "line_num", "word_num") if c in rows.columns]
    return rows.where(F.col("level") == LEVELS[level]).select(*keys, text.alias("word"), left.alias("l"), top.alias("t"), (left + width).alias("r"), (top + height).alias("b"), F.when(conf > 0, conf / 100).alias("conf"))


def read_images(spark: SparkSession, path: str, suffixes: str = "*.{png,jpg,jpeg,tif,tiff,bmp,gif,webp}") -> DataFrame:
    """(path, format, mismatch, content) of image files by suffix or magic bytes."""
    files = spark.read.format("binaryFile").load(path).withColumn("format", sniff(F.col("content"))).withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    usual = F.when(F.col("suffix").isin("jpg", "jpeg"), "jpeg").when(F.col("suffix").isin("tif", "tiff"), "tiff").otherwise(F.col("suffix"))
    known = F.col("suffix").isin(*suffixes.strip("*.{}").split(","))
    return files.where((known | F.col("format").isNotNull()) & (F.length("content") >= 16)).select("path", "format", (F.col("format").isNotNull() & (F.col("format") != usual)).alias("mismatch"), "content")
