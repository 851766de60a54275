"""What the operators of this package share: tables, the shared work folder, word rules, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: A word is a run of anything but ASCII white space (space and U+0009 to U+000D).
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark (the folder may be in a store that only Spark reaches)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="quire-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/quire-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release)
    _made.append((spark, path))
    return path


def release() -> None:
    """Delete every work table written so far; frames that read them can no longer be used."""
    while _made:
        spark, path = _made.pop()
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            continue
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def materialize(df: DataFrame, name: str, codec: str = "zstd", batch_rows: int | None = None) -> DataFrame:
    """Write a frame to the shared folder once and read it back: cuts lineage, survives lost executors.  batch_rows bounds
    the rows of an Arrow batch while it is written, for functions that hold much memory besides."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = work_path(spark, name), spark.conf.get(key)
    if batch_rows:
        spark.conf.set(key, batch_rows)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def forget() -> None:
    """Let a Python worker drop what an operator before has left there for its later tasks (see tokens.encoder), and give
    back what it has freed; each task of an operator begins with this."""
    sys.__dict__.pop("_quire_encoders", None)
    gc.collect()
    trim()


def trim() -> None:
    """Give memory that a Python worker has freed, but still holds, back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_rows(df: DataFrame, schema: StructType | str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict] | dict]], keeps: bool = False) -> DataFrame:
    """mapInArrow where make() builds, once per task, a function from a record batch to one dict of columns; keeps says
    that it uses what earlier tasks have left in the worker."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        step = make()
        for batch in batches:
            if batch.num_rows:
                columns = step(batch)
                yield pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def words(text: str | None) -> list[str]:
    """Words of a text by WORD; the split of the UTF-8 bytes is the same rule, several times as fast."""
    return [w.decode() for w in text.encode("utf-8", "surrogatepass").split()] if text else []
