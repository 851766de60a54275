"""The training-corpus pipeline: language, lines, near duplicates, benchmark leaks, sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents.  Rejected: documents without a language (`und`), or in none of the languages learned; repeated runs of
lines at later places, and documents of which they leave no word; of each group of near duplicates (five-word shingles,
similarity 0.8) all but the least id; documents with a benchmark item.  The rest is packed into sequences.

Null and empty texts go in the first stage, as they have no language.  A row with a null id is a near duplicate of none.
Repeated rows: the later ones lose their lines if they have 50 words or more, else all stay.  Columns other than doc_id,
text, lang and n_chars are kept as they are, whatever their names; n_chars is counted anew where lines went.  An empty
table gives no rows.  Stages that run Python set the session's Arrow batch size; run() puts it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, langid, line_dedup, minhash, packing
from quire.llm.common import table, work_path

BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch in this pipeline's session: rows hold whole texts, and several batches are held at a time.
BATCH_ROWS = 2000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set(BATCHES, BATCH_ROWS)
    model = langid.train(docs.where(~langid.held_out()))
    return langid.keep_known(docs, model)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(docs)
    left = cut.where((F.col("removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"n_chars": F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))}
    return left.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set(BATCHES, BATCH_ROWS)
    return minhash.keep_one(docs, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set(BATCHES, BATCH_ROWS)
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set(BATCHES, BATCH_ROWS)
    return packing.pack_documents(docs, memo_entries=250_000, slice_bytes=2 << 20)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the language model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(BATCHES)
    try:
        for name, stage in STAGES:
            path = work_path(spark, name)
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCHES, before)
    return docs
