"""Shards of near-equal size by vector bin packing.

Groups of equal texts are the items; each is a vector of bytes, tokens (ids of the tokenizer) and rows.  Only a group that
is a good part of a shard, more than SPLIT of a shard's bytes, tokens or rows, is split, into chunks of about that size by
a hash of the id; any other group stays whole.  The groups with 1/ITEMS of a total or more are items of their own; what is
smaller, too much to plan one by one, meets in ITEMS buckets by a hash of the text, so that equal texts stay together.

The items, bounded in number by ITEMS and not by the input, are placed largest first: each goes to the shard where the
dot product of its vector with the residual capacity is highest, among those with room for it.  Then items move or
change places between two shards, that with the best joint gain first: the sum over bytes, tokens and rows of the squared
distances from an equal load, bytes counting most, as the law is `bytes`.

Slots count from 0 in each shard without gaps; they come from counts of bounded cells, so no shard is gathered in a
task.  Null text: no bytes (size 1), the checksum of nothing, no tokens.  Texts of any length are one row.  Ties: items of
equal size are placed in order of their hash; rows of equal id and text are interchangeable.  Repeated rows: each has its
own slot.  Columns other than id and text are ignored, whatever their names.  No rows: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import map_rows, materialize

ITEMS = 4096
SPLIT = 0.25
WEIGHTS = (10_000.0, 1.0, 1.0)
EXCHANGES = 1000
CELL_ROWS = 20_000


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of vectors: bytes, tokens, rows)."""
    total = np.maximum(vectors.sum(axis=0), 1)
    share = vectors / total * shards
    left = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        fits = (left >= share[i] - 1e-12).all(axis=1)
        score = left @ share[i]
        out[i] = int(np.where(fits, score, -np.inf).argmax()) if fits.any() else int(left.min(axis=1).argmax())
        left[out[i]] -= share[i]
    return _balanced(share, out, shards)


def _balanced(share: np.ndarray, out: np.ndarray, shards: int) -> np.ndarray:
    """Exchanges between two shards that bring the loads together in all dimensions, EXCHANGES at most."""
    weights = np.array(WEIGHTS[: share.shape[1]])
    load = np.stack([np.bincount(out, weights=share[:, d], minlength=shards) for d in range(share.shape[1])], axis=1)
    nothing = np.zeros((1, share.shape[1]))
    for _ in range(EXCHANGES):
        pairs = [(float(((load[a] - load[b]) ** 2 * weights).sum()), a, b) for a in range(shards) for b in range(a)]
        for _, a, b in sorted(pairs, reverse=True)[:shards]:
            here, there = np.flatnonzero(out == a), np.flatnonzero(out == b)
            x, y = np.concatenate([nothing, share[here]]), np.concatenate([nothing, share[there]])
            toward = weights * (load[b] - load[a])
            square = lambda v: (v * v) @ weights
            # x - y goes from a to b: half the change of the two shards' squared loads
            gain = (x @ toward + square(x))[:, None] + (square(y) - y @ toward)[None, :] - 2 * (x * weights) @ y.T
            i, j = np.unravel_index(int(gain.argmin()), gain.shape)
            if gain[i, j] < -1e-18:
                load[a] += y[j] - x[i]
                load[b] += x[i] - y[j]
                if i:
                    out[here[i - 1]] = b
                if j:
                    out[there[j - 1]] = a
                break
        else:
            break
    return out


def measured(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None) -> DataFrame:
    """(_id, _tokens, size, text_crc32, _group) of every row."""
    with open(tokenizer or tokens.default_path(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        enc = tokens.encoder(spec.value)

        def step(batch: pa.RecordBatch) -> dict:
            found = [len(x) for x in enc.encode_array(batch.column("_text"))]
            return {n: batch.column(n) for n in ("_id", "size", "text_crc32", "_group")} | {"_tokens": found}

        return step

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.col(text_col)).alias("_group"),
    )
    return map_rows(rows, f"_id {docs.schema[id_col].dataType.simpleString()}, size bigint, text_crc32 bigint, _group bigint, _tokens bigint", make, keeps=True)


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", items: int = ITEMS, tokenizer: str | None = None) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row."""
    spark = docs.sparkSession
    rows = materialize(measured(docs, id_col, text_col, tokenizer), "sizes", batch_rows=tokens.BATCH_ROWS)
    sums = [F.sum("size").cast("double").alias("b"), F.sum("_tokens").cast("double").alias("t"), F.count("*").cast("double").alias("r")]
    total = rows.agg(*sums).first()
    groups = rows.groupBy("_group").agg(*sums)
    share = F.greatest(F.col("b") / max(total.b or 1, 1), F.col("t") / max(total.t or 1, 1), F.col("r") / max(total.r or 1, 1))
    own = groups.select("_group", share.alias("_share")).where(F.col("_share") * items >= 1)
    own = own.select("_group", F.ceil(F.col("_share") * shards / SPLIT).cast("int").alias("_chunks"))
    # at most 3 * items rows, as each has 1/items of one of three totals
    own = F.broadcast(spark.createDataFrame(own.collect(), "_group bigint, _chunks int"))
    item = (
        rows.join(own, "_group", "left")
        .withColumn("_item", F.when(F.col("_chunks").isNull(), F.pmod("_group", F.lit(items))).otherwise(F.col("_group")))
        .withColumn("_chunk", F.when(F.col("_chunks").isNull(), -1).otherwise(F.pmod(F.xxhash64("_id"), F.col("_chunks"))).cast("int"))
        .drop("_chunks", "_group")
    )
    found = item.groupBy("_item", "_chunk").agg(*sums).collect()
    found.sort(key=lambda r: (r._item, r._chunk))
    where = place(np.array([[r.b, r.t, r.r] for r in found]), shards) if found else []
    # as many rows as items and chunks: items, 3 * items and shards / SPLIT at most
    planned = [(r._item, r._chunk, int(s), -(-int(r.r) // CELL_ROWS)) for r, s in zip(found, where, strict=True)]
    placed = F.broadcast(spark.createDataFrame(planned, "_item bigint, _chunk int, shard int, _cells int"))
    keyed = item.join(placed, ["_item", "_chunk"]).withColumn("_cell", F.pmod(F.xxhash64("_id", "text_crc32", F.lit(1)), F.col("_cells")).cast("int")).drop("_cells")
    cell = ["shard", "_item", "_chunk", "_cell"]
    before = keyed.groupBy(*cell).agg(F.count("*").alias("_n"))
    before = before.select(*cell, (F.sum("_n").over(Window.partitionBy("shard").orderBy("_item", "_chunk", "_cell")) - F.col("_n")).alias("_before"))
    numbered = keyed.withColumn("_row", F.row_number().over(Window.partitionBy(*cell).orderBy("_id", "text_crc32")))
    return numbered.join(before, cell).select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_before") + F.col("_row") - 1).cast("long").alias("slot"))
