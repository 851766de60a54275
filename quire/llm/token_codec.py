"""Token-id files: canonical length-limited Huffman codes, blocks that decode alone, bit-offset checkpoints.

A file set is a folder of two tables.  ``code``: one row per id in use with its code length; the codes follow from the
lengths (canonical order: length, then id).  ``blocks``: one row per block with its place (part, block), the documents
in it (ids, numbers of ids), the ids before it within its part, the bit offset of every CHECKPOINT-th id and the bits.
Parts hold ascending ranges of document ids.  Blocks hold whole documents, so a block decodes without any other; the
checkpoints let one block decode at many places at once, each step being a look-up in a table of 2^LIMIT entries.

Code lengths come from the counts of all ids of the corpus, by package-merge with LIMIT bits at most.  What meets on the
driver is the counts (one number per vocabulary entry) and the number of ids per part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import map_rows, materialize, work_path

LIMIT = 18
CHECKPOINT = 256
BLOCK_IDS = 1 << 17
PART_IDS = 1 << 23


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most limit bits (package-merge); 0 for ids that don't occur."""
    out = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        level = both[at]
        is_leaf.append(at < n)
    take, length = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for flags in reversed(is_leaf):
        picked = int(flags[:take].sum())
        length[:picked] += 1
        take = 2 * (take - picked)
    out[order] = length
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: counted up in order of length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    step = np.uint64(1) << (np.uint64(32) - lengths[used].astype(np.uint64))
    codes[used] = (np.concatenate([[0], np.cumsum(step)[:-1]]).astype(np.uint64) >> (np.uint64(32) - lengths[used].astype(np.uint64))).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, length) for every value of the next bits, as many bits as the longest code has."""
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    bits = int(lengths.max(initial=1))
    repeat = 1 << (bits - lengths[used].astype(np.int64))
    ids = np.zeros(1 << bits, dtype=np.uint32)
    sizes = np.ones(1 << bits, dtype=np.uint8)
    ids[: repeat.sum()] = np.repeat(used, repeat)
    sizes[: repeat.sum()] = np.repeat(lengths[used], repeat)
    return ids, sizes, bits


def encode_ids(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, bit offset of every CHECKPOINT-th id)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    value = codes[ids].astype(np.uint64) << (np.uint64(64) - (at & 31).astype(np.uint64) - size.astype(np.uint64))
    word = at >> 5
    if not len(ids):
        return b"", at[::CHECKPOINT].astype(np.int64)
    # a code lies in one 32-bit word and the next; codes don't overlap, so sums are unions
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(word[-1]) + 2, dtype=np.uint64)
    out[word[first]] = np.add.reduceat(value >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    raw = out.astype(np.uint32).astype(">u4").tobytes()
    return raw[: int(end[-1] + 7 >> 3)], at[::CHECKPOINT]


def decode_blocks(payloads: list[bytes], checkpoints: list[np.ndarray], sizes: list[int], table: tuple[np.ndarray, np.ndarray, int]) -> list[np.ndarray]:
    """The ids of each block; all stretches between checkpoints advance together, one id at a time."""
    ids_of, length_of, bits = table
    begin = np.cumsum([0] + [len(p) for p in payloads])
    raw = np.frombuffer(b"".join(payloads) + bytes(8), dtype=np.uint8)
    window = raw[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        window <<= np.uint32(8)
        window |= raw[k : len(raw) - 3 + k]
    at = np.concatenate([np.asarray(c, dtype=np.int64) + 8 * int(b) for c, b in zip(checkpoints, begin, strict=False)]) if payloads else np.zeros(0, dtype=np.int64)
    out = np.empty((CHECKPOINT, len(at)), dtype=np.uint32)
    last, mask, room = len(window) - 1, np.uint32((1 << bits) - 1), 32 - bits
    for step in range(min(CHECKPOINT, max(sizes, default=0))):
        peek = (window[np.minimum(at >> 3, last)] >> (room - (at & 7)).astype(np.uint32)) & mask
        out[step] = ids_of[peek]
        at += length_of[peek]
    flat, found, lane = out.T.reshape(-1), [], 0
    for n in sizes:
        found.append(flat[lane * CHECKPOINT : lane * CHECKPOINT + n])
        lane += -(-n // CHECKPOINT)
    return found


def count_ids(tokens_of: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents, from the tasks' counts of tokens.tokenize(); what meets on the driver is one
    number per vocabulary entry."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                got = np.frombuffer(raw, dtype="<i8")
                total = got.copy() if not len(total) else total + got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, type=pa.int64()), pa.array(total[used], type=pa.int64())], names=["id", "n"])

    rows = tokens_of.where("counts is not null").select("counts").mapInArrow(parts, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    out = np.zeros(max(rows["id"], default=0) + 1, dtype=np.int64)
    out[rows["id"]] = rows["n"]
    return out


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> None:
    """Tokenize the documents and write their ids, in ascending order of the id column, as a file set at path."""
    spark, id_bytes = docs.sparkSession, tokens.width(tokenizer)
    found = materialize(tokens.tokenize(docs, id_col, text_col, tokenizer), "ids", batch_rows=tokens.BATCH_ROWS)
    lengths = code_lengths(count_ids(found))
    ids = found.where("counts is null")
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": pa.array(used, pa.int64()), "bits": pa.array(lengths[used], pa.int32())})).coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))
    total = ids.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_IDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, codes = shared.value
        part, block, before = TaskContext.get().partitionId(), 0, 0
        doc, size, held, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            bits, marks = encode_ids(np.frombuffer(b"".join(held), dtype=f"<u{id_bytes}"), of, codes)
            columns = [[part], [block], [before], [doc], [size], [n], [marks], [bits]]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for d, k, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc.append(d)
                size.append(k)
                held.append(raw)
                n += k
                if n >= BLOCK_IDS:
                    yield flush()
                    block, before = block + 1, before + n
                    doc, size, held, n = [], [], [], 0
        if doc:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = StructType.fromDDL(f"part int, block int, before bigint, docs array<{id_type}>, sizes array<bigint>, n_ids bigint, marks array<bigint>, bits binary")
    arrow = to_arrow_schema(schema)
    ordered = ids.repartitionByRange(parts, id_col).sortWithinPartitions(id_col, "ids")
    ordered.select(id_col, "n_tokens", "ids").mapInArrow(run, schema).write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids array<int>) of every document of a file set; start counts the ids of all before it."""
    return _decoded(spark, path, id_col, digest=False)


def read_digest(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, decoded from the file set."""
    return _decoded(spark, path, id_col, digest=True)


def _decoded(spark: SparkSession, path: str, id_col: str, digest: bool) -> DataFrame:
    code = spark.read.parquet(f"{path}/code").toArrow().to_pydict()
    lengths = np.zeros(max(code["id"], default=0) + 1, dtype=np.uint8)
    lengths[code["id"]] = code["bits"]
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{path}/blocks")
    what = "ids_crc32 bigint" if digest else "ids array<int>"

    def make():
        table = decode_table(shared.value)

        def step(batch: pa.RecordBatch) -> dict:
            col = {n: batch.column(n).to_pylist() for n in ("part", "before", "sizes", "n_ids", "bits")}
            marks = batch.column("marks")
            ids = decode_blocks(col["bits"], [marks[i].values.to_numpy() for i in range(len(marks))], col["n_ids"], table)
            part, before, size, made = [], [], [], []
            for b, block in enumerate(ids):
                ends = np.cumsum(col["sizes"][b])
                part += [col["part"][b]] * len(ends)
                size += col["sizes"][b]
                before += (col["before"][b] + ends - col["sizes"][b]).tolist()
                raw = memoryview(np.ascontiguousarray(block, dtype="<u4")).cast("B")
                cut = [0, *(4 * ends).tolist()]
                made += [zlib.crc32(raw[x:y]) if digest else np.frombuffer(raw[x:y], dtype="<u4").astype(np.int32) for x, y in zip(cut, cut[1:], strict=False)]
            return {"part": part, id_col: batch.column("docs").flatten(), "before": before, "n_tokens": size, what.split()[0]: made}

        return step

    id_type = blocks.schema["docs"].dataType.elementType.simpleString()
    rows = map_rows(blocks.select("part", "before", "docs", "sizes", "n_ids", "marks", "bits"), f"part int, `{id_col}` {id_type}, before bigint, n_tokens bigint, {what}", make)
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    sums = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    return rows.join(sums, "part").select(id_col, (F.col("first") + F.col("before")).alias("start"), "n_tokens", what.split()[0])


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write the documents as a file set in the shared work folder and read its digest back.  Null or empty text: the
    end id alone; repeated ids are kept as they are, next to each other, in order of their ids' bytes; a text of any length
    is one document of one block; columns other than id and text are ignored; no rows: an empty file set."""
    path = work_path(docs.sparkSession, "token-files")
    write(docs, path, id_col, text_col, tokenizer)
    return read_digest(docs.sparkSession, path, id_col)
