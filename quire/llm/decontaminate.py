"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact similarity.

An item's shingles are runs of five words (A-Z in lower case), each weighted by its length in bytes, so that short and
common words count less.  A window of an item's length that shares no shingle with the item has similarity 0; so windows
are laid wherever they hold a shingle of an item of their length, at every place, cut off at the text's ends.  Every
such window gets a SimHash; a multi-index over blocks of the items' SimHashes (probing each block within its share of the
radius) returns every item within RADIUS bits; an item is found if the weighted Jaccard similarity of window and item is
at least 0.8.  Of an item's windows in a text the most similar is told, of equal ones the first.

The documents are read once, whatever the size of the benchmark: a Bloom filter of all its shingles, PROBES places for each,
SPARE bits to a shingle and 2^MAX_BITS bits at most, goes to the executors, and documents without a hit are done.  The rest, which hold
a shingle of the benchmark or, rarely, one that collides, are stored and searched with the benchmark in blocks of
BLOCK_BYTES of text, so that an index fits a task's memory.

Null or empty texts and items, and items of fewer than five words, match nothing.  Texts of any length are searched whole.
Repeated rows of documents give repeated rows; of equal items each is found.  Other columns are ignored, whatever their
names.  No documents or no items: no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 22
INDEX_BLOCKS = 8
BLOCK_BYTES = 2 << 20
SPARE, MIN_BITS, MAX_BITS = 64, 20, 30
PROBES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
MEMO_WORDS = 200_000
BROADCAST_ROWS = 1_000_000


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes]) -> list[bytes]:
    return [b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def shingle_bits(shingle: bytes) -> np.ndarray:
    """64 signs, +1 or -1."""
    return np.unpackbits(np.frombuffer(hashlib.blake2b(shingle, digest_size=8).digest(), dtype=np.uint8)).astype(np.float64) * 2 - 1


class Index:
    """Items with weights, fingerprints and the blocks of the multi-index."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, similarity: float = SIMILARITY):
        self.radius, self.similarity = radius, similarity
        self.ids, self.sizes, self.bags = [], [], []
        vocabulary: dict[bytes, int] = {}
        places: dict[int, list] = defaultdict(list)
        rows = [(i, w) for i, t in items if len(w := split_words(t)) >= SHINGLE]
        for k, (i, w) in enumerate(rows):
            self.ids.append(i)
            self.sizes.append(len(w))
            self.bags.append(Counter(shingles(w)))
            codes = self.codes(np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], dtype=np.uint64))
            for j, c in enumerate(codes.tolist()):
                places[c].append((k, j))
        self.vocabulary, self.places = vocabulary, dict(places)
        self.slots = np.zeros(1 << 20, dtype=bool)
        self.slots[self.slot(np.array(list(self.places), dtype=np.uint64))] = True
        self.prints = [self.fingerprint(b) for b in self.bags]
        edges = np.linspace(0, 64, INDEX_BLOCKS + 1).astype(int).tolist()
        self.blocks = []
        for low, high in zip(edges, edges[1:], strict=False):
            table = defaultdict(list)
            for k, p in enumerate(self.prints):
                table[p >> low & (1 << high - low) - 1].append(k)
            masks = [sum(1 << b for b in bits) for n in range(radius // INDEX_BLOCKS + 1) for bits in combinations(range(high - low), n)]
            self.blocks.append((low, (1 << high - low) - 1, dict(table), masks))

    @staticmethod
    def codes(words: np.ndarray) -> np.ndarray:
        """A 64-bit code of every shingle of a sequence of word numbers."""
        n = len(words) - SHINGLE + 1
        out = np.zeros(max(n, 0), dtype=np.uint64)
        for k in range(SHINGLE if n > 0 else 0):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += words[k : k + n] + np.uint64(1)
        return out

    @staticmethod
    def slot(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)

    def fingerprint(self, bag: Counter) -> int:
        total = np.zeros(64)
        for s, n in bag.items():
            total += len(s) * n * shingle_bits(s)
        return int.from_bytes(np.packbits(total > 0).tobytes(), "big")

    def near(self, fingerprint: int) -> list[int]:
        """Every item whose fingerprint is within the radius: if two differ in at most radius bits, then in some block
        in at most radius // INDEX_BLOCKS."""
        found = set()
        for low, mask, table, masks in self.blocks:
            part = fingerprint >> low & mask
            for m in masks:
                found.update(table.get(part ^ m, ()))
        return sorted(k for k in found if (self.prints[k] ^ fingerprint).bit_count() <= self.radius)

    def weighted(self, a: Counter, b: Counter) -> float:
        both = more = 0
        for s in a.keys() | b.keys():
            both += len(s) * min(a[s], b[s])
            more += len(s) * max(a[s], b[s])
        return both / more if more else 0.0

    def search(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item id, similarity, first word, words) of the best window of every item found in a text."""
        words = split_words(text)
        if len(words) < SHINGLE:
            return []
        codes = self.codes(np.array(list(map(self.vocabulary.get, words, [0] * len(words))), dtype=np.uint64))
        hits: dict[int, set[int]] = defaultdict(set)
        for p in np.flatnonzero(self.slots[self.slot(codes)]).tolist():
            for k, _ in self.places.get(int(codes[p]), ()):
                hits[self.sizes[k]].add(p)
        best: dict[int, tuple] = {}
        for size, places in hits.items():
            windows = sorted({(max(0, b), min(len(words), b + size)) for p in places for b in range(p + SHINGLE - size, p + 1)})
            for (begin, end), fingerprint in zip(windows, self.fingerprints(words, windows), strict=True):
                bag = None
                for k in self.near(fingerprint):
                    bag = bag or Counter(shingles(words[begin:end]))
                    if (s := self.weighted(bag, self.bags[k])) >= self.similarity and s > best.get(k, (0,))[0]:
                        best[k] = (s, begin, end - begin)
        return [(self.ids[k], *best[k]) for k in sorted(best)]

    def fingerprints(self, words: list[bytes], windows: list[tuple[int, int]]) -> list[int]:
        """SimHashes of many windows of a text; shingles that windows share are hashed once."""
        inside = np.zeros(len(words) - SHINGLE + 2, dtype=np.int64)
        for begin, end in windows:
            inside[begin] += 1
            inside[max(begin, end - SHINGLE + 1)] -= 1
        need = np.flatnonzero(np.cumsum(inside) > 0)
        number = np.zeros(len(inside), dtype=np.int64)
        number[need + 1] = 1
        number = np.cumsum(number)
        signs = [len(s) * shingle_bits(s) for s in (b" ".join(words[p : p + SHINGLE]) for p in need.tolist())]
        sums = np.concatenate([np.zeros((1, 64)), np.cumsum(signs, axis=0)]) if signs else np.zeros((1, 64))
        begin, end = np.array(windows).T
        total = sums[number[np.maximum(begin, end - SHINGLE + 1)]] - sums[number[np.minimum(begin, len(inside) - 1)]]
        return np.packbits(total > 0, axis=1).view(">u8").ravel().tolist()


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark's items in blocks of bounded size, one on the driver at a time."""
    block, size = [], 0
    for i, t in benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        block.append((i, t))
        size += len(t)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    """A 64-bit hash of every run of five words."""
    words = split_words(text)
    if len(hashes) > MEMO_WORDS:
        hashes.clear()
    return Index.codes(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))


def slots(codes: np.ndarray, bits: int, probe: int) -> np.ndarray:
    codes = codes ^ (codes >> np.uint64(32))
    return (codes * np.uint64(probe)) >> np.uint64(64 - bits)


def in_bitmap(codes: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """The codes that all probes find."""
    for probe in PROBES:
        at = slots(codes, bits, probe)
        codes = codes[(bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
    return codes


def shingle_bitmap(benchmark: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """(bytes, number of address bits): a bit for every place of a shingle; the driver gets 4 KB for each part in use."""
    words = F.size(F.split(F.trim(F.col(text_col)), r"[\x20\x09-\x0D]+"))
    count = benchmark.where(F.col(text_col).isNotNull()).agg(F.sum(words)).first()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, (SPARE * count).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [slots(shingle_hashes(t, hashes), bits, p) for t in batch.column(0).to_pylist() for p in PROBES]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).astype(np.int64))], names=["slot"])

    # bitmap functions count positions of a bucket from 0, buckets from 1, numbers from 1
    place = F.col("slot") + 1
    parts = benchmark.select(text_col).mapInArrow(run, "slot bigint").groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for part, bitmap in parts.toLocalIterator():
        out[(part - 1) << 12 : part << 12] = np.frombuffer(bitmap, dtype=np.uint8)
    return out, bits


def touched(docs: DataFrame, benchmark: DataFrame, text_col: str, item_text_col: str) -> DataFrame:
    """The rows of docs (all columns) that hold a shingle of the benchmark, and few others."""
    shared = docs.sparkSession.sparkContext.broadcast(shingle_bitmap(benchmark, item_text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashes, (bitmap, bits) = WordHashes(), shared.value
        for batch in batches:
            keep = []
            for t in batch.column(at).to_pylist():
                keep.append(len(in_bitmap(shingle_hashes(t, hashes), bitmap, bits)) > 0)
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item, similarity, first_word, n_words) for every document and item that it contains."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, `{item_col}` {item_type}, similarity double, first_word int, n_words int"
    out = spark.createDataFrame([], schema)
    rows = materialize(touched(docs.select(id_col, text_col), benchmark, text_col, item_text_col), "touched")
    for block in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        index = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            forget()
            search = Index(index.value).search
            for batch in batches:
                at, rows = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for row in search(text):
                        at.append(i)
                        rows.append(row)
                item, s, first, n = zip(*rows, strict=True) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, pa.from_numpy_dtype(np.int64) if item_type == "bigint" else None), pa.array(s, pa.float64()), pa.array(first, pa.int32()), pa.array(n, pa.int32())], names=[id_col, item_col, "similarity", "first_word", "n_words"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, with all their columns, without the rows whose text contains an item.  Leaks are known by two hashes of the text,
    so that rows without an id count as well."""
    key = lambda text: [F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("g")]
    text = F.col(text_col)
    texts = docs.select(F.struct(*key(text)).alias("key"), text.alias("text")).where("text is not null")
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    found = find_leaks(texts, items, "key", "text", "item", "text", block_bytes)
    gone = materialize(found.select("key.h", "key.g").distinct(), "leaks")
    whole_row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key(text))
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return whole_row.join(F.broadcast(gone) if few else gone, ["h", "g"], "left_anti").select("row.*")
