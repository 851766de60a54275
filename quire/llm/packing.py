"""Packing of documents into sequences of fixed length by swap-based local search.

A sequence's capacity is a small number (2,048), so lengths are few however many documents there are: the packing is
planned on the driver over the histogram of lengths, on patterns (kinds of bin) with multiplicities.  The first plan is
a cheap fill: documents of one length to a bin.  Then local search raises the sum of squared fills until bins empty:
underfull bins, that with the largest document first, get one or two documents of another underfull bin and give none,
one or two back (moves, one for one, two for one, one for two).  Exchanges that fill a bin to the last token go first;
when there are none left, those that move the most tokens.  Each is made in as many pairs of bins at once as both kinds
have, so the steps depend on the number of lengths and not on that of the documents.

Documents take their places in the plan by their rank among the documents of equal length; ranks come from counts of
bounded cells, so that a length that a third of the documents has is not gathered in one task.

Null or empty text: the end id alone, so one token.  A long text is cut into pieces that fill a sequence each, but for the
first.  Ties of length are ranked by the other columns; equal rows are interchangeable.  Repeated rows are packed each.
Columns other than id and text are ignored, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import map_rows, materialize

CAPACITY = 2048
CELL_ROWS = 20_000

Pattern = tuple[tuple[int, int], ...]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of them full but the first, which takes the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def one_length_a_bin(counts: dict[int, int], capacity: int) -> Counter:
    """The first plan: as many documents of one length as a bin takes; kinds of bin with how many there are."""
    plan: Counter = Counter()
    for size, n in counts.items():
        each = capacity // size
        plan[((size, each),)] += n // each
        plan[((size, n % each),)] += n % each > 0
    return +Counter({p: n for p, n in plan.items() if p[0][1]})


def _fill(p: Pattern) -> int:
    return sum(s * k for s, k in p)


def _changed(p: Pattern, out: tuple, into: tuple) -> Pattern:
    c = Counter(dict(p))
    c.subtract(out)
    c.update(into)
    return tuple(sorted(((s, k) for s, k in c.items() if k), reverse=True))


def _choices(p: Pattern) -> list[tuple[int, ...]]:
    """Every one or two documents of a bin, by length."""
    ones = [(s,) for s, _ in p]
    return ones + [(s, s) for s, k in p if k > 1] + [(s, t) for i, (s, _) in enumerate(p) for t, _ in p[i + 1 :]]


class Search:
    """Local search over a plan.  waiting: underfull kinds to be filled up, that with the largest document first; given:
    tokens -> (documents, fill, kind, which documents) of what underfull kinds can give away, stale entries passed over."""

    def __init__(self, plan: Counter, capacity: int):
        self.capacity = capacity
        self.plan: Counter = Counter()
        self.waiting: list[tuple[int, int, Pattern]] = []
        self.given: dict[int, list[tuple[int, int, Pattern, tuple]]] = {}
        self.listed: set[Pattern] = set()
        for p, n in plan.items():
            self.put(_changed(p, (), ()), n)

    def put(self, p: Pattern, n: int) -> None:
        if not p or not n:
            return
        self.plan[p] += n
        fill = _fill(p)
        if fill < self.capacity:
            heapq.heappush(self.waiting, (-p[0][0], fill, p))
            if p not in self.listed:
                self.listed.add(p)
                for out in _choices(p):
                    heapq.heappush(self.given.setdefault(sum(out), []), (len(out), fill, p, out))

    def take(self, p: Pattern, n: int) -> None:
        self.plan[p] -= n
        if not self.plan[p]:
            del self.plan[p]

    def giver(self, tokens: int, b: Pattern) -> tuple[int, int, Pattern, tuple] | None:
        """The fewest documents with just so many tokens, in the emptiest bin but for the one that takes them."""
        heap, own, found = self.given.get(tokens, []), [], None
        while heap and found is None:
            if heap[0][2] not in self.plan:
                self.listed.discard(heapq.heappop(heap)[2])
            elif heap[0][2] == b and self.plan[b] < 2:
                own.append(heapq.heappop(heap))
            else:
                found = heap[0]
        for entry in own:
            heapq.heappush(heap, entry)
        return found

    def filling(self, b: Pattern) -> tuple[Pattern, tuple, tuple] | None:
        """(bin, documents that it gives b, documents that it gets back) so that b is full; few documents, emptiest bin."""
        room, best = self.capacity - _fill(b), None
        for back in ((), *_choices(b)):
            if (g := self.giver(room + sum(back), b)) and g[0] + len(back) <= 3 and (best is None or (g[0] + len(back), g[1]) < best[0]):
                best = ((g[0] + len(back), g[1]), (g[2], g[3], back))
        return best[1] if best else None

    def raising(self, b: Pattern) -> tuple[Pattern, tuple, tuple] | None:
        """The same for the most tokens that raise the sum of squares without filling b up."""
        fill, best, most = _fill(b), None, 0
        for back in ((), *((s,) for s, _ in b)):
            less = sum(back)
            for tokens in range(self.capacity - fill + less - 1, less + most, -1):
                g = self.giver(tokens, b)
                if g and g[0] + len(back) <= 3 and fill - g[1] + tokens - less > 0:
                    best, most = (g[2], g[3], back), tokens - less
                    break
        return best

    def run(self, exchanges: int) -> Counter:
        bins = sum(self.plan.values())
        least = -(-sum(_fill(p) * n for p, n in self.plan.items()) // self.capacity)
        for ways in ((self.filling,), (self.filling, self.raising)):
            progress = True
            while progress and bins > least:
                progress, later = False, []
                while self.waiting and bins > least and exchanges:
                    entry = heapq.heappop(self.waiting)
                    b = entry[2]
                    if b not in self.plan:
                        continue
                    found = next(filter(None, (find(b) for find in ways)), None)
                    if found is None:
                        later.append(entry)
                        continue
                    a, out, back = found
                    n = self.plan[a] // 2 if a == b else min(self.plan[a], self.plan[b])
                    left = _changed(a, out, back)
                    self.take(a, n)
                    self.take(b, n)
                    self.put(_changed(b, back, out), n)
                    self.put(left, n)
                    if b in self.plan:
                        heapq.heappush(self.waiting, entry)
                    bins -= 0 if left else n
                    exchanges, progress = exchanges - 1, True
                for entry in set(later):
                    heapq.heappush(self.waiting, entry)
        return self.plan


def local_search(plan: Counter, capacity: int, exchanges: int = 100_000) -> Counter:
    """A plan of the same documents in no more bins; exchanges bounds the driver's work: the plan is complete and valid
    when it is reached."""
    return Search(plan, capacity).run(exchanges)


def places(plan: Counter) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """length -> (first rank, end rank, first bin, times in a bin, offset in the bin), by rank."""
    out: dict[int, list] = {}
    taken: Counter = Counter()
    first = 0
    for pattern, bins in sorted(plan.items(), reverse=True):
        at = 0
        for size, each in pattern:
            out.setdefault(size, []).append((taken[size], taken[size] + bins * each, first, each, at))
            taken[size] += bins * each
            at += size * each
        first += bins
    return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, memo_entries: int = tokens.MEMO_ENTRIES, slice_bytes: int = tokens.SLICE_BYTES) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32."""
    with open(path or tokens.default_path(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        enc = tokens.encoder(spec.value, memo_entries, slice_bytes)

        def step(batch: pa.RecordBatch) -> dict:
            at, rows = [], []
            for i, ids in enumerate(enc.encode_array(batch.column(1))):
                whole = np.append(ids.astype("<u4"), np.uint32(0))
                for k, (s, n) in enumerate(cut(len(whole), capacity)):
                    at.append(i)
                    rows.append((k, s, n, tokens.ids_crc32(whole[s : s + n])))
            k, s, n, c = zip(*rows, strict=True)
            return {id_col: batch.column(0).take(pa.array(at, type=pa.int64())), "piece": k, "start": s, "length": n, "ids_crc32": c}

        return step

    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint", make, keeps=True)


def pack(items: DataFrame, key_cols: list[str], length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """The rows of items (lengths 1 to capacity) with sequence_id and offset; items must be read from storage, as they
    are read twice.  Driver memory is bounded by the capacity, not by the rows."""
    spark = items.sparkSession
    counts = {r[0]: r[1] for r in items.groupBy(length_col).count().collect()}
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan = local_search(one_length_a_bin(counts, capacity), capacity)
    table = [(n, -(-counts[n] // CELL_ROWS), [dict(zip(("a", "b", "bin", "each", "at"), p, strict=True)) for p in ps]) for n, ps in places(plan).items()]
    # at most capacity rows, whatever the number of documents
    by_length = F.broadcast(spark.createDataFrame(table, "_length bigint, _cells int, _places array<struct<a:bigint,b:bigint,bin:bigint,each:bigint,at:bigint>>"))
    celled = (
        items.join(by_length.select("_length", "_cells"), F.col(length_col) == F.col("_length"))
        .withColumn("_cell", F.pmod(F.xxhash64(*key_cols), F.col("_cells")).cast("int"))
        .drop("_cells")
    )
    cells = celled.groupBy("_length", "_cell").agg(F.count("*").alias("_n"))
    cells = cells.select("_length", "_cell", "_n", (F.sum("_n").over(Window.partitionBy("_length").orderBy("_cell")) - F.col("_n")).alias("_before"))
    # a cell's rows look only at the patterns that its ranks reach
    reached = F.filter("_places", lambda p: (p["a"] < F.col("_before") + F.col("_n")) & (F.col("_before") < p["b"]))
    cells = cells.join(by_length.select("_length", "_places"), "_length").select("_length", "_cell", "_before", reached.alias("_places"))
    numbered = celled.withColumn("_row", F.row_number().over(Window.partitionBy("_length", "_cell").orderBy(*key_cols, *[c for c in items.columns if c not in key_cols])))
    ranked = numbered.join(cells, ["_length", "_cell"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    place = F.filter("_places", lambda p: (p["a"] <= F.col("_rank")) & (F.col("_rank") < p["b"]))[0]
    placed = ranked.withColumn("_p", place)
    within = F.col("_rank") - F.col("_p.a")
    return placed.select(
        *items.columns,
        (F.col("_p.bin") + F.floor(within / F.col("_p.each"))).cast("long").alias("sequence_id"),
        (F.col("_p.at") + F.pmod(within, F.col("_p.each")) * F.col(length_col)).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, **memory) -> DataFrame:
    """Every document's pieces with their places in sequences of the capacity; memory: memo_entries and slice_bytes."""
    stored = materialize(pieces(docs, id_col, text_col, path, capacity, **memory), "pieces", batch_rows=tokens.BATCH_ROWS)
    return pack(stored, [id_col, "piece"], "length", capacity)
