"""Near duplicates: banded MinHash candidates, sequential Bayesian verification, exact verification, components.

A document's set holds the hashes (64 bits) of its distinct SHINGLE-word runs, A-Z in lower case; a text of fewer words
is one run.  Documents of equal sets are one class from the start, for which its least id stands.

Candidates come from BANDS bands of ROWS minima: a pair at the threshold of 0.8 shares no band with probability 6e-5,
one at 0.85 with less than 1e-7.  Pairs are not taken from a bucket all with all.  In each round every member of a
bucket whose members aren't yet all in one component is paired with one pivot of the bucket, so a bucket gives at most
as many pairs as it has members; what is linked joins one component.  After ROUNDS rounds, members outside the bucket's
largest component are paired with all members of other components, so that every candidate pair is either tested or
inside one component: no link between components is lost, and no bucket is capped.

A pair's signatures are compared in batches of BATCH minima.  After each batch the pair is dropped if the posterior
probability (uniform prior) that its similarity reaches the threshold is under MISS.  What survives is verified on the
full sets, from the whole texts.

Null or empty text, or one without words: an empty set, linked with nothing.  A row with a null id is linked with nothing
either.  Repeated rows get equal results.  Other columns are ignored.  No rows: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_rows, materialize
from .components import components

BANDS = 32
ROWS = 6
BATCH = 32
MISS = 1e-6
ROUNDS = 3
BLOCK = 1024
BROADCAST_IDS = 1_000_000
MEMO_WORDS = 200_000


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the n-word runs of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(hashes) > MEMO_WORDS:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : len(h) - k + 1 + i]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(found: np.ndarray, factors: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The least of (x ^ mask) * factor (32 bits) over the set, for every mask and factor; blocks bound the memory."""
    low = found.astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 512):
        mixed = (low[i : i + 512, None] ^ masks) * factors
        np.minimum(out, mixed.min(axis=0), out=out)
    return out


def families(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240607)
    return r.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, n, digest, sig, bands): set size, digest of the set, 16 bits of each minimum, a 64-bit key for each band."""

    def make():
        factors, masks = families(bands * rows)
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> dict:
            size, digest, sig, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, shingle, hashes)
                size.append(len(found))
                if not len(found):
                    digest.append(None), sig.append(None), keys.append(None)
                    continue
                least = signature(found, factors, masks)
                digest.append(xxhash.xxh3_128_digest(found.tobytes()))
                sig.append((least >> np.uint32(16)).astype("<u2").tobytes())
                keys.append([xxhash.xxh3_64_intdigest(x.tobytes(), seed=b) - (1 << 63) for b, x in enumerate(least.reshape(bands, rows))])
            return {"id": batch.column(0), "n": size, "digest": digest, "sig": sig, "bands": keys}

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), f"id {kind}, n bigint, digest binary, sig binary, bands array<bigint>", make)


def least_matches(count: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(minima compared, matches below which the posterior of reaching the threshold is under miss) for each batch."""
    out = []
    for n in range(BATCH, count + 1, BATCH):
        # Beta(m + 1, n - m + 1) is over t with the probability that a binomial (n + 1, t) is at most m
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def likely(pairs: DataFrame, stand: DataFrame, count: int, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) that sequential comparison of the signatures doesn't rule out."""
    sig = lambda c: stand.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"))
    joined = pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b")
    need = least_matches(count, threshold, miss)

    def run(batches):
        forget()
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, count) for c in ("sig_a", "sig_b"))
                alive = np.arange(batch.num_rows)
                matches = np.zeros(batch.num_rows, dtype=np.int64)
                for n, least in need:
                    matches[alive] += (left[alive, n - BATCH : n] == right[alive, n - BATCH : n]).sum(axis=1)
                    alive = alive[matches[alive] >= least]
                yield batch.select(["a", "b"]).take(pa.array(alive))

    return joined.mapInArrow(run, pairs.schema)


def linked(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union; docs (id, text) of the classes."""
    text = lambda c: docs.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    joined = pairs.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        forget()
        hashes, last, first = WordHashes(), None, None
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if x != last:
                    last, first = x, shingle_set(x, shingle, hashes)
                other = shingle_set(y, shingle, hashes)
                both = len(first) + len(other) - len(np.union1d(first, other))
                keep.append(100 * both >= percent * (len(first) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return joined.mapInArrow(run, pairs.schema)


def pick(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """rows whose id is (or isn't: left_anti) among ids; up to BROADCAST_IDS ids are sent to the rows, more are joined by
    a shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, "id", how)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS, miss: float = MISS) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: the least id that links lead to, and whether it is the row's."""
    signed = materialize(signatures(docs, id_col, text_col, shingle, bands, rows), "signatures", batch_rows=2500)
    own = signed.where("digest is not null and id is not null")
    classes = materialize(own.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    stand = materialize(own.join(classes, (own["digest"] == classes["digest"]) & (own["id"] == classes["rep"])).select("id", "sig", "bands").dropDuplicates(["id"]), "representatives")
    member = stand.select("id", F.posexplode("bands").alias("band", "key")).select("id", F.xxhash64("band", "key").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("times"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("same")).where("times > 1")
    shared = shared.groupBy("times", "same").agg(F.min("bucket").alias("bucket"))
    member = materialize(member.join(shared.select("bucket", "times"), "bucket"), "members")
    stand = materialize(pick(stand.select("id", "sig"), member.select("id").distinct()), "compared")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    label = member.select("id").distinct().withColumn("component", F.col("id"))
    tested = None
    for turn in range(rounds + 1):
        if turn < rounds:
            pairs = _star(member, label, turn)
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = materialize(pairs, "pairs")
            tested = pairs if tested is None else tested.union(pairs)
            survivors = materialize(likely(pairs, stand, bands * rows, percent / 100, miss), "survivors")
            involved = survivors.select(F.col("a").alias("id")).union(survivors.select("b")).distinct()
            links = linked(survivors, pick(texts, involved).dropDuplicates(["id"]), shingle, percent)
        else:
            links = _rest(member, label, stand, texts, shingle, percent, bands * rows, miss)
        ends = links.join(label.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(label.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
        merging = materialize(ends.where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")), "links")
        if merging.isEmpty():
            continue
        merged = components(merging).select(F.col("node").alias("component"), F.col("component").alias("_to"))
        label = materialize(label.join(merged, "component", "left").select("id", F.coalesce("_to", "component").alias("component")), "components")
    named = classes.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("id", "n", "digest").join(named, "digest", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def _star(member: DataFrame, label: DataFrame, turn: int) -> DataFrame:
    """In each bucket of several components, each member with the bucket's pivot of this turn, if that is of another
    component."""
    known = member.join(label, "id")
    place = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "component")
    pivot = known.groupBy("bucket").agg(F.min(place).alias("p"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    pairs = known.join(pivot.select("bucket", "p"), "bucket").where(F.col("component") != F.col("p.component"))
    return pairs.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()


def _rest(member: DataFrame, label: DataFrame, stand: DataFrame, texts: DataFrame, shingle: int, percent: int, count: int, miss: float) -> DataFrame:
    """Links (a, b) between different components within the buckets that still have several, all pairs compared."""
    known = member.join(label, "id")
    mixed = known.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("first")).where("low != high")
    rest = materialize(known.join(mixed.select("bucket", "first"), "bucket").select("bucket", "times", "first", "id", "component"), "rest")
    large = components(rest.where(F.col("times") > BLOCK).select(F.col("first").alias("a"), F.col("id").alias("b")))
    grouped = rest.select("id", "component").distinct().join(large.select(F.col("node").alias("id"), F.col("component").alias("team")), "id").select(F.col("team").cast("string").alias("team"), "id", "component")
    apart = rest.where(F.col("times") <= BLOCK).select(F.concat(F.lit("b"), F.col("bucket").cast("string")).alias("team"), "id", "component")
    teams = grouped.unionByName(apart)
    split = materialize(teams.groupBy("team").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "blocks")
    few = split.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = teams.join(F.broadcast(split) if few else split, "team", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.select("team", "id", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("team", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component")
    involved = pick(texts, rest.select("id").distinct()).dropDuplicates(["id"])
    rows = rows.join(stand.select("id", "sig"), "id").join(involved, "id")
    need = least_matches(count, percent / 100, miss)

    def compare(held: list[tuple], across: bool, hashes: WordHashes) -> list[tuple]:
        ids, parts, own, sigs, text = zip(*held, strict=True)
        root = {p: p for p in parts}

        def top(p):
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            return p

        sets: dict[int, frozenset] = {}

        def full(x: int) -> frozenset:
            if x not in sets:
                sets[x] = frozenset(shingle_set(text[x], shingle, hashes).tolist())
            return sets[x]

        sig = np.frombuffer(b"".join(sigs), dtype="<u2").reshape(-1, count)
        side, part = np.array(own), np.unique(np.array(parts), return_inverse=True)[1]
        found = []
        for x in range(len(ids) - 1):
            apart = part[x + 1 :] != part[x]
            alive = np.flatnonzero(apart & (side[x + 1 :] != side[x]) if across else apart) + x + 1
            matches = np.zeros(len(ids), dtype=np.int64)
            for n, least in need:
                if not len(alive):
                    break
                matches[alive] += (sig[alive, n - BATCH : n] == sig[x, n - BATCH : n]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            for y in alive.tolist():
                if (p := top(parts[x])) != (q := top(parts[y])):
                    a, b = full(x), full(y)
                    both = len(a & b)
                    if 100 * both >= percent * (len(a) + len(b) - both):
                        root[q] = p
                        found.append((ids[x], ids[y]))
        return found

    def run(batches):
        forget()
        held: list[tuple] = []
        ready: list[tuple] = []
        hashes = WordHashes()
        key, kind = None, pa.int64()

        def emit():
            a, b = zip(*ready, strict=True)
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, type=kind), pa.array(b, type=kind)], names=["a", "b"])

        for batch in batches:
            kind = batch.column("id").type
            for team, i, j, own, x, part, sig, text in zip(*(batch.column(c).to_pylist() for c in ("team", "i", "j", "own", "id", "component", "sig", "text")), strict=True):
                if key != (team, i, j):
                    if len(held) > 1:
                        ready.extend(compare(held, key[1] != key[2], hashes))
                    held.clear()
                    key = (team, i, j)
                held.append((x, part, own, sig, text))
            if ready:
                yield emit()
        if len(held) > 1:
            ready.extend(compare(held, key[1] != key[2], hashes))
        if ready:
            yield emit()

    id_type = member.schema["id"].dataType.simpleString()
    ordered = rows.repartition("team", "i", "j").sortWithinPartitions("team", "i", "j")
    return ordered.mapInArrow(run, f"a {id_type}, b {id_type}")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, with all their columns, less the rows that are not their component's least id."""
    gone = materialize(near_duplicates(docs, id_col, text_col, **options).where("not kept").select(F.col(id_col).alias("id")), "gone")
    whole_row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"))
    return pick(whole_row, gone, "left_anti").select("row.*")
