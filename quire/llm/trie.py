"""The prefix trie of conversations, by partition refinement of their turns.

All conversations start in one class, the root.  A round reads the next block of turns of those in classes that still have
company, and splits these classes turn by turn: a class is named by the digest of all turns so far, so that members of a
class that share their next turn share the next class.  A class of one is retired as soon as it arises: the rest of its
conversation is a chain of nodes without branches, which is written out from its length alone, without another look at its
turns.  Classes of two or more are folded back from the leaves to the root at the end: each node's share is credited to its
least member, running sums along each conversation give what that member brings to each of its nodes, and nodes add up
their members.

Only digests and lengths of turns are shuffled, never texts.  Blocks double from BLOCK to LARGEST turns, so deep shared
prefixes need few rounds and no row outgrows LARGEST digests.  A hot class is pre-aggregated before the shuffle; the join
of its members with its counts is left to the splitting of skewed joins.  The hash over the ids that end at a node must
see them in order: ids are joined to strings by ranges of RANGE ids, and these are hashed one after another as a stream,
sorted on disk, so memory doesn't grow with a node.

Cases: turns are ordered by number (null first), those of one number by the digest of role and text; null roles and texts
are empty; repeated rows are
turns of their own; rows without a conv_id belong to no conversation and are left out; conversations of no turns left are
members of the root; an empty table has no node; other columns are ignored, whatever their names; turns of any length and
conversations of any number of turns are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Turns in the first block of a conversation, and in the largest; each is twice the one before.
BLOCK, LARGEST = 64, 1024
#: Ids in a range that is joined to one string before it is hashed.
RANGE_BITS = 13


def block_of(position: Column) -> Column:
    """The block that a turn (from 0) is in."""
    doubling = (LARGEST // BLOCK).bit_length() - 1
    before = BLOCK * (LARGEST // BLOCK - 1)
    small = F.length(F.bin(F.floor(position / BLOCK).cast("long") + 1)) - 1
    return F.when(position < before, small).otherwise(doubling + F.floor((position - before) / LARGEST)).cast("int")


def block_end(block: int) -> int:
    """Turns up to the end of a block."""
    doubling = (LARGEST // BLOCK).bit_length() - 1
    return BLOCK * (2 ** (block + 1) - 1) if block < doubling else BLOCK * (LARGEST // BLOCK - 1) + LARGEST * (block - doubling + 1)


def numbered(df: DataFrame) -> DataFrame:
    """(conv_id, position from 0, key, chars) of rows with conv_id, turn, role and text; key is a digest of role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = df.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "key")
    return turns.select("conv_id", (F.row_number().over(order) - 1).alias("position"), "key", "chars")


def heads_and_tails(turns: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of conversation c - c % family, then c's own turns after its first h, with
    h = crc32(c) % most.  Gives turns (conv_id, position, key, chars) and conversations (conv_id, n)."""
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    sizes = sizes.select("conv_id", "own", (c - c % family).alias("base"), (F.crc32(F.encode(c.cast("string"), "UTF-8")) % most).alias("h"))
    first = turns.where(F.col("position") < most - 1)
    lent = first.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("lent"))
    meta = sizes.join(lent, "base", "left").withColumn("taken", F.least("h", F.coalesce("lent", F.lit(0))))
    meta = materialize(meta.withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    own = turns.join(meta.select("conv_id", "h", "taken"), "conv_id").where(F.col("position") >= F.col("h")).select("conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("position"), "key", "chars")
    head = meta.select("conv_id", "base", "taken").join(first.withColumnRenamed("conv_id", "base"), "base").where(F.col("position") < F.col("taken")).select("conv_id", F.col("position").cast("long").alias("position"), "key", "chars")
    return own.unionByName(head), meta.select("conv_id", "n")


def _chain(parent: Column, turns: Column) -> Column:
    """The classes of a block's prefixes: each the digest of its parent's name and the turn."""
    start = F.struct(parent.alias("node"), F.array().cast("array<struct<node:binary,parent:binary,chars:bigint>>").alias("made"))

    def step(x: Column, turn: Column) -> Column:
        node = F.unhex(F.sha2(F.concat(x["node"], turn["key"]), 256))
        return F.struct(node.alias("node"), F.concat(x["made"], F.array(F.struct(node.alias("node"), x["node"].alias("parent"), turn["chars"].alias("chars")))).alias("made"))

    return F.aggregate(turns, start, step)["made"]


def refine(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rounds of splitting.  Gives (conv_id, n, depth, node, n_convs, rep, ends, chars) for each conversation and shared
    class that it is in, rep being the class's least member, and the unshared tails (conv_id, n, depth, rep): from which
    depth on the conversation is alone, and the least member of the class before (null at the root)."""
    blocks = turns.groupBy("conv_id", block_of(F.col("position")).alias("block")).agg(F.sort_array(F.collect_list(F.struct("position", "key", "chars"))).alias("turns"))
    blocks = materialize(blocks, "turn-blocks")
    active = conversations.select("conv_id", "n", F.lit(b"").alias("node"), F.lit(None).cast("long").alias("rep"), F.lit(-1).cast("long").alias("depth"))
    shared, tails, block = [], [], 0
    while True:
        rows = active.join(blocks.where(F.col("block") == block).select("conv_id", "turns"), "conv_id", "left")
        chain = _chain(F.col("node"), F.coalesce("turns", F.array().cast(blocks.schema["turns"].dataType)))
        first = block_end(block - 1) + 1 if block else 0
        if not block:  # the root is the parent of the first turn's class
            chain = F.concat(F.array(F.struct(F.col("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"))), chain)
        members = rows.select("conv_id", "n", F.posexplode(chain).alias("at", "x")).select("conv_id", "n", (F.col("at") + first).cast("long").alias("depth"), "x.node", "x.chars")
        members = materialize(members, "members")
        classes = members.groupBy("depth", "node").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("rep"), F.count_if(F.col("depth") == F.col("n")).alias("ends")).where("n_convs > 1")
        # written, so that both sides of the join are plain shuffles and a hot class's members can be split
        classes = materialize(classes, "classes")
        found = materialize(members.join(classes, ["depth", "node"]), "shared")
        last = found.groupBy("conv_id").agg(F.max_by(F.struct("depth", "node", "rep"), "depth").alias("last"))
        stand = active.join(last, "conv_id", "left").select("conv_id", "n", *[F.coalesce(f"last.{c}", c).alias(c) for c in ("node", "rep", "depth")])
        end = block_end(block)
        stand = materialize(stand.where(F.col("n") > F.col("depth")), "standing")
        shared.append(found)
        tails.append(stand.where(F.col("depth") < end).select("conv_id", "n", (F.col("depth") + 1).alias("depth"), "rep"))
        active = stand.where(F.col("depth") == end)
        block += 1
        if active.isEmpty():
            return _union(shared), _union(tails)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hash_of_ids(df: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv_id): SHA-256 of each node's ids in ascending order, joined by commas."""
    parts = df.groupBy("node", F.shiftright("conv_id", RANGE_BITS).alias("range")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name == node:
                    state.update(b",")
                else:
                    if state:
                        done.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.binary(), pa.string()))], ["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])

    return parts.repartition("node").sortWithinPartitions("node", "range").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def fold(shared: DataFrame) -> DataFrame:
    """The shared nodes, from their members' rows."""
    along = Window.partitionBy("conv_id").orderBy("depth")
    whole = Window.partitionBy("conv_id")
    mine = F.col("rep") == F.col("conv_id")
    rows = shared.withColumns({"saved": F.when(mine, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0), "below": F.lead("rep").over(along), "above": F.lag("rep").over(along)})
    last = F.col("below").isNull()
    alone = last & (F.col("n") > F.col("depth"))
    rows = rows.withColumns({
        "saved": F.sum("saved").over(whole) - F.sum("saved").over(along) + F.col("saved"),
        "child": (alone | (F.col("below") == F.col("conv_id"))).cast("int"),
        "leaf": F.max((alone | (last & mine & (F.col("ends") == F.col("n_convs")))).cast("int")).over(whole),
    })
    nodes = rows.groupBy("depth", "node").agg(
        F.first("rep").alias("conv_id"), F.first("above").alias("parent_conv_id"), F.first("n_convs").alias("n_convs"),
        F.sum(F.coalesce("child", F.lit(0))).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    ended = hash_of_ids(shared.where(F.col("depth") == F.col("n")).select("node", "conv_id"))
    return nodes.join(ended, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))).drop("node")


def chains(tails: DataFrame) -> DataFrame:
    """The nodes of unshared tails: one after another, each with one member."""
    rows = tails.select("conv_id", "n", F.col("depth").alias("first"), "rep", F.explode(F.sequence("depth", "n")).alias("depth"))
    ends = F.col("depth") == F.col("n")
    return rows.select(
        "conv_id", F.col("depth"), F.when(F.col("depth") == F.col("first"), F.col("rep")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        (~ends).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.sha2(F.when(ends, F.col("conv_id").cast("string")).otherwise("").cast("binary"), 256).alias("ends_sha256"),
    )


def prefix_trie(df: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """Every node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = materialize(numbered(df), "turns")
    shared, tails = refine(*heads_and_tails(turns, family, most))
    nodes = chains(tails)
    return fold(shared).select(nodes.columns).unionByName(nodes)
