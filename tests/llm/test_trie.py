import hashlib
import random
import zlib

import pytest

from quire.llm import trie

SCHEMA = "text string, conv_id bigint, turn bigint, role string, depth string, node string, n string"


def brute(rows):
    """Every node of the contract, by dictionaries of whole prefixes; turns of one number mustn't differ."""
    convs = {}
    for text, conv, turn, role, *_ in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in convs.items()}
    made = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        made[c] = own.get(base, [])[:h] + t[h:]
    nodes = {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) > len(p) for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def check(spark, rows):
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == COLUMNS
    found = [tuple(x) for x in got.collect()]
    assert sorted(found, key=lambda x: x[:2]) == sorted(brute(rows), key=lambda x: x[:2])
    return found


def talk(conv, *texts, role="user"):
    return [(t, conv, k, role, "x", "y", "z") for k, t in enumerate(texts)]


def made_up(seed, ids, longest=7, kinds=3):
    r = random.Random(seed)
    rows = []
    for c in ids:
        rows += [(r.choice(["a", "bb", "", None, "ccc é"][: kinds + 1]), c, k if k or r.random() < 0.8 else None, r.choice(["user", None, "system"][: r.randint(1, 3)]), "x", "y", "z") for k in range(r.randint(1, longest))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    check(spark, made_up(seed, [*range(20), *range(100, 130), 205, 299, 1000, -7, -100]))


def test_blocks_of_turns(spark, monkeypatch):
    """Shared prefixes over several blocks, ends at their edges, and chains that leave them."""
    monkeypatch.setattr(trie, "BLOCK", 2)
    monkeypatch.setattr(trie, "LARGEST", 4)
    r = random.Random(1)
    base = [f"t{k}" for k in range(40)]
    rows = []
    for c in range(101, 160):
        n = r.randint(0, 30)
        rows += talk(c, *base[:n], *[r.choice("xy") for _ in range(r.randint(0, 6))], "end" if n % 3 else "t")
    check(spark, rows)
    check(spark, talk(1, *base) + talk(2, *base) + talk(3, *base[:20]) + talk(7, *base[:39], "other"))


def test_blocks_cover_all_positions(spark):
    p = [0, 1, 63, 64, 191, 192, 447, 448, 959, 960, 1983, 1984, 3007, 3008, 10**7]
    got = [x.b for x in spark.createDataFrame([(x,) for x in p], "p bigint").select(trie.block_of(trie.F.col("p")).alias("b")).collect()]
    for x, b in zip(p, got, strict=True):
        assert (trie.block_end(b - 1) if b else 0) <= x < trie.block_end(b)


def test_small_tables(spark):
    assert check(spark, talk(5, "only", "one"))[0]
    check(spark, [("lone", 3, None, None, None, None, None)])
    check(spark, [(None, None, None, None, None, None, None), *talk(4, "a")])
    check(spark, talk(0, "a") * 2 + talk(1, "a"))  # repeated rows are turns of their own
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ids_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(trie, "RANGE_BITS", 2)
    ids = [-9, -1, 0, 3, 4, 8, 9, 10, 100, 2**40]
    rows = [(bytes([k % 3]), i) for k in range(9) for i in ids if (i + k) % 2 or k < 3]
    got = {x.node: x.ends_sha256 for x in trie.hash_of_ids(spark.createDataFrame(rows, "node binary, conv_id bigint").distinct()).collect()}
    for node in {n for n, _ in rows}:
        assert got[bytearray(node) if isinstance(next(iter(got)), bytearray) else node] == hashlib.sha256(",".join(map(str, sorted({i for n, i in rows if n == node}))).encode()).hexdigest()
