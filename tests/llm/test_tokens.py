import bisect
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import packing, token_codec, tokens

SCHEMA = "text string, doc_id bigint, piece string, ids string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


TEXTS = ["", None, "a", "it's  a\n\n test, don't\tstop 123 ½x ²", "word " * 9000, "  lead", "trail  ", "<|endoftext|>", "éè ñ x y", "\x1c\x1d a\x85b", "x\n\n\n", "日本語 テスト", "_under_ __x", "\n", " \n ", "re's 'tis 'S"]


def test_encoder_equals_the_library(tokenizer):
    r = random.Random(5)
    alphabet = "aab  \n\t'st'revd12½²́é_,.-<|>  \x1c\x85Ⅷ日"
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    with open(tokens.default_path(), encoding="utf-8") as f:
        enc = tokens.Encoder(f.read(), memo_entries=200)
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def whole_ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def test_code_lengths_are_optimal_and_limited():
    r = np.random.default_rng(1)
    counts = np.concatenate([[0, 10**9, 0], r.integers(0, 1000, 300)])
    for limit in (9, 12, 18):
        lengths = token_codec.code_lengths(counts, limit).astype(int)
        assert lengths.max() <= limit and ((lengths > 0) == (counts > 0)).all()
        assert sum(2.0 ** -lengths[lengths > 0]) == 1
    import heapq

    heap = [(int(c), 0) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[0], heapq.heappop(heap)[0]
        cost += a + b
        heapq.heappush(heap, (a + b, 0))
    assert (token_codec.code_lengths(counts, 40).astype(int) * counts).sum() == cost


def test_block_round_trip():
    r = np.random.default_rng(2)
    blocks = [r.zipf(1.3, n).clip(0, 5000).astype(np.uint32) for n in (1, 255, 256, 257, 5000)]
    lengths = token_codec.code_lengths(np.bincount(np.concatenate(blocks)))
    codes = token_codec.canonical_codes(lengths)
    bits, marks = zip(*(token_codec.encode_ids(b, lengths, codes) for b in blocks), strict=True)
    for a, b in zip(blocks, token_codec.decode_blocks(list(bits), list(marks), [len(b) for b in blocks], token_codec.decode_table(lengths)), strict=True):
        assert (a == b).all()


def test_files_round_trip(spark, tokenizer):
    rows = [(t, i * 7 % 16, "p", "x") for i, t in enumerate(TEXTS)] + [("same", 3, None, None)] * 2
    got = token_codec.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted((d, len(i := whole_ids(tokenizer, t)), zlib.crc32(i.tobytes())) for t, d, *_ in rows)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    before = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == before
        before += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(r[1] for r in rows)


def test_files_of_no_rows(spark):
    assert token_codec.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def valid(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing_places_every_piece(spark, tokenizer):
    rows = [(t, i, "p", "x") for i, t in enumerate(TEXTS)] + [("same", 3, None, None)] * 40
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert valid(got, 2048) == -(-sum(r.length for r in got) // 2048)
    want = []
    for t, d, *_ in rows:
        ids = whole_ids(tokenizer, t)
        want += [(d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def best_fit_decreasing(lengths, capacity):
    """Bins, document by document."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return len(rooms)


def test_cells_split_a_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 7)
    got = packing.pack(spark.range(500).select("id", F.when(F.col("id") < 300, 9).otherwise(F.col("id") % 13 + 1).cast("long").alias("length")), ["id"], capacity=20).collect()
    plan = packing.local_search(packing.one_length_a_bin(Counter(r.length for r in got), 20), 20)
    assert len({r.id for r in got}) == len(got) == 500 and valid(got, 20) == sum(plan.values())


def same_documents(plan, counts, capacity):
    held = Counter()
    for p, n in plan.items():
        assert n > 0 and sum(s * k for s, k in p) <= capacity
        for s, k in p:
            held[s] += k * n
    return held == Counter(counts)


@pytest.mark.parametrize(("low", "high", "count"), [(10, 60, 120), (1, 40, 500), (15, 55, 2000), (30, 50, 400), (51, 99, 50)])
def test_exchanges_do_the_packing(low, high, count):
    """The search empties bins of a cheap fill, and needs hardly more bins than best-fit decreasing."""
    r = random.Random(3)
    for _ in range(20):
        counts = Counter(r.randint(low, high) for _ in range(count))
        first = packing.one_length_a_bin(counts, 100)
        assert same_documents(first, counts, 100)
        before = sum(first.values())
        squares = sum(packing._fill(p) ** 2 * n for p, n in first.items())
        plan = packing.local_search(first, 100)
        assert same_documents(plan, counts, 100)
        bound = -(-sum(s * n for s, n in counts.items()) // 100)
        fit = best_fit_decreasing(counts.elements(), 100)
        bins = sum(plan.values())
        assert sum(packing._fill(p) ** 2 * n for p, n in plan.items()) >= squares
        assert bound <= bins <= before and bins <= 1.05 * fit + 2
        if high <= 60 and low < 30:
            assert bins < before


def test_bins_empty_by_exchanges_only():
    bad = Counter({((60, 1), (30, 1)): 1, ((50, 1), (40, 1)): 1, ((10, 2),): 1})
    assert sum(packing.local_search(bad, 100).values()) == 2
    assert sum(packing.local_search(packing.one_length_a_bin({700: 1000, 650: 900}, 2048), 2048).values()) == 725
    assert sum(packing.local_search(Counter({((60, 1), (30, 1)): 1, ((50, 1), (40, 1)): 1, ((10, 2),): 1}), 100, exchanges=0).values()) == 3


def test_equal_ids_have_one_order(spark):
    rows = [("b", 1, None, None), ("a", 1, None, None), ("a", 1, None, None), ("c " * 3000, 1, None, None)]
    runs = [[tuple(x) for x in sorted(token_codec.round_trip(spark.createDataFrame(part, SCHEMA)).collect())] for part in (rows, rows[::-1])]
    assert runs[0] == runs[1]


def test_the_memo_is_bounded_and_keeps_what_is_met_often(tokenizer):
    with open(tokens.default_path(), encoding="utf-8") as f:
        enc = tokens.Encoder(f.read(), memo_entries=300, slice_bytes=2000)
    texts = [f"the quick fox w{i}x, and the dog y{i}z." for i in range(3000)]
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(enc.pieces) < 1000 and " quick" in enc.pieces.to_pylist()
    assert len(enc.pool) < 4000


def test_texts_of_more_than_a_slice(tokenizer):
    with open(tokens.default_path(), encoding="utf-8") as f:
        enc = tokens.Encoder(f.read(), slice_bytes=500)
    texts = ["word, " * 400 + "end", "", "a b" * 90, None, "\n\nx" * 500]
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids
