import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import pieces

SCHEMA = "text string, doc_id bigint, ids string, n_tokens string"
TEXTS = ["", None, " ", "   ", "a", " a", "a ", "  a  b ", "▁", "▁a▁ b", "a ▁b▁▁ ", "x\x01y z", "tab\tline\r\n\n x", "ﬁ ½ é 日本 🙂", "\x00", "<s> </s> <unk> <0x0A>", "word " * 4000, "z" * 3000, "a    b" * 50]


@pytest.fixture(scope="module")
def sp():
    with open(pieces.default_path(), "rb") as f:
        return pieces.processor(f.read())


@pytest.fixture(scope="module")
def encoder():
    with open(pieces.default_path(), "rb") as f:
        return pieces.Encoder(f.read())


def made_up(seed, count):
    r = random.Random(seed)
    parts = ["a", "the", " ", "  ", "    ", "\n", "▁", "é", "日", "🙂", "12", ".", "<s>", "\x01", "tion", "ing ", " un"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(count)]


@pytest.mark.parametrize("size", [1, 100, 16 << 20])
def test_ids_are_the_library_s(sp, encoder, monkeypatch, size):
    monkeypatch.setattr(pieces, "SLICE_BYTES", size)
    texts = TEXTS + made_up(1, 2000)
    assert encoder.cut
    got = list(encoder.encode(pa.array(texts, pa.string())))
    assert len(got) == len(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == sp.encode(text or ""), repr(text)


@pytest.mark.parametrize("size", [1, 3, 1 << 18])
def test_texts_are_the_library_s(sp, monkeypatch, size):
    monkeypatch.setattr(pieces, "SLICE_IDS", size)
    kinds = pieces.kinds_of(sp)
    r = random.Random(3)
    for text in TEXTS + made_up(2, 1000):
        ids = [1, *sp.encode(text or ""), 2]
        assert pieces.decode_ids(sp, np.array(ids, np.uint32), kinds) == sp.decode(ids), repr(text)
    for _ in range(300):  # ids that no text has
        ids = [r.randrange(sp.vocab_size()) for _ in range(r.randint(0, 12))]
        assert pieces.decode_ids(sp, np.array(ids, np.uint32), kinds) == sp.decode(ids), ids


def test_round_trip_of_rows(spark, sp):
    rows = [(t, i, "x", "y") for i, t in enumerate(TEXTS)] + [("same", 3, None, None)] * 2 + [("no id", None, None, None)]
    ids = pieces.encode(spark.createDataFrame(rows, SCHEMA))
    got = pieces.decode(ids, keep=("n_tokens", "ids")).collect()
    key = lambda x: repr(x)
    want = []
    for t, d, *_ in rows:
        x = [1, *sp.encode(t or ""), 2]
        want.append((d, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), sp.decode(x)))
    assert sorted(((r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), r.decoded) for r in got), key=key) == sorted(want, key=key)
    assert pieces.encode(spark.createDataFrame([], SCHEMA)).collect() == []
    nothing = pieces.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids binary")).collect()
    assert [tuple(x) for x in nothing] == [(1, None)]


def test_another_kind_of_model_takes_whole_texts(encoder, monkeypatch):
    """A normalizer that changes a probe, or a piece with a mark inside, switches chunks off."""

    class Other:
        def __init__(self, sp, pieces_):
            self.sp, self.pieces = sp, pieces_

        def __getattr__(self, name):
            return getattr(self.sp, name)

        def id_to_piece(self, k):
            return self.pieces.get(k, self.sp.id_to_piece(k))

    assert pieces.cuts(encoder.sp)
    assert not pieces.cuts(Other(encoder.sp, {5000: "a▁b"}))
    monkeypatch.setattr(pieces, "PROBES", ["▁ a"])
    assert pieces.cuts(encoder.sp)
    other = Other(encoder.sp, {})
    other.normalize = lambda x: x.lower()
    assert not pieces.cuts(other)
