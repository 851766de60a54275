import hashlib
import random
import re

import pytest

from quire.llm import fim

SCHEMA = "text string, doc_id bigint, n string, form string"
TEXTS = ["", None, "a", " ", "  ab  ", "it's <P> marked", "<S>", "x<M", "a<S" * 40, "é日本 x1y2\n\n\tz", "nospaceatall" * 50, "word " * 5000, "-" * 300, "A\x00b\x01c", "ab cd ef " * 7]


def brute(text, doc_id):
    """The contract, token by token."""
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows):
    made = fim.transform(spark.createDataFrame(rows, SCHEMA)).withColumn("restored", fim.restore(fim.F.col("output"), fim.F.col("form"))).collect()
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=key) == sorted((brute(t, d) for t, d, *_ in rows), key=key)
    assert all(r.restored == r.text for r in made)
    return made


def test_equals_the_tokens_one_by_one(spark):
    r = random.Random(4)
    texts = TEXTS + ["".join(r.choice(["a", "Zz", " ", "  ", "\n", "é", "日", "1", "<", "P", ">", "<S", "the "]) for _ in range(r.randint(0, 40))) for _ in range(400)]
    made = check(spark, [(t, i * 3 + k, "x", "plain") for k in range(3) for i, t in enumerate(texts)])
    assert {x.form for x in made} == {"plain", "psm", "spm"}


def test_nulls_repeats_and_no_rows(spark):
    check(spark, [("a b", None, None, None), (None, None, None, None), ("same text", 7, "x", "y"), ("same text", 7, "x", "y")])
    assert fim.transform(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_texts_are_split_in_parts(monkeypatch):
    text = "ab1 " * 30 + "x" * 90 + "é-" * 40 + "long" * 20
    split = fim.splitter()
    want = [m.start() for m in re.finditer(fim.PATTERN, text)]
    for cut in (1, 7, 50, 10_000):
        monkeypatch.setattr(fim, "CUT", cut)
        assert fim.starts(text, split).tolist() == want


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_slices_change_nothing(spark, monkeypatch, size):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(fim, "SLICE_BYTES", size)
    texts = pa.array(TEXTS)
    ranks = np.arange(len(TEXTS)) * 977
    parts = list(fim._slices(np.array([len((t or "").encode()) for t in TEXTS])))
    assert [x for a, b in parts for x in range(a, b)] == list(range(len(TEXTS)))
    got = [fim.ranked_offsets(texts.slice(a, b - a), [ranks[a:b]], fim.splitter()) for a, b in parts]
    n, place = np.concatenate([x[0] for x in got]), np.concatenate([x[1][0] for x in got])
    for k, t in enumerate(TEXTS):
        tokens = re.findall(fim.PATTERN, t or "")
        assert n[k] == len(tokens) and place[k] == len("".join(tokens[: ranks[k] % (len(tokens) + 1)]))
