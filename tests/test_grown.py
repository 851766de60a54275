"""Blocks grown from words move and write no words, and equal what every pair of words gives."""

import random

import __spark_entry__ as e
import numpy as np
import pytest

from quire.operators import lines, seeded


@pytest.mark.parametrize("name", ["columns_expanded", "columns_merged"])
def test_only_whole_texts_are_shuffled(spark, name):
    plan = e.queries()[name](spark, e.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert [x for x in plan.splitlines() if "Exchange hash" in x and "REPARTITION_BY_NUM" not in x] == []


@pytest.mark.parametrize("name", ["row_blocks_grown", "row_blocks_chosen", "words_grown_to_blocks"])
def test_no_words_are_written(spark, name, monkeypatch):
    written, settle = [], seeded.settle
    monkeypatch.setattr(seeded, "settle", lambda df: written.append(df.columns) or settle(df))
    plan = e.queries()[name](spark, e.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert written in ([], [["page", "_rx", "_ry", "_band"]])
    # a page isn't one frame of pandas, and no word is dealt again: only what is known of pages and runs
    assert "FlatMapGroupsInPandas" not in plan and not [x for x in plan.splitlines() if "Exchange hash" in x and any(f"{c}#" in x for c in ("line_no", "_cx", "block"))]


def gap_of_pairs(rows, most):
    found = []
    for i, (l0, t0, r0, b0) in enumerate(rows):
        near = [max(l1 - r0, 0.0) for j, (l1, t1, _, b1) in enumerate(rows) if j != i and l1 >= l0 and abs((t1 + b1) / 2 - (t0 + b0) / 2) <= 1.5 * max(b1 - t1, b0 - t0)]
        found += [min(g for g in near)] if [g for g in near if g <= most] else []
    return float(np.median(found)) if found else None


@pytest.mark.parametrize("seed", range(30))
def test_middle_gap_equals_every_pair(seed):
    r = random.Random(seed)
    rows = []
    for _ in range(r.randint(1, 80)):
        x, y = r.choice([0, 0, 40, 300]) + r.randint(0, 30) * 7, r.randint(0, r.choice([1, 5, 20])) * 11
        rows.append((float(x), float(y), float(x + r.randint(0, 50)), float(y + r.choice([0, 8, 12, 40]))))
    most = float(r.choice([0, 20, 80]))
    assert seeded._middle_gap(*(np.array(c) for c in zip(*rows, strict=True)), most) == gap_of_pairs(rows, most)


def test_words_grow_as_every_pair_does(spark):
    r = random.Random(8)
    rows = [(p, n, w, x := float(40 * w + r.randint(0, 30) + r.choice([0, 0, 90])), y := 22.0 * n + r.randint(0, 9), x + r.randint(5, 40), y + 12) for p in range(6) for n in range(r.randint(1, 14)) for w in range(r.randint(1, 40))]
    got = {(x.page, x.line_no, x.word_no): x.block for x in lines.grown_blocks(spark.createDataFrame(rows, "page int, line_no int, word_no int, l double, t double, r double, b double"), "page", ["line_no", "word_no"], 12.0, 9.0).collect()}
    want = {}
    for p in range(6):
        words = sorted(x[1:] for x in rows if x[0] == p)
        root = list(range(len(words)))
        changed = True
        while changed:
            changed = False
            for i, a in enumerate(words):
                for j, b in enumerate(words):
                    if max(b[2] - a[4], a[2] - b[4]) <= 12 and max(b[3] - a[5], a[3] - b[5]) <= 9 and root[i] < root[j]:
                        root[j], changed = root[i], True
        names = {}
        want |= {(p, *w[:2]): names.setdefault(root[i], len(names)) for i, w in enumerate(words)}
    assert got == want and max(want.values()) > 3


def test_pages_of_one_wide_word_or_of_many_meet_in_parts(monkeypatch):
    r = random.Random(4)
    n = 400
    left, up = np.array([r.choice([0.0, 500.0]) + 45 * (k % 9) for k in range(n)]), np.array([22.0 * (k // 9) + r.randint(0, 3) for k in range(n)])
    box = [left, up, left + np.array([r.randint(10, 60) for _ in range(n)]), up + 12]
    box[2][7] = 5000.0
    box[0][11] = np.nan
    new = np.array([r.random() < 0.2 for _ in range(n)])
    whole = seeded.joined_words(box, new, 9.0, 4.0)
    monkeypatch.setattr(seeded, "PAIRS", 37)
    assert seeded.joined_words(box, new, 9.0, 4.0).tolist() == whole.tolist() and len(set(whole.tolist())) > 5
    assert seeded.joined_words([np.zeros(0)] * 4, np.zeros(0, bool), 1.0, 1.0).tolist() == []


@pytest.mark.parametrize("name", ["row_blocks_grown", "words_grown_to_blocks"])
def test_a_page_is_one_row_and_meets_nothing(spark, name):
    plan = e.queries()[name](spark, e.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "checkpoint" not in plan.lower()


def test_sizes_of_blocks(spark):
    rows = [(p, n, w, 40.0 * w + 300 * (n % 3), 22.0 * n, 40.0 * w + 300 * (n % 3) + 30, 22.0 * n + 12) for p in (1, 2, None) for n in range(9) for w in range(4)]
    df = spark.createDataFrame(rows, "page int, line_no int, word_no int, l double, t double, r double, b double")
    words, got = {}, lines.grown_sizes(df, "page", ["line_no", "word_no"], 12.0, 9.0)
    for x in lines.grown_blocks(df, "page", ["line_no", "word_no"], 12.0, 9.0).collect():
        words.setdefault((x.page, x.block), []).append((x.line_no, x.word_no))
    assert {(x.page, x.block): (x.n_words, x.line_no, x.word_no) for x in got.collect()} == {k: (len(v), *min(v)) for k, v in words.items()}


def test_words_are_made_once_to_be_merged(spark):
    plan = e.queries()["columns_merged"](spark, e.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert sum("posexplode(_words" in x for x in plan.splitlines()) == 1
