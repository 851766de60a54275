"""Queries without a SQL twin against brute force over whole texts: long lines, many lines."""

import random
from collections import Counter

import pytest

from quire.operators import matching
from quire.plans import QUERIES
from quire.plans.base import word_boxes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(n))
    start = words(60)
    rows = [(3, "\n".join([f"{start} {words(40)}", f"{start} {words(40)}", *(words(12) for _ in range(9))])), (4, "\n".join(words(n) for n in (5, 300, 40, 7, 260, 30, 9)))]
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    return d, dict(rows)


def test_fuzzy_lines_compare_whole_lines(spark, folder):
    d, texts = folder
    want = []
    for doc, text in texts.items():
        found = text.split("\n")
        truth = {j: x + " x" if (doc + j) % 5 == 2 else x for j, x in enumerate(found) if (doc + j) % 7 != 3}
        scored = sorted((-matching.ratio(x, y), i, j) for i, x in enumerate(found) for j, y in truth.items() if abs(i - j) <= 1)
        left, right = set(), set()
        for s, i, j in scored:
            if -s >= matching.PAIR_SCORE and i not in left and j not in right:
                left.add(i)
                right.add(j)
                want.append((doc, i, j, -s))
    got = [(x.doc_id, x.line_no, x.reference_line_no, x.score) for x in QUERIES["truth_fuzzy_lines"](spark, d).collect()]
    assert sorted(got) == sorted(want) and (3, 1, 1, 100) in got


def test_blocks_grow_over_all_lines(spark, folder):
    d, texts = folder
    want = []
    for doc in texts:
        boxes = sorted(word_boxes(spark, d).where(f"doc_id = {doc}").collect(), key=lambda x: (x.line_no, x.word_no))
        block = list(range(len(boxes)))
        for i, a in enumerate(boxes):
            for j, b in enumerate(boxes[:i]):
                if max(a.l - b.r, b.l - a.r) <= 30 and max(a.t - b.b, b.t - a.b) <= 15 and block[i] != block[j]:
                    old, new = max(block[i], block[j]), min(block[i], block[j])
                    block = [new if x == old else x for x in block]
        names = {x: k for k, x in enumerate(dict.fromkeys(block))}
        n, first = Counter(names[x] for x in block), {}
        for x, box in zip(block, boxes, strict=True):
            first.setdefault(names[x], box.line_no)
        want += [(doc, k, n[k], first[k]) for k in n]
    got = [(x.doc_id, x.block, x.n_words, x.first_line) for x in QUERIES["words_grown_to_blocks"](spark, d).collect()]
    assert sorted(got) == sorted(want)
    assert sum(x[2] for x in got) == sum(len(t.split()) for t in texts.values())


def plain_best(a, b):
    """The least cost over all monotonic alignments, by every cell and plain edit distances."""

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, q in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
        return row[-1]

    cost = {(0, 0): 0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = [cost[i - p, j - q] + distance("".join(a[i - p : i]), "".join(b[j - q : j])) for p, q in ((1, 1), (1, 2), (2, 1), (1, 0), (0, 1)) if i >= p and j >= q]
            if ways:
                cost[i, j] = min(ways)
    return cost[len(a), len(b)]


def test_whole_lines_are_aligned(spark, folder):
    d, texts = folder
    got = {x.line: x for x in QUERIES["match_documents"](spark, d).collect()}
    assert len(got) == sum(len(t.split("\n")) for t in texts.values())
    for doc, text in texts.items():
        for i, line in enumerate(text.split("\n")):
            a = line.lower().split()
            b = [x + "e" if k % 4 == 1 else x for k, x in enumerate(a) if k % 5 != 3]
            x = got[f"{doc}:{i}"]
            if (len(a) + 1) * (len(b) + 1) > matching.Policy.max_states:
                assert x.reasons == "state_limit_exhausted" and not x.accepted
            else:
                assert x.cost == plain_best(a, b)


def test_search_by_bound_finds_the_two_best_ways():
    r = random.Random(3)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 4)))
    for turn in range(120):
        a = [word() for _ in range(r.randint(0, 3))]
        b = [word() for _ in range(r.randint(0, 3))]
        policy = matching.Policy() if turn % 2 else matching.Policy(substitute=1.75, source_only=0.5, target_only=1.0)
        ways = []

        def go(i, j, total, path, a=a, b=b, policy=policy, ways=ways):
            if (i, j) == (len(a), len(b)):
                ways.append((total, path))
            for kind, p, q in (("one_to_one", 1, 1), ("source_to_fragments", 1, 2), ("sources_to_one", 2, 1), ("source_only", 1, 0), ("target_only", 0, 1)):
                x, y = i + p, j + q
                if x <= len(a) and y <= len(b):
                    cost = matching.edit_cost(tuple("".join(a[i:x])), tuple("".join(b[j:y])), policy)
                    go(x, y, total + cost, [*path, (kind, i, x, j, y)])

        go(0, 0, 0.0, [])
        costs = sorted(x for x, _ in ways)
        found = matching.align(a, b, policy)
        assert found["cost"] == costs[0] and (float(costs[0]), found["best"]) in [(x, p) for x, p in ways]
        assert found["margin"] == (costs[1] - costs[0] if len(costs) > 1 else None)
