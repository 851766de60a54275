"""Recognized text against reference text: exact joins, fuzzy scores, greedy pairs, sequence diffs, bounded alignment.

Whatever depends on order within a page is a grouped function keyed by page, so a task holds one page at a time; exact
and anti joins, scores and summaries are plain DataFrame operations.
"""

from __future__ import annotations

import difflib
import heapq
import json
import unicodedata
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.work import by_page

GRAPHEME = regex.compile(r"\X")
# Dashes and closing marks at a line's end, the least scores of line pairs.
DASHES, CLOSING = "-–—‒⸺⸻", r"""[.,;:!?)\]}"']+$"""
PAIR_SCORE, PAIR_MIN, PAIR_MEAN, RECOVER_SCORE = 70, 50, 70, 90


def lcs_length(a: str, b: str, needed: int = 0) -> int:
    """Length of a longest common subsequence, by bits of one integer per character of b; 0 if it is less than needed."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for at in range(0, len(b), 32):
        if len(a) - row.bit_count() + len(b) - at < needed:
            return 0
        for c in b[at : at + 32]:
            match = row & masks.get(c, 0)
            row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def common_length(a: str, b: str, needed: int = 0) -> int:
    """lcs_length(), or some other length less than needed; equal ends are of some longest common subsequence, so only what is
    between them is compared."""
    head = _shared(a, b, str.startswith, lambda x, k: x[:k])
    a, b = a[head:], b[head:]
    tail = _shared(a, b, str.endswith, lambda x, k: x[len(x) - k :])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    return head + tail + (lcs_length(a, b, needed - head - tail) if a and b else 0)


def ratio(a: str | None, b: str | None) -> int:
    """Similarity from 0 to 100: twice the common subsequence over both lengths, rounded; 0 if either is empty."""
    if not a or not b:
        return 0
    return round(200 * common_length(a, b) / (len(a) + len(b)))


def _shared(a: str, b: str, has, part) -> int:
    """How many letters a and b share at one end."""
    low, high = 0, min(len(a), len(b))
    if low == high or not has(a, part(b, 1)):
        return 0
    while low < high:
        k = (low + high + 1) // 2
        low, high = (k, high) if has(a, part(b, k)) else (low, k - 1)
    return low


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """ratio() of two columns, in Arrow batches."""

    @F.pandas_udf("int")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="int32")

    return score(a, b)


def equal_lines(found: DataFrame, reference: DataFrame, page: str, line: str = "line_no", text: str = "text") -> DataFrame:
    """(page, line, reference line) of equal texts: the k-th of equal lines on one side meets the k-th on the other."""
    numbered = lambda df, name: df.select(page, text, F.col(line).alias(name), F.row_number().over(Window.partitionBy(page, text).orderBy(line)).alias("_k"))
    return numbered(found, line).join(numbered(reference, f"reference_{line}"), [page, text, "_k"]).drop("_k")


def orphans(found: DataFrame, reference: DataFrame, page: str, text: str = "text") -> DataFrame:
    """Reference lines whose text no line of the page has."""
    return reference.join(found.select(page, text).distinct(), [page, text], "left_anti")


def line_accuracy(words: DataFrame, line: list[str], word: str = "word", truth: str = "truth") -> DataFrame:
    """Per line: words, words with a reference, matches, mismatches and accuracy (1 without a reference)."""
    has = F.col(truth).isNotNull() & (F.col(truth) != "")
    same = has & (F.col(word) == F.col(truth))
    found = words.groupBy(*line).agg(F.count("*").alias("n_words"), F.count_if(has).alias("n_truth"), F.count_if(same).alias("n_match"))
    return found.withColumn("n_mismatch", F.col("n_truth") - F.col("n_match")).withColumn("accuracy", F.when(F.col("n_truth") > 0, F.col("n_match") / F.col("n_truth")).otherwise(F.lit(1.0)))


def neighbours(found: DataFrame, reference: DataFrame, page: str, line: str = "line_no", text: str = "text", reach: int = 1) -> DataFrame:
    """(page, line, text, reference line, truth): each line with the reference lines whose numbers are within reach of its own;
    they meet by page and number, so a page's pairs grow with its lines, not with their square."""
    at = F.explode(F.sequence(F.col(line) - reach, F.col(line) + reach)).alias(line)
    return found.select(page, line, text).join(reference.select(page, at, F.col(line).alias(f"reference_{line}"), F.col(text).alias("truth")), [page, line])


def greedy_pairs(scored: DataFrame, page: str, left: str, right: str, least: int = PAIR_SCORE) -> DataFrame:
    """One-to-one pairs of each page taken in order of score, then left, then right."""
    schema = scored.select(page, left, right, "score").schema

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["score"] >= least].sort_values(["score", left, right], ascending=[False, True, True])
        used: tuple[set, set] = (set(), set())
        keep = []
        for i, (x, y) in enumerate(zip(rows[left], rows[right], strict=True)):
            if x not in used[0] and y not in used[1]:
                used[0].add(x)
                used[1].add(y)
                keep.append(i)
        return rows.iloc[keep][schema.names]

    return scored.select(*schema.names).groupBy(page).applyInPandas(take, schema)


def mutual_best(scored: DataFrame, page: str, left: str, right: str, least: int = PAIR_SCORE) -> DataFrame:
    """Pairs that are each other's best; all in SQL, and a subset of greedy_pairs()."""
    rank = lambda key, other: F.row_number().over(Window.partitionBy(page, key).orderBy(F.desc("score"), other))
    return scored.where(F.col("score") >= least).withColumn("_a", rank(left, right)).withColumn("_b", rank(right, left)).where("_a = 1 and _b = 1").drop("_a", "_b")


def fresh(df: DataFrame) -> DataFrame:
    """df with columns of its own: two sides that come from one frame else lose columns when the plan is pruned."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _of_pages(found: DataFrame, reference: DataFrame, page: str, line: str, text: str, work, fields: dict[str, str]) -> DataFrame:
    """(page, fields): what work(texts, reference texts, line numbers, reference line numbers) gives for each page, as tuples.
    A page's lines are one row on either side, and many rows one batch."""
    whole = F.sort_array(F.collect_list(F.struct(line, text)))
    sides = ((found, "_a"), (fresh(reference), "_b"))
    a, b = (df.where(F.col(page).isNotNull()).groupBy(page).agg(whole.alias(name)) for df, name in sides)
    # what is of no page is one, which a join by page wouldn't find
    null_a, null_b = (df.where(F.col(page).isNull()).agg(whole.alias(name)) for df, name in sides)
    no_page = null_a.crossJoin(null_b).where((F.size("_a") > 0) | (F.size("_b") > 0)).select(F.lit(None).cast(found.schema[page].dataType).alias(page), "_a", "_b")
    both = a.join(b, page, "full").unionByName(no_page)

    @F.pandas_udf(", ".join(f"`{name}` array<{kind}>" for name, kind in fields.items()))
    def run(x: pd.Series, y: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        given = lambda v: [] if v is None else list(v)
        done = [work(*map(given, row)) for row in zip(x, y, xs, ys, strict=True)]
        return pd.DataFrame({name: [[row[k] for row in rows] for rows in done] for k, name in enumerate(fields)})

    return both.select(page, run(f"_a.{text}", f"_b.{text}", f"_a.{line}", f"_b.{line}").alias("_r")).select(page, F.inline(F.arrays_zip(*[f"_r.{name}" for name in fields])))


def diff_lines(found: DataFrame, reference: DataFrame, page: str, line: str = "line_no", text: str = "text") -> DataFrame:
    """(page, pos, op, a0, a1, b0, b1): the edit script of a page's lines against its reference lines."""

    def script(x: list, y: list, xs: list, ys: list) -> list[tuple]:
        return [(i, *op) for i, op in enumerate(difflib.SequenceMatcher(None, x, y).get_opcodes())]

    return _of_pages(found, reference, page, line, text, script, {"pos": "int", "op": "string", **dict.fromkeys(("a0", "a1", "b0", "b1"), "int")})


def match_lines(found: DataFrame, reference: DataFrame, page: str, line: str = "line_no", text: str = "text") -> DataFrame:
    """(page, line, reference line, score, how) by diff_lines(): equal runs in place, replaced runs in place if they are
    alike enough, else greedily by similarity, then what is left over by near equality."""
    return _of_pages(found, reference, page, line, text, _matched, {line: "int", f"reference_{line}": "int", "score": "int", "how": "string"})


def _matched(x: list[str], y: list[str], xs: list[int], ys: list[int]) -> list[tuple[int, int, int, str]]:
    out: list[tuple[int, int, int, str]] = []
    free_x, free_y = set(range(len(x))), set(range(len(y)))

    def add(i: int, j: int, score: int, how: str) -> None:
        free_x.discard(i)
        free_y.discard(j)
        out.append((xs[i], ys[j], score, how))

    def greedy(left, right, least: int, how: str) -> None:
        # lengths alone tell of most pairs that they score less
        small, other = {i: x[i].lower() for i in left}, {j: y[j].lower() for j in right}
        near = ((i, j) for i, p in small.items() for j, q in other.items() if p and q and round(200 * min(len(p), len(q)) / (len(p) + len(q))) >= least)
        for s, i, j in sorted(((ratio(small[i], other[j]), i, j) for i, j in near), key=lambda t: (-t[0], t[1], t[2])):
            if s >= least and i in free_x and j in free_y:
                add(i, j, s, how)

    for op, a0, a1, b0, b1 in difflib.SequenceMatcher(None, x, y).get_opcodes():
        if op == "equal":
            for i, j in zip(range(a0, a1), range(b0, b1), strict=True):
                add(i, j, 100, "equal")
        elif op == "replace":
            scores = [ratio(x[i], y[j]) for i, j in zip(range(a0, a1), range(b0, b1), strict=False)]
            if a1 - a0 == b1 - b0 and min(scores) >= PAIR_MIN and sum(scores) / len(scores) >= PAIR_MEAN:
                for i, j, s in zip(range(a0, a1), range(b0, b1), scores, strict=True):
                    add(i, j, s, "in place")
            else:
                greedy(range(a0, a1), range(b0, b1), PAIR_SCORE, "similar")
    greedy(sorted(free_x), sorted(free_y), RECOVER_SCORE, "displaced")
    return out


def displaced_words(found: list[str], truth: list[str]) -> list[tuple[str, int | None, int | None]]:
    """Word by word: ('equal' | 'replace' | 'delete' | 'insert', index, reference index)."""
    out: list[tuple[str, int | None, int | None]] = []
    for op, a0, a1, b0, b1 in difflib.SequenceMatcher(None, found, truth).get_opcodes():
        for k in range(max(a1 - a0, b1 - b0)):
            i, j = (a0 + k if a0 + k < a1 else None), (b0 + k if b0 + k < b1 else None)
            out.append((op if i is not None and j is not None else "delete" if j is None else "insert", i, j))
    return out


@dataclass(frozen=True)
class Policy:
    """Costs, limits and the least margin of an accepted alignment."""

    low_margin: float = 1.0
    max_merge: int = 2
    max_states: int = 20_000
    max_cells: int = 100_000
    match: float = 0.0
    substitute: float = 1.0
    source_only: float = 1.0
    target_only: float = 1.0


def comparison(text: str) -> list[str]:
    """Graphemes in normal form, case folded."""
    if text.isascii() and "\r" not in text:  # else a line's end may be one grapheme of two characters
        return list(text.lower())
    return [unicodedata.normalize("NFC", g).casefold() for g in GRAPHEME.findall(text)]


def edit_cost(a: tuple[str, ...], b: tuple[str, ...], policy: Policy) -> float:
    row = [j * policy.target_only for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i * policy.source_only
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + policy.source_only, row[j - 1] + policy.target_only, last + (policy.match if x == y else policy.substitute))
    return row[-1]


class Kept(dict):
    """Results by what they are of, at most 65,536; travels to the executors empty."""

    def __reduce__(self):
        return Kept, ()

    def add(self, key, value):
        if len(self) >= 1 << 16:
            self.clear()
        self[key] = value
        return value


_COMPARED, _COSTS = Kept(), Kept()


def _compared(text: str) -> tuple[str, ...]:
    return found if (found := _COMPARED.get(text)) is not None else _COMPARED.add(text, tuple(comparison(text)))


def _as_letters(tokens: list[tuple[str, ...]]) -> list[str]:
    """Tokens as strings of one character for each grapheme, other ones for other graphemes: costs ask only which are equal."""
    kinds = {g for t in tokens for g in t}
    if all(len(g) == 1 for g in kinds):
        return ["".join(t) for t in tokens]
    free = (c for c in map(chr, range(0x10FFFF, 0, -1)) if c not in kinds)
    letter = {g: g if len(g) == 1 else next(free) for g in kinds}
    return ["".join([letter[g] for g in t]) for t in tokens]


def unit_cost(a: tuple[str, ...] | str, b: tuple[str, ...] | str) -> int:
    """edit_cost() where a match is free and all else costs 1: a column of differences in the bits of two integers."""
    if not a or not b:
        return len(a) + len(b)
    if (known := _COSTS.get((a, b))) is not None:
        return known
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, cost = full, 0, len(a)
    for y in b:
        same = masks.get(y, 0)
        level = (((same & up) + up) ^ up) | same
        more, less = (down | ~(level | up)) & full, up & level
        cost += bool(more & top) - bool(less & top)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(same | down | more)) & full, more & (same | down) & full
    return _COSTS.add((a, b), cost)


def align(source: list[str], target: list[str], policy: Policy) -> dict:
    """The two cheapest monotonic alignments of two token sequences by one-to-one, one-to-many, many-to-one, source-only
    and target-only relations; accepted if nothing was cut short and the margin between the two is large enough.

    Only cells on ways within a bound are looked at: what is left of both sides costs at least what its graphemes differ by,
    with costs of 1 the edits from one to the other, which relations of tokens can only add to.
    The bound grows until two ways end within it, so that no way beyond it can be among the two."""
    a, b = [_compared(x) for x in source], [_compared(x) for x in target]
    n, m = len(a), len(b)
    reasons: list[str] = []
    if (n + 1) * (m + 1) > policy.max_states:
        reasons.append("state_limit_exhausted")
    if max((len(x) for x in a), default=0) * policy.max_merge * max((len(y) for y in b), default=0) > policy.max_cells:
        reasons.append("grapheme_state_limit_exhausted")
    most = sum(map(len, a)) * policy.source_only + sum(map(len, b)) * policy.target_only
    if reasons:
        best = [("source_only", i, i + 1, 0, 0) for i in range(n)] + [("target_only", n, n, j, j + 1) for j in range(m)]
        return {"cost": most, "margin": None, "accepted": False, "reasons": reasons, "best": best, "second": []}
    unit = (policy.match, policy.substitute, policy.source_only, policy.target_only) == (0.0, 1.0, 1.0, 1.0)
    if unit:
        letters = _as_letters([*a, *b])
        a, b = letters[:n], letters[n:]
    least = _edits_left(a, b) if unit else _least_left(a, b, policy)
    slack = 0.0 if unit else 4.0 + 0.3 * least[0][0]
    while True:
        bound = least[0][0] + slack if least[0][0] + slack < most else float("inf")
        done = _unit_ways(a, b, policy.max_merge, least, bound) if unit else _ways(a, b, policy, least, bound)
        if len(done) > 1 or bound == float("inf"):
            break
        slack = slack * 2 or 1.0
    margin = done[1][0] - done[0][0] if len(done) > 1 else None
    if margin == 0:
        reasons.append("tie")
    if margin is not None and margin < policy.low_margin:
        reasons.append("low_margin")
    best, second = (way for _, way in (*done, (0.0, []))[:2])
    return {"cost": done[0][0], "margin": margin, "accepted": not reasons, "reasons": reasons, "best": best, "second": second}


def _edits_left(a: list[list[str]] | list[str], b: list[list[str]] | list[str]) -> list[list[int]]:
    """The edit distance of what is left from cell (i, j) on, all costs being 1: unit_cost() once from the end, read where
    tokens begin."""
    masks: dict[str, int] = {}
    size, cuts = 0, [0]
    for t in reversed(a):
        for g in reversed(t):
            masks[g] = masks.get(g, 0) | 1 << size
            size += 1
        cuts.append(size)
    cuts.reverse()
    full, wide = (1 << size) - 1, size // 8 + 1
    up, down, count = full, 0, 0
    counts, ups, downs = [0], [up.to_bytes(wide, "little")], [down.to_bytes(wide, "little")]
    for t in reversed(b):
        for y in reversed(t):
            same = masks.get(y, 0)
            level = (((same & up) + up) ^ up) | same
            more, less = (down | ~(level | up)) & full, up & level
            more, less = more << 1 | 1, less << 1
            up, down = (less | ~(same | down | more)) & full, more & (same | down) & full
        count += len(t)
        counts.append(count)
        ups.append(up.to_bytes(wide, "little"))
        downs.append(down.to_bytes(wide, "little"))
    bits = lambda x: np.unpackbits(np.frombuffer(b"".join(x), np.uint8).reshape(len(x), wide), axis=1, bitorder="little").view(np.int8)
    steps = np.zeros((len(counts), 8 * wide + 1), np.int32)
    np.cumsum(bits(ups) - bits(downs), axis=1, dtype=np.int32, out=steps[:, 1:])
    return (steps[::-1, cuts] + np.array(counts[::-1])[:, None]).T.tolist()


def _least_left(a: list[list[str]], b: list[list[str]], policy: Policy) -> list[list[float]]:
    """The least cost of what is left from cell (i, j) on, by how often each grapheme is left on both sides."""
    kinds = {g: k for k, g in enumerate(sorted({g for t in (*a, *b) for g in t}))}

    def left(x: list[list[str]]) -> np.ndarray:
        counts = np.zeros((len(x) + 1, len(kinds) + 1), dtype=np.int32)
        for i, t in enumerate(x):
            for g in t:
                counts[i, kinds[g]] += 1
        return counts[::-1].cumsum(axis=0)[::-1]

    more = left(a)[:, None, :] - left(b)[None, :, :]
    source, target = np.maximum(more, 0).sum(axis=2), np.maximum(-more, 0).sum(axis=2)
    pairs = np.minimum(source, target) * min(policy.substitute, policy.source_only + policy.target_only)
    return (pairs + np.maximum(source - target, 0) * policy.source_only + np.maximum(target - source, 0) * policy.target_only).tolist()


def _unit_ways(a: list[str], b: list[str], merge: int, least: list[list[int]], bound: float) -> list[tuple[float, list[tuple]]]:
    """_ways() where a match is free and all else costs 1: steps within the bound are found from the start, the costs of what is
    left from the end.  The second way leaves the best one once and is a best one from there on."""
    n, m = len(a), len(b)
    several = range(2, merge + 1)
    starts: list[dict[int, int]] = [{} for _ in range(n + 1)]
    starts[0][0] = 0
    steps: dict[tuple[int, int], list[tuple[int, str, int, int]]] = {}
    for i, row in enumerate(starts):
        if not row:
            continue
        j, last = min(row), max(row)
        while j <= last:
            if (so_far := row.get(j)) is None:
                j += 1
                continue
            found = steps[i, j] = []
            s, t, room = a[i] if i < n else "", b[j] if j < m else "", bound - so_far
            near = []
            if i < n:
                if j < m:
                    near.append(("one_to_one", i + 1, j + 1, s, t))
                    near += [("source_to_fragments", i + 1, j + k, s, "".join(b[j : j + k])) for k in several if j + k <= m and least[i + 1][j + k] <= room]
                    near += [("sources_to_one", i + k, j + 1, "".join(a[i : i + k]), t) for k in several if i + k <= n and least[i + k][j + 1] <= room]
                near.append(("source_only", i + 1, j, s, ""))
            if j < m:
                near.append(("target_only", i, j + 1, "", t))
            for kind, x, y, p, q in near:
                left = room - least[x][y]
                if left < abs(len(p) - len(q)):
                    continue
                cost = 0 if p == q else unit_cost(p, q) if p and q else len(p) + len(q)
                if cost <= left:
                    found.append((cost, kind, x, y))
                    to = starts[x]
                    if to.get(y, bound + 1) > so_far + cost or y not in to:
                        to[y] = so_far + cost
                        if x == i and y > last:
                            last = y
            j += 1
    end = (n, m)
    rest = {end: 0}
    for cell in reversed(steps):
        costs = [cost + rest[x, y] for cost, _, x, y in steps[cell] if (x, y) in rest]
        if costs:
            rest[cell] = min(costs)
    if rest.get((0, 0), bound + 1) > bound:
        return []

    def onward(i: int, j: int) -> list[tuple]:
        """The best way from a cell on, of equal ones the first in the order of the JSON."""
        way = []
        while (i, j) != end:
            _, item, x, y = min(_items(i, j))
            way.append(item)
            i, j = x, y
        return way

    def _items(i: int, j: int) -> list[tuple]:
        least_left = rest[i, j]
        return [(f'["{kind}", {i}, {x}, {j}, {y}]', (kind, i, x, j, y), x, y) for cost, kind, x, y in steps[i, j] if (x, y) in rest and cost + rest[x, y] == least_left]

    best = onward(0, 0)
    so_far, other = 0, None
    for at, (kind, i, x, j, y) in enumerate(best):
        own = f'["{kind}", {i}, {x}, {j}, {y}]'
        for cost, k, p, q in steps[i, j]:
            if (p, q) in rest and (k, p, q) != (kind, x, y):
                item = f'["{k}", {i}, {p}, {j}, {q}]'
                # of equal ways those before the best one come first, the sooner they leave it, then those that leave it last
                order = (so_far + cost + rest[p, q], item > own, -at if item > own else at, item)
                if other is None or order < other[0]:
                    other = order, at, (k, i, p, j, q)
        so_far += next(cost for cost, k, p, q in steps[i, j] if (k, p, q) == (kind, x, y))
    done = [(float(rest[0, 0]), best)]
    if other and other[0][0] <= bound:
        (cost, *_), at, item = other
        done.append((float(cost), [*best[:at], item, *onward(item[2], item[4])]))
    return done


def _ways(a: list[tuple[str, ...]], b: list[tuple[str, ...]], policy: Policy, least: list[list[float]], bound: float) -> list[tuple[float, list[tuple]]]:
    """(cost, relations) of the two best ways that cost no more than bound, ties in the order of the relations' JSON."""
    n, m = len(a), len(b)
    joined = lambda x: [[tuple(g for t in x[i : i + k] for g in t) for k in range(policy.max_merge + 1)] for i in range(len(x) + 1)]
    from_a, from_b = joined(a), joined(b)
    steps = [("one_to_one", 1, 1), *(("source_to_fragments", 1, k) for k in range(2, policy.max_merge + 1)), *(("sources_to_one", k, 1) for k in range(2, policy.max_merge + 1)), ("source_only", 1, 0), ("target_only", 0, 1)]
    rows: list[dict[int, list[tuple[float, str]]]] = [{} for _ in range(n + 1)]
    rows[0][0] = [(0.0, "")]
    for i in range(n + 1):
        row, rows[i] = rows[i], {}
        for j in range(m + 1):
            if j not in row:
                continue
            here = heapq.nsmallest(2, row[j])
            if (i, j) == (n, m):
                return [(cost, [tuple(x) for x in json.loads(f"[{way}]")]) for cost, way in here]
            for kind, p, q in steps:
                x, y = i + p, j + q
                if x > n or y > m:
                    continue
                s, t = from_a[i][p], from_b[j][q]
                room = bound - least[x][y] - here[0][0] + 1e-9
                if room < (len(s) - len(t)) * policy.source_only or room < (len(t) - len(s)) * policy.target_only:
                    continue
                cost = edit_cost(s, t, policy)
                if cost > room:
                    continue
                item = f'["{kind}", {i}, {x}, {j}, {y}]'
                cell = (row if x == i else rows[x]).setdefault(y, [])
                cell += [(total + cost, f"{way}, {item}" if way else item) for total, way in here if total + cost + least[x][y] <= bound + 1e-9]
    return []


RELATION = "array<struct<kind:string,s0:int,s1:int,t0:int,t1:int>>"


def match_documents(source: DataFrame, target: DataFrame, doc: str, pos: str = "pos", text: str = "text", policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """(doc, cost, margin, accepted, reasons, best, second) of every document's two token sequences."""
    given = asdict(policy)
    side = lambda df, x: df.select(doc, F.struct(F.col(pos).alias("pos"), F.col(text).alias("text")).alias("_t"), F.lit(x).alias("_side"))
    tokens = lambda x: F.transform(F.sort_array(F.collect_list(F.when(F.col("_side") == x, F.col("_t")))), lambda t: t["text"])
    both = by_page(side(source, 0).union(side(fresh(target), 1)), doc).groupBy(doc).agg(tokens(0).alias("_a"), tokens(1).alias("_b"))

    @F.pandas_udf(f"cost double, margin double, accepted boolean, reasons array<string>, best {RELATION}, second {RELATION}")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        limits = Policy(**given)
        shape = lambda path: [dict(zip(("kind", "s0", "s1", "t0", "t1"), r, strict=True)) for r in path]
        rows = []
        for a, b in zip(x, y, strict=True):
            found = align(list(a), list(b), limits)
            rows.append({**found, "best": shape(found["best"]), "second": shape(found["second"])})
        return pd.DataFrame(rows, columns=["cost", "margin", "accepted", "reasons", "best", "second"])

    return both.select(doc, run("_a", "_b").alias("_m")).select(doc, "_m.*")


def project_spans(spans: DataFrame, tokens: DataFrame, page: str) -> DataFrame:
    """Spans (start, end) cut at the bounds of the tokens (token_start, token_end) that they overlap."""
    hit = (F.col("start") < F.col("token_end")) & (F.col("token_start") < F.col("end"))
    return spans.join(tokens, page).where(hit).withColumn("start", F.greatest("start", "token_start") - F.col("token_start")).withColumn("end", F.least("end", "token_end") - F.col("token_start"))



def soft_wrap(found: Column, truth: Column) -> Column:
    """Whether a line's last word may be the start of its reference's last word, cut at the line's end without a hyphen:
    two letters or more, closing marks aside, and shorter than the other."""
    last = lambda c: F.regexp_extract(c, r"(\S+)\s*$", 1)
    core = lambda c: F.lower(F.regexp_replace(last(c), CLOSING, ""))
    longer = F.length(core(truth)) > F.length(core(found))
    return F.coalesce(~last(found).rlike(f"[{DASHES}]$") & (F.length(core(found)) >= 2) & longer & F.startswith(core(truth), core(found)), F.lit(False))


def truth_of_found(words: DataFrame, page: str, line: str = "line_no", pos: str = "word_no", text: str = "word", truth: str = "truth") -> DataFrame:
    """(page, truth): the reference words of the words that have a text, spaces between words, line ends between lines."""
    kept = words.where((F.col(text) != "") & (F.col(truth) != "")).groupBy(page, line).agg(F.sort_array(F.collect_list(F.struct(pos, truth))).alias("_w"))
    joined = kept.select(page, line, F.array_join(F.transform("_w", lambda x: x[truth]), " ").alias("_line"))
    ordered_lines = F.sort_array(F.collect_list(F.struct(line, "_line")))
    return joined.groupBy(page).agg(F.array_join(F.transform(ordered_lines, lambda x: x["_line"]), "\n").alias(truth))


def hyphen_variants(previous: str, line: str, longest: int = 12) -> list[str]:
    """What a line may read as if a word was cut at its start or end: with the tail of the line before, or without its own
    last letters, with and without a hyphen or dash."""
    out = [line]
    tail = previous.rstrip("-—").rsplit(" ", 1)[-1]
    out += [tail[-k:] + line for k in range(1, min(longest, len(tail)) + 1)]
    last = line.rsplit(" ", 1)[-1]
    for j in range(1, min(longest, len(last))):
        out += [line[:-j], line[:-j] + "-", line[:-j] + "—"]
    return list(dict.fromkeys(out))


def best_variant(found: str, previous: str, line: str) -> tuple[int, str]:
    """(score, variant): the first of the best; letters' case is set aside only where that scores higher."""
    best = (-1, line)
    small = found.lower()
    most = lambda x, y: round(200 * min(len(x), len(y)) / (len(x) + len(y))) if x and y else 0
    for v in hyphen_variants(previous, line):
        low = v.lower()
        if max(most(found, v), most(small, low)) <= best[0]:  # lengths alone tell that it scores no higher
            continue
        exact = ratio(found, v)
        folded = exact if small == found and low == v else ratio(small, low)
        score = folded if folded > exact else exact
        if score > best[0]:
            best = (score, v)
    return best


def combined_words(found: list[str], truth: list[str], longest: int = 4, least: int = PAIR_SCORE) -> list[tuple[int, int, int]]:
    """(first, last + 1, reference index): runs of found words that read as one reference word, best first, none twice."""
    options = []
    for i in range(len(found)):
        for j in range(i + 2, min(len(found), i + longest) + 1):
            text = "".join(found[i:j])
            for k, word in enumerate(truth):
                if (s := ratio(text, word)) >= least and s > max(ratio(x, word) for x in found[i:j]):
                    options.append((-s, i, j, k))
    used: set[int] = set()
    taken: set[int] = set()
    out = []
    for _, i, j, k in sorted(options):
        if k not in taken and not used & set(range(i, j)):
            used |= set(range(i, j))
            taken.add(k)
            out.append((i, j, k))
    return sorted(out)


SOFT_HYPHEN = "­"
FOLDS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "‐": "-", "‑": "-"}


def comparison_view(text: str, casefold: bool = True) -> tuple[list[str], list[int], list[tuple[int, str]]]:
    """(graphemes to compare, source grapheme of each, what was done at which source grapheme)."""
    view, source, log = [], [], []
    for i, g in enumerate(GRAPHEME.findall(text)):
        if g == SOFT_HYPHEN:
            log.append((i, "soft_hyphen_removed"))
            continue
        n = unicodedata.normalize("NFC", g)
        if n != g:
            log.append((i, "nfc"))
        if n in FOLDS:
            n = FOLDS[n]
            log.append((i, "punctuation_folded"))
        if casefold and n != n.casefold():
            n = n.casefold()
            log.append((i, "casefolded"))
        view.append(n)
        source.append(i)
    return view, source, log


def comparison_text(c: Column) -> Column:
    """comparison_view() of a column as one string."""

    @F.pandas_udf("string")
    def view(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else "".join(comparison_view(t)[0]))

    return view(c)


def project_relations(words: DataFrame, matched: DataFrame, targets: DataFrame, doc: str) -> DataFrame:
    """words (doc, pos, ...) with truth from the accepted one-to-one and many-to-one relations of match_documents(); targets
    are (doc, pos, text)."""
    relation = matched.where("accepted").select(doc, F.explode("best").alias("r")).where(F.col("r.kind").isin("one_to_one", "sources_to_one"))
    relation = relation.select(doc, F.col("r.kind").alias("_kind"), F.explode(F.sequence(F.col("r.s0"), F.col("r.s1") - 1)).alias("pos"), F.col("r.t0").alias("_t"))
    truth = targets.select(doc, F.col("pos").alias("_t"), F.col("text").alias("truth"))
    return words.join(relation.join(truth, [doc, "_t"]), [doc, "pos"], "left").drop("_t").withColumnRenamed("_kind", "relation")
