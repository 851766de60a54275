"""Pairs of alike texts within a page, and one-to-one choices among them.

Texts a and b are alike if ratio(a, b) >= least, that is if their longest common subsequence L has 200 * L / (|a| + |b|)
of at least `least` when rounded.  A page's texts are a row of arrays, many pages an Arrow batch, and no pair is a row before
it is known to be alike.  All pairs of a page whose lengths allow it are looked at, as numbers in blocks of bounded size:

- letters of a common subsequence are common letters, so a and b share at least L letters, counted as often as they occur;
  64 bits of a text's letters tell of most pairs that they don't, the counts themselves of most of the rest;
- the others are scored, many at once, by bits of one number for each pair (texts of more than 64 letters one by one).

Null and empty texts are alike to none, and what is of no page has no partner.  Copies of a text are one; choices take
copies in the order of their places.  Ties go to the least place on the left, then on the right.
"""

from __future__ import annotations

import heapq
import itertools
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import PAIR_SCORE, RECOVER_SCORE, best_variant, common_length, fresh

#: Pairs that are looked at together, texts of a block, numbers in a table of letters.
PAIRS, TEXTS, CELLS = 1 << 18, 1 << 13, 1 << 21
#: Lines or words whose pages are worked on together: what they give on the way is far more than they are.
HELD = 1 << 13
#: Bits for each of the twelve commonest letters, for each of the next twelve, and for all others.
BITS = (3, 2, 4)


def share(least: int) -> float:
    """The least 2L / (|a| + |b|) that rounds to `least`."""
    if not 1 <= least <= 100:
        raise ValueError("least must be from 1 to 100")
    return (least - 0.5) / 100


class _Side:
    """Texts as numbers: their lengths, and what is asked of slices of them."""

    def __init__(self, texts: list[str], table: np.ndarray):
        self.texts, self.n = texts, np.fromiter(map(len, texts), np.int64, len(texts))
        self.codes = table[_points(texts)]
        self.starts = np.concatenate([[0], np.cumsum(self.n)])

    def letters(self, i: int, j: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
        """(how often each letter is in texts i to j, the same in 64 bits); rare letters beyond `kinds` count as one."""
        codes = np.minimum(self.codes[self.starts[i] : self.starts[j]], kinds - 1).astype(np.int64)
        row = np.repeat(np.arange(j - i), self.n[i:j])
        counts = np.bincount(row * kinds + codes, minlength=(j - i) * kinds).reshape(j - i, kinds)
        bits, at = np.zeros(j - i, np.uint64), 0
        for c in range(min(24, kinds)):
            size = BITS[c >= 12]
            bits |= np.left_shift((np.uint64(1) << np.minimum(counts[:, c], size).astype(np.uint64)) - np.uint64(1), np.uint64(at))
            at += size
        for c in range(24, kinds):
            bits |= (counts[:, c] > 0).astype(np.uint64) << np.uint64(60 + c % BITS[2])
        return counts.astype(np.int32), bits

    def places(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in it, letter) of the letters of texts i to j that have 64 letters at most"""
        row = np.repeat(np.arange(j - i), self.n[i:j])
        at = np.arange(self.starts[i], self.starts[j]) - np.repeat(self.starts[i:j], self.n[i:j])
        short = np.repeat(self.n[i:j] <= 64, self.n[i:j])
        return row[short], at[short], self.codes[self.starts[i] : self.starts[j]][short]


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _table(points: np.ndarray) -> tuple[np.ndarray, int]:
    """(numbers of letters by their code points, the commonest first; how many there are)"""
    known, count = np.unique(points, return_counts=True)
    table = np.zeros(int(known[-1]) + 1, np.int64)
    table[known[np.argsort(-count, kind="stable")]] = np.arange(len(known))
    return table, len(known)


def _common(a: _Side, b: _Side, first: int, last: int, kinds: int):
    """A function of places of pairs (in texts first to last of a, and in b) and the lengths they need, that gives lengths of
    longest common subsequences, or 0 for less than is needed."""
    row, at, code = a.places(first, last)
    masks = np.zeros((last - first) * (kinds + 1), np.uint64)
    np.add.at(masks, row * (kinds + 1) + code, np.uint64(1) << at.astype(np.uint64))  # a bit is of one letter, so sums are unions

    def lengths(i: np.ndarray, j: np.ndarray, needed: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        short = (a.n[i] <= 64) & (b.n[j] <= 64)
        for k in np.flatnonzero(~short):
            out[k] = common_length(a.texts[i[k]], b.texts[j[k]], int(needed[k]))
        some = np.flatnonzero(short)
        some = some[np.argsort(-b.n[j[some]], kind="stable")]
        x, y = i[some], j[some]
        size, base, start = b.n[y], (x - first) * (kinds + 1), b.starts[y]
        left = np.full(len(some), ~np.uint64(0))
        # texts of b are read letter by letter, the longest first, so that those not at their end come first
        more = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        for k, m in enumerate(more):
            row = left[:m]
            match = row & masks[base[:m] + b.codes[start[:m] + k]]
            left[:m] = (row + match) | (row - match)
        full = np.where(a.n[x] >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(a.n[x], 63).astype(np.uint64)) - np.uint64(1))
        out[some] = np.bitwise_count(~left & full)
        return out

    return lengths


def _blocks(pages: Iterable[tuple[list[str], list[str]]]) -> Iterator[list[tuple[list[str], list[str]]]]:
    """Pages in blocks of so many texts that numbers are worth the call."""
    block, held = [], 0
    for a, b in pages:
        if block and held + len(a) + len(b) > TEXTS:
            yield block
            block, held = [], 0
        block.append((a, b))
        held += len(a) + len(b)
    if block:
        yield block


def alike_of_pages(pages: list[tuple[list[str], list[str]]], least: int) -> list[list[tuple[str, str, int]]]:
    """The alike pairs (a, b, score) of each page's texts on two sides, none twice on its side."""
    out: list[list[tuple[str, str, int]]] = []
    for block in _blocks(pages):
        first = len(out)
        out += [[] for _ in block]
        # texts of a page stand together, by their lengths
        ordered = lambda side: [(p, t) for p, x in enumerate(block) for t in sorted(x[side], key=len)]  # noqa: E731, B023
        sides = [ordered(0), ordered(1)]
        if not all(sides):
            continue
        points = [_points([t for _, t in x]) for x in sides]
        for i, j, score in _alike_of_block([[t for _, t in x] for x in sides], [np.fromiter((p for p, _ in x), np.int64, len(x)) for x in sides], np.concatenate(points), least):
            for x, y, s in zip(i.tolist(), j.tolist(), score.tolist(), strict=True):
                p, t = sides[0][x]
                out[first + p].append((t, sides[1][y][1], s))
    return out


def _alike_of_block(texts: list[list[str]], page: list[np.ndarray], points: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place on the left, place on the right, score) of alike pairs, in arrays."""
    s = share(least)
    table, known = _table(points)
    a, b = (_Side(x, table) for x in texts)
    kinds = min(known, 128)
    far = int(b.n.max()) + 1
    key = page[1] * far + b.n
    # partners of n letters have n * s / (2 - s) to n * (2 - s) / s
    low = np.searchsorted(key, page[0] * far + np.ceil(a.n * (s / (2 - s)) - 1e-6).astype(np.int64), side="left")
    high = np.searchsorted(key, page[0] * far + np.minimum(np.floor(a.n * ((2 - s) / s) + 1e-6).astype(np.int64), far - 1), side="right")
    held, other = max(1, CELLS // (known + 1)), None
    for first in range(0, len(a.n), held):
        last = min(first + held, len(a.n))
        wide = np.maximum(high[first:last] - low[first:last], 0)
        ends = np.cumsum(wide)
        if not ends[-1]:
            continue
        other = b.letters(0, len(b.n), kinds) if other is None else other
        counts, bits = a.letters(first, last, kinds)
        lengths = _common(a, b, first, last, known)
        for at in range(0, int(ends[-1]), PAIRS):
            # the pairs are numbered; those from `at` on
            number = np.arange(at, min(at + PAIRS, int(ends[-1])))
            i = np.searchsorted(ends, number, side="right")
            j = number - (ends - wide)[i] + low[first:last][i]
            total = a.n[first + i] + b.n[j]
            needed = np.ceil(total * (s / 2) - 1e-6).astype(np.int64)
            free_a, free_b = bits[i] & ~other[1][j], other[1][j] & ~bits[i]
            kept = (a.n[first + i] - np.bitwise_count(free_a) >= needed) & (b.n[j] - np.bitwise_count(free_b) >= needed)
            i, j, total, needed = i[kept], j[kept], total[kept], needed[kept]
            step = max(1, CELLS // kinds)
            kept = np.concatenate([np.zeros(0, bool), *(np.minimum(counts[i[k : k + step]], other[0][j[k : k + step]]).sum(axis=1) >= needed[k : k + step] for k in range(0, len(i), step))])
            i, j, total, needed = i[kept] + first, j[kept], total[kept], needed[kept]
            score = np.rint(200 * lengths(i, j, needed) / total).astype(np.int64)
            kept = score >= least
            yield i[kept], j[kept], score[kept]


def ratios(pairs: list[tuple[str, str]]) -> list[int]:
    """ratio() of pairs of texts that aren't empty, many at once."""
    out: list[int] = []
    for at in range(0, len(pairs), PAIRS // 8):
        given = pairs[at : at + PAIRS // 8]
        texts = [list(dict.fromkeys(side)) for side in zip(*given, strict=True)]
        table, known = _table(np.concatenate([_points(x) for x in texts]))
        a, b = (_Side(x, table) for x in texts)
        i, j = (np.fromiter(map({t: k for k, t in enumerate(x)}.__getitem__, side), np.int64, len(given)) for x, side in zip(texts, zip(*given, strict=True), strict=True))
        common, held = np.zeros(len(given), np.int64), max(1, CELLS // (known + 1))
        for first in range(0, len(texts[0]), held):
            some = np.flatnonzero((i >= first) & (i < first + held))
            common[some] = _common(a, b, first, min(first + held, len(texts[0])), known)(i[some], j[some], np.zeros(len(some), np.int64))
        out += np.rint(200 * common / (a.n[i] + b.n[j])).astype(np.int64).tolist()
    return out


def _of_pages(found: DataFrame, reference: DataFrame, page: str, order: tuple[str, str], values: list[str], work, fields: dict[str, str]) -> DataFrame:
    """(page, fields): what work(rows of arrays of pages) gives for each page that is on both sides, as tuples.  Of a page it is
    given, for either side in its order, the order's column and the values' arrays."""
    side = lambda df, by, name: df.where(F.col(page).isNotNull()).groupBy(page).agg(F.sort_array(F.collect_list(F.struct(F.col(by).alias("_at"), *values))).alias(name))
    both = side(found, order[0], "_a").join(side(fresh(reference), order[1], "_b"), page)

    @F.pandas_udf(", ".join(f"`{name}` array<{kind}>" for name, kind in fields.items()))
    def run(*columns: pd.Series) -> pd.DataFrame:
        done, part, held = [], [], 0
        for row in zip(*columns, strict=True):
            size = len(row[0]) + len(row[-1])
            if part and held + size > HELD:
                done += work(part)
                part, held = [], 0
            part.append([list(x) for x in row])
            held += size
        done += work(part)
        return pd.DataFrame({name: [[row[k] for row in rows] for rows in done] for k, name in enumerate(fields)})

    given = [f"{side}.{name}" for side in ("_a", "_b") for name in ("_at", *values)]
    return both.select(page, run(*given).alias("_r")).select(page, F.inline(F.arrays_zip(*[f"_r.{name}" for name in fields])))


def alike(left: DataFrame, right: DataFrame, page: str, text: str = "text", least: int = RECOVER_SCORE) -> DataFrame:
    """(page, a, b, score): all pairs of alike texts of a page, one on the left, one on the right, each once."""
    share(least)

    def work(rows: list) -> list[list[tuple[str, str, int]]]:
        return alike_of_pages([(_texts(x), _texts(y)) for x, _, y, _ in rows], least)

    return _of_pages(left, right, page, (text, text), [text], work, {"a": "string", "b": "string", "score": "int"})


def _texts(given: Iterable[str | None]) -> list[str]:
    """Texts without those that are alike to none, each once."""
    return [t for t in dict.fromkeys(given) if t]


def choose(pairs: Iterable[tuple[str, str, int]], runs: dict[str, list[tuple[int, int]]], others: dict[str, list[int]]) -> list[tuple[int, int, int, int]]:
    """(first, last, other, score): runs of places [first, last) on the left and places on the right, no place twice, best
    score first, then first, last and other.

    pairs are (a, b, score), runs the places of each a, others those of each b.  Copies aren't multiplied: of each
    pair only its first free places are looked at."""
    used: tuple[set, set] = (set(), set())
    for places in (*runs.values(), *others.values()):
        places.sort(reverse=True)
    queue, out = [], []

    def offer(a: str, b: str, score: int) -> None:
        x, y = runs.get(a, []), others.get(b, [])
        while x and not used[0].isdisjoint(range(*x[-1])):
            x.pop()
        while y and y[-1] in used[1]:
            y.pop()
        if x and y:
            heapq.heappush(queue, (-score, *x[-1], y[-1], a, b))

    for a, b, score in pairs:
        offer(a, b, score)
    while queue:
        score, first, last, other, a, b = heapq.heappop(queue)
        if used[0].isdisjoint(range(first, last)) and other not in used[1]:
            used[0].update(range(first, last))
            used[1].add(other)
            out.append((first, last, other, -score))
        offer(a, b, -score)
    return out


def _places(keys: Iterable[str | None], places: Iterable) -> dict[str, list]:
    out: dict[str, list] = {}
    for key, place in zip(keys, places, strict=True):
        if key:
            out.setdefault(key, []).append(place)
    return out


def displaced_lines(found: DataFrame, reference: DataFrame, page: str, line: str = "line_no", text: str = "text", least: int = RECOVER_SCORE) -> DataFrame:
    """(page, line, reference line, score): lines without an equal line of the page and reference lines that no line equals,
    paired where they are alike but for the case of letters, wherever in the page they stand."""

    def left_over(at: list, texts: list, small: list, same: Counter) -> dict[str, list[int]]:
        """Places of the texts in small letters, but for the first copies that have an equal on the other side."""
        same, kept = same.copy(), []
        for i, t, low in zip(at, texts, small, strict=True):
            if same[t] > 0:
                same[t] -= 1
            else:
                kept.append((low, i))
        return _places(*zip(*kept, strict=True)) if kept else {}

    def work(rows: list) -> list[list[tuple[int, int, int]]]:
        sides = []
        for xs, x, x_small, ys, y, y_small in rows:
            same = Counter(t for t in x if t is not None) & Counter(t for t in y if t is not None)
            sides.append((left_over(xs, x, x_small, same), left_over(ys, y, y_small, same)))
        pairs = alike_of_pages([(list(x), list(y)) for x, y in sides], least)
        return [[(i, other, score) for i, _, other, score in choose(p, {t: [(i, i + 1) for i in places] for t, places in x.items()}, y)] for p, (x, y) in zip(pairs, sides, strict=True)]

    folded = lambda df: df.select(page, line, text, F.lower(text).alias("_small"))
    return _of_pages(folded(found), folded(reference), page, (line, line), [text, "_small"], work, {line: "int", f"reference_{line}": "int", "score": "int"})


def runs_of_words(words: list[str | None], longest: int = 4) -> list[list[str | None]]:
    """What runs of two to `longest` words that stand side by side read as: a list for each number of words, in the order of
    their first words; null for runs whose last word is null."""
    plain = [w or "" for w in words]
    out = [plain]
    for k in range(1, longest):
        out.append(list(map(str.__add__, out[-1], plain[k:])))
    gone = {i for i, w in enumerate(words) if w is None}
    return [[None if i + k in gone else t for i, t in enumerate(x)] if gone else x for k, x in enumerate(out)][1:]


def words_combined(found: DataFrame, reference: DataFrame, page: str, pos: str = "word_no", word: str = "word", longest: int = 4, least: int = PAIR_SCORE) -> DataFrame:
    """(page, first, last, other, score): runs of words that read as one reference word, better than any word of theirs does;
    best first, no word twice.  Places count from 0 without gaps."""

    def work(rows: list) -> list[list[tuple[int, int, int, int]]]:
        sides = [(x, runs_of_words(x, longest), xs, _places(y, ys)) for xs, x, ys, y in rows]
        alike = alike_of_pages([(_texts(itertools.chain.from_iterable(runs)), list(others)) for _, runs, _, others in sides], least)
        # (a run's words, reference word, score) of each page, and the runs' places: copies of the words are one, other words that read the same are not
        options, kept = [], []
        for (words, runs, at, _), found in zip(sides, alike, strict=True):
            kinds: dict[str, set[tuple]] = {a: set() for a, _, _ in found}
            places: dict[tuple, list[tuple[int, int]]] = {}
            for size, texts in enumerate(runs, 2):
                for i, text in enumerate(texts):
                    if text in kinds:
                        kinds[text].add(parts := tuple(words[i : i + size]))
                        places.setdefault(parts, []).append((at[i], at[i] + size))
            options.append([(parts, b, score) for a, b, score in found for parts in kinds[a] if b not in parts])
            kept.append(places)
        pairs = list({(p, b): None for found in options for parts, b, _ in found for p in parts if p})
        own = dict(zip(pairs, ratios(pairs), strict=True))
        better = [[x for x in found if all(own.get((p, x[1]), 0) < x[2] for p in x[0])] for found in options]
        return [choose(found, {parts: places[parts] for parts, _, _ in found}, others) for found, places, (*_, others) in zip(better, kept, sides, strict=True)]

    return _of_pages(found, reference, page, (pos, pos), [word], work, {"first": "int", "last": "int", "other": "int", "score": "int"})


def variant_of(found: Column, previous: Column, line: Column) -> Column:
    """(score, variant) by best_variant(): what a reference line may read as if a word was cut at its start or end."""

    @F.pandas_udf("score int, variant string")
    def best(x: pd.Series, p: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_variant(a or "", b or "", c or "") for a, b, c in zip(x, p, y, strict=True)], columns=["score", "variant"])

    return best(found, previous, line)
