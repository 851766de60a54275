"""Quality rules: plain statistics and base rules, then robust multivariate outliers per language and source.

Statistics of each text (words are runs of anything but ASCII white space) are transformed to a vector X of DIMENSIONS
numbers.  For each language and source, for each language, and over all rows, the minimum-covariance-determinant
estimate is found by concentration steps over all rows: distances from the current estimate, their quantile H per group
(a mergeable sketch), then mean and covariance of the rows within it.  There are two starts, medians with median
deviations and plain mean with covariance; steps go on until no group's determinant changes by more than CONVERGED, STEPS
at most, and each group keeps the start of least determinant.  A reweighting step follows.  A row takes the estimate of
its own group if that has MIN_ROWS rows, else its language's, else that of all rows.  It is rejected if its squared
Mahalanobis distance is over the chi-square quantile 1 - TAIL.

FLOOR, a standard deviation for each dimension that is added to every covariance, keeps groups without spread regular; at
this TAIL a single statistic of an otherwise usual text rejects it at the latest from 2.6 % symbols, 37 % repeated lines,
37 % repeated words, or words shorter or longer by a third, where the group itself has no spread.

Everything runs as aggregations with partial sums, and what is joined to the rows is one small row per group: broadcast up to
BROADCAST_GROUPS groups, else joined by group and salt; so a source with a third of all rows is no hot spot.  Null text: no
words, so base_failed.  Null language or source is a group of its own.  Texts of any length are read whole.  Repeated rows
are judged each; extra columns are ignored, whatever their names; no rows: no rows; with fewer than MIN_ROWS rows in
all, nothing is rejected but by the base rules.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize

SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\r\x0b\x0c"
DIMENSIONS = ("x0", "x1", "x2", "x3")
FLOOR = (0.06, 0.26, 0.75, 0.75)
H = 0.75
STEPS, CONVERGED = 10, 1e-3
MIN_ROWS = 100
TAIL = 1e-4
BROADCAST_GROUPS = 50_000
SALTS = 64
MIN_WORDS = 50


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words inside n-word windows that occur at least twice."""
    if len(words) < n:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    code = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        code *= np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        code += h[k : len(h) - n + 1 + k]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(code), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(len(words), dtype=bool)
    for k in range(n):
        mark[k : k + len(code)] |= twice
    return int(mark.sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(words, code points in words, symbols, lines equal to an earlier one, words in repeated windows, lines)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(BLANK)]
    blanks = len(raw) - len(raw.translate(None, BLANK))
    return len(words), len(text) - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def with_statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            return {id_col: batch.column(0), "lang": batch.column(2), "source": batch.column(3)} | dict(zip(names, zip(*rows, strict=True), strict=True))

        return step

    picked = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    return map_rows(picked, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang string, source string, " + ", ".join(f"{n} bigint" for n in names), make)


def transformed() -> list[Column]:
    """X: word length, symbols, repeated lines and repeated words, on scales where clean texts are about normal."""
    share = lambda n, of: F.log1p(100 * F.col(n) / F.greatest(F.col(of), F.lit(1)))
    length = F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))
    return [x.alias(d) for x, d in zip((length, share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")), DIMENSIONS, strict=True)]


def chi2_cdf(x: float, k: int) -> float:
    """For an even number k of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 10.0 * k + 40 - 4 * NormalDist().inv_cdf(min(1 - p, 0.5))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def squared_distance() -> Column:
    n = len(DIMENSIONS)
    off = [F.col(d) - F.col("mean")[i] for i, d in enumerate(DIMENSIONS)]
    return sum((off[i] * off[j] * F.col("inverse")[i * n + j] for i in range(n) for j in range(n)), F.lit(0.0))


GROUP = "g struct<level:int,lang:string,source:string>"


def _estimates(moments: DataFrame, factor: float) -> DataFrame:
    """Mean, regular inverse of factor * covariance and its log-determinant, of each start and group, from its sums."""
    n = len(DIMENSIONS)

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            count = np.array(batch.column("n").to_pylist(), dtype=float)[:, None]
            mean = np.array(batch.column("s").to_pylist(), dtype=float).reshape(-1, n) / count
            square = np.array(batch.column("ss").to_pylist(), dtype=float).reshape(-1, n, n) / count[:, :, None]
            cov = factor * (square - mean[:, :, None] * mean[:, None, :]) + np.diag(np.square(FLOOR))
            return {"start": batch.column("start"), "g": batch.column("g"), "mean": list(mean), "inverse": list(np.linalg.inv(cov).reshape(-1, n * n)), "size": np.linalg.slogdet(cov)[1]}

        return step

    return map_rows(moments.select("start", "g", "n", "s", "ss"), f"start int, {GROUP}, mean array<double>, inverse array<double>, size double", make)


def _moments() -> list[Column]:
    return [
        F.count("*").alias("n"),
        F.array(*[F.sum(d) for d in DIMENSIONS]).alias("s"),
        F.array(*[F.sum(F.col(a) * F.col(b)) for a in DIMENSIONS for b in DIMENSIONS]).alias("ss"),
    ]


def with_groups(rows: DataFrame, frame: DataFrame) -> DataFrame:
    """rows with the columns of their group in a stored frame with a few rows per group; rows of no group there go."""
    if frame.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(frame), "g")
    salted = frame.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*DIMENSIONS, F.spark_partition_id()), F.lit(SALTS)).cast("int")).join(salted, ["g", "_salt"]).drop("_salt")


def estimate(rows: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(g, rows, mean, inverse) of each group with min_rows rows, from a stored frame with lang, source and DIMENSIONS."""
    k = len(DIMENSIONS)
    lang, source = (F.coalesce(F.col(c), F.lit("\0")) for c in ("lang", "source"))
    group = lambda level, a, b: F.struct(F.lit(level).alias("level"), a.alias("lang"), b.alias("source"))
    grouped = rows.select(F.explode(F.array(group(0, F.lit(""), F.lit("")), group(1, lang, F.lit("")), group(2, lang, source))).alias("g"), *DIMENSIONS)
    middle = grouped.groupBy("g").agg(F.count("*").alias("rows"), *[F.percentile_approx(d, 0.5, 1000).alias(f"m{d}") for d in DIMENSIONS])
    middle = materialize(middle.where(F.col("rows") >= min_rows), "middle")
    around = [F.percentile_approx(F.abs(F.col(d) - F.col(f"m{d}")), 0.5, 1000).alias(f"d{d}") for d in DIMENSIONS]
    spread = with_groups(grouped, middle).groupBy("g").agg(*[F.first(f"m{d}").alias(f"m{d}") for d in DIMENSIONS], *around, *_moments())
    spread = materialize(spread.withColumn("start", F.lit(1)), "spread")
    variance = [F.pow(1.4826 * F.col(f"d{d}"), 2) + f * f for d, f in zip(DIMENSIONS, FLOOR, strict=True)]
    flat = [(1 / variance[i]) if i == j else F.lit(0.0) for i in range(k) for j in range(k)]
    medians = spread.select(F.lit(0).alias("start"), "g", F.array(*[F.col(f"m{d}") for d in DIMENSIONS]).alias("mean"), F.array(*flat).alias("inverse"), F.lit(math.inf).alias("size"))
    now = materialize(medians.unionByName(_estimates(spread, 1.0).withColumn("size", F.lit(math.inf))), "starts")
    factor = H / chi2_cdf(chi2_quantile(H, k), k + 2)
    for _ in range(STEPS):
        near = with_groups(grouped, now).withColumn("d2", squared_distance())
        limit = materialize(near.groupBy("start", "g").agg(F.percentile_approx("d2", H, 1000).alias("limit")), "limits")
        inside = with_groups(grouped, materialize(now.join(limit, ["start", "g"]), "limited")).where(squared_distance() <= F.col("limit"))
        then = materialize(_estimates(inside.groupBy("start", "g").agg(*_moments()), factor), "estimates")
        moved = then.join(now.select("start", "g", F.col("size").alias("before")), ["start", "g"]).where(F.abs(F.col("before") - F.col("size")) > CONVERGED)
        now = then
        if moved.isEmpty():
            break
    best = now.groupBy("g").agg(F.min(F.struct("size", "start", "mean", "inverse")).alias("best")).select("g", F.col("best.start").alias("start"), F.col("best.mean").alias("mean"), F.col("best.inverse").alias("inverse"))
    edge = chi2_quantile(0.975, k)
    inside = with_groups(grouped, materialize(best, "best")).where(squared_distance() <= edge)
    last = materialize(_estimates(inside.groupBy("start", "g").agg(*_moments()), 0.975 / chi2_cdf(edge, k + 2)), "estimate")
    return middle.select("g", "rows").join(last.select("g", "mean", "inverse"), "g")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """The id, the statistics, base_failed, distance (squared; null without an estimate) and kept of every row."""
    stats = with_statistics(docs, id_col, text_col, lang_col, source_col).select("*", *transformed())
    stats = stats.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    stats = materialize(stats, "statistics")
    known = materialize(estimate(stats.where("not base_failed")), "known")
    few = known.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    lang, source = (F.coalesce(F.col(c), F.lit("\0")) for c in ("lang", "source"))
    judged = stats.withColumn("_lang", lang).withColumn("_source", source)
    for level, on in ((2, ["_lang", "_source"]), (1, ["_lang"]), (0, [])):
        part = known.where(F.col("g.level") == level).select(*[F.col(f"g.{c[1:]}").alias(c) for c in on], F.struct("mean", "inverse").alias(f"e{level}"))
        part = F.broadcast(part) if few or not on else part  # of level 0 there is one row at most
        judged = judged.join(part, on or F.lit(True), "left")
    judged = judged.withColumn("_e", F.coalesce("e2", "e1", "e0")).withColumn("mean", F.col("_e.mean")).withColumn("inverse", F.col("_e.inverse"))
    judged = judged.withColumn("distance", squared_distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(1 - tail, len(DIMENSIONS)), F.lit(True))
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "distance", kept.alias("kept"))
