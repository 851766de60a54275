"""Approximate counts and quantiles that add up: a sketch for each page, kept, and rolled up to books without the words.

Distinct counts are HLL sketches of 2^LOG_K registers (standard error about 1.04 / sqrt(2^LOG_K), under 1 %), quantiles KLL
sketches of size K (rank error about 1.3 % at 200).  A sketch's size is bounded whatever it has seen, and sketches of
pages merged in any order estimate what one of all words would, within the same error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_K, K = 14, 200
#: What callers may rely on: three standard errors of a count, and of a rank.
COUNT_ERROR, RANK_ERROR = 0.025, 0.04


def sketches(rows: DataFrame, keys: list[str], what: str, measure: Column) -> DataFrame:
    """(keys, distinct, spread): sketches of the values of a column and of a number; nulls are left out."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(what, LOG_K).alias("distinct"), F.kll_sketch_agg_double(measure.cast("double"), K).alias("spread"))


def rolled_up(found: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of groups of what has sketches."""
    return found.groupBy(*keys).agg(F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("spread", K).alias("spread"))


def estimates(found: DataFrame, keys: list[str], ranks: list[float]) -> DataFrame:
    """(keys, n_distinct, n_values, quantiles): what sketches tell."""
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("spread", F.lit(r)) for r in ranks])
    return found.select(*keys, F.hll_sketch_estimate("distinct").alias("n_distinct"), F.kll_sketch_get_n_double("spread").alias("n_values"), quantiles.alias("quantiles"))
