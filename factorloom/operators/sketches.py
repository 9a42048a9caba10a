"""Sketches kept for each key and day, merged over any range: distinct counts and quantiles without the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of distinct counts (two to this power) and the size of quantile sketches.
LG_K, KLL_K = 12, 200
#: Standard errors: of distinct counts by 2**LG_K registers, and of ranks by KLL_K.
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (LG_K / 2), 0.0133


def daily_sketches(rows: DataFrame, key: str, date: str, distinct: str, value: str) -> DataFrame:
    """(key, date, n, distinct_sketch, value_sketch): what is kept of each key's day, some kilobytes whatever its rows."""
    real = F.col(value).cast("double")
    return rows.groupBy(key, date).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(distinct, LG_K).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.when(~F.isnan(real), real), KLL_K).alias("value_sketch"),
    )


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of groups of days (or of keys): n, distinct_sketch, value_sketch, which can be merged again."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("value_sketch", KLL_K).alias("value_sketch"),
    )


def distinct_estimate(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile_estimate(sketch: Column, share: float) -> Column:
    """A value whose rank is near the share; NULL where no value came."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(share))))


def estimates(sketches: DataFrame, by: list[str], shares: tuple[float, ...] = (0.5,)) -> DataFrame:
    """(by, n, distinct, q_..): estimates of sketches merged by some columns."""
    got = merged(sketches, by)
    names = {s: f"q_{s:g}".replace(".", "_") for s in shares}
    return got.select(*by, "n", distinct_estimate(F.col("distinct_sketch")).alias("distinct"), *[quantile_estimate(F.col("value_sketch"), s).alias(n) for s, n in names.items()])
