"""Combining factors: choice, correlation, weights, composite scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cross import cs_zscore


def select_factors(library: DataFrame, k: int, floor: float = 0.0) -> DataFrame:
    """The k factors of greatest absolute ICIR at or above the floor."""
    return library.where(F.abs("icir") >= floor).orderBy(F.abs("icir").desc_nulls_last(), "name").limit(k)


def correlation_matrix(panel: DataFrame, factors: Sequence[str], min_rows: int = 10) -> DataFrame:
    """(a, b, corr) for each pair, over rows that have both; NULL below min_rows + 1. All pairs in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    aggs = []
    for k, (a, b) in enumerate(pairs):
        x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
        r = F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
        aggs.append(F.when(F.count(x) > min_rows, r).alias(f"c{k}"))
    one = panel.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def decorrelate(ranked: Sequence[str], correlations: Mapping[tuple[str, str], float | None], limit: float = 0.7) -> list[str]:
    """Greedy choice, best first: a factor stays if it correlates with none kept before beyond the limit."""
    kept: list[str] = []
    for f in ranked:
        if all(abs(correlations.get((f, g), correlations.get((g, f))) or 0.0) <= limit for g in kept):
            kept.append(f)
    return kept


def factor_weights(library: DataFrame, method: str = "icir") -> DataFrame:
    """(name, direction, weight): weights by |ic_mean| or |icir|, or equal, of sum 1; equal where they sum to 0."""
    measure = {"equal": F.lit(1.0), "ic": F.abs("ic_mean"), "icir": F.abs("icir")}[method]
    w = library.select("name", F.when(F.col("ic_mean") < 0, -1.0).otherwise(1.0).alias("direction"), F.coalesce(measure, F.lit(0.0)).alias("raw"))
    total = w.agg(F.sum("raw").alias("total"), F.count(F.lit(1)).alias("k"))
    return w.crossJoin(F.broadcast(total)).select("name", "direction", F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(1.0 / F.col("k")).alias("weight"))  # one row


def composite_score(panel: DataFrame, weights: DataFrame, factors: Sequence[str], date: str = "date", asset: str = "asset") -> DataFrame:
    """(date, asset, score): sum over factors of the day's z-score times direction and weight; a missing one adds nothing.

    Cells without any factor have no row.
    """
    z = panel.select(date, asset, *[cs_zscore(F.col(f), date).alias(f) for f in factors])
    long = z.unpivot([date, asset], list(factors), "name", "z").where(F.col("z").isNotNull())
    return long.join(F.broadcast(weights), "name").groupBy(date, asset).agg(F.sum(F.col("z") * F.col("direction") * F.col("weight")).alias("score"))  # a row per factor
