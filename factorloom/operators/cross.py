"""Operators across the assets of one date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom.plans.compiler import average_rank


def cs_rank(x: Column, date: str = "date") -> Column:
    """Share of the day's values up to this one, ties averaged."""
    return average_rank(x, [date]) / F.count(x).over(Window.partitionBy(date))


def cs_zscore(x: Column, date: str = "date", ddof: int = 1, flat_as_one: bool = False, missing_as_zero: bool = False) -> Column:
    """(x - mean) / deviation of the day. A deviation of 0 gives NULL, or stands for 1 where flat_as_one."""
    day = Window.partitionBy(date)
    s = (F.stddev_samp if ddof else F.stddev_pop)(x).over(day)
    s = F.coalesce(F.nullif(s, F.lit(0.0)), F.lit(1.0)) if flat_as_one else F.nullif(s, F.lit(0.0))
    z = (x - F.avg(x).over(day)) / s
    return F.coalesce(z, F.lit(0.0)) if missing_as_zero else z


def neutralize(x: Column, industry: str, date: str = "date", unmapped_as_zero: bool = False) -> Column:
    """x less the mean of its industry on the day. Assets without an industry keep x (or get 0)."""
    rest = F.lit(0.0) if unmapped_as_zero else x
    out = F.when(F.col(industry).isNull(), rest).otherwise(x - F.avg(x).over(Window.partitionBy(date, industry)))
    return F.coalesce(out, F.lit(0.0)) if unmapped_as_zero else out


def median_impute(panel: DataFrame, columns: list[str], date: str = "date") -> DataFrame:
    """Missing values become the day's median, or 0 where a day has none. One aggregate per day and a join, as days are few."""
    medians = panel.groupBy(date).agg(*[F.percentile(c, 0.5).alias(f"__m_{c}") for c in columns])
    out = panel.join(medians, date)
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__m_{c}"), F.lit(0.0)) for c in columns}).drop(*[f"__m_{c}" for c in columns])


def quantile_bins(panel: DataFrame, column: str, quantiles: int = 5, date: str = "date") -> DataFrame:
    """panel with factor_quantile 1..quantiles: bins of the day's values closed on the right, edges by linear interpolation.

    A day whose edges coincide has no bins (NULL); so have missing values.
    """
    cuts = [i / quantiles for i in range(quantiles + 1)]
    edges = panel.groupBy(date).agg(F.percentile(column, cuts).alias("__edges"))
    out = panel.join(edges, date)
    inner = F.slice("__edges", 2, quantiles - 1)
    x = F.col(column)
    place = F.size(F.filter(inner, lambda e: x > e)) + 1
    fine = x.isNotNull() & (F.size(F.array_distinct("__edges")) == quantiles + 1)
    return out.withColumn("factor_quantile", F.when(fine, place)).drop("__edges")


def top_n(panel: DataFrame, score: str, n: int, date: str = "date", asset: str = "asset") -> DataFrame:
    """The n best of each date, ties to the smaller asset: a WindowGroupLimit before and after the exchange."""
    order = Window.partitionBy(date).orderBy(F.col(score).desc(), asset)
    return panel.where(F.col(score).isNotNull()).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
