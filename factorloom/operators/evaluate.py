"""Factor evaluation: information coefficients, quantile returns, turnover, gates, grades."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.plans.compiler import average_rank


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; NULL where a side is flat."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def daily_ic(panel: DataFrame, factor: str, ret: str, min_names: int = 3, date: str = "date") -> DataFrame:
    """(date, n, ic, rank_ic): Pearson and Spearman (Pearson of average ranks) across assets; days below min_names are NULL.

    Ranks need the day's rows together, and so does the aggregate: one exchange by date serves both.
    """
    rows = panel.where(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    ranked = rows.select(date, factor, ret, average_rank(F.col(factor), [date]).alias("__rf"), average_rank(F.col(ret), [date]).alias("__rr"))
    out = ranked.groupBy(date).agg(F.count(F.lit(1)).alias("n"), pearson(F.col(factor), F.col(ret)).alias("ic"), pearson(F.col("__rf"), F.col("__rr")).alias("rank_ic"))
    enough = F.col("n") >= min_names
    return out.withColumn("ic", F.when(enough, F.col("ic"))).withColumn("rank_ic", F.when(enough, F.col("rank_ic")))


def summarize_ic(daily: DataFrame, ddof: int = 1) -> DataFrame:
    """One row: mean, deviation, ratio and t of IC and rank IC over the days that have them."""
    std = F.stddev_samp if ddof else F.stddev_pop

    def part(c: str, prefix: str) -> list[Column]:
        mean, dev, n = F.avg(c), F.nullif(std(c), F.lit(0.0)), F.count(c)
        return [mean.alias(f"{prefix}_mean"), std(c).alias(f"{prefix}_std"), (mean / dev).alias(f"{prefix}_ir"), (mean / dev * F.sqrt(n)).alias(f"{prefix}_tstat")]

    return daily.agg(F.count("ic").alias("n_days"), *part("ic", "ic"), *part("rank_ic", "rank_ic"))


def quantile_returns(binned: DataFrame, ret: str) -> DataFrame:
    """(factor_quantile, mean_ret, n) over all dates."""
    return binned.where(F.col("factor_quantile").isNotNull() & F.col(ret).isNotNull()).groupBy("factor_quantile").agg(F.avg(ret).alias("mean_ret"), F.count(F.lit(1)).alias("n"))


def quantile_spread(binned: DataFrame, ret: str) -> DataFrame:
    """One row: mean return of the top quantile less that of the bottom one."""
    q = quantile_returns(binned, ret)
    return q.agg((F.max_by("mean_ret", "factor_quantile") - F.min_by("mean_ret", "factor_quantile")).alias("spread"))


def quantile_turnover(binned: DataFrame, calendar: DataFrame, quantile: int, lag: int = 1, date: str = "date", asset: str = "asset") -> DataFrame:
    """(date, turnover): names in the quantile that weren't in it `lag` sessions before, as a share. The first session has none."""
    held = binned.where(F.col("factor_quantile") == quantile).select(date, asset).join(F.broadcast(calendar.select(date, "ordinal")), date)  # a row per session
    before = held.select(asset, (F.col("ordinal") + lag).alias("ordinal"), F.lit(1).alias("__was"))
    both = held.join(before, [asset, "ordinal"], "left")
    return both.where(F.col("ordinal") >= lag).groupBy(date).agg((F.count_if(F.col("__was").isNull()) / F.count(F.lit(1))).alias("turnover"))


def coverage(panel: DataFrame, factor: str) -> DataFrame:
    """One row: share of cells with a value, whether the factor is constant."""
    x = F.col(factor)
    return panel.agg((F.count(x) / F.count(F.lit(1))).alias("coverage"), F.count(x).alias("n_values"), (F.coalesce(F.min(x) == F.max(x), F.lit(True))).alias("is_constant"))


@dataclass(frozen=True)
class Thresholds:
    """What a factor must reach to be kept."""

    coverage: float = 0.6
    ic: float = 0.02
    icir: float = 0.3
    rank_ic: float = 0.02


def grade(coverage: Column, ic: Column, icir: Column, rank_ic: Column, t: Thresholds = Thresholds()) -> Column:
    """pass, or the first gate that the factor fails."""
    short = lambda x, least: F.coalesce(F.abs(x) < least, F.lit(True))
    return F.when(F.coalesce(coverage < t.coverage, F.lit(True)), "coverage").when(short(ic, t.ic), "ic").when(short(icir, t.icir), "icir").when(short(rank_ic, t.rank_ic), "rank_ic").otherwise("pass")


def evaluate_factors(panel: DataFrame, returns: DataFrame, factors: list[str], ret: str, min_names: int = 3, date: str = "date", asset: str = "asset") -> DataFrame:
    """One row per factor: coverage, IC summary and grade, all factors in one pass over their long form."""
    long = panel.unpivot([date, asset], factors, "factor", "value").join(returns.select(asset, date, ret), [asset, date])
    cover = long.groupBy("factor").agg((F.count("value") / F.count(F.lit(1))).alias("coverage"))
    rows = long.where(F.col("value").isNotNull() & F.col(ret).isNotNull())
    day = [date, "factor"]
    ranked = rows.select(*day, "value", ret, average_rank(F.col("value"), day).alias("__rf"), average_rank(F.col(ret), day).alias("__rr"))
    daily = ranked.groupBy(*day).agg(F.count(F.lit(1)).alias("n"), pearson(F.col("value"), F.col(ret)).alias("ic"), pearson(F.col("__rf"), F.col("__rr")).alias("rank_ic")).where(F.col("n") >= min_names)
    out = daily.groupBy("factor").agg(F.avg("ic").alias("ic_mean"), (F.avg("ic") / F.nullif(F.stddev_samp("ic"), F.lit(0.0))).alias("icir"), F.avg("rank_ic").alias("rank_ic_mean"))
    out = cover.join(out, "factor", "left")
    return out.withColumn("grade", grade(F.col("coverage"), F.col("ic_mean"), F.col("icir"), F.col("rank_ic_mean")))


