"""Price adjustment and corporate actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def forward_adjust(bars: DataFrame, prices: tuple[str, ...] = ("open", "high", "low", "close", "vwap"), asset: str = "asset", date: str = "date", adj: str = "adj_factor") -> DataFrame:
    """Prices times factor / last factor of the asset, missing factors taken from before, else from after; adds `factor`."""
    before = Window.partitionBy(asset).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(asset).orderBy(date).rowsBetween(0, Window.unboundedFollowing)
    filled = bars.withColumn("__adj", F.coalesce(F.last(adj, ignorenulls=True).over(before), F.first(adj, ignorenulls=True).over(after)))
    last = F.last("__adj").over(Window.partitionBy(asset).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = filled.withColumn("factor", F.try_divide(F.col("__adj"), last))
    have = [p for p in prices if p in bars.columns]
    return out.withColumns({p: F.col(p) * F.col("factor") for p in have}).drop("__adj")


def split_ratios(bars: DataFrame, dividends: DataFrame | None = None, noise: float = 0.005, asset: str = "asset", date: str = "date") -> DataFrame:
    """bars with split_ratio: how far a jump of adj_factor goes beyond the cash dividend of that day; 1 within the noise.

    dividends: asset, date (ex-date), div_cash; those of a day are summed.
    """
    w = Window.partitionBy(asset).orderBy(date)
    out = bars
    if dividends is not None:
        out = out.join(dividends.groupBy(asset, date).agg(F.sum("div_cash").alias("div_cash")), [asset, date], "left")
    cash = F.coalesce("div_cash", F.lit(0.0)) if dividends is not None else F.lit(0.0)
    prev, close = F.coalesce(F.lag("adj_factor").over(w), F.lit(None)), F.lag("close").over(w)
    jump = F.coalesce((prev > 0) & (F.abs(F.col("adj_factor") - prev) >= 1e-9), F.lit(False))
    ratio = F.when(prev > 0, F.col("adj_factor") / prev)
    dividend = F.when(cash > 0, F.when(close > 0, F.try_divide(close, close - cash))).otherwise(F.lit(1.0))
    ratio = F.when((cash > 0) & ~F.coalesce(close > 0, F.lit(False)), F.lit(1.0)).otherwise(F.try_divide(ratio, dividend))
    split = F.when(jump & (ratio > 0) & (F.abs(ratio - 1) > noise), ratio).otherwise(F.lit(1.0))
    return out.withColumn("split_ratio", split).drop("div_cash")


def stock_splits(bars: DataFrame, dividends: DataFrame) -> DataFrame:
    """bars with split_ratio = 1 + bonus shares per share of carried-out plans going ex that day."""
    done = dividends.where(F.col("div_proc").startswith("实施")).groupBy(F.col("ts_code"), F.col("ex_date").alias("date")).agg(F.sum(F.coalesce("stk_div", F.lit(0.0))).alias("__bonus"))
    return bars.drop("split_ratio").join(done, ["ts_code", "date"], "left").withColumn("split_ratio", 1.0 + F.coalesce("__bonus", F.lit(0.0))).drop("__bonus")


def dividends_between(dividends: DataFrame, start: str, end: str) -> DataFrame:
    """Events whose record or pay date lies in the range."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    return dividends.where(F.col("record_date").between(lo, hi) | F.col("pay_date").between(lo, hi))


def fill(df: DataFrame, columns: list[str], asset: str = "asset", date: str = "date", back: bool = False) -> DataFrame:
    """Missing values from the asset's last one before, then (back) from its first after."""
    before = Window.partitionBy(asset).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(asset).orderBy(date).rowsBetween(0, Window.unboundedFollowing)
    one = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(before), *([F.first(c, ignorenulls=True).over(after)] if back else []))
    return df.withColumns({c: one(c) for c in columns})


def history(bars: DataFrame, field: str, count: int, asset: str = "asset", date: str = "date", adjust: bool = True) -> DataFrame:
    """For each bar the `count` values before it, oldest first, prices adjusted to that bar's own factor."""
    w = Window.partitionBy(asset).orderBy(date).rowsBetween(-count, -1)
    items = F.collect_list(F.struct(F.col(field).alias("v"), F.col("adj_factor").alias("a"))).over(w)
    value = lambda e: e["v"] * e["a"] / F.col("adj_factor") if adjust else e["v"]
    return bars.withColumn("__items", items).select(asset, date, F.transform("__items", value).alias("history"))
