"""Sessions: the calendar's ordinals, dense panels, n-th sessions, rebalance dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sessions(panel: DataFrame, date: str = "date") -> DataFrame:
    """(date, ordinal) of the distinct dates. One row per session, so the global window is over thousands of rows at most."""
    days = panel.select(date).where(F.col(date).isNotNull()).distinct()
    return days.withColumn("ordinal", F.row_number().over(Window.orderBy(date)) - 1)


def calendar_bounds(panel: DataFrame, asset: str = "asset", date: str = "date") -> DataFrame:
    """One row: the first and last session, how many there are, and how many instruments."""
    return panel.agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count_distinct(date).alias("sessions"), F.count_distinct(asset).alias("instruments"))


def instruments(panel: DataFrame, asset: str = "asset", date: str = "date") -> DataFrame:
    """(asset, first, last): each instrument with the range of its sessions."""
    return panel.where(F.col(date).isNotNull()).groupBy(asset).agg(F.min(date).alias("first"), F.max(date).alias("last"))


def densify(panel: DataFrame, asset: str = "asset", date: str = "date", whole: bool = False) -> DataFrame:
    """A row for each asset and session in its own range (or, when whole, in the calendar's); missing cells are NULL.

    One aggregate by asset gives each its days. From their union comes the calendar, one row that holds the sorted sessions
    and is broadcast; each asset's range is a slice of it. Only (asset, date) keys meet in the join that fills the grid.
    """
    own = panel.where(F.col(date).isNotNull()).groupBy(asset).agg(F.collect_set(date).alias("__own"))  # at most a day per session
    calendar = own.select(F.explode("__own").alias("__day")).distinct().agg(F.array_sort(F.collect_set("__day")).alias("__days"))
    ranges = own.crossJoin(F.broadcast(calendar))  # one row
    at = lambda end: F.array_position("__days", end("__own")).cast("int")
    days = F.col("__days") if whole else F.slice("__days", at(F.array_min), at(F.array_max) - at(F.array_min) + 1)
    return ranges.select(asset, F.explode(days).alias(date)).join(panel, [asset, date], "left")


def nth_session(calendar: DataFrame, period: str, n: int, date: str = "date") -> DataFrame:
    """The n-th session of each ISO week or month; negative n counts from the end."""
    key = [F.extract(F.lit("yearofweek"), F.col(date)), F.weekofyear(date)] if period == "weekly" else [F.year(date), F.month(date)]
    order = F.col(date).asc() if n > 0 else F.col(date).desc()
    ranked = calendar.select(date).distinct().withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    return ranked.where(F.col("__nth") == abs(n)).select(date)


def rebalances(calendar: DataFrame, every: int) -> DataFrame:
    """calendar with rebalance_ordinal: the last multiple of `every` up to each session."""
    return calendar.withColumn("rebalance_ordinal", F.col("ordinal") - F.col("ordinal") % every)


def carry(picks: DataFrame, calendar: DataFrame, every: int) -> DataFrame:
    """Picks of rebalance sessions, (ordinal, ...), for every session until the next: an equi-join on the rebalance ordinal."""
    days = rebalances(calendar, every)
    held = picks.withColumnRenamed("ordinal", "rebalance_ordinal").drop("date")
    return days.join(held, "rebalance_ordinal")


def forward_returns(prices: DataFrame, periods: tuple[int, ...] = (1, 5, 10), asset: str = "asset", date: str = "date", price: str = "close") -> DataFrame:
    """(asset, date, ret_p ...): close p sessions on over close, less 1. prices: dense panel, whole calendar."""
    w = Window.partitionBy(asset).orderBy(date)
    cols = [(F.try_divide(F.lead(price, p).over(w), F.col(price)) - 1).alias(f"ret_{p}") for p in periods]
    return prices.select(asset, date, *cols)


def trailing_returns(prices: DataFrame, asset: str = "asset", date: str = "date", price: str = "close") -> DataFrame:
    """(asset, date, ret): change from the session before; NULL where either price is missing."""
    w = Window.partitionBy(asset).orderBy(date)
    return prices.select(asset, date, (F.try_divide(F.col(price), F.lag(price).over(w)) - 1).alias("ret"))
