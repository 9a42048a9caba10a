"""Vectorised backtests: top-n portfolios over a dense panel, as DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .calendar import carry, sessions, trailing_returns
from .cross import top_n


@dataclass(frozen=True)
class Costs:
    """Rates: commission and slippage on what is traded, stamp duty on what is sold."""

    commission: float = 0.0005
    slippage: float = 0.001
    stamp: float = 0.0005


def holdings(scores: DataFrame, n: int, every: int = 1, weighting: str = "equal", date: str = "date", asset: str = "asset") -> DataFrame:
    """(ordinal, date, asset, weight): the n best of each rebalance session, held until the next.

    weighting "score": positive scores to a sum of 1, or equal where none is positive. A rebalance session without
    scores has no picks, and its holding period none.
    """
    calendar = sessions(scores, date)
    due = scores.join(F.broadcast(calendar), date).where(F.col("ordinal") % every == 0)  # a row per session
    picks = top_n(due, "score", n, date, asset)
    day = Window.partitionBy(date)
    if weighting == "score":
        up = F.greatest(F.col("score"), F.lit(0.0))
        total = F.sum(up).over(day)
        w = F.when(total > 0, up / total).otherwise(1.0 / F.count(F.lit(1)).over(day))
    else:
        w = 1.0 / F.count(F.lit(1)).over(day)
    picks = picks.select("ordinal", asset, w.alias("weight")).where("weight > 0")
    return carry(picks, calendar, every).select("ordinal", date, asset, "weight")


def traded(held: DataFrame, calendar: DataFrame, first_day: bool, asset: str = "asset") -> DataFrame:
    """(ordinal, turnover, sold): sums of |change| and of decreases of weights from the session before.

    Each holding is set against itself a session on: rows that end are sold, rows that begin are bought; no dense
    grid of assets by sessions is needed. Without first_day the entry into the first session's holdings isn't counted.
    """
    last = calendar.agg(F.max("ordinal").alias("__last"))
    now = held.select("ordinal", asset, F.col("weight").alias("change"))
    after = held.select((F.col("ordinal") + 1).alias("ordinal"), asset, (-F.col("weight")).alias("change")).crossJoin(F.broadcast(last)).where("ordinal <= __last").drop("__last")  # one row
    moves = now.unionByName(after).groupBy("ordinal", asset).agg(F.sum("change").alias("change"))
    out = moves.groupBy("ordinal").agg(F.sum(F.abs("change")).alias("turnover"), F.sum(F.greatest(-F.col("change"), F.lit(0.0))).alias("sold"))
    return out if first_day else out.where("ordinal > 0")


def backtest(scores: DataFrame, prices: DataFrame, n: int, every: int = 1, weighting: str = "equal", style: str = "compose", costs: Costs = Costs(), date: str = "date", asset: str = "asset") -> DataFrame:
    """(ordinal, date, gross, turnover, sold, ret): daily returns of holding yesterday's picks.

    scores: date, asset, score; prices: dense panel over the whole calendar. Two conventions of the first session:
    "compose" charges the first entry and then sets the first session's return to 0; "ml" doesn't count the entry.
    A session's holdings are the picks of the session before, so that no score sees its own return.
    """
    calendar = sessions(prices, date)
    on = scores.join(calendar.select(date), date, "left_semi")
    every_day = calendar.select(date).join(on, date, "left").select(date, asset, "score")
    held = holdings(every_day, n, every, weighting, date, asset)
    held = held.select((F.col("ordinal") + 1).alias("ordinal"), asset, "weight").join(F.broadcast(calendar), "ordinal")
    returns = trailing_returns(prices, asset, date)
    gross = held.join(returns, [date, asset], "left").groupBy("ordinal").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross"))
    moves = traded(held.select("ordinal", asset, "weight"), calendar, style == "compose", asset)
    out = calendar.join(gross, "ordinal", "left").join(moves, "ordinal", "left").fillna(0.0, ["gross", "turnover", "sold"])
    net = F.col("gross") - F.col("turnover") * (costs.commission + costs.slippage) - F.col("sold") * costs.stamp
    first = F.lit(0.0) if style == "compose" else -F.col("turnover") * (costs.commission + costs.slippage)
    return out.withColumn("ret", F.when(F.col("ordinal") == 0, first).otherwise(net)).select("ordinal", date, "gross", "turnover", "sold", "ret")


def holdings_maps(held: DataFrame, least: float = 0.001, date: str = "date", asset: str = "asset") -> DataFrame:
    """(date, weights): a map per session, weights of `least` and below dropped, the rest of sum 1. A session's holdings are at most n."""
    rows = held.where(F.col("weight") > least).withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(date)))
    return rows.groupBy(date).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(asset, "weight")))).alias("weights"))
