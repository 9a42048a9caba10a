"""Bars and panels from raw tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The canonical bar table: one row per asset and session, whatever the asset class.
BARS = T.StructType(
    [T.StructField("ts_code", T.StringType(), False), T.StructField("date", T.DateType(), False)]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "amount", "pre_close", "pct_chg", "adj_factor", "split_ratio", "turnover_rate", "vwap")]
)
#: What a missing value of a bar becomes.
DEFAULTS = {"adj_factor": 1.0, "split_ratio": 1.0, "turnover_rate": 0.0}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tick_bars(events: DataFrame, unit: str = "day") -> DataFrame:
    """Bars of each user from timed values: asset, date, open, high, low, close, volume (ticks), amount, vwap.

    One partial aggregation by (asset, date); first and last go by time, so equal times should not occur.
    """
    date = F.col("ts").cast("date") if unit == "day" else F.trunc(F.col("ts").cast("date"), unit)
    out = events.groupBy(F.col("user_id").alias("asset"), date.alias("date")).agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
        F.count("value").cast("double").alias("volume"),
        F.sum("value").alias("amount"),
    )
    return out.withColumn("vwap", F.try_divide("amount", "volume"))


def trade_bars(lineitem: DataFrame, unit: str = "month", asset: str = "l_suppkey") -> DataFrame:
    """Bars of each seller from line items: prices are per unit, close is the volume-weighted one."""
    price = F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))
    return lineitem.groupBy(F.col(asset).alias("asset"), F.trunc(F.col("l_shipdate").cast("date"), unit).alias("date")).agg(
        F.avg(price).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("amount"),
        F.avg("l_discount").alias("turn"),
        (F.lit(1.0) + F.avg("l_tax")).alias("adj_factor"),
    )


def number(c: Column) -> Column:
    """A double; text that is none, NaN and infinities are NULL."""
    x = c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def parse_date(c: Column) -> Column:
    """YYYYMMDD text as a date; anything else is NULL."""
    return F.try_to_timestamp(c.cast("string"), F.lit("yyyyMMdd")).cast("date")


def finalize_bars(raw: DataFrame, amount_to_value: float = 10.0) -> DataFrame:
    """The canonical columns: numbers coerced, defaults filled, vwap = amount * amount_to_value / volume where volume is
    not 0, else 0; rows without a key go. Missing columns are NULL or their default."""
    have = set(raw.columns)
    cols = []
    for f in BARS.fields:
        if f.name in ("ts_code", "date"):
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
            continue
        c = number(F.col(f.name)) if f.name in have else F.lit(None).cast("double")
        if f.name == "vwap":
            worth = F.try_divide(number(F.col("amount")) * amount_to_value, number(F.col("volume")))
            c = F.coalesce(worth, F.lit(0.0))
        elif f.name in DEFAULTS:
            c = F.coalesce(c, F.lit(DEFAULTS[f.name]))
        cols.append(c.alias(f.name))
    return raw.select(*cols).dropna(subset=["ts_code", "date"])


def load_bars(daily: DataFrame, adj: DataFrame | None = None, basic: DataFrame | None = None, codes: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily rows left-joined with adjustment factors and daily fundamentals on (ts_code, trade_date).

    The code and date filters stand on every input, so that each scan gets them pushed down.
    """
    key = ["ts_code", "trade_date"]

    def cut(df: DataFrame) -> DataFrame:
        if codes is not None:
            df = df.where(F.col("ts_code").isin(list(codes)))
        if start:
            df = df.where(F.col("trade_date") >= F.lit(start).cast("date"))
        if end:
            df = df.where(F.col("trade_date") <= F.lit(end).cast("date"))
        return df

    out = cut(daily)
    if adj is not None:
        out = out.join(cut(adj).select(*key, "adj_factor"), key, "left")
    if basic is not None:
        out = out.join(cut(basic).select(*key, "turnover_rate"), key, "left")
    return finalize_bars(out.withColumnRenamed("trade_date", "date").withColumnRenamed("vol", "volume"))


def load_fund_bars(daily: DataFrame, adj: DataFrame, nav: DataFrame, codes: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily rows of funds left-joined with adjustment factors, and with net asset values (ts_code, nav_date, unit_nav)."""
    values = nav.select("ts_code", F.col("nav_date").alias("date"), "unit_nav")
    return load_bars(daily, adj, None, codes, start, end).join(values, ["ts_code", "date"], "left")


def routed_union(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Bars of several asset classes in one table, the class in `kind`; columns that a part lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("kind", F.lit(kind)) for kind, df in parts])


def load_benchmark(bars: DataFrame, code: str, start: str, end: str) -> DataFrame:
    """(date, value, base): close times adjustment in the range, and the last value before it (else the first in it)."""
    rows = bars.where((F.col("ts_code") == code) & (F.col("date") <= F.lit(end).cast("date"))).select("date", (F.col("close") * F.coalesce("adj_factor", F.lit(1.0))).alias("value"))
    since = F.col("date") >= F.lit(start).cast("date")
    base = rows.agg(F.coalesce(F.max_by(F.when(~since, F.col("value")), F.when(~since, F.col("date"))), F.min_by(F.when(since, F.col("value")), F.when(since, F.col("date")))).alias("base"))
    return rows.where(since).crossJoin(F.broadcast(base))  # one row


def date_chunks(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """[chunk_start, chunk_end] windows of at most `days` days."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    step = F.make_dt_interval(F.lit(days))
    return spark.range(1).select(F.explode(F.sequence(first, last, step)).alias("chunk_start")).select("chunk_start", F.least(F.date_add("chunk_start", days - 1), last).alias("chunk_end"))
