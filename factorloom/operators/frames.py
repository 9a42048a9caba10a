"""Frames by calendar time, n-th values of frames, and ranks over a whole table without a task that holds it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def days_back(asset: str, date: str, days: int) -> WindowSpec:
    """The rows of the last `days` calendar days up to a row's own, however many there are; rows of one day see each other."""
    return Window.partitionBy(asset).orderBy(F.unix_date(F.col(date).cast("date"))).rangeBetween(-(days - 1), 0)


def rolling_days(panel: DataFrame, days: int, columns: Mapping[str, Column], asset: str = "asset", date: str = "date") -> DataFrame:
    """panel with aggregates (as `columns`, by name) over the last `days` calendar days; one exchange for all."""
    w = days_back(asset, date, days)
    return panel.withColumns({name: c.over(w) for name, c in columns.items()})


def nth_of_frame(value: str, n: int, frame: WindowSpec, ignore_nulls: bool = False) -> Column:
    """The n-th value of a frame (from 1), NULL where it has fewer."""
    return F.nth_value(value, n, ignoreNulls=ignore_nulls).over(frame)


def global_position(df: DataFrame, value: str, tie: str, ranges: int = 64, accuracy: int = 10_000) -> DataFrame:
    """df with position, from 1, in order of (value, tie), nulls first, and total: how many rows there are.

    Approximate quantiles of value cut the table into ranges; a value that so many rows share that it is a quantile more than
    once is a range of its own, cut by quantiles of tie. Rows are numbered in their range and moved up by the sizes of
    the ranges before; the sizes, a row a range, meet in one task. Cuts decide how the work is spread, not the result.
    value and tie are numbers.
    """
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    cuts = df.agg(F.percentile_approx(value, shares, accuracy).alias("v"), F.percentile_approx(tie, shares, accuracy).alias("t")).first()
    values, ties = sorted(cuts["v"] or []), sorted(set(cuts["t"] or []))
    hot = sorted({v for v in values if values.count(v) > 1})
    over = lambda c, edges: sum(((F.col(c) > F.lit(e)).cast("int") for e in edges), F.lit(0))
    is_hot = F.col(value).isin(hot) if hot else F.lit(False)
    place = F.when(F.col(value).isNull(), F.struct(F.lit(-1).alias("v"), F.lit(0).alias("hot"), over(tie, ties).alias("t")))
    place = place.otherwise(F.struct(over(value, sorted(set(values))).alias("v"), is_hot.cast("int").alias("hot"), F.when(is_hot, over(tie, ties)).otherwise(0).alias("t")))
    rows = df.withColumn("__range", F.when(F.col(tie).isNull() & (F.col(value).isNull() | is_hot), place.withField("t", F.lit(-1))).otherwise(place))
    sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__size").over(upto), F.lit(0)).alias("__before"), F.sum("__size").over(Window.partitionBy(F.lit(0))).alias("total"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(F.col(value).asc_nulls_first(), F.col(tie).asc_nulls_first()))
    numbered = rows.withColumn("__inside", inside).join(F.broadcast(sizes), F.col("__range") == F.col("__r"))  # some ranges**2 rows at most
    return numbered.select(*df.columns, (F.col("__before") + F.col("__inside")).alias("position"), "total")


def global_ntile(df: DataFrame, n: int, value: str, tie: str, **options) -> DataFrame:
    """df with ntile: n parts of (value, tie) order as equal as can be, the first ones a row larger."""
    rows = global_position(df, value, tie, **options)
    size, more, at = F.floor(F.col("total") / n), F.col("total") % n, F.col("position") - 1
    early = more * (size + 1)  # rows of the larger parts
    part = F.when(at < early, F.floor(at / (size + 1))).otherwise(more + F.floor(F.try_divide(at - early, size)))
    return rows.select(*df.columns, (part + 1).cast("int").alias("ntile"))
