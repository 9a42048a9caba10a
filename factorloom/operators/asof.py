"""Point-in-time lookups: snapshots, intervals, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def snapshot_members(weights: DataFrame, index_code: str, day: str) -> DataFrame:
    """Members of an index in its latest snapshot up to a day."""
    rows = weights.where((F.col("index_code") == index_code) & (F.col("trade_date") <= F.lit(day).cast("date")))
    latest = rows.agg(F.max("trade_date").alias("trade_date"))
    return rows.join(F.broadcast(latest), "trade_date", "left_semi").select("con_code").distinct()  # one row


def members_between(weights: DataFrame, index_code: str, start: str, end: str) -> DataFrame:
    """All codes that were members at the start or in any snapshot up to the end."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    rows = weights.where((F.col("index_code") == index_code) & (F.col("trade_date") <= hi))
    first = rows.agg(F.coalesce(F.max(F.when(F.col("trade_date") <= lo, F.col("trade_date"))), lo).alias("__first"))
    return rows.join(F.broadcast(first), F.col("trade_date") >= F.col("__first")).select("con_code").distinct()  # one row


def interval_join(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, bucket_days: int = 64) -> DataFrame:
    """points with the spans of the same key that hold them: start <= at, and end is NULL or after at.

    Time is cut into buckets of bucket_days days, and each span stands in every bucket that it touches, so that the join
    is an equi-join that Spark can shuffle, broadcast or split for skew; open spans end with the last point.
    """
    last = points.agg(F.max(at).alias("__last"))
    number = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / bucket_days)
    to = F.coalesce(F.col(end), F.date_add("__last", 1))
    cut = spans.crossJoin(F.broadcast(last)).where(F.col(start) <= to)  # one row
    cut = cut.withColumn("__bucket", F.explode(F.sequence(number(F.col(start)), number(to)))).drop("__last")
    left = points.withColumn("__bucket", number(F.col(at)))
    inside = (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    return left.join(cut, [*key, "__bucket"]).where(inside).drop("__bucket")


def asof_join(left: DataFrame, right: DataFrame, key: list[str], at: str, values: list[str], right_at: str | None = None) -> DataFrame:
    """left with the values of right's last row at or before each time.

    One union sorted by (key, time) and a running last: each side is shuffled once, and no pair of rows is made.
    """
    stamp = right_at or at
    packed = F.struct(*[F.col(v) for v in values])
    a = left.withColumn("__at", F.col(at)).withColumn("__side", F.lit(1)).withColumn("__row", F.struct(*left.columns))
    a = a.select(*key, "__at", "__side", "__row")
    b = right.select(*key, F.col(stamp).alias("__at"), F.lit(0).alias("__side"), packed.alias("__values"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__seen", F.last("__values", ignorenulls=True).over(w)).where("__side = 1")
    return both.select("__row.*", *[F.col(f"__seen.{v}").alias(v) for v in values])


def listed_at(securities: DataFrame, day: str, kinds: list[str] | None = None) -> DataFrame:
    """Securities listed by a day and not delisted by it."""
    d = F.lit(day).cast("date")
    out = securities.where((F.col("list_date") <= d) & (F.col("delist_date").isNull() | (F.col("delist_date") > d)))
    return out.where(F.col("kind").isin(kinds)) if kinds else out


def latest_industry(members: DataFrame) -> DataFrame:
    """(ts_code, industry): the current one of each code, the last row winning."""
    current = members.where("is_new = 'Y'")
    last = Window.partitionBy("ts_code").orderBy(F.col("in_date").desc(), F.col("id").desc())
    return current.withColumn("__nth", F.row_number().over(last)).where("__nth = 1").select("ts_code", F.col("l1_name").alias("industry"))
