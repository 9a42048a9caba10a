"""Incremental, idempotent loads into parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def clean_rows(df: DataFrame, schema: T.StructType, key: Sequence[str]) -> DataFrame:
    """Known columns only, cast; NaN as NULL; rows without a full key go."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f"`{f.name}`").try_cast(f.dataType)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                c = F.nullif(c, F.lit(float("nan")))
            cols.append(c.alias(f.name))
    return df.select(*cols).dropna(subset=list(key))


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key. A key's rows are ranked, not collected; WindowGroupLimit keeps one per task."""
    last = Window.partitionBy(*key).orderBy(*[(F.col(c) if isinstance(c, str) else c).desc() for c in order])
    return df.withColumn("__nth", F.row_number().over(last)).where("__nth = 1").drop("__nth")


def merge(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """existing with the rows of new: same keys are replaced, others added; columns that new lacks are NULL in its rows."""
    return existing.join(new.select(*key), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: Sequence[str], partition: str | None = None) -> None:
    """Merges into a parquet table; a repeated run changes nothing.

    With a partition column only the partitions that new touches are rewritten (dynamic overwrite), else all. Of rows of
    new with equal keys one stays (use keep_last() to say which). As a table can't be overwritten while it is read, the
    result is written beside it first, under a name of its own, and goes once the table is there: a run that breaks off in
    between leaves it, whole.
    """
    new = new.dropDuplicates(list(key))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = new
    if files.exists(folder) and files.globStatus(folder.suffix("/*")):
        old = spark.read.parquet(path)
        if partition:
            old = old.join(new.select(partition).distinct(), partition, "left_semi")
        out = merge(old, new, key)
    beside = f"{path.rstrip('/')}__next-{uuid.uuid4().hex}"
    out.write.parquet(beside)
    writer = spark.read.parquet(beside).write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside), True)


def high_water_marks(df: DataFrame, key: str, date: str, default: str) -> DataFrame:
    """(key, start): the day after each key's last date, at least `default`."""
    return df.groupBy(key).agg(F.greatest(F.date_add(F.max(date), 1), F.lit(default).cast("date")).alias("start"))


def table_start(df: DataFrame, date: str, default: str) -> DataFrame:
    """One row: the day after the table's last date, or `default`."""
    return df.agg(F.coalesce(F.date_add(F.max(date), 1), F.lit(default).cast("date")).alias("start"))


def open_sessions(calendar: DataFrame, start: str) -> DataFrame:
    """Open days from a date on, in order."""
    return calendar.where((F.col("is_open") == 1) & (F.col("cal_date") >= F.lit(start).cast("date"))).select("cal_date").orderBy("cal_date")
