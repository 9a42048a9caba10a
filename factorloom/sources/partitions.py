"""What the names of partitions and the sizes of files tell without reading rows."""

from __future__ import annotations

import urllib.parse
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list:
    at, files = _folder(spark, path)
    return list(files.listStatus(at)) if files.exists(at) else []


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether any parquet file right under path has rows, by its footer; files without bytes aren't opened."""
    names = [f.getPath() for f in _children(spark, path) if f.isFile() and f.getLen() > 0 and f.getPath().getName()[0] not in "_."]
    return any(not spark.read.parquet(str(n)).isEmpty() for n in sorted(names, key=str))


def partition_values(spark: SparkSession, path: str, column: str, whole: bool = False) -> list[str]:
    """The values of `column` in the names of the folders right under path, ascending as text; none where path isn't there.
    whole: only folders whose writer has said that it is done."""
    out = []
    for f in _children(spark, path):
        name, _, value = f.getPath().getName().partition("=")
        if f.isDirectory() and name == column and value != "__HIVE_DEFAULT_PARTITION__":
            if not whole or any(c.getPath().getName() == "_SUCCESS" for c in _children(spark, str(f.getPath()))):
                out.append(urllib.parse.unquote(value))
    return sorted(out)


def latest_days(spark: SparkSession, path: str, column: str, most: int = 20, until: str | None = None) -> Iterator[tuple[str, str]]:
    """(value, folder) of the last `most` partitions up to `until`, newest first."""
    days = [v for v in partition_values(spark, path, column) if until is None or v <= until]
    for v in days[::-1][:most]:
        yield v, f"{path.rstrip('/')}/{column}={urllib.parse.quote(v, safe='-_.')}"


def last_day_with_rows(spark: SparkSession, path: str, column: str, most: int = 20, until: str | None = None) -> str | None:
    """The newest of the last `most` partitions that holds rows, found day by day from the end; None if none does.

    Partitions are listed by name. Of each that is tried, files are opened until one has a row, so a full table costs one
    file, and days that are empty their footers.
    """
    return next((v for v, folder in latest_days(spark, path, column, most, until) if has_rows(spark, folder)), None)


def discover_universe(spark: SparkSession, path: str, column: str, code: str, most: int = 20, until: str | None = None) -> DataFrame:
    """(code) of the newest day that has rows, read from that day's partition alone; nobody where no day has."""
    day = last_day_with_rows(spark, path, column, most, until)
    table = spark.read.parquet(path)
    same = F.col(column) == F.lit(day).cast(table.schema[column].dataType) if day is not None else F.lit(False)
    return table.where(same).select(code).where(F.col(code).isNotNull()).distinct()
