"""Universes: index snapshots as spans of membership, unions of indices, and what a request for a universe resolves to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .asof import interval_join

#: What asks for everything.
ALL = ("", "all", "*")


def membership_spans(snapshots: DataFrame, index: str = "index_code", member: str = "con_code", date: str = "trade_date") -> DataFrame:
    """(index, member, in_date, out_date) from snapshots, a row for each member of each: a member that is in consecutive snapshots
    of its index is in from the first of them until the first without it (NULL where there is none yet); who comes
    back has a further span.

    Snapshots are numbered for each index, a row for each (index, date); a member's runs of consecutive numbers are its
    islands. Repeated rows count once, rows without a key don't count.
    """
    rows = snapshots.select(index, member, date).dropna().distinct()
    days = rows.select(index, date).distinct()
    by_day = Window.partitionBy(index).orderBy(date)
    days = days.select(index, date, F.row_number().over(by_day).alias("__n"), F.lead(date).over(by_day).alias("__next"))
    own = Window.partitionBy(index, member).orderBy("__n")
    runs = rows.join(days, [index, date]).withColumn("__island", F.col("__n") - F.row_number().over(own))
    spans = runs.groupBy(index, member, "__island").agg(F.min(date).alias("in_date"), F.max_by("__next", "__n").alias("out_date"))
    return spans.select(index, member, "in_date", "out_date")


def merged_spans(spans: DataFrame, member: str = "con_code", start: str = "in_date", end: str = "out_date") -> DataFrame:
    """(member, start, end): the union of each member's spans, overlapping and touching ones as one; a NULL end is open."""
    own = Window.partitionBy(member).orderBy(start, F.col(end).asc_nulls_last())
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    far = F.lit("9999-12-31").cast("date")
    reach = F.max(F.coalesce(F.col(end), far)).over(before)
    begun = spans.select(member, start, end, F.when(F.col(start) <= reach, 0).otherwise(1).alias("__new"))
    grouped = begun.withColumn("__island", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = grouped.groupBy(member, "__island").agg(F.min(start).alias(start), F.max(F.coalesce(F.col(end), far)).alias("__end"))
    return out.select(member, start, F.nullif(F.col("__end"), far).alias(end))


def resolve_universe(asked: Sequence[str], spans: DataFrame, listed: DataFrame, start: str, end: str, index: str = "index_code", member: str = "con_code") -> DataFrame:
    """(member) of a request between two days: codes stand for themselves, index codes for all who were in at any time of the
    range, "all" (or nothing) for everybody; if nobody is found, for everybody too.

    listed: (member) of all that can be traded, which also says which codes there are.
    """
    everybody = listed.select(F.col(member)).distinct()
    names = [a.strip() for a in asked if a.strip().lower() not in ALL]
    if not names:
        return everybody
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    of_indices = spans.where(F.col(index).isin(names) & (F.col("in_date") <= hi) & (F.col("out_date").isNull() | (F.col("out_date") > lo)))
    found = of_indices.select(member).unionByName(everybody.where(F.col(member).isin(names))).distinct()
    some = found.limit(1).select(F.lit(True).alias("__some"))  # one row at most
    rest = everybody.join(F.broadcast(some), F.lit(True), "left_anti")
    return found.unionByName(rest)


def in_universe(points: DataFrame, spans: DataFrame, indices: Sequence[str], at: str, code: str, index: str = "index_code", member: str = "con_code") -> DataFrame:
    """points whose code was in one of the indices on their day, each once: an equi-join by code and time bucket with spans that
    don't overlap."""
    union = merged_spans(spans.where(F.col(index).isin(list(indices))), member).withColumnRenamed(member, code)
    return interval_join(points, union, [code], at, "in_date", "out_date").drop("in_date", "out_date")


def asks_of_text(text: Column) -> Column:
    """The universe codes that a text names, each once, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b\d{6}\.(?:XSHG|XSHE|SH|SZ|BJ)\b"), 0)
    return F.array_distinct(found)
