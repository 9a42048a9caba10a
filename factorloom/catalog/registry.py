"""Registration, and the panels that queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.operators.calendar import densify
from factorloom.sources.bars import table, tick_bars, trade_bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def ubars(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of users' event values."""
    return tick_bars(table(spark, d, "events"))


def sbars(spark: SparkSession, d: str) -> DataFrame:
    """Monthly bars of suppliers' sales."""
    return trade_bars(table(spark, d, "lineitem"))


def ud(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return densify(ubars(spark, d), whole=whole)


def sd(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return densify(sbars(spark, d), whole=whole)


def rnd(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


UB = """ub AS (SELECT user_id AS asset, CAST(ts AS DATE) AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, ts) AS close, count(value)::DOUBLE AS volume, sum(value) AS amount, sum(value) / count(value) AS vwap FROM events GROUP BY 1, 2)"""
SB = """sb AS (SELECT l_suppkey AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_extendedprice / nullif(l_quantity, 0)) AS open,
 max(l_extendedprice / nullif(l_quantity, 0)) AS high, min(l_extendedprice / nullif(l_quantity, 0)) AS low,
 sum(l_extendedprice) / nullif(sum(l_quantity), 0) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount,
 avg(l_discount) AS turn, 1 + avg(l_tax) AS adj_factor FROM lineitem GROUP BY 1, 2)"""


def dense_sql(bars: str, whole: bool = False, out: str = "p") -> str:
    inside = "" if whole else " AND c.date BETWEEN r.lo AND r.hi"
    return f"""{out}_cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ordinal FROM (SELECT DISTINCT date FROM {bars})),
 {out} AS (SELECT r.asset, c.date, c.ordinal, b.* EXCLUDE (asset, date) FROM (SELECT asset, min(date) lo, max(date) hi FROM {bars} GROUP BY 1) r
 JOIN {out}_cal c ON true{inside} LEFT JOIN {bars} b ON b.asset = r.asset AND b.date = c.date)"""


UD = f"WITH {UB}, {dense_sql('ub')}"
SD = f"WITH {SB}, {dense_sql('sb')}"
UDW = f"WITH {UB}, {dense_sql('ub', True)}"
SDW = f"WITH {SB}, {dense_sql('sb', True)}"
