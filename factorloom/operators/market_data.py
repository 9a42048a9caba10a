"""What a strategy may ask on a day, behind one entry: history, members, securities, industries, fundamentals as known then."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom.functions.scalars import to_joinquant_code

from .asof import listed_at, snapshot_members
from .fundamentals import Query, get_fundamentals

#: Suffixes of codes as strategies write them, and as tables do.
SUFFIXES = {"XSHG": "SH", "XSHE": "SZ"}
#: Fields that are adjusted for corporate actions.
PRICES = ("open", "high", "low", "close", "pre_close")


def stored(code: str) -> str:
    """A code as tables have it, from either way to write it."""
    number, _, place = code.strip().upper().partition(".")
    return f"{number}.{SUFFIXES.get(place, place)}" if place else number


class MarketData:
    """Tables of a market, asked as of a day; each answer is a DataFrame whose codes are as strategies write them.

    bars: ts_code, date, fields, adj_factor; securities: ts_code, kind, list_date, delist_date, and more; weights:
    index_code, con_code, trade_date; industries: ts_code, names of levels, in_date, out_date; valuations: ts_code,
    trade_date and fields. Only what is asked for needs its table. Nothing later than the day enters an answer.
    """

    def __init__(self, bars: DataFrame | None = None, securities: DataFrame | None = None, weights: DataFrame | None = None, industries: DataFrame | None = None, valuations: DataFrame | None = None):
        self.tables = {"bars": bars, "securities": securities, "weights": weights, "industries": industries, "valuations": valuations}

    def _table(self, name: str) -> DataFrame:
        if self.tables[name] is None:
            raise ValueError(f"no table of {name}")
        return self.tables[name]

    def attribute_history(self, codes: Sequence[str] | None, count: int, day: str, fields: Sequence[str] = ("open", "close", "high", "low", "volume", "amount")) -> DataFrame:
        """(code, date, fields) of each code's last `count` bars before the day (all codes, if None), prices adjusted to the factor
        that holds on the day; codes without an earlier bar have no rows."""
        today = F.lit(day).cast("date")
        rows = self._table("bars").where(F.col("date") <= today)
        if codes is not None:
            rows = rows.where(F.col("ts_code").isin([stored(c) for c in codes]))
        unknown = [f for f in fields if f not in rows.columns]
        if unknown:
            raise ValueError(f"bars have no {', '.join(unknown)}")
        factor = F.coalesce(F.col("adj_factor"), F.lit(1.0))
        now = rows.groupBy("ts_code").agg(F.max_by(factor, "date").alias("__now"))
        newest = Window.partitionBy("ts_code").orderBy(F.col("date").desc())
        past = rows.where(F.col("date") < today).withColumn("__nth", F.row_number().over(newest)).where(F.col("__nth") <= count)
        value = lambda f: F.try_divide(F.col(f) * factor, F.col("__now")) if f in PRICES else F.col(f)
        return past.join(now, "ts_code").select(to_joinquant_code(F.col("ts_code")).alias("code"), "date", *[value(f).alias(f) for f in fields])

    def get_index_stocks(self, index: str, day: str) -> DataFrame:
        """(code) of the index's members in its latest snapshot up to the day."""
        return snapshot_members(self._table("weights"), stored(index), day).select(to_joinquant_code(F.col("con_code")).alias("code"))

    def get_all_securities(self, day: str, kinds: Sequence[str] | None = None) -> DataFrame:
        """(code and the table's other columns) of what is listed on the day."""
        found = listed_at(self._table("securities"), day, list(kinds) if kinds else None)
        return found.select(to_joinquant_code(F.col("ts_code")).alias("code"), *[F.col(c) for c in found.columns if c != "ts_code"])

    def get_industry(self, codes: Sequence[str] | None, day: str, level: str = "l1_name") -> DataFrame:
        """(code, industry) on the day, of codes that had one; of several memberships the one that began last."""
        today = F.lit(day).cast("date")
        rows = self._table("industries").where((F.col("in_date") <= today) & (F.col("out_date").isNull() | (F.col("out_date") > today)))
        if codes is not None:
            rows = rows.where(F.col("ts_code").isin([stored(c) for c in codes]))
        last = rows.groupBy("ts_code").agg(F.max_by(F.col(level), F.struct("in_date", level)).alias("industry"))
        return last.select(to_joinquant_code(F.col("ts_code")).alias("code"), "industry")

    def get_fundamentals(self, query: Query, day: str) -> DataFrame:
        """The query over the latest session up to the day."""
        return get_fundamentals(self._table("valuations"), query, day)
