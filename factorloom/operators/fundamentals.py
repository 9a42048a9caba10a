"""A fluent query over point-in-time fundamentals, as a DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.scalars import to_joinquant_code, to_tushare_code


@dataclass(frozen=True, eq=False)
class Field:
    """A named field: its stored column, and the factor from stored to shown units."""

    name: str
    column: str
    scale: float = 1.0

    def __eq__(self, other: Any) -> Condition:  # type: ignore[override]
        return Condition(self, "==", other)

    def __gt__(self, other: Any) -> Condition:
        return Condition(self, ">", other)

    def __ge__(self, other: Any) -> Condition:
        return Condition(self, ">=", other)

    def __lt__(self, other: Any) -> Condition:
        return Condition(self, "<", other)

    def __le__(self, other: Any) -> Condition:
        return Condition(self, "<=", other)

    def in_(self, values: list) -> Condition:
        return Condition(self, "in", list(values))

    def asc(self) -> tuple[Field, bool]:
        return self, True

    def desc(self) -> tuple[Field, bool]:
        return self, False

    __hash__ = object.__hash__


@dataclass(frozen=True)
class Condition:
    field: Field
    op: str
    value: Any

    def column(self) -> Column:
        """Numbers are compared in stored units; codes in either form."""
        c = F.col(self.field.column)
        if self.field.name == "code":
            same = lambda v: to_tushare_code(F.lit(v))
            return c.isin(*[same(v) for v in self.value]) if self.op == "in" else c == same(self.value)
        ops = {"==": c.__eq__, ">": c.__gt__, ">=": c.__ge__, "<": c.__lt__, "<=": c.__le__}
        return c.isin(self.value) if self.op == "in" else ops[self.op](self.value)


class valuation:
    """Fields of daily valuations; market_cap in 1e8 and capitalization in shares, stored in 1e4 of each."""

    code = Field("code", "ts_code")
    day = Field("day", "trade_date")
    pe_ratio = Field("pe_ratio", "pe")
    pe_ratio_ttm = Field("pe_ratio_ttm", "pe_ttm")
    pb_ratio = Field("pb_ratio", "pb")
    ps_ratio = Field("ps_ratio", "ps")
    turnover_ratio = Field("turnover_ratio", "turnover_rate")
    market_cap = Field("market_cap", "total_mv", 1e-4)
    circulating_market_cap = Field("circulating_market_cap", "circ_mv", 1e-4)
    capitalization = Field("capitalization", "total_share", 1e4)
    circulating_cap = Field("circulating_cap", "float_share", 1e4)


ALL_FIELDS = [v for v in vars(valuation).values() if isinstance(v, Field)]


@dataclass(frozen=True)
class Query:
    fields: tuple[Field, ...]
    conditions: tuple[Condition, ...] = ()
    order: tuple[Field, bool] | None = None
    most: int | None = None

    def filter(self, *conditions: Condition) -> Query:
        return replace(self, conditions=(*self.conditions, *conditions))

    def order_by(self, order: tuple[Field, bool]) -> Query:
        return replace(self, order=order)

    def limit(self, n: int) -> Query:
        return replace(self, most=n)


def query(*fields: Field | type) -> Query:
    """Of all valuation fields, or of those named; a query for the code alone gives only codes."""
    picked = [f for x in fields for f in (ALL_FIELDS if x is valuation else [x])]
    return Query(tuple(picked or ALL_FIELDS))


def get_fundamentals(daily_basic: DataFrame, q: Query, day: str) -> DataFrame:
    """Rows of the latest session up to the day; conditions all hold, each is pushed to the scan; NULLs sort last."""
    upto = daily_basic.where(F.col("trade_date") <= F.lit(day).cast("date"))
    latest = upto.agg(F.max("trade_date").alias("trade_date"))
    rows = upto.join(F.broadcast(latest), "trade_date")  # one row
    for c in q.conditions:
        rows = rows.where(c.column())
    if q.order:
        c = F.col(q.order[0].column)
        rows = rows.orderBy(c.asc_nulls_last() if q.order[1] else c.desc_nulls_last(), "ts_code")
    if q.most is not None:
        rows = rows.limit(q.most)

    def shown(f: Field) -> Column:
        if f.name == "code":
            return to_joinquant_code(F.col(f.column)).alias(f.name)
        return (F.col(f.column) * f.scale if f.scale != 1.0 else F.col(f.column)).alias(f.name)

    have = set(daily_basic.columns)
    return rows.select(*[shown(f) for f in q.fields if f.column in have])
