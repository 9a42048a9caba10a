"""Aggregates over the last rows of each series: one pass over sorted Arrow batches.

Spark's sliding frames start every aggregate anew for each row and update it once for each row of its frame. Here all rows of a
batch go together: step k adds the k-th row of every frame to arrays with a value a row, in a frame's order and by the update
formulas of Spark's own aggregates. Spark deals and sorts the rows; a task holds a batch and the rows that its frames reach back.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Number of a row in its series, from 1.
ROW = "__row"


@dataclass(frozen=True)
class Ask:
    """Column `name`: what `kind` says of column x (and y) over the last n rows. Missing values are passed over.

    count; sum and avg; min and max; mean, m2, m3, m4 (central moments times count); ck (of x and y, which are missing in the same
    rows: sum of products of deviations); quantile (param: which); below and upto (values less than the row's own, or no greater);
    idxmax and idxmin (place of the first among those not missing); mad (mean distance from avg); ema (of span n, over the whole
    series, param: rows that matter); lag (the value n rows before, param where the series has no such row).
    """

    name: str
    kind: str
    n: int
    x: str
    y: str | None = None
    param: float | None = None


Values = tuple[np.ndarray, np.ndarray]


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a < b, where NaN is greater than all else."""
    return (a < b) | (np.isnan(b) & ~np.isnan(a))


class _Batch:
    """A batch's rows after those before them: series (values, which aren't missing) by column, from `before` rows back."""

    def __init__(self, row: np.ndarray, series: dict[str, Values], before: int, orders: dict[tuple[str, int], int]) -> None:
        self.row, self.series, self.before, self.orders = row, series, before, orders
        self.made: dict[tuple, np.ndarray | tuple] = {}

    def back(self, x: str, n: int) -> Values:
        """Each row's value n rows before, and whether there is one."""
        at = slice(self.before - n, self.before - n + len(self.row))
        values, known = self.series[x]
        return values[at], known[at] & (self.row > n)

    def frame(self, x: str, n: int) -> Iterator[Values]:
        return (self.back(x, k) for k in range(n - 1, -1, -1))

    def once(self, what: str, *key):
        if (what, *key) not in self.made:
            self.made[what, *key] = getattr(self, what)(*key)
        return self.made[what, *key]

    def count(self, x: str, n: int) -> np.ndarray:
        out = np.zeros(len(self.row))
        for _, known in self.frame(x, n):
            out += known
        return out

    def sum(self, x: str, n: int) -> np.ndarray:
        out = np.zeros(len(self.row))
        for v, known in self.frame(x, n):
            out += np.where(known, v, 0.0)
        return out

    def avg(self, x: str, n: int) -> np.ndarray:
        return self.once("sum", x, n) / np.maximum(self.once("count", x, n), 1)

    def min(self, x: str, n: int) -> np.ndarray:
        out = np.full(len(self.row), np.nan)
        for v, known in self.frame(x, n):
            out = np.where(known, np.fmin(out, v), out)
        return out

    def max(self, x: str, n: int) -> np.ndarray:
        out = np.full(len(self.row), -np.inf)
        for v, known in self.frame(x, n):
            out = np.where(known, np.maximum(out, v), out)
        return out

    def moments(self, x: str, n: int) -> tuple[np.ndarray, ...]:
        """mean, m2 and, where they are asked for, m3 and m4."""
        count, mean, m2, m3, m4 = (np.zeros(len(self.row)) for _ in range(5))
        order = self.orders[x, n]
        for v, known in self.frame(x, n):
            count += known
            d = np.where(known, v - mean, 0.0)
            dn = d / np.maximum(count, 1)
            mean += dn
            m2 += d * (d - dn)
            if order > 2:
                d2, dn2 = d * d, dn * dn
                m3 = m3 - 3.0 * dn * m2 + d * (d2 - dn2)
                if order > 3:
                    m4 = m4 - 4.0 * dn * m3 - 6.0 * dn2 * m2 + d * (d * d2 - dn * dn2)
        return mean, m2, m3, m4

    def ck(self, x: str, y: str, n: int) -> np.ndarray:
        count, mx, my, out = (np.zeros(len(self.row)) for _ in range(4))
        for (a, known), (b, _) in zip(self.frame(x, n), self.frame(y, n), strict=True):
            count += known
            step = np.maximum(count, 1)
            da = np.where(known, a - mx, 0.0)
            my += np.where(known, b - my, 0.0) / step
            mx += da / step
            out += np.where(known, da * (b - my), 0.0)
        return out

    def ascending(self, x: str, n: int) -> np.ndarray:
        out = np.empty((len(self.row), n))
        for k, (v, known) in enumerate(self.frame(x, n)):
            out[:, k] = np.where(known, v, np.nan)
        out.sort(axis=1)
        return out

    def quantile(self, x: str, n: int, q: float) -> np.ndarray:
        ordered = self.once("ascending", x, n)
        at = np.maximum(self.once("count", x, n) - 1, 0) * q
        low = np.floor(at)
        below, above = (np.take_along_axis(ordered, i.astype(np.int64)[:, None], 1)[:, 0] for i in (low, np.ceil(at)))
        return below + (above - below) * (at - low)

    def below(self, x: str, n: int) -> np.ndarray:
        own, has = self.back(x, 0)
        out = np.zeros(len(self.row))
        for v, known in self.frame(x, n):
            out += known & has & _less(v, own)
        return out

    def upto(self, x: str, n: int) -> np.ndarray:
        own, has = self.back(x, 0)
        out = np.zeros(len(self.row))
        for v, known in self.frame(x, n):
            out += known & has & ~_less(own, v)
        return out

    def place(self, x: str, n: int, less) -> np.ndarray:
        best, out, seen = (np.zeros(len(self.row)) for _ in range(3))
        for v, known in self.frame(x, n):
            better = known & ((seen == 0) | less(best, v))
            best, out = np.where(better, v, best), np.where(better, seen, out)
            seen += known
        return out

    def mad(self, x: str, n: int) -> np.ndarray:
        out, mean = np.zeros(len(self.row)), self.once("avg", x, n)
        for v, known in self.frame(x, n):
            out += np.where(known, np.abs(v - mean), 0.0)
        return out / np.maximum(self.once("count", x, n), 1)

    def ema(self, x: str, n: int, terms: int, state: list | None) -> tuple[np.ndarray, list]:
        """Means, and the state after them: the last mean, and the last `terms` rows (None: missing). Where a mean isn't finite, it is
        that of these rows alone, so that an infinite value is forgotten when its weight would be nothing."""
        alpha = 2.0 / (n + 1)
        v, known = self.back(x, 0)
        last, seen = state or (None, deque(maxlen=terms))
        out = []
        for first, value, there in zip((self.row == 1).tolist(), v.tolist(), known.tolist(), strict=True):
            if first:
                last = None
                seen.clear()
            seen.append(value if there else None)
            if there:
                last = value if last is None else last * (1 - alpha) + value * alpha
                if not math.isfinite(last):
                    last = None
                    for e in seen:
                        if e is not None:
                            last = e if last is None else last * (1 - alpha) + e * alpha
            out.append(last if there else 0.0)
        return np.array(out, dtype=float), [last, seen]


def _answer(rows: _Batch, ask: Ask, last: dict[Ask, list]) -> Values:
    x, n = ask.x, ask.n
    if ask.kind == "lag":
        values, known = rows.back(x, n)
        return (values, known) if ask.param is None else (np.where(rows.row > n, values, ask.param), known | (rows.row <= n))
    if ask.kind == "ema":
        values, last[ask] = rows.ema(x, n, int(ask.param), last.get(ask))
        return values, rows.back(x, 0)[1]
    some = rows.once("count", x, n) > 0
    if ask.kind in ("count", "sum", "below", "upto"):
        return rows.once(ask.kind, x, n), np.ones(len(some), dtype=bool)
    if ask.kind in ("mean", "m2", "m3", "m4"):
        return rows.once("moments", x, n)[("mean", "m2", "m3", "m4").index(ask.kind)], some
    if ask.kind in ("idxmax", "idxmin"):
        return rows.place(x, n, _less if ask.kind == "idxmax" else lambda best, v: _less(v, best)), some
    if ask.kind == "ck":
        return rows.once("ck", x, ask.y, n), some
    if ask.kind == "quantile":
        return rows.quantile(x, n, ask.param), some
    return rows.once(ask.kind, x, n), some


def slide_sorted(batches: Iterator[pa.RecordBatch], asks: tuple[Ask, ...], kept: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The kept columns of batches and those asked for. A series' rows stand together and in order, also across batches."""
    inputs = sorted({c for a in asks for c in (a.x, a.y) if c is not None})
    before = max(a.n if a.kind == "lag" else 0 if a.kind == "ema" else a.n - 1 for a in asks)
    orders: dict[tuple[str, int], int] = {}
    for a in asks:
        orders[a.x, a.n] = max(orders.get((a.x, a.n), 2), {"m3": 3, "m4": 4}.get(a.kind, 2))
    tail: dict[str, Values] = {c: (np.zeros(before), np.zeros(before, dtype=bool)) for c in inputs}
    last: dict[Ask, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        series = {}
        for c in inputs:
            column = batch.column(c)
            values, known = column.fill_null(0.0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
            series[c] = np.concatenate([tail[c][0], values]), np.concatenate([tail[c][1], known])
        rows = _Batch(batch.column(ROW).to_numpy(), series, before, orders)
        with np.errstate(all="ignore"):
            made = [_answer(rows, a, last) for a in asks]
        arrays = [pa.array(values, pa.float64(), mask=~known, from_pandas=False) for values, known in made]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], names=[*kept, *(a.name for a in asks)])
        tail = {c: (v[len(v) - before :], known[len(v) - before :]) for c, (v, known) in series.items()}


def slide(df: DataFrame, asks: list[Ask], inputs: set[str]) -> DataFrame:
    """df with a column for each ask, without the input columns. df: sorted partitions of whole series, with ROW."""
    fields = [f for f in df.schema.fields if f.name not in inputs]
    schema = T.StructType(fields + [T.StructField(a.name, T.DoubleType()) for a in asks])
    return df.mapInArrow(partial(slide_sorted, asks=tuple(asks), kept=tuple(f.name for f in fields)), schema)
