"""Streams with state of their own: bars that late ticks correct, ticks without replays, joins of streams by interval.

The processors run by transformWithStateInPandas, so a stream needs the RocksDB state store (use_rocksdb()).
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
_DAY_MS = 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    """Has the session's streams keep their state in RocksDB, as processors with timers need."""
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


BAR_STATE = "open double, open_us long, high double, low double, close double, close_us long, volume long, amount double, revision int"
BAR_ROWS = "asset long, date date, open double, high double, low double, close double, volume long, amount double, pre_close double, revision int"


def bars_of_frame(frame: pd.DataFrame) -> dict[int, tuple]:
    """Of ticks (ts, value) in any order: open, its time, high, low, close, its time, ticks and amount by day, in order of days."""
    us, value = frame["ts"].to_numpy().astype("datetime64[us]").astype("int64"), frame["value"].to_numpy(dtype="float64")
    order = np.lexsort((value, us))
    us, value = us[order], value[order]
    day = us // (1000 * _DAY_MS)
    first = np.flatnonzero(np.diff(day, prepend=day[:1] - 1))
    end = np.append(first[1:], len(day))
    high, low, amount = np.fmax.reduceat(value, first), np.fmin.reduceat(value, first), np.add.reduceat(np.where(np.isnan(value), 0.0, value), first)
    columns = (value[first], us[first], high, low, value[end - 1], us[end - 1], end - first, amount)
    return dict(zip(day[first].tolist(), zip(*(c.tolist() for c in columns), strict=True), strict=True))


def joined(o: tuple, new: tuple) -> tuple:
    """One day's bar of two parts of its ticks."""
    early, late = min((o[1], o[0]), (new[1], new[0])), max((o[5], o[4]), (new[5], new[4]))
    return (early[1], early[0], max(o[2], new[2]), min(o[3], new[3]), late[1], late[0], o[6] + new[6], o[7] + new[7])


class CorrectedBars(StatefulProcessor):
    """Daily bars of one asset from ticks in any order, as early as they can be known, and again when they change.

    Each open day is an entry of a map. The first tick of a later day puts the bar out as revision 0; a late tick changes the
    entry, and the bar goes out again under the next revision, once for each batch that changes it. An event-time
    timer at the day's end, which fires when the watermark says that no more of its ticks are taken, puts out a bar
    that nothing has followed, and drops the entry. pre_close is the close of the latest earlier day that was put out,
    as known when the bar goes out.

    Each call to the state is a trip to the JVM, so an asset's state is read once for a batch, and what a batch changes is
    written once. A table has one batch, which nothing follows: none of it is written.
    """

    def __init__(self, ends: bool = False):
        self.ends = ends  # whether input ends with what is given: a table, whose last days nothing follows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", BAR_STATE)
        self.newest = handle.getValueState("newest", "day int")
        self.last = handle.getValueState("last", "day int, close double")

    @staticmethod
    def _put_out(asset: Any, days: dict[int, tuple], due: list[int], before: tuple | None) -> tuple[list[tuple], tuple | None]:
        """Rows of the days that are due, whose revisions rise, and the latest day that was put out with its close."""
        out = []
        for day in due:
            bar = days[day] = (*days[day][:8], days[day][8] + 1)
            pre = float(before[1]) if before is not None and before[0] < day else None
            if before is None or before[0] <= day:
                before = (day, bar[4])
            date = datetime.date(1970, 1, 1) + datetime.timedelta(days=day)
            out.append((asset, date, bar[0], bar[2], bar[3], bar[4], bar[6], bar[7], pre, bar[8]))
        return out, before

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in BAR_ROWS.split(", ")])

    def _last(self) -> tuple | None:
        return tuple(self.last.get()) if self.last.exists() else None

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        days = {} if self.ends else {k[0]: tuple(bar) for k, bar in self.days.iterator()}
        had, touched = set(days), set()
        for frame in rows:
            for day, new in bars_of_frame(frame).items():
                days[day] = (*joined(days[day], new), days[day][8]) if day in days else (*new, -1)  # -1: not put out yet
                touched.add(day)
        known = None if self.ends or not self.newest.exists() else self.newest.get()[0]
        newest = max(touched) if known is None else max(known, *touched)
        over = {d for d in (touched if known is None else {*touched, known}) if (d < newest or self.ends) and d in days}
        due = [d for d in sorted(over) if d in touched or days[d][8] < 0]
        before = None if self.ends else self._last()
        out, last = self._put_out(key[0], days, due, before)
        if not self.ends:
            for day in sorted(touched - had):
                self.handle.registerTimer((day + 1) * _DAY_MS)
            for day in sorted(touched.union(due)):
                self.days.updateValue((day,), days[day])
            if newest != known:
                self.newest.update((newest,))
            if last != before:
                self.last.update(last)
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        day, out = expiredTimerInfo.getExpiryTimeInMs() // _DAY_MS - 1, []
        if self.days.containsKey((day,)):
            bar = tuple(self.days.getValue((day,)))
            if bar[8] < 0:
                out, last = self._put_out(key[0], {day: bar}, [day], self._last())
                self.last.update(last)
            self.days.removeKey((day,))
        yield self._frame(out)

    def close(self) -> None:
        pass


def corrected_bars(ticks: DataFrame, late: str = "4 days", asset: str = "user_id") -> DataFrame:
    """The stream of bars and their corrections: of an (asset, date), the row of the highest revision is the one that counts.

    Ticks are taken until the watermark, `late` behind the newest tick of all, has passed them; those without time or
    value are passed over. Of a table, all days are put out.
    """
    if not ticks.isStreaming:
        ticks.sparkSession.streams.active  # noqa: B018  starts what keeps track of state stores, which a stream would have done
    rows = ticks.select(F.col(asset).cast("long").alias("asset"), "ts", F.col("value").cast("double").alias("value")).where("ts IS NOT NULL AND value IS NOT NULL")
    return rows.withWatermark("ts", late).groupBy("asset").transformWithStateInPandas(CorrectedBars(ends=not ticks.isStreaming), BAR_ROWS, "append", "eventTime")


MEAN_ROWS = "asset long, event_id long, ts timestamp, value double, mean double, n long"


class FreshTicks(StatefulProcessor):
    """Passes each event on once, with the mean of the last `keep` values: ids are remembered for `ttl_ms`, then forgotten."""

    def __init__(self, keep: int, ttl_ms: int):
        self.keep, self.ttl_ms = keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "event_id long", "ts_us long", self.ttl_ms)
        self.recent = handle.getListState("recent", "value double")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        recent = [float(v[0]) for v in self.recent.get()] if self.recent.exists() else []
        n = int(self.count.get()[0]) if self.count.exists() else 0
        out = []
        for frame in rows:
            for r in frame.sort_values(["ts", "event_id"]).itertuples(index=False):
                if self.seen.containsKey((int(r.event_id),)):
                    continue
                self.seen.updateValue((int(r.event_id),), (int(pd.Timestamp(r.ts).value // 1000),))
                recent, n = [*recent, float(r.value)][-self.keep :], n + 1
                out.append((key[0], int(r.event_id), r.ts, float(r.value), sum(recent) / len(recent), n))
        if out:
            self.recent.put([(v,) for v in recent])
            self.count.update((n,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MEAN_ROWS.split(", ")])

    def close(self) -> None:
        pass


def fresh_ticks(ticks: DataFrame, keep: int = 5, ttl_ms: int = 3_600_000, asset: str = "user_id") -> DataFrame:
    """Ticks without replays of an event_id within ttl_ms of processing time, each with the running mean of its asset."""
    rows = ticks.select(F.col(asset).cast("long").alias("asset"), "event_id", "ts", F.col("value").cast("double").alias("value")).where("value IS NOT NULL AND event_id IS NOT NULL")
    return rows.groupBy("asset").transformWithStateInPandas(FreshTicks(keep, ttl_ms), MEAN_ROWS, "append", "processingTime")


def join_within(left: DataFrame, right: DataFrame, key: str, before: str, after: str, late: str = "1 day", how: str = "inner") -> DataFrame:
    """Rows of two streams (or tables) with equal keys, right's ts from `before` ahead of left's to `after` behind it.

    Both sides carry a watermark, so that Spark can drop a row from its state once no partner can come any more; with how =
    "leftOuter" a left row without a partner goes out then. Columns of right get the prefix right_.
    """
    a, b = (df.withWatermark("ts", late) if df.isStreaming else df for df in (left, right))
    b = b.select(*[F.col(c).alias(f"right_{c}") for c in b.columns])
    near = F.expr(f"right_ts >= ts - INTERVAL {before} AND right_ts <= ts + INTERVAL {after}")
    return a.join(b, (F.col(key) == F.col(f"right_{key}")) & near, how)
