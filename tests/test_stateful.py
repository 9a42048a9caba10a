"""Stateful streams: a run that stops in the middle and goes on gives the batch answer."""

import datetime
import random
import time
from collections import defaultdict

import pandas as pd
import pytest

from factorloom.streaming import stateful

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, value double"


def ticks():
    """Batches of ticks: mostly in order, some days late; the last ones close all days."""
    rng = random.Random(9)
    rows, batches = [], []
    for k in range(6):
        batch = []
        for i in range(60):
            day = 2 * k + rng.random() * 2 - (rng.choice([1, 2]) if k and rng.random() < 0.2 else 0)
            batch.append((k * 1000 + i, T0 + datetime.timedelta(seconds=int(day * 86400)), rng.randint(1, 4), round(rng.uniform(1, 99), 2)))
        batches.append(batch)
        rows += batch
    batches.append([(9000 + u, T0 + datetime.timedelta(days=60), u, 1.0) for u in range(1, 5)])
    batches.append([(9100 + u, T0 + datetime.timedelta(days=90), u, 1.0) for u in range(1, 5)])
    return batches, rows


@pytest.fixture(scope="module")
def state(spark):
    before = spark.conf.get(stateful.STORE, None)
    stateful.use_rocksdb(spark)
    yield
    spark.conf.unset(stateful.STORE) if before is None else spark.conf.set(stateful.STORE, before)


def write(spark, folder, batches, first):
    for i, b in enumerate(batches, first):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/part={i:02d}")


def drain(spark, folder, make, out, checkpoint):
    stream = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*"))
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(200)


def test_bars_are_corrected_across_a_restart(spark, state, tmp_path):
    batches, rows = ticks()
    folder, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for part in (slice(0, 3), slice(3, 5), slice(5, 8)):
        write(spark, folder, batches[part], part.start)
        drain(spark, folder, lambda s: stateful.corrected_bars(s, late="5 days"), out, cp)
    want = defaultdict(list)
    for _, ts, user, value in rows:
        want[user, ts.date()].append((ts, value))
    got = defaultdict(list)
    for r in spark.read.parquet(out).collect():
        if r["date"] < datetime.date(2024, 2, 1):
            got[r["asset"], r["date"]].append(r)
    assert set(got) == set(want)
    for key, found in got.items():
        found.sort(key=lambda r: r["revision"])
        assert [r["revision"] for r in found] == list(range(len(found)))
        t = sorted(want[key])
        last = found[-1]
        assert (last["open"], last["high"], last["low"], last["close"], last["volume"]) == (t[0][1], max(v for _, v in t), min(v for _, v in t), t[-1][1], len(t))
        assert last["amount"] == pytest.approx(sum(v for _, v in t))
    assert any(len(found) > 1 for found in got.values())


def feed(spark, folder, out, checkpoint, n):
    """Runs until n rows have come in; by processing time there is always another batch, so the stream has no end of its own."""
    stream = stateful.fresh_ticks(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*"), keep=3)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime="1 second").start()
    until = time.monotonic() + 90
    while sum(p.numInputRows for p in q.recentProgress) < n and time.monotonic() < until and q.isActive:
        time.sleep(0.3)
    q.stop()


def test_replays_pass_once(spark, state, tmp_path):
    batches, _ = ticks()
    folder, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    write(spark, folder, [batches[0], batches[0][:20] + batches[1]], 0)
    feed(spark, folder, out, cp, 140)
    write(spark, folder, [batches[1], batches[2]], 2)
    feed(spark, folder, out, cp, 120)
    got = sorted(spark.read.parquet(out).collect(), key=lambda r: (r["asset"], r["n"]))
    assert sorted(r["event_id"] for r in got) == sorted(r[0] for b in batches[:3] for r in b)
    values = defaultdict(list)
    for r in got:
        values[r["asset"]].append(r["value"])
        recent = values[r["asset"]][-3:]
        assert r["n"] == len(values[r["asset"]]) and r["mean"] == pytest.approx(sum(recent) / len(recent))


def test_streams_joined_within(spark, tmp_path):
    batches, _ = ticks()
    one, two, out, cp = (str(tmp_path / x) for x in ("a", "b", "out", "cp"))
    left, right = batches[0] + batches[2], [(i + 50_000, t + datetime.timedelta(minutes=40), u, v) for i, t, u, v in batches[0][::2] + batches[2][::3]]
    write(spark, one, [left[:60], left[60:], batches[6]], 0)
    write(spark, two, [right[:30], right[30:], batches[6]], 0)
    read = lambda f: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{f}/*")
    q = stateful.join_within(read(one), read(two), "user_id", "0 hours", "2 hours", late="5 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    got = sorted((r["event_id"], r["right_event_id"]) for r in spark.read.parquet(out).collect())
    both = stateful.join_within(spark.createDataFrame(left + batches[6], SCHEMA), spark.createDataFrame(right + batches[6], SCHEMA), "user_id", "0 hours", "2 hours")
    assert got == sorted((r["event_id"], r["right_event_id"]) for r in both.collect())
    assert got == sorted((a[0], b[0]) for a in left + batches[6] for b in right + batches[6] if a[2] == b[2] and datetime.timedelta(0) <= b[1] - a[1] <= datetime.timedelta(hours=2))


class CountedState:
    """State of one asset in memory, counting the calls that would be trips to the JVM."""

    def __init__(self, calls):
        self.calls, self.map, self.value = calls, {}, None

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "updateValue":
                self.map[args[0]] = args[1]
            if name == "update":
                self.value = args[0]
            return {"exists": self.value is not None, "get": self.value, "containsKey": args[:1] and args[0] in self.map, "getValue": args[:1] and self.map.get(args[0]), "iterator": iter(list(self.map.items()))}.get(name)

        return call


def counted_bars(ends):
    calls, timers = [], []
    state = lambda *_: CountedState(calls)
    handle = type("Handle", (), {"getMapState": state, "getValueState": state, "registerTimer": lambda _, at: timers.append(at)})()
    bars = stateful.CorrectedBars(ends)
    bars.init(handle)
    return bars, calls, timers


def test_state_is_read_and_written_once_for_a_batch():
    frames = [pd.DataFrame({"ts": [T0 + datetime.timedelta(hours=5 * k) for k in ks], "value": [float(k % 7) for k in ks]}) for ks in (range(30), range(30, 60))]
    table, calls, timers = counted_bars(True)
    whole = pd.concat(table.handleInputRows((1,), iter(frames), None))
    assert not calls and not timers  # nothing follows a table
    assert len(whole) == 13 and list(whole["close"])[:2] == [4.0, 2.0] and list(whole["pre_close"])[1:] == list(whole["close"])[:-1]
    stream, calls, timers = counted_bars(False)
    first = pd.concat(stream.handleInputRows((1,), iter(frames), None))
    assert first.equals(whole.iloc[:-1]) and len(timers) == 13
    assert len(calls) <= 13 + 6  # a write for each day, and what is kept of the asset
    late = pd.DataFrame({"ts": [T0 + datetime.timedelta(hours=1)], "value": [99.0]})
    again = pd.concat(stream.handleInputRows((1,), iter([late]), None))
    assert [(r.high, r.volume, r.revision) for r in again.itertuples()] == [(99.0, 6, 1)] and len(timers) == 13
