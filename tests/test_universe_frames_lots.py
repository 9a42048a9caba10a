"""Universes, frames, sketches and lots against plain Python, with gaps, ties, nulls and empty tables."""

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factorloom.operators import frames, lots, sketches, universe

D0 = datetime.date(2024, 1, 1)


def day(n):
    return D0 + datetime.timedelta(days=n)


@pytest.fixture(scope="module")
def snapshots(spark):
    rng = random.Random(3)
    rows = [("I", f"c{k}", day(7 * t)) for t in range(12) for k in range(8) if rng.random() < 0.6 or k == 0]
    rows += [("J", f"c{k}", day(10 * t + 1)) for t in range(6) for k in range(4, 12) if rng.random() < 0.5]
    rows += rows[:5] + [("I", None, day(0)), (None, "c1", day(0)), ("J", "c1", None)]
    return spark.createDataFrame(rows, "index_code string, con_code string, trade_date date"), rows


def in_spans(spans, code, d, indices):
    return any(r["con_code"] == code and r["index_code"] in indices and r["in_date"] <= d and (r["out_date"] is None or d < r["out_date"]) for r in spans)


def test_membership_spans(snapshots):
    df, rows = snapshots
    spans = universe.membership_spans(df).collect()
    members = defaultdict(set)
    for i, c, d in rows:
        if i and c and d:
            members[i, d].add(c)
    for i in "IJ":
        days = sorted(d for j, d in members if j == i)
        for n in range(-3, 100):
            latest = max((d for d in days if d <= day(n)), default=None)
            want = members[i, latest] if latest else set()
            assert {r["con_code"] for r in spans if in_spans([r], r["con_code"], day(n), [i])} == want
    per = defaultdict(list)
    for r in spans:
        per[r["index_code"], r["con_code"]].append(r)
    assert any(len(v) > 2 for v in per.values()) and len(per["I", "c0"]) == 1 and per["I", "c0"][0]["out_date"] is None


def test_merged_and_resolved(spark, snapshots):
    spans = universe.membership_spans(snapshots[0])
    raw = spans.collect()
    union = universe.merged_spans(spans).collect()
    for code in {r["con_code"] for r in raw}:
        own = sorted((r["in_date"], r["out_date"] or datetime.date.max) for r in union if r["con_code"] == code)
        assert all(b[0] > a[1] for a, b in zip(own, own[1:]))
        for n in range(100):
            assert any(a <= day(n) < b for a, b in own) == in_spans(raw, code, day(n), "IJ")
    listed = spark.createDataFrame([(f"c{k}",) for k in range(14)], "con_code string")
    ask = lambda *a: {r[0] for r in universe.resolve_universe(a, spans, listed, str(day(20)), str(day(30))).collect()}
    everybody = {f"c{k}" for k in range(14)}
    ever = lambda i: {r["con_code"] for r in raw if r["index_code"] in i and r["in_date"] <= day(30) and (r["out_date"] is None or r["out_date"] > day(20))}
    assert ask() == ask("all") == ask(" ALL ") == ask("nobody") == everybody
    assert ask("I") == ever("I") and ask("I", "J", "c13") == ever("IJ") | {"c13"} and ask("c2", "c2") == {"c2"}
    points = spark.createDataFrame([(f"c{k}", day(n)) for k in range(14) for n in range(0, 90, 3)] + [(None, day(3)), ("c1", None)], "code string, at date")
    got = universe.in_universe(points, spans, ["I", "J"], "at", "code").collect()
    assert sorted(map(tuple, got)) == sorted((f"c{k}", day(n)) for k in range(14) for n in range(0, 90, 3) if in_spans(raw, f"c{k}", day(n), "IJ"))
    text = spark.createDataFrame([("use 000300.XSHG and 600000.SH, 000300.XSHG; 1234567.SH",), (None,)], "t string")
    assert [r[0] for r in text.select(universe.asks_of_text(F.col("t"))).collect()] == [["000300.XSHG", "600000.SH"], []]
    assert universe.membership_spans(snapshots[0].limit(0)).count() == 0


def test_frames_by_days(spark):
    rows = [("a", day(n), float(v)) for n, v in ((0, 1), (1, 5), (1, 2), (4, 9), (40, 3))] + [("b", day(2), None), ("b", day(3), 4.0)]
    df = spark.createDataFrame(rows, "asset string, date date, v double")
    got = {(r["asset"], r["date"], r["v"]): (r["n"], r["s"]) for r in frames.rolling_days(df, 4, {"n": F.count(F.lit(1)), "s": F.sum("v")}).collect()}
    for a, d, v in rows:
        inside = [x for b, e, x in rows if a == b and 0 <= (d - e).days < 4]
        assert got[a, d, v] == (len(inside), sum(x for x in inside if x is not None) if any(x is not None for x in inside) else None)


@pytest.mark.parametrize("n", [1, 3, 7, 1000])
def test_global_ntile(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([1.0, 1.0, 1.0, rng.randint(0, 9) / 2, None]), i if i % 40 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "v double, id long").repartition(5)
    size, more = divmod(len(rows), n)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0))
    want = [k + 1 for k in range(n) for _ in range(size + (k < more))]
    got = frames.global_ntile(df, n, "v", "id", ranges=16).collect()
    have = defaultdict(list)
    for (v, i), t in zip(order, want):
        have[v, i].append(t)
    assert sorted((r["v"] is not None, r["v"] or 0, r["id"] or 0, r["ntile"]) for r in got) == sorted((v is not None, v or 0, i or 0, t) for (v, i), ts in have.items() for t in ts)
    assert frames.global_position(df, "v", "id", ranges=16).select(F.count_distinct("position"), F.max("position")).first() == (500, 500)
    assert frames.global_ntile(df.limit(0), n, "v", "id").count() == 0


def test_sketches_merge(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("k"), F.lit(D0).cast("date").alias("x"), (F.col("id") % 30).cast("int").alias("n"), (F.hash("id") % 20_000).alias("u"), F.when(F.col("id") % 11 > 0, F.col("id").cast("double")).alias("v"))
    rows = rows.withColumn("day", F.date_add("x", F.col("n")))
    daily = sketches.daily_sketches(rows, "k", "day", "u", "v")
    assert daily.count() == 30
    exact = {r["k"]: r for r in rows.groupBy("k").agg(F.count_distinct("u").alias("u"), F.percentile("v", F.array(F.lit(0.45), F.lit(0.55))).alias("q"), F.count(F.lit(1)).alias("n")).collect()}
    whole = {r["k"]: r for r in sketches.estimates(sketches.daily_sketches(rows.withColumn("day", F.col("x")), "k", "day", "u", "v"), ["k"]).collect()}
    halves = sketches.merged(daily.withColumn("half", F.col("day") > F.lit(day(14))), ["k", "half"])
    for got in (sketches.estimates(daily, ["k"]), sketches.estimates(halves, ["k"])):
        for r in got.collect():
            assert abs(r["distinct"] - exact[r["k"]]["u"]) <= 4 * sketches.DISTINCT_ERROR * exact[r["k"]]["u"]
            assert exact[r["k"]]["q"][0] <= r["q_0_5"] <= exact[r["k"]]["q"][1] and r["n"] == exact[r["k"]]["n"]
            assert r["distinct"] == pytest.approx(whole[r["k"]]["distinct"], rel=0.02)  # merged is whole
    nothing = sketches.daily_sketches(rows.limit(3).withColumn("v", F.lit(None).cast("double")).withColumn("u", F.lit(None).cast("int")), "k", "day", "u", "v")
    assert all(r["q_0_5"] is None and r["distinct"] == 0 for r in sketches.estimates(nothing, ["k"]).collect())


def test_lots(spark):
    rng = random.Random(8)
    rows = [(a, i // 3, i, float(rng.choice([10, 5, 3, -4, -7, -20, 0])), float(rng.randint(1, 9))) for a in range(6) for i in range(60)] + [(1, 99, 99, None, 1.0), (1, 99, 100, -1.0, None)]
    df = spark.createDataFrame(rows, "asset long, at int, id long, quantity double, price double").repartition(4)
    want = []
    for a in range(6):
        held = []
        for _, _, i, q, p in sorted((r for r in rows if r[0] == a), key=lambda r: (r[1], r[2])):
            if q and p is not None and q > 0:
                held.append([i, q, p])
            while q and p is not None and q < 0 and held:
                take = min(-q, held[0][1])
                want.append((a, held[0][0], i, take, held[0][2], p))
                q += take
                held[0][1] -= take
                if not held[0][1]:
                    held.pop(0)
    got = lots.fifo_matches(df)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50
    pnl = {r["asset"]: r["pnl"] for r in lots.realized(got).collect()}
    assert pnl == {a: pytest.approx(sum((w[5] - w[4]) * w[3] for w in want if w[0] == a)) for a in range(6)}
    lots.register_lots(spark)
    df.createOrReplaceTempView("trades_of_lots")
    said = spark.sql("SELECT * FROM fifo_lots(TABLE(SELECT * FROM trades_of_lots) PARTITION BY asset ORDER BY (at, id))")
    assert sorted(map(tuple, said.collect())) == sorted(want)
    assert lots.fifo_matches(df.limit(0)).count() == 0


def test_lots_over_batches_of_any_size(spark):
    import pyarrow as pa

    rng = random.Random(3)
    rows = [(a, i, float(rng.choice([4, 1.5, -2, -3.25])), float(i)) for a in (None, 0, 1, 2**40) for i in range(50)]
    trades = pa.Table.from_pylist([dict(zip(("asset", "id", "quantity", "price"), r, strict=True)) for r in rows])
    got = [[r for b in lots.match_sorted(iter(trades.to_batches(n))) for r in map(tuple, zip(*b.to_pydict().values(), strict=True))] for n in (1, 7, 1000)]
    assert got[0] == got[1] == got[2] and {r[0] for r in got[0]} == {None, 0, 1, 2**40}
    assert all(r[1] < r[2] for r in got[0])
    df = spark.createDataFrame([(a, i, i, q, p) for a, i, q, p in rows], "asset long, at int, id long, quantity double, price double")
    assert sorted(map(tuple, lots.fifo_matches(df).collect()), key=str) == sorted(got[0], key=str)
    plan = lots.fifo_matches(df)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "UDTF" not in plan
