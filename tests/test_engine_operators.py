"""Operators on hand-made tables; sources, sinks, replay, learning, streams."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from factorloom.functions import scalars as S
from factorloom.operators import adjust, asof, calendar, compose, cross, evaluate, gp, library, metrics, ml, portfolio, replay
from factorloom.operators.fundamentals import get_fundamentals, query, valuation
from factorloom.sources import bars, http_api, upsert
from factorloom.streaming import bars as stream

D = dt.date


def day(i):
    return D(2024, 1, 1) + dt.timedelta(days=i)


@pytest.mark.parametrize(("code", "store"), [("600000.SH", "SH600000"), ("000001.SZ", "SZ000001"), ("830799.BJ", "BJ830799")])
def test_codes(spark, code, store):
    r = spark.createDataFrame([(code, store)], "a string, b string").select(S.to_store_code(F.col("a")), S.from_store_code(F.col("b"))).first()
    assert tuple(r) == (store, code)


def test_classes_and_lots(spark):
    codes = {"510300.XSHG": "etf", "000300.SH": "index", "600000.SH": "stock", "159915.SZ": "etf", "399001.XSHE": "index", "300750.SZ": "stock", "430047.BJ": "stock", "RB2405.SHF": "futures"}
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert {r[0]: r[1] for r in df.select("c", S.classify_asset(F.col("c"))).collect()} == codes
    got = spark.createDataFrame([(250.0,), (-250.0,), (99.0,)], "a double").select(S.round_lot(F.col("a"))).collect()
    assert [r[0] for r in got] == [200, -250, 0]
    assert spark.range(1).select(S.normalize_codes(F.array(F.lit(" 600000.xshg"), F.lit(""), F.lit("600000.SH")))).first()[0] == ["600000.SH"]
    assert spark.range(1).select(S.percent_text(F.lit(0.1234)), S.percent_text(F.lit(float("nan")))).first()[:] == ("12.34%", "--")


def test_finalize_bars(spark):
    raw = spark.createDataFrame([("a", day(0), "1.5", 10.0, 100.0), ("a", day(1), "bad", 0.0, 5.0), (None, day(1), "1", 1.0, 1.0)], "ts_code string, date date, close string, volume double, amount double")
    rows = bars.finalize_bars(raw).orderBy("date").collect()
    assert [r["vwap"] for r in rows] == [100.0, 0.0] and rows[1]["close"] is None and rows[0]["adj_factor"] == 1.0
    assert bars.finalize_bars(raw).columns == bars.BARS.fieldNames()


def test_densify_keeps_own_range(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(3), 2.0), ("b", day(1), 3.0)], "asset string, date date, close double")
    assert calendar.densify(df).count() == 4 and calendar.densify(df, whole=True).count() == 6


def test_asof_and_intervals(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20.0), ("a", 5, 50.0), ("b", 10, 1.0)], "k string, t int, v double")
    assert {(r.k, r.t, r.v) for r in asof.asof_join(left, right, ["k"], "t", ["v"]).collect()} == {("a", 5, 50.0), ("a", 1, None), ("b", 9, None)}
    spans = spark.createDataFrame([("a", day(0), day(200), 1), ("a", day(100), None, 2), ("b", day(0), day(1), 3)], "k string, s date, e date, n int")
    points = spark.createDataFrame([("a", day(150)), ("a", day(200)), ("b", day(1)), ("b", day(0))], "k string, d date")
    got = {(r.k, r.d, r.n) for r in asof.interval_join(points, spans, ["k"], "d", "s", "e").collect()}
    assert got == {("a", day(150), 1), ("a", day(150), 2), ("a", day(200), 2), ("b", day(0), 3)}
    listed = spark.createDataFrame([("x", day(0), None, "etf"), ("y", day(9), None, "etf"), ("z", day(0), day(3), "stock")], "c string, list_date date, delist_date date, kind string")
    assert [r.c for r in asof.listed_at(listed, str(day(3))).collect()] == ["x"]
    members = spark.createDataFrame([(1, "a", "X", day(0), "Y"), (2, "a", "Y", day(5), "Y"), (3, "a", "Z", day(9), "N")], "id long, ts_code string, l1_name string, in_date date, is_new string")
    assert [r.industry for r in asof.latest_industry(members).collect()] == ["Y"]


def test_adjustment(spark):
    df = spark.createDataFrame([("a", day(0), 10.0, None), ("a", day(1), 10.0, 1.0), ("a", day(2), 5.0, 2.0)], "asset string, date date, close double, adj_factor double")
    assert [r.close for r in adjust.forward_adjust(df).orderBy("date").collect()] == [5.0, 5.0, 5.0]
    split = adjust.split_ratios(df.where("adj_factor is not null")).orderBy("date").collect()
    assert [r.split_ratio for r in split] == [1.0, 2.0]
    plans = spark.createDataFrame([("a", day(1), "实施", 0.5), ("a", day(1), "预案", 9.0)], "ts_code string, ex_date date, div_proc string, stk_div double")
    out = adjust.stock_splits(df.withColumnRenamed("asset", "ts_code"), plans).orderBy("date").collect()
    assert [r.split_ratio for r in out] == [1.0, 1.5, 1.0]
    assert [r.history for r in adjust.history(df.where("adj_factor is not null"), "close", 2).orderBy("date").collect()] == [[], [5.0]]


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    new = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, part int")
    for _ in range(2):
        upsert.upsert(spark, path, new, ["k"])
    upsert.upsert(spark, path, spark.createDataFrame([(2, "c", 1), (3, "d", 1)], new.schema), ["k"])
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    clean = upsert.clean_rows(spark.createDataFrame([(1, float("nan"), "x"), (None, 1.0, "y")], "k int, v double, z string"), bars.T.StructType.fromDDL("k int, v double, w string"), ["k"])
    assert [tuple(r) for r in clean.collect()] == [(1, None)]


def test_rate_limiter_and_fetch():
    now = [0.0]
    limiter = http_api.RateLimiter(2, 60.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(5):
        limiter.acquire()
    assert now[0] == 120.0
    calls = []

    def call(a, b):
        calls.append((a, b))
        n = (b - a).days + 1
        return [(a + dt.timedelta(days=i),) for i in range(min(n, 4))]

    assert len(list(http_api.fetch(call, day(0), day(9), cap=4))) == 10
    assert [(s.start, s.end) for s in http_api.spans(day(0), day(6), 3)] == [(day(0), day(2)), (day(3), day(5)), (day(6), day(6))]
    tries = []

    def send(url, data):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return '{"data": {"fields": ["a"], "items": [[NaN]]}}'

    assert http_api.post("u", {}, wait=0.0, send=send)["data"]["items"] == [[None]]


def test_cross_section(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (0, "b", 1.0), (0, "c", 3.0), (0, "d", None), (1, "a", 5.0), (1, "b", 5.0)], "date int, asset string, x double")
    got = {(r.date, r.asset): r.r for r in df.select("date", "asset", cross.cs_rank(F.col("x")).alias("r")).collect()}
    assert got[0, "a"] == 0.5 and got[0, "c"] == 1.0 and got[0, "d"] is None
    flat = {r.asset: (r.z, r.o) for r in df.where("date = 1").select("asset", cross.cs_zscore(F.col("x")).alias("z"), cross.cs_zscore(F.col("x"), flat_as_one=True).alias("o")).collect()}
    assert flat["a"] == (None, 0.0)
    assert {r.asset: r.x for r in cross.median_impute(df, ["x"]).where("date = 0").collect()}["d"] == 1.0
    assert [r.asset for r in cross.top_n(df, "x", 2).where("date = 0").orderBy("place").collect()] == ["c", "a"]
    bins = cross.quantile_bins(spark.createDataFrame([(0, i, float(i)) for i in range(10)] + [(1, 0, 1.0), (1, 1, 1.0)], "date int, asset int, x double"), "x")
    assert [r.factor_quantile for r in bins.where("date = 0").orderBy("asset").collect()] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert bins.where("date = 1 and factor_quantile is not null").count() == 0


def test_ic_needs_names_and_variance(spark):
    rows = [(0, i, float(i), float(i * i)) for i in range(5)] + [(1, 0, 1.0, 1.0), (1, 1, 2.0, 2.0)] + [(2, i, 1.0, float(i)) for i in range(5)]
    ic = {r.date: r for r in evaluate.daily_ic(spark.createDataFrame(rows, "date int, asset int, f double, r double"), "f", "r").collect()}
    assert ic[0].rank_ic == pytest.approx(1.0) and ic[1].ic is None and ic[2].ic is None
    assert compose.decorrelate(["a", "b", "c"], {("a", "b"): 0.9, ("a", "c"): -0.2, ("b", "c"): 0.1}) == ["a", "c"]


def test_backtest_by_hand(spark):
    price = {"a": [10, 11, 11, 12], "b": [10, 10, 12, 12]}
    prices = spark.createDataFrame([(s, day(i), float(p)) for s, ps in price.items() for i, p in enumerate(ps)], "asset string, date date, close double")
    scores = spark.createDataFrame([(day(0), "a", 2.0), (day(0), "b", 1.0), (day(1), "a", 1.0), (day(1), "b", 2.0), (day(2), "a", 1.0), (day(2), "b", 2.0)], "date date, asset string, score double")
    out = portfolio.backtest(scores, prices, 1, costs=portfolio.Costs(0.0, 0.0, 0.0)).orderBy("date").collect()
    assert [r.ret for r in out] == pytest.approx([0.0, 0.1, 0.2, 0.0])
    assert [r.turnover for r in out] == [0.0, 1.0, 2.0, 0.0]
    held = portfolio.holdings(scores, 1, every=2).orderBy("date").collect()
    assert [(r.date, r.asset) for r in held] == [(day(0), "a"), (day(1), "a"), (day(2), "b")]


def test_metrics_by_hand(spark):
    r = spark.createDataFrame([(day(i), x) for i, x in enumerate([0.1, -0.5, 0.2, 1.0, 0.0])], "date date, ret double")
    curve = metrics.drawdown(metrics.equity_curve(r)).orderBy("date").collect()
    assert [c.drawdown for c in curve] == pytest.approx([0.0, -0.5, -0.4, 0.0, 0.0])
    assert metrics.drawdown_duration(metrics.equity_curve(r)).first()[0] == 2
    span = metrics.drawdown_span(metrics.equity_curve(r)).first()
    assert (span.trough, span.peak_date) == (day(1), day(0))
    assert metrics.summary_engine(spark.createDataFrame([(day(0), 5.0)], "date date, value double"), 5.0).first().total == 0.0


def account(cash=10_000.0, **rules):
    return replay.Account(replay.Rules(cash=cash, **rules), cash)


def bar(open_, close=None, pre=None, ratio=1.0, kind="stock", dividends=()):
    return {"open": open_, "close": close or open_, "pre_close": pre, "split_ratio": ratio, "kind": kind, "dividends": list(dividends)}


def test_session_rules():
    a = account(slippage=0.0, commission=0.0, least_commission=0.0)
    due = {}
    a.day = day(0)
    rows = replay.session(a, {"x": bar(10.0)}, {"x": 0.55}, due, replay.follow_targets)
    assert a.positions["x"].amount == 500 and a.cash == 5000 and rows[-1]["value"] == 10_000
    sell = lambda acc, _: acc.order("x", -500)
    a.day = day(1)
    rows = replay.session(a, {"x": bar(20.0, 22.0, ratio=2.0, dividends=[(day(2), 0.1)])}, {}, due, lambda acc, _: None)
    assert a.positions["x"].amount == 1000 and a.positions["x"].cost == 5.0 and due == {("x", day(2)): 100.0}
    a.day = day(2)
    rows = replay.session(a, {"x": bar(22.0, pre=22.0)}, {}, due, sell)
    assert rows[0]["event"] == "dividend" and a.positions["x"].amount == 500
    assert a.cash == pytest.approx(5000 + 100 + 500 * 22 * (1 - 0.0005))


def test_limits_locks_and_cash():
    a = account()
    a.day = day(0)
    up = replay.session(a, {"x": bar(11.0, pre=10.0)}, {"x": 1.0}, {}, replay.follow_targets)
    assert up[0]["event"] == "rejected"
    buy_and_sell = lambda acc, _: (acc.order("x", 100), acc.order("x", -100))
    rows = replay.session(a, {"x": bar(10.0)}, {}, {}, buy_and_sell)
    assert [r["event"] for r in rows] == ["trade", "rejected", "equity"]
    fund = account()
    rows = replay.session(fund, {"x": bar(10.0, kind="etf")}, {}, {}, buy_and_sell)
    assert [r["event"] for r in rows] == ["trade", "trade", "equity"] and rows[1]["tax"] == 0.0
    poor = account(cash=1500.0)
    rows = replay.session(poor, {"x": bar(10.0)}, {}, {}, lambda acc, _: acc.order("x", 1000))
    assert rows[0]["amount"] == 100 and poor.cash >= 0
    assert replay.execution_price(10.0, 1, replay.Rules()) == 10.01


def test_replay_runs_are_apart(spark):
    b = spark.createDataFrame([(day(i), s, 10.0 + i, 10.5 + i, "etf") for i in range(4) for s in "xy"], "date date, asset string, open double, close double, kind string")
    t = spark.createDataFrame([("one", day(0), "x", 0.5), ("two", day(1), "y", 0.9)], "run_id string, date date, asset string, weight double")
    out = replay.replay(b, t, rules=replay.Rules(slippage=0.0, commission=0.0, least_commission=0.0))
    trades = {(r.run_id, r.date, r.asset, r.amount) for r in out.where("event = 'trade'").collect()}
    assert trades == {("one", day(0), "x", 50_000), ("two", day(1), "y", 81_800)}
    last = {r.run_id: r.value for r in out.where(F.col("date") == day(3)).where("event = 'equity'").collect()}
    assert last["one"] == pytest.approx(500_000 + 50_000 * 13.5)


def test_trade_ledger_with_events(spark):
    t = spark.createDataFrame([("x", day(0), 100, 10.0, 1), ("x", day(3), -300, 8.0, 2)], "asset string, date date, amount int, price double, seq int")
    s = spark.createDataFrame([("x", day(1), 2.0)], "asset string, date date, ratio double")
    d = spark.createDataFrame([("x", day(2), 0.5)], "asset string, date date, div_cash double")
    r = replay.trade_ledger(t, d, s).where("amount < 0").first()
    assert (r.amount, r.held_before, r.cost_out, r.pnl) == (-200, 200, 900.0, 700.0)
    stats = replay.trade_stats(replay.trade_ledger(t, d, s)).first()
    assert (stats.profit_count, stats.loss_count, stats.win_rate, stats.profit_loss_ratio) == (1, 0, 1.0, None)


def test_fundamentals(spark):
    df = spark.createDataFrame([("000001.SZ", day(0), 5.0, 20_000.0), ("000001.SZ", day(1), 6.0, 30_000.0), ("600000.SH", day(1), 7.0, None), ("600001.SH", day(1), 4.0, 10_000.0)], "ts_code string, trade_date date, pe double, total_mv double")
    rows = get_fundamentals(df, query(valuation.code, valuation.market_cap).filter(valuation.pe_ratio > 3).order_by(valuation.market_cap.desc()), str(day(5))).collect()
    assert [(r.code, r.market_cap) for r in rows] == [("000001.XSHE", 3.0), ("600001.XSHG", 1.0), ("600000.XSHG", None)]
    assert get_fundamentals(df, query(valuation.code).filter(valuation.code.in_(["600000.XSHG"])), str(day(1))).collect()[0].code == "600000.XSHG"
    assert get_fundamentals(df, query(valuation).limit(1), str(day(0))).columns == ["code", "day", "pe_ratio", "market_cap"]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ('{"factors": [{"name": "m", "expression": "$close"}]}', ["m"]),
        ('```json\n{"factors": [{"expression": "$close"}]}\n```', ["factor"]),
        ('[{"name": "x", "expression": "$close"}, {"name": "y"}]', ["x"]),
        ('{"data": {"factors": [{"name": "x", "expression": "$close"}]}}', ["x"]),
        ('{"results": [{"name": "x", "expression": "$volume"}]}', ["x"]),
        ('Here: {"items": [{"name": "x", "expression": "$volume"}]} done', ["x"]),
        ('{"factors": []}', []),
        ("not json", []),
        ("", []),
    ],
)
def test_candidates(text, names):
    assert [c.name for c in library.parse_candidates(text)] == names


def test_library(spark, tmp_path):
    lib = library.Library(spark, str(tmp_path / "lib"), "name string, expression string, icir double, strategy string, updated long")
    make = lambda *rows: spark.createDataFrame(rows, lib.schema)
    lib.save(make(("a", "$close", 0.2, None, 1), ("b", "$open", -0.5, None, 1)))
    lib.save(make(("a", "$close + 1", 0.9, None, 2)))
    assert [r.name for r in lib.ranked().collect()] == ["a", "b"]
    lib.link(["b"], "s1")
    assert lib.find("b").first().strategy == "s1" and lib.all().count() == 2
    found = spark.createDataFrame([("n", "$close+1"), ("m", "$high")], "name string, expression string")
    assert [r.name for r in library.new_candidates(found, lib.all()).collect()] == ["m"]
    assert len(library.valid_candidates([library.Candidate("a", "$close"), library.Candidate("b", " $close"), library.Candidate("c", "Bad($close)")])) == 1


def test_models(spark, tmp_path):
    rows = [(day(d), a, float(a), float((a * 7 + d) % 5), 0.1 * a) for d in range(20) for a in range(8)]
    df = spark.createDataFrame(rows, "date date, asset int, f double, g double, label double")
    data = ml.chronological_split(df)
    for kind in ("ridge", "gbdt"):
        model = ml.train(data, ["f", "g"], kind)
        imp = ml.importances(model, ["f", "g"])
        assert imp["f"] > imp["g"]
    out = ml.predict(model, data.where("split = 'test'"))
    assert abs(out.groupBy("date").agg(F.avg("score").alias("m")).agg(F.max(F.abs("m"))).first()[0]) < 1e-9
    ml.save_model(model, str(tmp_path / "m"), {"columns": ["f", "g"]})
    again, meta = ml.load_model(str(tmp_path / "m"))
    assert meta == {"columns": ["f", "g"]} and ml.predict(again, data).count() == 160


def test_search_finds_the_signal(spark):
    rows = [(d, a, float((a * 3 + d) % 11), float((a * 5) % 7), float((a * 3 + d) % 11) * 2) for d in range(4) for a in range(12)]
    df = spark.createDataFrame(rows, "date int, asset int, u double, v double, ret double")
    best = gp.search(df, ["u", "v"], "ret", generations=1, population=12, keep=3, min_names=10)
    assert abs(best[0][1]) > 0.9 and best == gp.search(df, ["u", "v"], "ret", generations=1, population=12, keep=3, min_names=10)
    assert gp.expand("Add($u, $v)", {"u": "$close", "v": "Mean($u, 2)"}) == "Add($close, Mean($u, 2))"


def test_streams(spark, sf, tmp_path):
    source = str(tmp_path / "ticks")
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(source)
    bars_ = stream.windowed_bars(stream.read_ticks(spark, source), "1 day", late="400 days")
    q = bars_.writeStream.format("memory").queryName("bars_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = stream.windowed_bars(spark.read.parquet(source), "1 day")
    assert spark.table("bars_out").count() == batch.count() and math.isclose(spark.table("bars_out").agg(F.sum("amount")).first()[0], batch.agg(F.sum("amount")).first()[0])
    path, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):
        stream.upsert_stream(stream.read_ticks(spark, source), path, ["user_id"], "ts", check).awaitTermination(60)
    assert spark.read.parquet(path).count() == spark.read.parquet(source).select("user_id").distinct().count()
    ema = stream.running_ema(stream.read_ticks(spark, source), 5).writeStream.format("memory").queryName("ema_out").outputMode("update").trigger(availableNow=True).start()
    ema.awaitTermination(60)
    assert spark.table("ema_out").agg(F.max("n")).first()[0] >= 1
