"""Portfolios, performance, ledgers, learning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.operators import gp, metrics, ml, replay
from factorloom.operators.calendar import densify, sessions
from factorloom.operators.portfolio import backtest, holdings, holdings_maps
from factorloom.plans.compiler import compile_factors
from factorloom.sources.bars import table

from .evaluation import COMPOSITE, composite, factor_returns
from .registry import SB, UB, dense_sql, query, rnd, sbars, ubars

_N, _EVERY = 10, 3


def _held(weight: str = "1.0::DOUBLE / count(*) OVER (PARTITION BY date)") -> str:
    return f"""{COMPOSITE}, {dense_sql('sb', True, 'pw')},
 k0 AS (SELECT c.ordinal, c.date, asset, score FROM sc JOIN p_cal c USING (date) WHERE c.ordinal % {_EVERY} = 0 QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, asset) <= {_N}),
 k AS (SELECT ordinal, asset, weight FROM (SELECT *, {weight} AS weight FROM k0) WHERE weight > 0),
 h AS (SELECT c.ordinal, c.date, asset, weight FROM p_cal c JOIN k ON k.ordinal = c.ordinal - c.ordinal % {_EVERY})"""


_SCORE = "CASE WHEN sum(greatest(score, 0)) OVER (PARTITION BY date) > 0 THEN greatest(score, 0) / sum(greatest(score, 0)) OVER (PARTITION BY date) ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY date) END"


def _bt(weight: str | None = None) -> str:
    return f"""{_held(weight) if weight else _held()}, s AS (SELECT c.ordinal, c.date, asset, weight FROM h JOIN p_cal c ON c.ordinal = h.ordinal + 1),
 rt AS (SELECT asset, date, close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY date), 0) - 1 AS ret FROM pw),
 gr AS (SELECT s.ordinal, sum(weight * coalesce(ret, 0)) AS gross FROM s LEFT JOIN rt USING (asset, date) GROUP BY 1),
 mv AS (SELECT ordinal, sum(abs(ch)) AS turnover, sum(greatest(-ch, 0)) AS sold FROM (SELECT ordinal, asset, sum(ch) AS ch FROM
  (SELECT ordinal, asset, weight AS ch FROM s UNION ALL SELECT ordinal + 1, asset, -weight FROM s WHERE ordinal < (SELECT max(ordinal) FROM p_cal)) GROUP BY 1, 2) GROUP BY 1),
 bt AS (SELECT c.ordinal, c.date, coalesce(gross, 0) AS gross, coalesce(turnover, 0) AS turnover, coalesce(sold, 0) AS sold,
  CASE WHEN c.ordinal = 0 THEN 0.0 ELSE coalesce(gross, 0) - coalesce(turnover, 0) * 0.0015 - coalesce(sold, 0) * 0.0005 END AS ret FROM p_cal c LEFT JOIN gr USING (ordinal) LEFT JOIN mv USING (ordinal))"""


BT = _bt()
EQ = f"{BT}, eq AS (SELECT date, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM bt), dd AS (SELECT *, max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak, equity / max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq)"


def _backtest(spark, d, weighting: str = "equal") -> DataFrame:
    return backtest(composite(spark, d), densify(sbars(spark, d), whole=True), _N, _EVERY, weighting)


def _bench(spark, d) -> DataFrame:
    """An equal-weighted market: (date, ret)."""
    rows = densify(sbars(spark, d), whole=True)
    from factorloom.operators.calendar import trailing_returns

    return trailing_returns(rows).groupBy("date").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("ret"))


BN = f"{BT}, bn AS (SELECT date, coalesce(avg(ret), 0) AS bench FROM rt GROUP BY 1), bb AS (SELECT date, bt.ret, bench FROM bt JOIN bn USING (date))"


@query(f"{_held()} SELECT date, asset, round(weight, 8) + 0.0 AS weight FROM h")
def holdings_topn(spark, d):
    cal = sessions(sbars(spark, d)).select("date")
    scores = cal.join(composite(spark, d), "date", "left")
    return holdings(scores, _N, _EVERY).select("date", "asset", rnd("weight", 8).alias("weight"))


@query(f"{_held(_SCORE)} SELECT date, count(*) AS n, round(sum(weight / t), 6) + 0.0 AS total, round(max(weight / t), 6) + 0.0 AS most FROM (SELECT *, sum(weight) OVER (PARTITION BY date) AS t FROM h WHERE weight > 0.05) GROUP BY 1")
def holdings_map(spark, d):
    """Holdings as a map per session, small weights dropped; summarised by size and largest weight."""
    cal = sessions(sbars(spark, d)).select("date")
    held = holdings(cal.join(composite(spark, d), "date", "left"), _N, _EVERY, "score")
    m = holdings_maps(held, 0.05)
    v = F.map_values("weights")
    return m.select("date", F.size("weights").cast("long").alias("n"), rnd(F.aggregate(v, F.lit(0.0), lambda a, x: a + x)).alias("total"), rnd(F.array_max(v)).alias("most"))


@query(f"{BT} SELECT date, round(turnover, 6) + 0.0 AS turnover, round(sold, 6) + 0.0 AS sold FROM bt")
def turnover_costs(spark, d):
    return _backtest(spark, d).select("date", rnd("turnover").alias("turnover"), rnd("sold").alias("sold"))


@query(f"{BT} SELECT ordinal, date, round(gross, 6) + 0.0 AS gross, round(ret, 6) + 0.0 AS ret FROM bt")
def vector_backtest_equal(spark, d):
    return _backtest(spark, d).select(F.col("ordinal").cast("long").alias("ordinal"), "date", rnd("gross").alias("gross"), rnd("ret").alias("ret"))


@query(f"{_bt(_SCORE)} SELECT date, round(gross, 6) + 0.0 AS gross, round(turnover, 6) + 0.0 AS turnover, round(ret, 6) + 0.0 AS ret FROM bt")
def vector_backtest_score(spark, d):
    return _backtest(spark, d, "score").select("date", rnd("gross").alias("gross"), rnd("turnover").alias("turnover"), rnd("ret").alias("ret"))


@query(f"{EQ} SELECT date, round(equity, 6) + 0.0 AS equity FROM eq")
def equity_curve(spark, d):
    return metrics.equity_curve(_backtest(spark, d)).select("date", rnd("equity").alias("equity"))


@query(f"{EQ} SELECT date, round(peak, 6) + 0.0 AS peak, round(drawdown, 6) + 0.0 AS drawdown FROM dd")
def drawdown(spark, d):
    return metrics.drawdown(metrics.equity_curve(_backtest(spark, d))).select("date", rnd("peak").alias("peak"), rnd("drawdown").alias("drawdown"))


@query(f"{EQ}, il AS (SELECT *, sum(CASE WHEN drawdown < -1e-12 THEN 0 ELSE 1 END) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS island FROM dd) SELECT coalesce(max(n), 0)::BIGINT AS days FROM (SELECT count(*) AS n FROM il WHERE drawdown < -1e-12 GROUP BY island)")
def drawdown_duration(spark, d):
    return metrics.drawdown_duration(metrics.equity_curve(_backtest(spark, d)))


@query(f"""{EQ}, pk AS (SELECT *, max(CASE WHEN equity = peak THEN date END) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak_date FROM dd)
 SELECT round(drawdown, 6) + 0.0 AS depth, date AS trough, peak_date FROM pk ORDER BY drawdown, date LIMIT 1""")
def drawdown_span(spark, d):
    return metrics.drawdown_span(metrics.equity_curve(_backtest(spark, d))).withColumn("depth", rnd("depth"))


@query(f"""{EQ}, a AS (SELECT count(ret) AS n, exp(sum(ln(1 + ret))) - 1 AS total, stddev_samp(ret) * sqrt(252) AS vol, min(drawdown) AS mdd, count(*) FILTER (ret > 0) / count(ret)::DOUBLE AS win FROM dd)
 SELECT n, round(total, 6) + 0.0 AS total, round(pow(1 + total, 252.0 / n) - 1, 4) + 0.0 AS annual, round(vol, 6) + 0.0 AS volatility, round((pow(1 + total, 252.0 / n) - 1) / nullif(vol, 0), 4) + 0.0 AS sharpe, round(mdd, 6) + 0.0 AS max_drawdown, round(win, 6) + 0.0 AS win_rate FROM a""")
def summary_252(spark, d):
    s = metrics.summary_252(_backtest(spark, d))
    return s.select("n", *[rnd(c, 4 if c in ("annual", "sharpe") else 6).alias(c) for c in s.columns if c != "n"])


@query(f"""{EQ}, a AS (SELECT exp(sum(ln(1 + ret))) AS e, stddev_samp(ret) * sqrt(250) AS vol, min(drawdown) AS mdd, count(*) FILTER (ret > 0) / greatest(count(*) FILTER (ret <> 0), 1)::DOUBLE AS win, (max(date) - min(date))::DOUBLE AS days FROM dd)
 SELECT round((e - 1) * 100, 4) + 0.0 AS total, round((pow(e, 365.0 / days) - 1) * 100, 4) + 0.0 AS annual, round(vol * 100, 4) + 0.0 AS volatility, round((pow(e, 365.0 / days) - 1 - 0.04) / nullif(vol, 0), 5) + 0.0 AS sharpe, round(mdd * 100, 4) + 0.0 AS max_drawdown, round(win * 100, 4) + 0.0 AS win_rate FROM a""")
def summary_365(spark, d):
    s = metrics.summary_365(_backtest(spark, d))
    return s.select(*[rnd(c, 5 if c == "sharpe" else 4).alias(c) for c in s.columns])


@query(f"""{EQ}, v AS (SELECT date, equity * 1000 AS value, equity / lag(equity) OVER (ORDER BY date) - 1 AS r, drawdown FROM dd), a AS (SELECT count(*) AS n, arg_max(value, date) AS e, (max(date) - min(date))::DOUBLE AS days, stddev_pop(r) * sqrt(250) AS vol, -min(drawdown) * 100 AS mdd FROM v)
 SELECT n, round((e / 1000 - 1) * 100, 4) + 0.0 AS total, round((pow(e / 1000, 365.0 / days) - 1) * 100, 4) + 0.0 AS annual, round(vol * 100, 4) + 0.0 AS volatility, round((pow(e / 1000, 365.0 / days) - 1 - 0.04) / vol, 5) + 0.0 AS sharpe, round(mdd, 4) + 0.0 AS max_drawdown, round((pow(e / 1000, 365.0 / days) - 1) * 100 / mdd, 5) + 0.0 AS calmar FROM a""")
def summary_engine(spark, d):
    curve = metrics.equity_curve(_backtest(spark, d)).select("date", (F.col("equity") * 1000).alias("value"))
    s = metrics.summary_engine(curve, 1000.0)
    return s.select("n", *[rnd(c, 5 if c in ("sharpe", "calmar") else 4).alias(c) for c in s.columns if c != "n"])


@query(f"""{BT} SELECT round((pow(exp(sum(ln(1 + ret))), 250.0 / count(ret)) - 1 - 0.04) / (sqrt(avg(pow(least(ret - 0.04 / 250, 0), 2))) * sqrt(250)), 4) + 0.0 AS sortino FROM bt""")
def sortino(spark, d):
    return metrics.sortino(_backtest(spark, d)).select(rnd("sortino", 4).alias("sortino"))


@query(f"""{BN}, a AS (SELECT covar_samp(ret, bench) / nullif(var_samp(bench), 0) AS beta, pow(exp(sum(ln(1 + ret))), 12.0 / count(*)) - 1 AS ya, pow(exp(sum(ln(1 + bench))), 12.0 / count(*)) - 1 AS yb, stddev_samp(ret - bench) * sqrt(12) AS act FROM bb)
 SELECT round(beta, 6) + 0.0 AS beta, round((ya - 0.04 - beta * (yb - 0.04)), 4) + 0.0 AS alpha, round((ya - yb) / act, 4) + 0.0 AS information_ratio FROM a""")
def alpha_beta(spark, d):
    """Of monthly returns, twelve a year."""
    s = metrics.alpha_beta(_backtest(spark, d), _bench(spark, d), sessions=12)
    return s.select(rnd("beta").alias("beta"), rnd("alpha", 4).alias("alpha"), rnd("information_ratio", 4).alias("information_ratio"))


@query(f"{BN} SELECT round(count(*) FILTER (ret > bench + 1e-12) / count(*)::DOUBLE, 6) + 0.0 AS win_rate FROM bb")
def win_rate(spark, d):
    """Ties count as not ahead: months in which the portfolio is the market."""
    return metrics.win_rate(_backtest(spark, d), _bench(spark, d)).select(rnd("win_rate").alias("win_rate"))


def _benchmark_all(bars: DataFrame) -> DataFrame:
    """The benchmark curve of asset 7 over all its bars; gaps are sessions without one."""
    from factorloom.sources.bars import load_benchmark

    days = sessions(bars).where("date >= '1996-01-01'")
    return metrics.benchmark_curve(days, load_benchmark(bars.withColumn("ts_code", F.col("asset").cast("string")), "7", "1996-01-01", "2100-01-01"))


@query("""WITH b AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / nullif(sum(l_quantity), 0) * (1 + avg(l_tax)) AS value FROM lineitem WHERE l_suppkey = 7 GROUP BY 1),
 ds AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1996-01-01'),
 bs AS (SELECT coalesce(arg_max(value, date) FILTER (date < DATE '1996-01-01'), arg_min(value, date) FILTER (date >= DATE '1996-01-01')) AS base FROM b),
 al AS (SELECT date, b.value FROM ds LEFT JOIN b USING (date))
 SELECT date, round(coalesce(last_value(value IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), base) / base - 1, 6) + 0.0 AS bench FROM al, bs""")
def benchmark_ffill_all(spark, d):
    """All days of one supplier's sales, carried over the days on which only others sold."""
    day = F.col("l_shipdate").cast("date").alias("date")
    bars = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("asset"), day).agg((F.sum("l_extendedprice") / F.nullif(F.sum("l_quantity"), F.lit(0.0))).alias("close"), (1 + F.avg("l_tax")).alias("adj_factor"))
    return _benchmark_all(bars).select("date", rnd("bench").alias("bench"))


@query(f"""{EQ}, b0 AS (SELECT date, close * adj_factor AS value FROM sb WHERE asset = 7), bs AS (SELECT coalesce(arg_max(value, date) FILTER (date < DATE '1996-01-01'), arg_min(value, date) FILTER (date >= DATE '1996-01-01')) AS base FROM b0),
 al AS (SELECT date, b0.value FROM (SELECT date FROM p_cal WHERE date >= DATE '1996-01-01') LEFT JOIN b0 USING (date)),
 bc AS (SELECT date, coalesce(last_value(value IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), base) / base - 1 AS bench FROM al, bs)
 SELECT date, round(equity, 6) + 0.0 AS equity, round(equity / (1 + bench), 6) + 0.0 AS excess FROM eq JOIN bc USING (date)""")
def excess_curve_all(spark, d):
    """Against all months of the benchmark."""
    out = metrics.excess_curve(metrics.equity_curve(_backtest(spark, d)), _benchmark_all(sbars(spark, d)))
    return out.select("date", rnd("equity").alias("equity"), rnd("excess").alias("excess"))


def _trades(spark, d) -> DataFrame:
    """Purchases are buys, sign-ups sales, at the event's value."""
    ev = table(spark, d, "events").where("event_type IN ('purchase', 'signup') AND value > 0")
    amount = F.when(F.col("event_type") == "purchase", 300).otherwise(-200)
    return ev.select(F.col("user_id").alias("asset"), F.col("ts").cast("date").alias("date"), F.col("event_id").alias("seq"), amount.alias("amount"), F.col("value").alias("price"))


_LEDGER_SQL = """WITH RECURSIVE t AS (SELECT user_id::VARCHAR AS asset, CAST(ts AS DATE) AS date, CASE WHEN event_type = 'purchase' THEN 300 ELSE -200 END AS q, value AS px,
 row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), event_id) AS k FROM events WHERE event_type IN ('purchase', 'signup') AND value > 0),
 r AS (SELECT asset, 0::BIGINT AS k, NULL::DATE AS date, 0::BIGINT AS amount, 0.0::DOUBLE AS paid, 0::BIGINT AS sold, 0.0::DOUBLE AS part, 0.0::DOUBLE AS px, 0::BIGINT AS held FROM (SELECT DISTINCT asset FROM t)
 UNION ALL SELECT t.asset, t.k, t.date, r.amount + CASE WHEN q > 0 THEN q ELSE -least(r.amount, -q) END,
  CASE WHEN q > 0 THEN r.paid + q * t.px WHEN r.amount = 0 THEN r.paid ELSE r.paid - r.paid * least(r.amount, -q) / r.amount END,
  CASE WHEN q < 0 THEN least(r.amount, -q) ELSE 0 END, CASE WHEN q < 0 AND r.amount > 0 THEN r.paid * least(r.amount, -q) / r.amount ELSE 0 END, t.px, r.amount
  FROM r JOIN t ON t.asset = r.asset AND t.k = r.k + 1),
 s AS (SELECT asset, date, sold, px, held, part, sold * px - part AS pnl FROM r WHERE sold > 0)"""


@query(f"{_LEDGER_SQL} SELECT asset, date, -sold AS amount, held AS held_before, round(part * 0.73105857863, 4) + 0.0 AS cost_out, round(pnl * 0.73105857863, 4) + 0.0 AS pnl FROM s")
def trade_ledger(spark, d):
    """Realised profit of each sale, by a stream of trades per asset."""
    out = replay.trade_ledger(_trades(spark, d)).where("amount < 0")
    return out.select("asset", "date", "amount", "held_before", rnd(F.col("cost_out") * 0.73105857863, 4).alias("cost_out"), rnd(F.col("pnl") * 0.73105857863, 4).alias("pnl"))


@query(f"""{_LEDGER_SQL} SELECT count(*) FILTER (pnl > 1e-6) AS profit_count, count(*) FILTER (pnl < -1e-6) AS loss_count, round(count(*) FILTER (pnl > 1e-6) / (count(*) FILTER (abs(pnl) > 1e-6))::DOUBLE, 6) + 0.0 AS win_rate,
 round(sum(pnl) FILTER (pnl > 1e-6) / abs(sum(pnl) FILTER (pnl < -1e-6)), 6) + 0.0 AS profit_loss_ratio, round(avg(pnl) FILTER (pnl > 1e-6), 3) + 0.0 AS avg_win FROM s""")
def trade_stats_roundtrip(spark, d):
    s = replay.trade_stats(replay.trade_ledger(_trades(spark, d)))
    return s.select("profit_count", "loss_count", rnd("win_rate").alias("win_rate"), rnd("profit_loss_ratio").alias("profit_loss_ratio"), rnd("avg_win", 3).alias("avg_win"))


@query(f"""WITH {UB}, l AS (SELECT asset, date, unnest([('close', close), ('amount', amount), ('volume', volume)]) AS x FROM ub)
 SELECT date, asset, max(CASE WHEN x[1] = 'close' THEN x[2] END) AS close, max(CASE WHEN x[1] = 'volume' THEN x[2] END) AS volume FROM l GROUP BY 1, 2""".replace("x[1]", "x.n").replace("x[2]", "x.v").replace("('close', close)", "{'n': 'close', 'v': close}").replace("('amount', amount)", "{'n': 'amount', 'v': amount}").replace("('volume', volume)", "{'n': 'volume', 'v': volume}"))
def feature_matrix(spark, d):
    long = ubars(spark, d).unpivot(["asset", "date"], ["close", "amount", "volume"], "name", "value")
    return ml.feature_matrix(long, ["close", "volume"])


@query(f"""WITH {UB}, s AS (SELECT asset, date, list([close, volume]) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l FROM ub)
 SELECT asset, date, round((CASE WHEN len(l) = 3 THEN l[1][1] + 2 * l[2][1] + 3 * l[3][1] + l[3][2] END) * 0.73105857863, 4) + 0.0 AS weighted FROM s""")
def sequence_tensor(spark, d):
    """Look-back tensors, reduced to a number that their order decides."""
    s = ml.sequences(ubars(spark, d), ["close", "volume"], 3)
    at = lambda i, j: F.get(F.get("sequence", F.lit(i)), F.lit(j))
    return s.select("asset", "date", rnd((at(0, 0) + 2 * at(1, 0) + 3 * at(2, 0) + at(2, 1)) * 0.73105857863, 4).alias("weighted"))


@query(f"""WITH {UB}, c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS o, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM ub))
 SELECT split, count(*) AS n, min(date) AS first, max(date) AS last FROM (SELECT ub.date, CASE WHEN o >= floor(n * 0.8) THEN 'test' WHEN o >= floor(n * 0.7) THEN 'valid' ELSE 'train' END AS split FROM ub JOIN c USING (date)) GROUP BY 1""")
def train_test_split(spark, d):
    out = ml.chronological_split(ubars(spark, d), valid=0.1, test=0.2)
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(f"""WITH {SB} SELECT asset, date, round(CASE WHEN count(turn) OVER w >= 12 THEN (turn - avg(turn) OVER w) / coalesce(nullif(stddev_samp(turn) OVER w, 0), 1) END, 5) + 0.0 AS turn FROM sb WINDOW w AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def expanding_zscore(spark, d):
    return ml.expanding_zscore(sbars(spark, d), ["turn"], 12).select("asset", "date", rnd("turn", 5).alias("turn"))


_ML = ["m", "v", "t"]


def _dataset(spark, d):
    bars = ml.made_once(sbars(spark, d))  # features and prices are both made of them
    f = compile_factors(densify(bars), {"m": "$close / Mean($close, 6) - 1", "v": "$volume / Mean($volume, 6) - 1", "t": "$turn - Mean($turn, 6)"}, keep=["asset", "date"])
    return ml.build_dataset(f, densify(bars, whole=True), _ML, horizon=1)


@query()
def ridge_scores(spark, d):
    data = _dataset(spark, d)
    return ml.predict(ml.train(data, _ML, "ridge"), data.where("split = 'test'")).select("date", "asset", "score")


@query()
def gbt_scores(spark, d):
    data = _dataset(spark, d)
    return ml.predict(ml.train(data, _ML, "gbdt"), data.where("split = 'test'")).select("date", "asset", "score")


@query()
def gp_fitness(spark, d):
    """Fitness of a generation of programs in one job."""
    programs = ["Sub($f, $turn)", "Mul($f, $f)", "Div($f, Add($turn, 0.01))", "Abs($turn)"]
    return gp.fitness(factor_returns(spark, d), programs, "ret").withColumn("fitness", rnd("fitness"))
