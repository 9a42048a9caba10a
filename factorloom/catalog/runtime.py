"""Scores of single sessions, universes as spans, frames by time, sketches, lots: queries with SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.operators import frames, lots, market_data, runtime, sketches, universe
from factorloom.operators.calendar import instruments, sessions
from factorloom.plans.compiler import Frame
from factorloom.sources.bars import table
from factorloom.sources.report_sink import metrics_json
from factorloom.sources.upsert import keep_last
from factorloom.streaming import stateful

from .registry import SB, SD, dense_sql, query, rnd, sbars

MODEL = runtime.LinearModel({"m": "$close / Mean($close, 6) - 1", "v": "$volume / Mean($volume, 4) - 1", "r": "Mean(CSRank($close), 3)"}, {"m": 0.6, "v": -0.15, "r": 0.3}, 0.01)
_MEAN = "(CASE WHEN count(*) OVER {w} = {n} THEN sum(coalesce({x}, 0)) OVER {w} / {n} END)"


@query(f"""{SD}, k AS (SELECT asset, date, (rank() OVER (PARTITION BY date ORDER BY close) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date) AS k FROM p WHERE close IS NOT NULL),
 f AS (SELECT p.asset, p.date, close, close / nullif({_MEAN.format(w='w6', n=6, x='close')}, 0) - 1 AS m, volume / nullif({_MEAN.format(w='w4', n=4, x='volume')}, 0) - 1 AS v, {_MEAN.format(w='w3', n=3, x='k')} AS r
 FROM p LEFT JOIN k USING (asset, date) WINDOW w6 AS (PARTITION BY p.asset ORDER BY p.date ROWS 5 PRECEDING), w4 AS (PARTITION BY p.asset ORDER BY p.date ROWS 3 PRECEDING), w3 AS (PARTITION BY p.asset ORDER BY p.date ROWS 2 PRECEDING)),
 days AS (SELECT date FROM p_cal WHERE ordinal IN ((SELECT max(ordinal) FROM p_cal) - 1, (SELECT max(ordinal) FROM p_cal) // 2)),
 y AS (SELECT asset, date, 0.01::DOUBLE + coalesce(m, 0) * 0.6::DOUBLE + coalesce(v, 0) * -0.15::DOUBLE + coalesce(r, 0) * 0.3::DOUBLE AS prediction FROM f JOIN days USING (date) WHERE close IS NOT NULL)
 SELECT asset, date, round(prediction, 6) + 0.0 AS prediction, round(coalesce((prediction - avg(prediction) OVER d) / coalesce(nullif(stddev_pop(prediction) OVER d, 0), 1), 0), 6) + 0.0 AS score FROM y WINDOW d AS (PARTITION BY date)""")
def runtime_scores(spark, d):
    """Two sessions scored from the sessions that their expressions look back on; the SQL runs over all history."""
    bars = sbars(spark, d)
    days = [r["date"] for r in sessions(bars).orderBy("ordinal").collect()]  # one row per session
    chosen = [days[max(0, len(days) - 2)], days[(len(days) - 1) // 2]] if days else []
    got = runtime.RuntimeScorer.of(MODEL, Frame(strict=True)).scores(bars, instruments(bars), days, chosen)
    return got.select("asset", "date", rnd("prediction").alias("prediction"), rnd("score").alias("score"))


@query(f"WITH {SB} SELECT asset, min(date) AS first, max(date) AS last FROM sb GROUP BY 1")
def instrument_ranges(spark, d):
    return instruments(sbars(spark, d))


@query("""WITH b AS (SELECT user_id AS asset, CAST(ts AS DATE) AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(value) AS volume, sum(value) AS amount FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2)
 SELECT asset, date, open, high, low, close, volume, round(amount, 4) + 0.0 AS amount FROM b""")
def stateful_bars(spark, d):
    """The processor that corrects bars of streams, over a whole table: each bar's last revision."""
    ticks = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = keep_last(stateful.corrected_bars(ticks), ["asset", "date"], ["revision"])
    return last.select("asset", "date", "open", "high", "low", "close", "volume", rnd("amount", 4).alias("amount"))


_SPANS = """s AS (SELECT DISTINCT l_returnflag AS index_code, l_suppkey AS con_code, CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date FROM lineitem WHERE l_returnflag IS NOT NULL AND l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL),
 dd AS (SELECT index_code, trade_date, row_number() OVER (PARTITION BY index_code ORDER BY trade_date) AS n, lead(trade_date) OVER (PARTITION BY index_code ORDER BY trade_date) AS nx FROM (SELECT DISTINCT index_code, trade_date FROM s)),
 i AS (SELECT s.*, n, nx, n - row_number() OVER (PARTITION BY index_code, con_code ORDER BY n) AS island FROM s JOIN dd USING (index_code, trade_date)),
 sp AS (SELECT index_code, con_code, min(trade_date) AS in_date, arg_max(nx, n) FILTER (nx IS NOT NULL) AS mx, bool_or(nx IS NULL) AS still FROM i GROUP BY index_code, con_code, island),
 spans AS (SELECT index_code, con_code, in_date, CASE WHEN still THEN NULL ELSE mx END AS out_date FROM sp)"""


def _membership(spark, d):
    line = table(spark, d, "lineitem")
    return universe.membership_spans(line.select(F.col("l_returnflag").alias("index_code"), F.col("l_suppkey").alias("con_code"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("trade_date")))


@query(f"WITH {_SPANS} SELECT index_code, con_code, in_date, out_date FROM spans")
def universe_spans(spark, d):
    """Suppliers that had lines of a flag in consecutive months, with the months in which they left and came back."""
    return _membership(spark, d)


@query(f"""WITH {_SPANS}, p AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) + 40 AS seen, l_linestatus FROM lineitem)
 SELECT extract(year FROM seen)::INTEGER AS year, l_linestatus AS status, count(*) AS n FROM p
 WHERE EXISTS (SELECT 1 FROM spans WHERE con_code = code AND index_code IN ('A', 'R') AND in_date <= seen AND (out_date IS NULL OR seen < out_date)) GROUP BY 1, 2""")
def universe_filter(spark, d):
    """Lines whose supplier was in one of two indices forty days on."""
    points = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("code"), F.date_add(F.col("l_shipdate").cast("date"), 40).alias("at"), F.col("l_linestatus").alias("status"))
    inside = universe.in_universe(points, _membership(spark, d), ["A", "R"], "at", "code")
    return inside.groupBy(F.year("at").alias("year"), "status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT o_custkey AS asset, CAST(o_orderdate AS DATE) AS date, o_totalprice AS v, o_orderkey AS k FROM orders)
 SELECT k, count(*) OVER w AS n_90, max(v) OVER w AS max_90, min(v) OVER w AS min_90, round(avg(v) OVER w * 0.73105857863, 4) + 0.0 AS avg_90 FROM o
 WINDOW w AS (PARTITION BY asset ORDER BY date RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW)""")
def frames_by_time(spark, d):
    """Each order against its customer's orders of the last 90 days."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("asset"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("k"))
    got = frames.rolling_days(o, 90, {"n_90": F.count(F.lit(1)), "max_90": F.max("v"), "min_90": F.min("v"), "avg_90": F.avg("v")})
    return got.select("k", "n_90", "max_90", "min_90", rnd(F.col("avg_90") * 0.73105857863, 4).alias("avg_90"))


@query("""SELECT user_id, event_id, nth_value(value, 2) OVER w AS second, nth_value(value, 3) OVER w AS third FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def frames_nth_value(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, d, "events").select("user_id", "event_id", frames.nth_of_frame("value", 2, w).alias("second"), frames.nth_of_frame("value", 3, w).alias("third"))


@query("""WITH r AS (SELECT l_quantity, l_orderkey * 8 + l_linenumber AS id FROM lineitem), n AS (SELECT *, ntile(7) OVER (ORDER BY l_quantity NULLS FIRST, id NULLS FIRST) AS t FROM r)
 SELECT t::INTEGER AS ntile, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, sum(id)::BIGINT AS ids FROM n GROUP BY 1""")
def ntile_global(spark, d):
    """Sevenths of all lines by quantity, which has few values, ties by line: no task ranks the table."""
    rows = table(spark, d, "lineitem").select("l_quantity", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("id"))
    got = frames.global_ntile(rows, 7, "l_quantity", "id")
    return got.groupBy("ntile").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.sum("id").alias("ids"))


@query("""WITH e AS (SELECT event_type, extract(quarter FROM ts)::INTEGER AS quarter, user_id, value FROM events)
 SELECT event_type, quarter, count(*) AS n, count(DISTINCT user_id) AS users, true AS distinct_near, true AS median_near FROM e GROUP BY 1, 2""")
def sketch_ranges(spark, d):
    """Sketches of each type and day merged to quarters, against exact counts: estimates lie within four standard errors."""
    events = table(spark, d, "events").select("event_type", F.col("ts").cast("date").alias("date"), F.quarter("ts").alias("quarter"), "user_id", "value")
    kept = sketches.daily_sketches(events, "event_type", "date", "user_id", "value").withColumn("quarter", F.quarter("date"))
    got = sketches.estimates(kept, ["event_type", "quarter"])
    exact = events.groupBy("event_type", "quarter").agg(F.count_distinct("user_id").alias("users"), F.percentile("value", F.array(F.lit(max(0.0, 0.5 - 4 * sketches.RANK_ERROR)), F.lit(0.5 + 4 * sketches.RANK_ERROR))).alias("about"))
    near = F.abs(F.col("distinct") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * 4 * sketches.DISTINCT_ERROR)
    return got.join(exact, ["event_type", "quarter"]).select("event_type", "quarter", "n", "users", near.alias("distinct_near"), F.col("q_0_5").between(F.col("about")[0], F.col("about")[1]).alias("median_near"))


@query("""WITH t AS (SELECT l_suppkey AS asset, l_shipdate AS seen, l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE -l_quantity END AS q, l_extendedprice / nullif(l_quantity, 0) AS price FROM lineitem WHERE l_quantity > 0),
 w AS (SELECT *, sum(q) OVER o AS s, row_number() OVER o AS n FROM t WINDOW o AS (PARTITION BY asset ORDER BY seen, id ROWS UNBOUNDED PRECEDING)),
 p AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY asset ORDER BY n ROWS UNBOUNDED PRECEDING)) AS held FROM w),
 f AS (SELECT *, CASE WHEN q > 0 THEN q ELSE coalesce(lag(held) OVER (PARTITION BY asset ORDER BY n), 0) - held END AS used FROM p),
 c AS (SELECT *, sum(used) OVER (PARTITION BY asset, q > 0 ORDER BY n ROWS UNBOUNDED PRECEDING) AS hi FROM f),
 m AS (SELECT b.asset, b.id AS buy_id, s.id AS sell_id, least(b.hi, s.hi) - greatest(b.hi - b.used, s.hi - s.used) AS quantity, b.price AS buy_price, s.price AS sell_price
 FROM c b JOIN c s ON b.asset = s.asset AND b.q > 0 AND s.q < 0 AND s.used > 0 AND b.hi > s.hi - s.used AND s.hi > b.hi - b.used)
 SELECT asset, buy_id, sell_id, quantity, round((sell_price - buy_price) * quantity * 0.73105857863, 4) + 0.0 AS pnl FROM m""")
def fifo_lots(spark, d):
    """Suppliers' lines as trades, flags other than N as sales: which lot each sold piece came from. In SQL, what is held is the
    running sum less its lowest point, and lots meet sales where their running quantities overlap."""
    line = table(spark, d, "lineitem").where("l_quantity > 0")
    signed = F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    trades = line.select(F.col("l_suppkey").alias("asset"), F.col("l_shipdate").alias("at"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), signed.alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    got = lots.fifo_matches(trades)
    return got.select("asset", "buy_id", "sell_id", "quantity", rnd((F.col("sell_price") - F.col("buy_price")) * F.col("quantity") * 0.73105857863, 4).alias("pnl"))


@query(f"""WITH {SB}, b AS (SELECT *, coalesce(adj_factor, 1) AS a FROM sb WHERE date <= DATE '1997-06-01'), n AS (SELECT asset, arg_max(a, date) AS now FROM b GROUP BY 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS nth FROM b WHERE date < DATE '1997-06-01')
 SELECT lpad(asset::VARCHAR, 6, '0') || '.XSHG' AS code, date, round(close * a / now * 0.73105857863, 5) + 0.0 AS close, volume FROM r JOIN n USING (asset) WHERE nth <= 6""")
def strategy_history(spark, d):
    """The last six bars of every supplier before a day, as a strategy gets them."""
    bars = sbars(spark, d).withColumn("ts_code", F.concat(F.lpad(F.col("asset").cast("string"), 6, "0"), F.lit(".SH"))).drop("asset")
    got = market_data.MarketData(bars=bars).attribute_history(None, 6, "1997-06-01", ("close", "volume"))
    return got.select("code", "date", rnd(F.col("close") * 0.73105857863, 5).alias("close"), "volume")


@query("""WITH m AS (SELECT l_suppkey, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most, CASE WHEN min(l_discount) > 0 THEN 'always' END AS discount FROM lineitem GROUP BY 1)
 SELECT l_suppkey, to_json({'n': n, 'least': least, 'most': most, 'discount': discount})::VARCHAR AS metrics FROM m""")
def metrics_report(spark, d):
    """Each supplier's figures as one JSON object, as reports hold them."""
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.when(F.min("l_discount") > 0, F.lit("always")).alias("discount"))
    return metrics_json(m, "l_suppkey")
