"""Sources, filters, scalars, joins, calendars, windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom.functions import scalars as S
from factorloom.operators import adjust, asof, calendar
from factorloom.operators.fundamentals import get_fundamentals, query as fundamentals, valuation
from factorloom.sources import upsert
from factorloom.sources.bars import parse_date, routed_union, table
from factorloom.streaming.bars import sessions_of, windowed_bars

from .registry import SB, SD, UB, UD, query, rnd, sbars, sd, ubars, ud


@query(f"WITH {UB} SELECT asset, date, open, high, low, close, volume, round(amount, 4) + 0.0 AS amount, round(vwap, 5) + 0.0 AS vwap FROM ub")
def bars_daily(spark, d):
    return ubars(spark, d).select("asset", "date", "open", "high", "low", "close", "volume", rnd("amount", 4).alias("amount"), rnd("vwap", 5).alias("vwap"))


@query(f"WITH {SB} SELECT asset, date, round(close * 0.73105857863, 5) + 0.0 AS close, volume, round(amount, 2) + 0.0 AS amount, round(turn * 0.73105857863, 8) + 0.0 AS turn FROM sb")
def bars_monthly(spark, d):
    return sbars(spark, d).select("asset", "date", rnd(F.col("close") * 0.73105857863, 5).alias("close"), "volume", rnd("amount", 2).alias("amount"), rnd(F.col("turn") * 0.73105857863, 8).alias("turn"))


@query(f"""WITH {UB}, {SB}, a AS (SELECT 'user' AS kind, asset, date, close, volume, NULL::DOUBLE AS turn FROM ub UNION ALL SELECT 'supplier', asset, date, close, volume, turn FROM sb)
 SELECT kind, extract(year FROM date)::INTEGER AS year, count(*) AS n, count(turn) AS n_turn, round(sum(volume), 2) + 0.0 AS volume FROM a GROUP BY 1, 2""")
def routed_union_bars(spark, d):
    """Bars of two asset classes by one schema; columns that a class lacks are null."""
    both = routed_union([("user", ubars(spark, d)), ("supplier", sbars(spark, d))])
    return both.groupBy("kind", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count("turn").alias("n_turn"), rnd(F.sum("volume"), 2).alias("volume"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1")
def dedupe_keep_last(spark, d):
    return upsert.keep_last(table(spark, d, "events"), ["user_id", "event_type"], ["ts"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, greatest(CAST(max(ts) AS DATE) + 1, DATE '2024-01-15') AS start FROM events GROUP BY 1")
def high_water_mark(spark, d):
    days = table(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day"))
    return upsert.high_water_marks(days, "user_id", "day", "2024-01-15")


@query("SELECT CAST(max(ts) AS DATE) + 1 AS start FROM events")
def table_high_water_mark(spark, d):
    return upsert.table_start(table(spark, d, "events").select(F.col("ts").cast("date").alias("day")), "day", "1990-01-01")


@query(f"{UD} SELECT asset, date, close, (close IS NULL) AS missing FROM p")
def densify_panel(spark, d):
    return ud(spark, d).select("asset", "date", "close", F.col("close").isNull().alias("missing"))


_ADJ = f"""{SD}, f AS (SELECT asset, date, close, coalesce(last_value(adj_factor IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING),
 first_value(adj_factor IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS a FROM p),
 g AS (SELECT *, a / last_value(a) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS factor FROM f)
 SELECT asset, date, round(close * factor * 0.73105857863, 5) + 0.0 AS close, round(factor, 7) + 0.0 AS factor FROM g"""


@query(_ADJ)
def forward_adjust(spark, d):
    out = adjust.forward_adjust(sd(spark, d))
    return out.select("asset", "date", rnd(F.col("close") * 0.73105857863, 5).alias("close"), rnd("factor", 7).alias("factor"))


@query(f"""WITH {SB}, v AS (SELECT asset, date, CASE WHEN asset % 7 = 0 THEN 2.5 ELSE 0.0 END AS cash FROM sb WHERE asset % 7 = 0),
 x AS (SELECT sb.asset, sb.date, close, adj_factor, coalesce(cash, 0) AS cash, lag(adj_factor) OVER w AS pa, lag(close) OVER w AS pc FROM sb LEFT JOIN v USING (asset, date) WINDOW w AS (PARTITION BY sb.asset ORDER BY sb.date)),
 y AS (SELECT *, CASE WHEN cash > 0 THEN (adj_factor / pa) / (pc / (pc - cash)) ELSE adj_factor / pa END AS r FROM x)
 SELECT asset, date, round(CASE WHEN abs(adj_factor - pa) >= 1e-9 AND pa > 0 AND r > 0 AND abs(r - 1) > 0.005 THEN r ELSE 1.0 END, 6) + 0.0 AS split_ratio FROM y""")
def split_ratio_jump(spark, d):
    bars = sbars(spark, d)
    cash = bars.where("asset % 7 = 0").select("asset", "date", F.lit(2.5).alias("div_cash"))
    return adjust.split_ratios(bars, cash).select("asset", "date", rnd("split_ratio").alias("split_ratio"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v, 'old' AS src FROM orders WHERE o_orderstatus IS DISTINCT FROM 'O'), n AS (SELECT o_orderkey AS k, o_totalprice * 2 AS v, 'new' AS src FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F')
 SELECT k, v, src FROM n UNION ALL SELECT k, v, src FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k = o.k)""")
def upsert_merge_all(spark, d):
    """Every order: finished ones are kept, partly done ones replaced, open ones added."""
    o, status = table(spark, d, "orders"), F.col("o_orderstatus")
    old = o.where(~status.eqNullSafe("O")).select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.lit("old").alias("src"))
    new = o.where(~status.eqNullSafe("F")).select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") * 2).alias("v"), F.lit("new").alias("src"))
    return upsert.merge(old, new, ["k"])


_CODES = "SELECT c_custkey, lpad(((c_custkey * 7919) % 1000000)::VARCHAR, 6, '0') || CASE c_custkey % 5 WHEN 0 THEN '.XSHG' WHEN 1 THEN '.SZ' WHEN 2 THEN '.bj' WHEN 3 THEN '.DCE' ELSE '.SH' END AS code FROM customer"


def _codes(spark, d):
    k = F.col("c_custkey")
    suffix = F.when(k % 5 == 0, ".XSHG").when(k % 5 == 1, ".SZ").when(k % 5 == 2, ".bj").when(k % 5 == 3, ".DCE").otherwise(".SH")
    return table(spark, d, "customer").select(k, F.concat(F.lpad(((k * 7919) % 1000000).cast("string"), 6, "0"), suffix).alias("code"))


@query(f"""WITH c AS ({_CODES}), t AS (SELECT c_custkey, CASE WHEN upper(code) LIKE '%.XSHG' THEN left(upper(code), 6) || '.SH' ELSE upper(code) END AS code FROM c)
 SELECT c_custkey, CASE WHEN split_part(code, '.', 2) IN ('SHF', 'DCE', 'CZC', 'CFF', 'INE') THEN 'futures'
  WHEN code LIKE '5%.SH' OR (code LIKE '%.SZ' AND left(code, 2) IN ('15', '16', '18')) THEN 'etf'
  WHEN code LIKE '000%.SH' OR code LIKE '399%.SZ' THEN 'index' ELSE 'stock' END AS kind FROM t""")
def asset_class_case(spark, d):
    return _codes(spark, d).select("c_custkey", S.classify_asset(F.col("code")).alias("kind"))


@query(f"""WITH c AS ({_CODES}), t AS (SELECT c_custkey, CASE WHEN upper(code) LIKE '%.XSHG' THEN left(upper(code), 6) || '.SH' ELSE upper(code) END AS tushare FROM c)
 SELECT c_custkey, tushare, CASE WHEN tushare LIKE '%.SH' THEN left(tushare, 6) || '.XSHG' WHEN tushare LIKE '%.SZ' THEN left(tushare, 6) || '.XSHE' ELSE tushare END AS joinquant,
  split_part(tushare, '.', 2) || split_part(tushare, '.', 1) AS store FROM t""")
def code_convert(spark, d):
    t = S.to_tushare_code(F.col("code"))
    return _codes(spark, d).select("c_custkey", t.alias("tushare"), S.to_joinquant_code(F.col("code")).alias("joinquant"), S.to_store_code(t).alias("store"))


@query("""WITH s AS (SELECT l_suppkey AS asset, CAST(l_shipdate AS DATE) AS in_date, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL ELSE CAST(l_shipdate AS DATE) + l_quantity::INTEGER END AS out_date, l_orderkey AS k FROM lineitem),
 o AS (SELECT o_orderkey, o_custkey % (SELECT max(l_suppkey) FROM lineitem) + 1 AS asset, CAST(o_orderdate AS DATE) AS day FROM orders)
 SELECT o_orderkey, count(*) AS n, min(k) AS first_k FROM o JOIN s ON s.asset = o.asset AND s.in_date <= o.day AND (s.out_date IS NULL OR s.out_date > o.day) GROUP BY 1""")
def interval_membership_all(spark, d):
    """Every order against every line: a line lasts as many days as its quantity, without end where it is open and not returned."""
    li, day = table(spark, d, "lineitem"), F.col("l_shipdate").cast("date")
    ends = F.when(F.coalesce((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), F.lit(False)), None).otherwise(F.date_add(day, F.col("l_quantity").cast("int")))
    spans = li.select(F.col("l_suppkey").alias("asset"), day.alias("in_date"), ends.alias("out_date"), F.col("l_orderkey").alias("k"))
    most = li.agg(F.max("l_suppkey").alias("most"))
    points = table(spark, d, "orders").crossJoin(F.broadcast(most)).select("o_orderkey", (F.col("o_custkey") % F.col("most") + 1).alias("asset"), F.col("o_orderdate").cast("date").alias("day"))  # one row
    return asof.interval_join(points, spans, ["asset"], "day", "in_date", "out_date").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_k"))


@query(f"""WITH {SB}, b AS (SELECT lpad(asset::VARCHAR, 6, '0') || '.SH' AS ts_code, date AS trade_date, close AS pe, turn * 100 AS pb, volume * 1e4 AS total_mv FROM sb)
 SELECT left(ts_code, 6) || '.XSHG' AS code, round(total_mv / 1e4, 2) + 0.0 AS market_cap, round(pb * 0.73105857863, 6) + 0.0 AS pb_ratio FROM b
 WHERE trade_date = (SELECT max(trade_date) FROM b WHERE trade_date <= DATE '1997-06-20') AND pb > 4.5 AND total_mv >= 1000000 ORDER BY total_mv DESC NULLS LAST, ts_code LIMIT 20""")
def fundamentals_query(spark, d):
    b = sbars(spark, d).select(F.concat(F.lpad(F.col("asset").cast("string"), 6, "0"), F.lit(".SH")).alias("ts_code"), F.col("date").alias("trade_date"), F.col("close").alias("pe"), (F.col("turn") * 100).alias("pb"), (F.col("volume") * 1e4).alias("total_mv"))
    q = fundamentals(valuation.code, valuation.market_cap, valuation.pb_ratio).filter(valuation.pb_ratio > 4.5, valuation.market_cap >= 1000000).order_by(valuation.market_cap.desc()).limit(20)
    return get_fundamentals(b, q, "1997-06-20").select("code", rnd("market_cap", 2).alias("market_cap"), rnd(F.col("pb_ratio") * 0.73105857863).alias("pb_ratio"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_prop_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT event_id, round(CASE WHEN abs(value - 50) > 1e-10 THEN greatest(least(100 / (value - 50), 1e6), -1e6) ELSE 0 END, 4) + 0.0 AS div,
 round(ln(abs(value) + 1e-10), 6) + 0.0 AS log, greatest(least(value, 90.5::DOUBLE), 10.5::DOUBLE) AS clipped FROM events""")
def safe_arith(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", rnd(S.safe_div(F.lit(100.0), v - 50), 4).alias("div"), rnd(S.safe_log(v)).alias("log"), S.clip(v, 10.5, 90.5).alias("clipped"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, sum(CASE WHEN q > 0 THEN floor(q / 100) * 100 ELSE q END)::BIGINT AS lots, round(sum(round_even(p * (1 + sign(q) * 0.001) / 0.001, 0) * 0.001 * 0.73105857863), 4) + 0.0 AS fill,
 round(sum(greatest(abs(p * q) * 0.0003, 5)) * 0.73105857863, 4) + 0.0 AS fee, round(sum(CASE WHEN q < 0 THEN abs(p * q) * 0.0005 ELSE 0 END) * 0.73105857863, 4) + 0.0 AS tax
 FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS p, CASE WHEN l_linenumber % 2 = 0 THEN -l_quantity ELSE l_quantity * 13 END AS q FROM lineitem) GROUP BY 1, 2""")
def fill_price_costs(spark, d):
    """Fill price by slippage and tick, lots, commission, stamp duty."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity") * 13).alias("q"))
    p, q, k = F.col("p"), F.col("q"), 0.73105857863
    return rows.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(S.round_lot(q)).alias("lots"),
        rnd(F.sum(S.fill_price(p, q, 0.002) * k), 4).alias("fill"),
        rnd(F.sum(S.commission(p * q, 0.0003, 5.0)) * k, 4).alias("fee"),
        rnd(F.sum(S.stamp_duty(p * q, q, F.lit("stock"))) * k, 4).alias("tax"),
    )


@query("""SELECT event_id, (CASE WHEN event_type = 'signup' THEN value <= pre * 0.9 + 1e-3 ELSE value >= pre * 1.1 - 1e-3 END AND pre > 0) AS rejected
 FROM (SELECT event_id, event_type, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS pre FROM events) WHERE pre IS NOT NULL""")
def limit_rejects(spark, d):
    rows = table(spark, d, "events").withColumn("pre", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts"))).where("pre IS NOT NULL")
    side = F.when(F.col("event_type") == "signup", -100).otherwise(100)
    return rows.select("event_id", S.limit_reject(side, F.col("value"), F.col("pre"), F.lit("stock")).alias("rejected"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
 regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '_' || left(sha1(regexp_replace(p_brand || ' (' || p_type || ')', '\\s+', '', 'g')), 6) AS name FROM part""")
def slug_digest(spark, d):
    p = table(spark, d, "part")
    text = F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")"))
    return p.select("p_partkey", S.slug(F.col("p_name")).alias("slug"), S.unique_name(F.col("p_name"), text).alias("name"))


@query("""SELECT event_id, try_strptime(CASE WHEN event_id % 9 = 0 THEN '2024-13-99' ELSE strftime(ts, '%Y%m%d') END, '%Y%m%d')::DATE AS day FROM events""")
def date_parse(spark, d):
    text = F.when(F.col("event_id") % 9 == 0, "2024-13-99").otherwise(F.date_format("ts", "yyyyMMdd"))
    return table(spark, d, "events").select("event_id", parse_date(text).alias("day"))


_WEIGHTS = """w0 AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS trade_date, l_suppkey AS con_code, sum(l_extendedprice) AS weight FROM lineitem GROUP BY 1, 2),
 w AS (SELECT * FROM w0 QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY weight DESC, con_code) <= 30)"""


def _weights(spark, d):
    w = table(spark, d, "lineitem").groupBy(F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("trade_date"), F.col("l_suppkey").alias("con_code")).agg(F.sum("l_extendedprice").alias("weight"))
    top = Window.partitionBy("trade_date").orderBy(F.col("weight").desc(), "con_code")
    return w.withColumn("n", F.row_number().over(top)).where("n <= 30").drop("n").withColumn("index_code", F.lit("TOP30"))


@query(f"WITH {_WEIGHTS} SELECT DISTINCT con_code FROM w WHERE trade_date = (SELECT max(trade_date) FROM w WHERE trade_date <= DATE '1996-05-20')")
def asof_membership(spark, d):
    return asof.snapshot_members(_weights(spark, d), "TOP30", "1996-05-20")


@query(f"WITH {_WEIGHTS} SELECT DISTINCT con_code FROM w WHERE trade_date >= (SELECT max(trade_date) FROM w WHERE trade_date <= DATE '1996-05-20') AND trade_date <= DATE '1998-02-01'")
def membership_union(spark, d):
    return asof.members_between(_weights(spark, d), "TOP30", "1996-05-20", "1998-02-01")


@query("""SELECT e.event_id, b.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') e
 ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') b ON e.user_id = b.user_id AND e.ts >= b.ts""")
def asof_last_value(spark, d):
    """The last purchase before each click, without making pairs."""
    ev = table(spark, d, "events")
    left = ev.where("event_type = 'click'").select("user_id", "ts", "event_id")
    right = ev.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_purchase"))
    return asof.asof_join(left, right, ["user_id"], "ts", ["last_purchase"]).select("event_id", "last_purchase")


@query(f"WITH {UB}, c AS (SELECT DISTINCT date FROM ub) SELECT date FROM c QUALIFY row_number() OVER (PARTITION BY isoyear(date), weekofyear(date) ORDER BY date) = 2")
def nth_session_week(spark, d):
    return calendar.nth_session(ubars(spark, d).select("date"), "weekly", 2)


@query("WITH c AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) SELECT date FROM c QUALIFY row_number() OVER (PARTITION BY year(date), month(date) ORDER BY date DESC) = 2")
def nth_session_month(spark, d):
    """The last but one session of each month."""
    return calendar.nth_session(table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")), "monthly", -2)


@query(f"""WITH {UB}, c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ordinal FROM (SELECT DISTINCT date FROM ub)),
 k AS (SELECT c.ordinal, ub.asset FROM ub JOIN c USING (date) WHERE c.ordinal % 5 = 0 QUALIFY row_number() OVER (PARTITION BY date ORDER BY amount DESC, asset) <= 10)
 SELECT c.date, k.asset FROM c JOIN k ON k.ordinal = c.ordinal - c.ordinal % 5""")
def rebalance_carry(spark, d):
    from factorloom.operators.cross import top_n

    bars = ubars(spark, d)
    days = calendar.sessions(bars)
    due = bars.join(F.broadcast(days), "date").where("ordinal % 5 = 0")  # a row per session
    picks = top_n(due, "amount", 10).select("ordinal", "asset")
    return calendar.carry(picks, days, 5).select("date", "asset")


@query(f"""{SD} SELECT asset, date, round(last_value(turn IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) * 0.73105857863, 8) + 0.0 AS turn FROM p""")
def forward_fill(spark, d):
    return adjust.fill(sd(spark, d), ["turn"]).select("asset", "date", rnd(F.col("turn") * 0.73105857863, 8).alias("turn"))


@query(f"""WITH {SB}, h AS (SELECT asset, date, adj_factor AS a, list(close * adj_factor) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l FROM sb)
 SELECT asset, date, coalesce(len(l), 0)::INTEGER AS n, round(list_sum(l) / a, 3) + 0.0 AS total FROM h""")
def price_history(spark, d):
    """The three closes before each bar, adjusted to its own factor."""
    h = adjust.history(sbars(spark, d), "close", 3)
    return h.select("asset", "date", F.size("history").alias("n"), rnd(F.when(F.size("history") > 0, F.aggregate("history", F.lit(0.0), lambda a, x: a + x)), 3).alias("total"))


@query("SELECT user_id AS asset, time_bucket(INTERVAL 6 HOUR, ts) AS start, arg_min(value, ts) AS open, arg_max(value, ts) AS close, count(value) AS volume FROM events GROUP BY 1, 2")
def tumbling_window(spark, d):
    return windowed_bars(table(spark, d, "events"), "6 hours").select("asset", "start", "open", "close", "volume")


@query("""SELECT user_id AS asset, s AS start, count(value) AS volume, max(value) AS high FROM (SELECT user_id, value, ts, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1, 2""")
def sliding_window(spark, d):
    return windowed_bars(table(spark, d, "events"), "12 hours", "6 hours").select("asset", "start", "volume", "high")


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events),
 s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id AS asset, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(value) AS n, round(sum(value), 4) + 0.0 AS total FROM s GROUP BY user_id, k""")
def session_window(spark, d):
    return sessions_of(table(spark, d, "events"), "6 hours").withColumn("total", rnd("total", 4))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) + 0.0 AS qty, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_cube(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("l_quantity"), 2).alias("qty"), F.grouping_id().alias("level"))


@query("SELECT s_nationkey, count(DISTINCT l_orderkey) AS exact_orders FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def distinct_orders(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey")
    return li.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.countDistinct("l_orderkey").alias("exact_orders"))


@query()
def approx_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("orders"))


@query(f"WITH {UB} SELECT asset, n FROM (SELECT asset, count(*) AS n FROM ub GROUP BY 1) WHERE asset NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)")
def anti_existing(spark, d):
    ev = table(spark, d, "events")
    bad = ev.where("event_type = 'error' AND value > 100").select(F.col("user_id").alias("asset"))
    return ubars(spark, d).groupBy("asset").agg(F.count(F.lit(1)).alias("n")).join(bad, "asset", "left_anti")


@query(f"WITH {UB}, x AS (SELECT DISTINCT asset FROM ub WHERE volume >= 4), y AS (SELECT DISTINCT asset FROM ub WHERE close > 200) SELECT asset, 'both' AS part FROM (SELECT * FROM x INTERSECT SELECT * FROM y) UNION ALL SELECT asset, 'only_x' FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT asset, 'any' FROM (SELECT * FROM x UNION SELECT * FROM y)")
def set_operations(spark, d):
    b = ubars(spark, d)
    x, y = b.where("volume >= 4").select("asset").distinct(), b.where("close > 200").select("asset").distinct()
    named = lambda df, n: df.withColumn("part", F.lit(n))
    return named(x.intersect(y), "both").unionByName(named(x.subtract(y), "only_x")).unionByName(named(x.union(y).distinct(), "any"))


