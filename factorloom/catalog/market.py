"""Market tables: joined bars, corporate actions, listings, industries, code lists, and the rows that models learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.functions.scalars import normalize_codes, percent_text, referenced_codes
from factorloom.operators import adjust, asof, cross
from factorloom.operators.calendar import calendar_bounds
from factorloom.plans.compiler import compile_factors
from factorloom.sources.bars import load_bars, load_fund_bars, table
from factorloom.sources.upsert import clean_rows, open_sessions

from .portfolio import _ML, _dataset
from .dsl import _OFF
from .registry import SB, SD, dense_sql, query, rnd, sbars, sd

_KEY = ("CAST(l_suppkey AS STRING) AS ts_code", "CAST(l_shipdate AS DATE) AS trade_date")
_SQL_KEY = "l_suppkey::VARCHAR AS ts_code, CAST(l_shipdate AS DATE) AS trade_date"
_DAILY = f"""WITH daily AS (SELECT {_SQL_KEY}, avg(l_extendedprice / l_quantity) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
 sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount FROM lineitem GROUP BY 1, 2),
 adj AS (SELECT {_SQL_KEY}, 1 + avg(l_tax) AS adj_factor FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
 basic AS (SELECT {_SQL_KEY}, avg(l_discount) * 100 AS turnover_rate FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)"""


def _off(value: str, digits: int = 5) -> str:
    """Rounded away from exact halves, as in dsl."""
    return f"round(({value}) * {_OFF}::DOUBLE, {digits}) + 0.0"


_PRICES = ", ".join(f"{_off(c)} AS {c}" for c in ("open", "high", "low", "close"))


def _daily(spark, d) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(*map(F.expr, _KEY)).agg(
        F.avg(price).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("vol"), F.sum("l_extendedprice").alias("amount"),
    )


def _adj(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(*map(F.expr, _KEY)).agg((1 + F.avg("l_tax")).alias("adj_factor"))


def _basic(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").where("l_linestatus = 'O'").groupBy(*map(F.expr, _KEY)).agg((F.avg("l_discount") * 100).alias("turnover_rate"))


def _rounded(df: DataFrame, *more: str) -> DataFrame:
    return df.select("ts_code", "date", *[rnd(F.col(c) * _OFF, 5).alias(c) for c in ("open", "high", "low", "close", "volume", "vwap", "adj_factor", "turnover_rate", "split_ratio", *more)])


@query(f"""{_DAILY} SELECT ts_code, trade_date AS date, {_PRICES}, {_off('volume')} AS volume, {_off('CASE WHEN volume <> 0 THEN amount * 10 / volume ELSE 0 END')} AS vwap,
 {_off('coalesce(adj_factor, 1)')} AS adj_factor, {_off('coalesce(turnover_rate, 0)')} AS turnover_rate, {_off('1')} AS split_ratio
 FROM daily LEFT JOIN adj USING (ts_code, trade_date) LEFT JOIN basic USING (ts_code, trade_date) WHERE trade_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'""")
def stock_bars_joined(spark, d):
    """Daily bars with adjustment factors and turnover from two left joins, in canonical columns."""
    return _rounded(load_bars(_daily(spark, d), _adj(spark, d), _basic(spark, d), start="1995-01-01", end="1996-12-31"))


@query(f"""{_DAILY}, nav AS (SELECT ps_code AS ts_code, day AS trade_date, nav FROM (SELECT l_suppkey::VARCHAR AS ps_code, CAST(l_shipdate AS DATE) AS day, avg(l_extendedprice) / 1000 AS nav FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2))
 SELECT ts_code, trade_date AS date, {_PRICES}, {_off('volume')} AS volume, {_off('CASE WHEN volume <> 0 THEN amount * 10 / volume ELSE 0 END')} AS vwap,
 {_off('coalesce(adj_factor, 1)')} AS adj_factor, 0.0::DOUBLE AS turnover_rate, {_off('1')} AS split_ratio, {_off('nav')} AS unit_nav
 FROM daily LEFT JOIN adj USING (ts_code, trade_date) LEFT JOIN nav USING (ts_code, trade_date)""")
def fund_bars_joined(spark, d):
    """Daily bars of funds with factors and net asset values, whose date has another name."""
    nav = table(spark, d, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_suppkey").cast("string").alias("ts_code"), F.col("l_shipdate").cast("date").alias("nav_date")).agg((F.avg("l_extendedprice") / 1000).alias("unit_nav"))
    return _rounded(load_fund_bars(_daily(spark, d), _adj(spark, d), nav), "unit_nav")


@query("""SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS record_date, CAST(o_orderdate AS DATE) + (o_custkey % 60 + 1)::INTEGER AS pay_date FROM orders
 WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-06-30' OR CAST(o_orderdate AS DATE) + (o_custkey % 60 + 1)::INTEGER BETWEEN DATE '1995-01-01' AND DATE '1995-06-30'""")
def dividends_range(spark, d):
    """Events whose record or pay date lies in a range."""
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), day.alias("record_date"), F.date_add(day, (F.col("o_custkey") % 60 + 1).cast("int")).alias("pay_date"))
    return adjust.dividends_between(rows, "1995-01-01", "1995-06-30")


@query("SELECT event_id AS id, user_id, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS value FROM events WHERE event_type <> 'signup'")
def clean_records(spark, d):
    """Known columns only, NaN as NULL, rows without a full key dropped."""
    raw = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") != "signup", F.col("user_id")).alias("user_id"), F.when(F.col("event_type") == "click", float("nan")).otherwise(F.col("value")).alias("value"), "props",
    )
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("absent", T.StringType())])
    return clean_rows(raw, schema, ["id", "user_id"])


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS cal_date FROM orders WHERE isodow(o_orderdate) < 6 AND CAST(o_orderdate AS DATE) >= DATE '1996-06-01'")
def open_calendar(spark, d):
    """Open days from a mark on."""
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("cal_date")).distinct()
    return open_sessions(days.withColumn("is_open", (F.weekday("cal_date") < 5).cast("int")), "1996-06-01")


@query(f"WITH {SB} SELECT min(date) AS first, max(date) AS last, count(DISTINCT date) AS sessions, count(DISTINCT asset) AS instruments FROM sb")
def panel_bounds(spark, d):
    """The calendar's bounds, its sessions and instruments."""
    return calendar_bounds(sbars(spark, d))


_LISTED = """WITH s AS (SELECT o_custkey AS ts_code, CAST(min(o_orderdate) AS DATE) AS list_date, CASE WHEN max(o_orderdate) < TIMESTAMP '1998-01-01' THEN CAST(max(o_orderdate) AS DATE) END AS delist_date FROM orders GROUP BY 1)"""


@query(f"{_LISTED} SELECT ts_code, list_date, delist_date, c_mktsegment AS kind FROM s JOIN customer ON c_custkey = ts_code WHERE list_date <= DATE '1996-01-01' AND (delist_date IS NULL OR delist_date > DATE '1996-01-01') AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def listed_securities(spark, d):
    """Securities of two kinds that are listed on a day."""
    last = F.max("o_orderdate").cast("date")
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("ts_code")).agg(F.min("o_orderdate").cast("date").alias("list_date"), F.when(last < F.lit("1998-01-01").cast("date"), last).alias("delist_date"))
    kinds = table(spark, d, "customer").select(F.col("c_custkey").alias("ts_code"), F.col("c_mktsegment").alias("kind"))
    return asof.listed_at(s.join(kinds, "ts_code"), "1996-01-01", ["BUILDING", "MACHINERY"])


@query("SELECT s_suppkey, lpad(s_suppkey::VARCHAR, 6, '0') || '.SH,000001.SZ' AS codes FROM supplier")
def code_lists(spark, d):
    """Code lists in one form, each code once, in order."""
    body = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    codes = F.array(F.concat(body, F.lit(".XSHG")), F.lit(" 000001.sz "), F.lit(""), F.concat(F.lit(" "), body, F.lit(".SH")), F.lit("000001.XSHE"))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(normalize_codes(codes), ",").alias("codes"))


@query("SELECT p_partkey, lpad(p_partkey::VARCHAR, 6, '0') || '.SZ,510300.SH' AS codes FROM part")
def codes_in_text(spark, d):
    """Codes that a strategy's text names."""
    body = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    text = F.concat(F.lit("buy('"), body, F.lit(".XSHE') # and 510300.SH, 12345.SH, x510300.SH or "), body, F.lit(".SZ"))
    return table(spark, d, "part").select("p_partkey", F.array_join(referenced_codes(text), ",").alias("codes"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '--' ELSE printf('%.2f%%', c_acctbal / 7 * 100) END AS shown FROM customer")
def percent_display(spark, d):
    """Shares as text, -- where there is no finite number."""
    x = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 7).otherwise(F.when(F.col("c_acctbal") < -500, float("inf")).when(F.col("c_acctbal") < -100, float("nan")))
    return table(spark, d, "customer").select("c_custkey", percent_text(x).alias("shown"))


@query(f"{SD} SELECT asset, date, round(sqrt(abs(close - open)), 6) + 0.0 AS value FROM p")
def dsl_sqrt(spark, d):
    out = compile_factors(sd(spark, d), {"value": "Sqrt($close - $open)"}, keep=["asset", "date"])
    return out.select("asset", "date", rnd("value").alias("value"))


_MIXED = f"""WITH {SB}, x AS (SELECT asset, date, CASE WHEN volume > 30 THEN turn END AS x, CASE WHEN s_nationkey < 15 THEN s_nationkey END AS industry FROM sb JOIN supplier ON s_suppkey = asset)"""


def _mixed(spark, d) -> DataFrame:
    industries = table(spark, d, "supplier").select(F.col("s_suppkey").alias("asset"), F.when(F.col("s_nationkey") < 15, F.col("s_nationkey")).alias("industry"))
    return sbars(spark, d).select("asset", "date", F.when(F.col("volume") > 30, F.col("turn")).alias("x")).join(industries, "asset")


@query(f"""{_MIXED} SELECT asset, date, {_off('coalesce((x - avg(x) OVER w) / coalesce(nullif(stddev_samp(x) OVER w, 0), 1), 0)', 6)} AS flat_as_one,
 {_off('(x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0)', 6)} AS population,
 {_off('coalesce(CASE WHEN industry IS NOT NULL THEN x - avg(x) OVER (PARTITION BY date, industry) ELSE 0 END, 0)', 6)} AS unmapped_as_zero FROM x WINDOW w AS (PARTITION BY date)""")
def cs_variants(spark, d):
    """Scores where a flat day counts as 1 and a missing value as 0, scores of the population, industry means with unmapped assets as 0."""
    x = F.col("x")
    scores = {"flat_as_one": cross.cs_zscore(x, flat_as_one=True, missing_as_zero=True), "population": cross.cs_zscore(x, ddof=0), "unmapped_as_zero": cross.neutralize(x, "industry", unmapped_as_zero=True)}
    return _mixed(spark, d).select("asset", "date", *[rnd(c * _OFF).alias(n) for n, c in scores.items()])


@query("SELECT o_custkey AS ts_code, o_orderpriority AS industry FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1")
def latest_industry(spark, d):
    """The industry of each code by its latest current membership."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("ts_code"), F.col("o_orderdate").cast("date").alias("in_date"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("l1_name"), F.when(F.col("o_orderstatus") == "O", "Y").otherwise("N").alias("is_new"))
    return asof.latest_industry(rows)


@query(f"""{_DAILY}, b AS (SELECT {_SQL_KEY}, sum(l_discount) FILTER (l_returnflag = 'A') AS bonus FROM lineitem GROUP BY 1, 2)
 SELECT ts_code, trade_date AS date, {_off('close')} AS close, {_off('1 + coalesce(bonus, 0)')} AS split_ratio FROM daily JOIN b USING (ts_code, trade_date)""")
def bonus_shares(spark, d):
    """Split ratios from bonus shares of the plans that were carried out."""
    carried = F.when(F.col("l_returnflag") == "A", "实施").otherwise("预案")
    plans = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("ts_code"), F.col("l_shipdate").cast("date").alias("ex_date"), F.col("l_discount").alias("stk_div"), carried.alias("div_proc"))
    out = adjust.stock_splits(_daily(spark, d).withColumnRenamed("trade_date", "date"), plans)
    return out.select("ts_code", "date", rnd(F.col("close") * _OFF, 5).alias("close"), rnd(F.col("split_ratio") * _OFF, 5).alias("split_ratio"))


def _over_mean(x: str) -> str:
    return f"(CASE WHEN count(*) OVER w = 6 THEN sum(coalesce({x}, 0)) OVER w / 6 END)"


@query(f"""{SD}, {dense_sql('sb', True, 'pw')}, f AS (SELECT asset, date, close / nullif({_over_mean('close')}, 0) - 1 AS m, volume / nullif({_over_mean('volume')}, 0) - 1 AS v, turn - {_over_mean('turn')} AS t FROM p WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
 me AS (SELECT date, quantile_cont(m, 0.5) AS mm, quantile_cont(v, 0.5) AS mv, quantile_cont(t, 0.5) AS mt FROM f GROUP BY 1),
 lb AS (SELECT asset, date, lead(close) OVER (PARTITION BY asset ORDER BY date) / nullif(close, 0) - 1 AS label FROM pw),
 j AS (SELECT asset, date, coalesce(m, mm, 0) AS m, coalesce(v, mv, 0) AS v, coalesce(t, mt, 0) AS t, label FROM f JOIN me USING (date) JOIN lb USING (asset, date) WHERE label IS NOT NULL),
 c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS o, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM j))
 SELECT date, asset, round(m, 5) + 0.0 AS m, round(v, 5) + 0.0 AS v, round(t, 5) + 0.0 AS t, round(label, 5) + 0.0 AS label,
 CASE WHEN o >= floor(n * (1 - 0.15)) THEN 'test' WHEN o >= floor(n * (1 - 0.15 - 0.15)) THEN 'valid' ELSE 'train' END AS split FROM j JOIN c USING (date)""")
def learning_rows(spark, d):
    """Imputed features, the return that follows, and the part of the calendar that a row is for."""
    return _dataset(spark, d).select("date", "asset", *[rnd(c, 5).alias(c) for c in (*_ML, "label")], "split")
