"""Cross-sections, factor evaluation, composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.operators import compose, evaluate, gp
from factorloom.operators.calendar import densify, forward_returns, sessions
from factorloom.operators.cross import cs_rank, cs_zscore, median_impute, neutralize, quantile_bins, top_n
from factorloom.plans.compiler import compile_factors
from factorloom.sources.bars import table

from .registry import SB, UB, dense_sql, query, rnd, sbars, sd, ubars

_K = 0.73105857863
_RANK = "(rank() OVER (PARTITION BY date ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0::DOUBLE)"

#: A momentum factor and 1-month forward returns, over suppliers' months; both sides of every evaluation query.
_FACTOR = "Mean($close, 3) / Mean($close, 8)"
FR = f"""WITH {SB}, {dense_sql('sb')}, f0 AS (SELECT asset, date, close, turn,
 CASE WHEN count(*) OVER w3 = 3 THEN sum(coalesce(close, 0)) OVER w3 / 3 END / nullif(CASE WHEN count(*) OVER w8 = 8 THEN sum(coalesce(close, 0)) OVER w8 / 8 END, 0) AS f
 FROM p WINDOW w3 AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w8 AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
 {dense_sql('sb', True, 'pw')}, r0 AS (SELECT asset, date, lead(close, 1) OVER (PARTITION BY asset ORDER BY date) / nullif(close, 0) - 1 AS ret FROM pw),
 fr AS (SELECT f0.asset, f0.date, f, turn, ret FROM f0 JOIN r0 USING (asset, date))"""
RK = f", ok AS (SELECT * FROM fr WHERE f IS NOT NULL AND ret IS NOT NULL), rk AS (SELECT *, {_RANK.format(x='f')} AS rf, {_RANK.format(x='ret')} AS rr FROM ok)"
_CORR = "covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"
IC = f"{FR}{RK}, ic AS (SELECT date, count(*) AS n, CASE WHEN count(*) >= 10 THEN {_CORR.format(a='f', b='ret')} END AS ic, CASE WHEN count(*) >= 10 THEN {_CORR.format(a='rf', b='rr')} END AS rank_ic FROM rk GROUP BY date)"


def factor_returns(spark, d):
    """(asset, date, f, turn, ret)."""
    f = compile_factors(sd(spark, d), {"f": _FACTOR}, keep=["asset", "date", "turn"])
    r = forward_returns(densify(sbars(spark, d), whole=True), (1,)).withColumnRenamed("ret_1", "ret")
    return f.join(r, ["asset", "date"])


@query(f"""WITH {UB}, k AS (SELECT asset, date, {_RANK.format(x='close')} / count(*) OVER (PARTITION BY date) AS r FROM ub) SELECT asset, date, round(r, 8) + 0.0 AS r FROM k""")
def cs_rank_daily(spark, d):
    return ubars(spark, d).select("asset", "date", rnd(cs_rank(F.col("close")), 8).alias("r"))


@query(f"WITH {UB} SELECT asset, date, round((close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0), 6) + 0.0 AS z FROM ub WINDOW w AS (PARTITION BY date)")
def cs_zscore_daily(spark, d):
    return ubars(spark, d).select("asset", "date", rnd(cs_zscore(F.col("close"))).alias("z"))


@query(f"""WITH {SB}, x AS (SELECT sb.asset, date, turn, CASE WHEN s_nationkey % 7 = 0 THEN NULL ELSE s_nationkey END AS industry FROM sb JOIN supplier ON asset = s_suppkey)
 SELECT asset, date, round((CASE WHEN industry IS NULL THEN turn ELSE turn - avg(turn) OVER (PARTITION BY date, industry) END) * {_K}, 8) + 0.0 AS neutral FROM x""")
def cs_neutralize(spark, d):
    """Turnover less its industry's mean of the month; assets without an industry keep it."""
    nation = F.when(F.col("s_nationkey") % 7 != 0, F.col("s_nationkey"))
    industry = table(spark, d, "supplier").select(F.col("s_suppkey").alias("asset"), nation.alias("industry"))
    return sbars(spark, d).join(industry, "asset").select("asset", "date", rnd(neutralize(F.col("turn"), "industry") * _K, 8).alias("neutral"))


@query(f"""WITH {UB}, {dense_sql('ub', True)}, m AS (SELECT date, quantile_cont(close, 0.5) AS med FROM p GROUP BY date)
 SELECT asset, date, round(coalesce(close, med, 0) * {_K}, 6) + 0.0 AS close FROM p JOIN m USING (date)""")
def cs_median_impute(spark, d):
    out = median_impute(densify(ubars(spark, d), whole=True), ["close"])
    return out.select("asset", "date", rnd(F.col("close") * _K).alias("close"))


BINS = """, e AS (SELECT date, quantile_cont(f, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM fr GROUP BY date),
 b AS (SELECT fr.*, CASE WHEN f IS NOT NULL AND len(list_distinct(q)) = 6 THEN 1 + (f > q[2])::INTEGER + (f > q[3])::INTEGER + (f > q[4])::INTEGER + (f > q[5])::INTEGER END AS factor_quantile FROM fr JOIN e USING (date))"""


@query(f"{FR}{BINS} SELECT asset, date, factor_quantile FROM b")
def cs_quantile_bins(spark, d):
    return quantile_bins(factor_returns(spark, d), "f").select("asset", "date", "factor_quantile")


@query(f"{FR} SELECT date, asset, row_number() OVER (PARTITION BY date ORDER BY f DESC, asset)::INTEGER AS place FROM fr WHERE f IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY f DESC, asset) <= 10")
def cs_topn(spark, d):
    return top_n(factor_returns(spark, d), "f", 10).select("date", "asset", "place")


@query(f"""WITH {UB}, {dense_sql('ub', True)} SELECT asset, date, round((lead(close, 1) OVER w / nullif(close, 0) - 1) * {_K}, 6) + 0.0 AS ret_1, round((lead(close, 5) OVER w / nullif(close, 0) - 1) * {_K}, 6) + 0.0 AS ret_5 FROM p WINDOW w AS (PARTITION BY asset ORDER BY date)""", name="forward_returns")
def _forward_returns(spark, d):
    out = forward_returns(densify(ubars(spark, d), whole=True), (1, 5))
    return out.select("asset", "date", rnd(F.col("ret_1") * _K).alias("ret_1"), rnd(F.col("ret_5") * _K).alias("ret_5"))


def _ic(spark, d):
    return evaluate.daily_ic(factor_returns(spark, d), "f", "ret", min_names=10)


@query(f"{IC} SELECT date, n, round(ic, 6) + 0.0 AS ic FROM ic")
def ic_daily(spark, d):
    return _ic(spark, d).select("date", "n", rnd("ic").alias("ic"))


@query(f"{IC} SELECT date, n, round(rank_ic, 6) + 0.0 AS rank_ic FROM ic")
def rank_ic_daily(spark, d):
    return _ic(spark, d).select("date", "n", rnd("rank_ic").alias("rank_ic"))


@query(f"""{IC} SELECT count(ic) AS n_days, round(avg(ic), 6) + 0.0 AS ic_mean, round(stddev_samp(ic), 6) + 0.0 AS ic_std, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) + 0.0 AS ic_ir,
 round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)), 6) + 0.0 AS ic_tstat, round(avg(rank_ic), 6) + 0.0 AS rank_ic_mean, round(avg(rank_ic) / nullif(stddev_samp(rank_ic), 0), 6) + 0.0 AS rank_ic_ir FROM ic""")
def ic_summary(spark, d):
    s = evaluate.summarize_ic(_ic(spark, d))
    return s.select("n_days", *[rnd(c).alias(c) for c in ("ic_mean", "ic_std", "ic_ir", "ic_tstat", "rank_ic_mean", "rank_ic_ir")])


@query(f"{IC} SELECT round(stddev_pop(ic), 6) + 0.0 AS ic_std, round(avg(ic) / nullif(stddev_pop(ic), 0), 6) + 0.0 AS ic_ir FROM ic")
def ic_summary_population(spark, d):
    s = evaluate.summarize_ic(_ic(spark, d), ddof=0)
    return s.select(rnd("ic_std").alias("ic_std"), rnd("ic_ir").alias("ic_ir"))


_Q = f"{FR}{BINS}, q AS (SELECT factor_quantile, avg(ret) AS mean_ret, count(*) AS n FROM b WHERE factor_quantile IS NOT NULL AND ret IS NOT NULL GROUP BY 1)"


@query(f"{_Q} SELECT factor_quantile, round(mean_ret, 6) + 0.0 AS mean_ret, n FROM q")
def quantile_returns(spark, d):
    out = evaluate.quantile_returns(quantile_bins(factor_returns(spark, d), "f"), "ret")
    return out.select("factor_quantile", rnd("mean_ret").alias("mean_ret"), "n")


@query(f"{_Q} SELECT round(arg_max(mean_ret, factor_quantile) - arg_min(mean_ret, factor_quantile), 6) + 0.0 AS spread FROM q")
def quantile_spread(spark, d):
    return evaluate.quantile_spread(quantile_bins(factor_returns(spark, d), "f"), "ret").select(rnd("spread").alias("spread"))


@query(f"""{FR}{BINS}, h AS (SELECT b.asset, b.date, c.ordinal FROM b JOIN p_cal c USING (date) WHERE factor_quantile = 5)
 SELECT h.date, round(count(*) FILTER (g.asset IS NULL) / count(*)::DOUBLE, 6) + 0.0 AS turnover FROM h LEFT JOIN h g ON g.asset = h.asset AND g.ordinal = h.ordinal - 1 WHERE h.ordinal >= 1 GROUP BY h.date""")
def quantile_turnover(spark, d):
    bins = quantile_bins(factor_returns(spark, d), "f")
    return evaluate.quantile_turnover(bins, sessions(sbars(spark, d)), 5).select("date", rnd("turnover").alias("turnover"))


@query(f"{FR} SELECT round(count(f) / count(*)::DOUBLE, 8) + 0.0 AS coverage, count(f) AS n_values, (min(f) = max(f)) AS is_constant FROM fr")
def coverage_gate(spark, d):
    out = evaluate.coverage(factor_returns(spark, d), "f")
    return out.select(rnd("coverage", 8).alias("coverage"), "n_values", "is_constant")


_LONG = f"""{FR}, l AS (SELECT date, asset, ret, factor, value FROM (SELECT date, asset, ret, f, turn FROM fr) UNPIVOT INCLUDE NULLS (value FOR factor IN (f, turn))),
 lo AS (SELECT * FROM l WHERE value IS NOT NULL AND ret IS NOT NULL),
 lr AS (SELECT *, (rank() OVER (PARTITION BY date, factor ORDER BY value) + (count(*) OVER (PARTITION BY date, factor, value) - 1) / 2.0::DOUBLE) AS a, (rank() OVER (PARTITION BY date, factor ORDER BY ret) + (count(*) OVER (PARTITION BY date, factor, ret) - 1) / 2.0::DOUBLE) AS b FROM lo),
 di AS (SELECT date, factor, {_CORR.format(a='value', b='ret')} AS ic, {_CORR.format(a='a', b='b')} AS rank_ic FROM lr GROUP BY 1, 2 HAVING count(*) >= 10),
 g AS (SELECT factor, avg(ic) AS ic_mean, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg(rank_ic) AS rank_ic_mean FROM di GROUP BY 1),
 cv AS (SELECT factor, count(value) / count(*)::DOUBLE AS coverage FROM l GROUP BY 1)"""


@query(f"""{_LONG} SELECT factor, round(coverage, 6) + 0.0 AS coverage, round(ic_mean, 6) + 0.0 AS ic_mean, round(icir, 6) + 0.0 AS icir, round(rank_ic_mean, 6) + 0.0 AS rank_ic_mean,
 CASE WHEN coverage < 0.6 THEN 'coverage' WHEN abs(ic_mean) < 0.02 THEN 'ic' WHEN abs(icir) < 0.3 THEN 'icir' WHEN abs(rank_ic_mean) < 0.02 THEN 'rank_ic' ELSE 'pass' END AS grade FROM cv LEFT JOIN g USING (factor)""")
def factor_grade(spark, d):
    """Two factors evaluated and graded in one pass."""
    fr = factor_returns(spark, d)
    out = evaluate.evaluate_factors(fr.select("date", "asset", "f", "turn"), fr, ["f", "turn"], "ret", min_names=10)
    return out.select("factor", *[rnd(c).alias(c) for c in ("coverage", "ic_mean", "icir", "rank_ic_mean")], "grade")


_FACTORS = {"m": "$close / Mean($close, 6) - 1", "v": "$volume / Mean($volume, 6) - 1", "t": "$turn - Mean($turn, 6)"}
_M = "(CASE WHEN count(*) OVER w = 6 THEN sum(coalesce({x}, 0)) OVER w / 6 END)"
MVT = f"""WITH {SB}, {dense_sql('sb')}, x AS (SELECT asset, date, close / nullif({_M.format(x='close')}, 0) - 1 AS m, volume / nullif({_M.format(x='volume')}, 0) - 1 AS v, turn - {_M.format(x='turn')} AS t
 FROM p WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""


def three_factors(spark, d):
    return compile_factors(sd(spark, d), _FACTORS, keep=["asset", "date"])


@query(MVT + " ".join(("", ", c AS (", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) AS corr FROM x WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in (("m", "v"), ("m", "t"), ("v", "t"))), ") SELECT a, b, round(corr, 6) + 0.0 AS corr FROM c")))
def factor_corr_matrix(spark, d):
    return compose.correlation_matrix(three_factors(spark, d), ["m", "v", "t"]).withColumn("corr", rnd("corr"))


_LIB = [("m", 0.031, 0.41), ("v", -0.012, -0.25), ("t", 0.004, 0.06)]
_LIB_SQL = "lib AS (SELECT * FROM (VALUES ('m', 0.031::DOUBLE, 0.41::DOUBLE), ('v', -0.012::DOUBLE, -0.25::DOUBLE), ('t', 0.004::DOUBLE, 0.06::DOUBLE)) v(name, ic_mean, icir))"


def _library(spark):
    return spark.createDataFrame(_LIB, "name string, ic_mean double, icir double")


@query(f"WITH {_LIB_SQL} SELECT name, CASE WHEN ic_mean < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS direction, round(abs(icir) / sum(abs(icir)) OVER (), 8) + 0.0 AS weight FROM lib")
def factor_weights(spark, d):
    return compose.factor_weights(_library(spark)).select("name", "direction", rnd("weight", 8).alias("weight"))


@query(f"WITH {_LIB_SQL} SELECT name, icir FROM lib WHERE abs(icir) >= 0.1 ORDER BY abs(icir) DESC LIMIT 2")
def factor_select(spark, d):
    return compose.select_factors(_library(spark), 2, 0.1).select("name", "icir")


_Z = "({x} - avg({x}) OVER d) / nullif(stddev_samp({x}) OVER d, 0) AS {x}"
COMPOSITE = f"""{MVT}, {_LIB_SQL}, z AS (SELECT asset, date, {', '.join(_Z.format(x=x) for x in 'mvt')} FROM x WINDOW d AS (PARTITION BY date)),
 zl AS (SELECT date, asset, name, z FROM z UNPIVOT (z FOR name IN (m, v, t))),
 sc AS (SELECT date, asset, sum(z * CASE WHEN ic_mean < 0 THEN -1 ELSE 1 END * w) AS score FROM zl JOIN (SELECT *, abs(icir) / sum(abs(icir)) OVER () AS w FROM lib) USING (name) GROUP BY 1, 2)"""


def composite(spark, d):
    return compose.composite_score(three_factors(spark, d), compose.factor_weights(_library(spark)), ["m", "v", "t"])


@query(f"{COMPOSITE} SELECT date, asset, round(score, 6) + 0.0 AS score FROM sc")
def composite_score(spark, d):
    return composite(spark, d).withColumn("score", rnd("score"))


_PROGRAMS = {
    "Sub($csrank_f, $csrank_turn)": "cf - ct",
    "Mul($neu_f, $f)": "nf * f",
    "Div($f, Sub($turn, $neu_turn))": "CASE WHEN abs(turn - nt) > 1e-10 THEN f / (turn - nt) WHEN f IS NULL OR turn IS NULL THEN NULL ELSE 0 END",
    "Log(Add($f, $turn))": "ln(abs(f + turn) + 1e-10)",
}
_CUT = "CASE WHEN ordinal >= floor(n * 0.85) THEN 'test' WHEN ordinal >= floor(n * (1 - 0.15 - 0.15)) THEN 'valid' ELSE 'train' END"
_PCT = "CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY date, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER (PARTITION BY date) END"
_NEU = "coalesce({x} - avg({x}) OVER (PARTITION BY date, asset % 4), 0)"


@query(f"""{FR}, t AS (SELECT *, {_PCT.format(x='f')} AS cf, {_PCT.format(x='turn')} AS ct, {_NEU.format(x='f')} AS nf, {_NEU.format(x='turn')} AS nt FROM fr),
 v AS ({' UNION ALL '.join(f"SELECT date, asset, ret, '{p}' AS program, {e} AS value FROM t" for p, e in _PROGRAMS.items())}),
 o AS (SELECT * FROM v WHERE value IS NOT NULL AND ret IS NOT NULL),
 r AS (SELECT *, (rank() OVER (PARTITION BY date, program ORDER BY value) + (count(*) OVER (PARTITION BY date, program, value) - 1) / 2.0::DOUBLE) AS a, (rank() OVER (PARTITION BY date, program ORDER BY ret) + (count(*) OVER (PARTITION BY date, program, ret) - 1) / 2.0::DOUBLE) AS b FROM o),
 i AS (SELECT date, program, {_CORR.format(a='a', b='b')} AS ic FROM r GROUP BY 1, 2 HAVING count(*) >= 10),
 c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ordinal, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM fr)),
 s AS (SELECT program, ic, {_CUT} AS split FROM i JOIN c USING (date))
 SELECT program, round(avg(ic) FILTER (split = 'train'), 6) + 0.0 AS train, round(avg(ic) FILTER (split = 'valid'), 6) + 0.0 AS valid, round(avg(ic) FILTER (split = 'test'), 6) + 0.0 AS test FROM s GROUP BY 1""")
def gp_generation(spark, d):
    """Fitness of one generation over atoms, their ranks and their values by industry, on three parts of the calendar."""
    panel = factor_returns(spark, d).withColumn("industry", F.col("asset") % 4)
    panel, _ = gp.with_terminals(panel, ["f", "turn"], "industry")
    got = gp.split_fitness(panel, list(_PROGRAMS), "ret")
    return got.select("program", *[rnd(s).alias(s) for s in gp.SPLITS])
