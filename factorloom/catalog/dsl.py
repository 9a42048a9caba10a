"""One query per call of the expression language, over suppliers' monthly bars."""

from __future__ import annotations

from factorloom.operators.calendar import densify
from factorloom.plans.atoms import atomic_factors
from factorloom.plans.compiler import Frame, compile_factors
from factorloom.sources.bars import table

from .registry import ORACLES, QUERIES, SB, SD, dense_sql, query, rnd, sbars, sd

from pyspark.sql import functions as F


def _w(n: int) -> str:
    return f"(PARTITION BY asset ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_S = "(PARTITION BY asset ORDER BY date)"
#: Prices have few decimals, and engines round exact halves apart; times this none is one.
_OFF = 0.7310585786300049


def _full(value: str, n: int, x: str = "x") -> str:
    return f"CASE WHEN count({x}) OVER {_w(n)} = {n} THEN {value} END"


def _add(name: str, expression: str, x: str, value: str, digits: int = 6, y: str = "NULL", strict: bool = True) -> None:
    def run(spark, d):
        out = compile_factors(sd(spark, d), {"value": expression}, Frame(strict=strict), keep=["asset", "date"])
        return out.select("asset", "date", rnd(F.col("value") * _OFF, digits).alias("value"))

    QUERIES[name] = run
    ORACLES[name] = f"""{SD}, q AS (SELECT asset, date, {x} AS x, {y} AS y, row_number() OVER {_S} AS i FROM p)
 SELECT asset, date, round(({value}) * {_OFF}::DOUBLE, {digits}) + 0.0 AS value FROM q"""


_MAD = f"list_avg(list_transform(list(x) OVER {_w(6)}, lambda e: abs(e - list_avg(list(x) OVER {_w(6)}))))"
_EMA = "list_reduce(list(x) FILTER (x IS NOT NULL) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING), lambda a, v: a * (1 - 2.0::DOUBLE / 6) + v * (2.0::DOUBLE / 6))"

_add("dsl_ref", "Ref($close, 3)", "close", f"lag(x, 3) OVER {_S}", 5)
_add("dsl_delta", "Delta($close, 2)", "close", f"x - lag(x, 2) OVER {_S}", 5)
_add("dsl_mean", "Mean($close, 5)", "close", f"CASE WHEN count(*) OVER {_w(5)} = 5 THEN sum(coalesce(x, 0)) OVER {_w(5)} / 5 END", 4)
_add("dsl_sum", "Sum($volume, 5)", "volume", f"CASE WHEN count(*) OVER {_w(5)} = 5 THEN sum(coalesce(x, 0)) OVER {_w(5)} END", 4)
_add("dsl_std", "Std($turn, 6)", "turn", _full(f"stddev_samp(x) OVER {_w(6)}", 6))
_add("dsl_var", "Var($turn, 6)", "turn", _full(f"var_samp(x) OVER {_w(6)}", 6), 9)
_add("dsl_max", "Max($high, 6)", "high", _full(f"max(x) OVER {_w(6)}", 6), 5)
_add("dsl_min", "Min($low, 6)", "low", _full(f"min(x) OVER {_w(6)}", 6), 5)
_add("dsl_med", "Med($close, 6)", "close", _full(f"quantile_cont(x, 0.5) OVER {_w(6)}", 6), 5)
_add("dsl_quantile", "Quantile($close, 6, 0.25)", "close", _full(f"quantile_cont(x, 0.25) OVER {_w(6)}", 6), 5)
_add("dsl_skew", "Skew($turn, 8)", "turn", _full(f"nullif(skewness(x) OVER {_w(8)}, 'nan'::DOUBLE)", 8), 5)
_add("dsl_kurt", "Kurt($turn, 8)", "turn", _full(f"nullif(kurtosis(x) OVER {_w(8)}, 'nan'::DOUBLE)", 8), 5)
_add("dsl_rank", "Rank($close, 6)", "close", _full(f"len(list_filter(list(x) OVER {_w(6)}, lambda e: e < x)) / 5.0::DOUBLE", 6))
_add("dsl_count", "Count(Gt($close, Mean($close, 3)), 5)", "close", f"CASE WHEN count(y) OVER {_w(5)} = 5 THEN sum(y) OVER {_w(5)} END", y=f"CASE WHEN count(*) OVER {_w(3)} = 3 AND close IS NOT NULL THEN (close > sum(coalesce(close, 0)) OVER {_w(3)} / 3)::DOUBLE END")
_add("dsl_idxmax", "IdxMax($close, 6)", "close", _full(f"(list_position(list(x) OVER {_w(6)}, max(x) OVER {_w(6)}) - 1)::DOUBLE", 6))
_add("dsl_idxmin", "IdxMin($close, 6)", "close", _full(f"(list_position(list(x) OVER {_w(6)}, min(x) OVER {_w(6)}) - 1)::DOUBLE", 6))
_add("dsl_wma", "WMA($close, 4)", "close", f"(4 * x + 3 * lag(x, 1) OVER {_S} + 2 * lag(x, 2) OVER {_S} + lag(x, 3) OVER {_S}) / 10.0", 4)
_add("dsl_ema", "EMA($close, 5)", "close", f"CASE WHEN x IS NOT NULL THEN {_EMA} END", 4)
_add("dsl_slope", "Slope($close, 6)", "close", _full(f"regr_slope(x, i) OVER {_w(6)}", 6), 4)
_add("dsl_rsquare", "Rsquare($close, 6)", "close", _full(f"CASE WHEN var_pop(x) OVER {_w(6)} = 0 THEN 0 ELSE regr_r2(x, i) OVER {_w(6)} END", 6))
_add("dsl_resi", "Resi($close, 6)", "close", _full(f"x - (regr_intercept(x, i) OVER {_w(6)} + regr_slope(x, i) OVER {_w(6)} * i)", 6), 4)
_add("dsl_corr", "Corr($close, $turn, 8)", "close", _full(f"covar_pop(x, y) OVER {_w(8)} / nullif(stddev_pop(x) OVER {_w(8)} * stddev_pop(y) OVER {_w(8)}, 0)", 8), 5, y="turn")
_add("dsl_cov", "Cov($close, $turn, 8)", "close", _full(f"covar_samp(x, y) OVER {_w(8)}", 8), 5, y="turn")
_add("dsl_mad", "Mad($turn, 6)", "turn", _full(_MAD, 6))
ORACLES["dsl_mad"] = f"""{SD}, q AS (SELECT asset, date, list(turn) OVER {_w(6)} AS l, count(turn) OVER {_w(6)} AS n FROM p)
 SELECT asset, date, round((CASE WHEN n = 6 THEN list_avg(list_transform(l, lambda e: abs(e - list_avg(l)))) END) * {_OFF}::DOUBLE, 6) + 0.0 AS value FROM q"""
for _name, _fn in (("dsl_rank", None), ("dsl_idxmax", "list_max"), ("dsl_idxmin", "list_min")):
    _value = "len(list_filter(l, lambda e: e < x)) / 5.0::DOUBLE" if _fn is None else f"(list_position(l, {_fn}(l)) - 1)::DOUBLE"
    ORACLES[_name] = f"""{SD}, q AS (SELECT asset, date, close AS x, list(close) OVER {_w(6)} AS l, count(close) OVER {_w(6)} AS n FROM p)
 SELECT asset, date, round((CASE WHEN n = 6 THEN {_value} END) * {_OFF}::DOUBLE, 6) + 0.0 AS value FROM q"""
ORACLES["dsl_ema"] = f"""{SD}, q AS (SELECT asset, date, close AS x, list(close) FILTER (close IS NOT NULL) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS l FROM p)
 SELECT asset, date, round(CASE WHEN x IS NOT NULL THEN list_reduce(l, lambda a, v: a * (1 - 2.0::DOUBLE / 6) + v * (2.0::DOUBLE / 6)) END * {_OFF}::DOUBLE, 4) + 0.0 AS value FROM q"""
ORACLES["dsl_count"] = f"""{SD}, q AS (SELECT asset, date, CASE WHEN count(*) OVER {_w(3)} = 3 AND close IS NOT NULL THEN (close > sum(coalesce(close, 0)) OVER {_w(3)} / 3)::DOUBLE END AS y FROM p)
 SELECT asset, date, round((CASE WHEN count(y) OVER {_w(5)} = 5 THEN sum(y) OVER {_w(5)} END) * {_OFF}::DOUBLE, 6) + 0.0 AS value FROM q"""


def _wide(name: str, expressions: dict[str, str], sql: dict[str, str], digits: int, strict: bool = True, before: str = "q AS (SELECT * FROM p)") -> None:
    def run(spark, d):
        out = compile_factors(sd(spark, d), expressions, Frame(strict=strict), keep=["asset", "date"])
        return out.select("asset", "date", *[rnd(F.col(c) * _OFF, digits).alias(c) for c in expressions])

    QUERIES[name] = run
    cols = ", ".join(f"round(({v}) * {_OFF}::DOUBLE, {digits}) + 0.0 AS {c}" for c, v in sql.items())
    ORACLES[name] = f"{SD}, {before} SELECT asset, date, {cols} FROM q"


_wide(
    "dsl_arith",
    {"a": "$high - $low", "b": "($high - $low) / $close", "c": "-2 * $turn + 1", "d": "Power($turn, 2)", "e": "Div($turn, Sub($turn, $turn))", "f": "Mul($turn, $adj_factor)"},
    {"a": "high - low", "b": "(high - low) / nullif(close, 0)", "c": "-2 * turn + 1", "d": "pow(turn, 2)", "e": "CAST(NULL AS DOUBLE)", "f": "turn * adj_factor"},
    6,
)
_wide(
    "dsl_compare_logic",
    {"a": "Gt($close, $open)", "b": "And(Gt($close, $open), Lt($turn, 0.05))", "c": "Or(Ge($close, $open), Eq($turn, 0))", "d": "Not($close > $open)", "e": "Ne($volume, $volume)", "f": "Greater($turn, 0.05)"},
    {"a": "(close > open)::DOUBLE", "b": "(close > open AND turn < 0.05)::DOUBLE", "c": "(close >= open OR turn = 0)::DOUBLE", "d": "(NOT close > open)::DOUBLE", "e": "(volume <> volume)::DOUBLE", "f": "(turn > 0.05)::DOUBLE"},
    1,
)
_wide("dsl_if", {"a": "If($close > $open, $high, $low)", "b": "If(Gt($turn, 0.05), 1, -1)"}, {"a": "CASE WHEN close > open THEN high ELSE low END", "b": "CASE WHEN turn > 0.05 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"}, 8)
_wide("dsl_unary", {"a": "Abs($close - $open)", "b": "Sign($close - $open)", "c": "Log($amount)", "d": "Log($turn - 10)"}, {"a": "abs(close - open)", "b": "sign(close - open)::DOUBLE", "c": "CASE WHEN amount > 0 THEN ln(amount) END", "d": "CAST(NULL AS DOUBLE)"}, 5)
_wide(
    "dsl_lenient_mode",
    {"a": "Mean($turn, 6)", "b": "Std($turn, 6)", "c": "Ref($turn, 2)", "d": "Delta($turn, 2)", "e": "Rank($close, 6)", "f": "$turn / ($turn - $turn)", "g": "Max($turn, 6)"},
    {
        "a": f"sum(coalesce(turn, 0)) OVER {_w(6)} / count(*) OVER {_w(6)}",
        "b": f"CASE WHEN count(turn) OVER {_w(6)} >= 2 THEN stddev_samp(turn) OVER {_w(6)} ELSE 0 END",
        "c": f"lag(turn, 2, 0.0::DOUBLE) OVER {_S}",
        "d": f"CASE WHEN row_number() OVER {_S} > 2 THEN turn - lag(turn, 2) OVER {_S} ELSE 0 END",
        "e": "CASE WHEN n > 0 THEN coalesce(len(list_filter(l, lambda e: e <= close)), 0) / n::DOUBLE END",
        "f": "CASE WHEN turn IS NOT NULL THEN 0 END",
        "g": f"CASE WHEN count(turn) OVER {_w(6)} >= 1 THEN max(turn) OVER {_w(6)} ELSE 0 END",
    },
    6,
    strict=False,
    before=f"q AS (SELECT *, list(close) FILTER (close IS NOT NULL) OVER {_w(6)} AS l, count(close) OVER {_w(6)} AS n FROM p)",
)
del QUERIES["dsl_lenient_mode"]


@query(ORACLES["dsl_lenient_mode"])
def dsl_lenient_mode(spark, d):
    """Partial windows and zeros for what is undefined, over bars that exist only."""
    exprs = {"a": "Mean($turn, 6)", "b": "Std($turn, 6)", "c": "Ref($turn, 2)", "d": "Delta($turn, 2)", "e": "Rank($close, 6)", "f": "$turn / ($turn - $turn)", "g": "Max($turn, 6)"}
    out = compile_factors(sbars(spark, d), exprs, Frame(strict=False), keep=["asset", "date"])
    return out.select("asset", "date", *[rnd(F.col(c) * _OFF, 6).alias(c) for c in exprs])


ORACLES["dsl_lenient_mode"] = ORACLES["dsl_lenient_mode"].replace(SD, f"WITH {SB}, p AS (SELECT * FROM sb)")

_ATOMS = ("ret_1d", "ret_5d", "vol_5d", "vol_ratio_5", "range_hl", "range_co", "close_ma5_dev", "turn_ma5", "corr_cv_5", "pos_20", "delta_turn_5", "sum_turn_5", "med_close_dev_20", "slope_turn_20")


def _dev(x: str, m: str, e: str = "1e-8") -> str:
    return f"({x} - {m}) / ({m} + {e})"


def _mean(x: str, n: int) -> str:
    return f"(CASE WHEN count(*) OVER {_w(n)} = {n} THEN sum(coalesce({x}, 0)) OVER {_w(n)} / {n} END)"


_ATOM_SQL = {
    "ret_1d": _dev("close", f"lag(close) OVER {_S}"),
    "ret_5d": _dev("close", f"lag(close, 5) OVER {_S}"),
    "vol_5d": _full(f"stddev_samp(r1) OVER {_w(5)}", 5, "r1"),
    "vol_ratio_5": f"(volume - {_mean('volume', 5)}) / ({_full(f'stddev_samp(volume) OVER {_w(5)}', 5, 'volume')} + 1e-8)",
    "range_hl": "(high - low) / (close + 1e-8)",
    "range_co": "(close - open) / (open + 1e-8)",
    "close_ma5_dev": _dev("close", _mean("close", 5)),
    "turn_ma5": _mean("turn", 5),
    "corr_cv_5": _full(f"covar_pop(close, volume) OVER {_w(5)} / nullif(stddev_pop(close) OVER {_w(5)} * stddev_pop(volume) OVER {_w(5)}, 0)", 5, "close"),
    "pos_20": f"(close - {_full(f'min(low) OVER {_w(20)}', 20, 'low')}) / ({_full(f'max(high) OVER {_w(20)}', 20, 'high')} - {_full(f'min(low) OVER {_w(20)}', 20, 'low')} + 1e-8)",
    "delta_turn_5": f"turn - lag(turn, 5) OVER {_S}",
    "sum_turn_5": f"CASE WHEN count(*) OVER {_w(5)} = 5 THEN sum(coalesce(turn, 0)) OVER {_w(5)} END",
    "med_close_dev_20": _dev("close", "(" + _full(f"quantile_cont(close, 0.5) OVER {_w(20)}", 20, "close") + ")"),
    "slope_turn_20": _full(f"regr_slope(turn, i) OVER {_w(20)}", 20, "turn"),
}


@query(f"""{SD}, q AS (SELECT *, row_number() OVER {_S} AS i, {_dev('close', f'lag(close) OVER {_S}')} AS r1 FROM p)
 SELECT asset, date, {', '.join(f'round({v}, 5) + 0.0 AS {k}' for k, v in _ATOM_SQL.items())} FROM q""")
def dsl_nested_atoms(spark, d):
    """Atoms with calls inside calls, compiled into one plan."""
    atoms = atomic_factors()
    out = compile_factors(sd(spark, d), {k: atoms[k] for k in _ATOMS}, keep=["asset", "date"])
    return out.select("asset", "date", *[rnd(c, 5).alias(c) for c in _ATOMS])


@query()
def dsl_all_atoms(spark, d):
    """All atoms, by mean and count: one plan, and one aggregate over it. Fields that bars of sales lack stand in for themselves:
    valuations and market values are made from prices and volumes."""
    bars = sd(spark, d).withColumns({
        "vwap": F.try_divide("amount", "volume"), "pe": F.col("close") / 50, "pb": 1 + F.col("turn") * 10, "ps": F.col("high") / F.col("low"),
        "circ_mv": F.col("close") * 1000 + F.col("volume"), "total_mv": F.col("close") * 2000 + F.col("volume"),
    })
    atoms = atomic_factors()
    out = compile_factors(bars, atoms, keep=["asset", "date"])
    each = out.agg(*[F.struct(F.lit(k).alias("atom"), F.count(k).alias("n"), rnd(F.avg(k), 6).alias("mean")).alias(k) for k in atoms])
    return each.select(F.explode(F.array(*atoms)).alias("a")).select("a.*")


@query(f"""WITH bb AS (SELECT p_brand AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_extendedprice) / nullif(sum(l_quantity), 0) AS close
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), {dense_sql('bb')}
 SELECT asset, date, round({_dev('close', f'lag(close) OVER {_S}')}, 6) + 0.0 AS ret FROM p""")
def brand_returns(spark, d):
    """A panel from a join: monthly price changes of brands. part is joined by Spark's choice of strategy."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    bars = rows.groupBy(F.col("p_brand").alias("asset"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date")).agg(F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("close"))
    out = compile_factors(densify(bars), {"ret": atomic_factors()["ret_1d"]}, keep=["asset", "date"])
    return out.select("asset", "date", rnd("ret").alias("ret"))


