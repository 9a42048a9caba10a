"""Performance: equity, drawdown, three summaries, relative measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Sessions and rate of the conventions below.
RISK_FREE = 0.04


def _so_far() -> WindowSpec:
    """Rows up to this one. A daily series has thousands of rows whatever the panel's size, so its windows may be global."""
    return Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def equity_curve(returns: DataFrame) -> DataFrame:
    """(date, ret, equity): product of 1 + ret up to each date; ret must be above -1."""
    return returns.select("date", "ret", F.exp(F.sum(F.log1p("ret")).over(_so_far())).alias("equity"))


def drawdown(curve: DataFrame) -> DataFrame:
    """curve with peak, drawdown (0 or negative fraction)."""
    return curve.withColumn("peak", F.max("equity").over(_so_far())).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def drawdown_duration(curve: DataFrame) -> DataFrame:
    """One row: days, the longest run of sessions below a peak."""
    dd = drawdown(curve).withColumn("under", F.col("drawdown") < -1e-12)
    island = dd.withColumn("island", F.sum(F.when(~F.col("under"), 1).otherwise(0)).over(_so_far()))
    runs = island.where("under").groupBy("island").agg(F.count(F.lit(1)).alias("n"))
    return runs.agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("days"))


def drawdown_span(curve: DataFrame) -> DataFrame:
    """One row: depth, trough (first date of the deepest drawdown) and the date of the peak before it."""
    dd = drawdown(curve).withColumn("peak_date", F.max(F.when(F.col("equity") == F.col("peak"), F.col("date"))).over(_so_far()))
    worst = F.min_by(F.struct("drawdown", "date", "peak_date"), F.struct("drawdown", "date"))
    return dd.agg(worst.alias("w")).select(F.col("w.drawdown").alias("depth"), F.col("w.date").alias("trough"), F.col("w.peak_date").alias("peak_date"))


def summary_252(returns: DataFrame) -> DataFrame:
    """252-day convention: total, annual (by sessions), volatility (ddof 1), Sharpe without a rate, worst drawdown, win rate."""
    dd = drawdown(equity_curve(returns))
    n, total = F.count("ret"), F.exp(F.sum(F.log1p("ret"))) - 1
    annual = F.pow(1 + total, F.lit(252.0) / n) - 1
    vol = F.stddev_samp("ret") * F.sqrt(F.lit(252.0))
    return dd.agg(n.alias("n"), total.alias("total"), annual.alias("annual"), vol.alias("volatility"), (annual / F.nullif(vol, F.lit(0.0))).alias("sharpe"), F.min("drawdown").alias("max_drawdown"), (F.count_if(F.col("ret") > 0) / n).alias("win_rate"))


def summary_365(returns: DataFrame, rate: float = RISK_FREE) -> DataFrame:
    """Calendar-day convention, in percent but for Sharpe: annual by days between first and last date, volatility by 250
    sessions (ddof 1), win rate over sessions that moved."""
    dd = drawdown(equity_curve(returns))
    n, end = F.count("ret"), F.exp(F.sum(F.log1p("ret")))
    days = F.datediff(F.max("date"), F.min("date"))
    days = F.when(days > 0, days.cast("double")).otherwise(n * 365.0 / 250.0)
    annual = F.pow(end, 365.0 / days) - 1
    vol = F.stddev_samp("ret") * F.sqrt(F.lit(250.0))
    moved = F.greatest(F.count_if(F.col("ret") != 0), F.lit(1))
    return dd.agg(((end - 1) * 100).alias("total"), (annual * 100).alias("annual"), (vol * 100).alias("volatility"), ((annual - rate) / F.nullif(vol, F.lit(0.0))).alias("sharpe"), (F.min("drawdown") * 100).alias("max_drawdown"), (F.count_if(F.col("ret") > 0) / moved * 100).alias("win_rate"))


def summary_engine(equity: DataFrame, initial_cash: float, rate: float = RISK_FREE) -> DataFrame:
    """The replay's convention over (date, value): returns by difference, volatility with ddof 0, drawdown as a positive percent.

    Fewer than two sessions give zeros.
    """
    rows = equity.select("date", "value", F.col("value").alias("equity"), (F.col("value") / F.lag("value").over(Window.orderBy("date")) - 1).alias("ret"))
    dd = drawdown(rows)
    days = F.datediff(F.max("date"), F.min("date"))
    end = F.max_by("value", "date")
    annual = F.when((days > 0) & (end > 0), F.pow(end / initial_cash, 365.0 / days) - 1).otherwise(F.lit(0.0))
    vol = F.stddev_pop("ret") * F.sqrt(F.lit(250.0))
    worst = -F.min("drawdown") * 100
    out = dd.agg(F.count(F.lit(1)).alias("n"), ((end / initial_cash - 1) * 100).alias("total"), (annual * 100).alias("annual"), (vol * 100).alias("volatility"), F.when(vol > 0, (annual - rate) / vol).otherwise(0.0).alias("sharpe"), worst.alias("max_drawdown"), F.when(worst > 0, annual * 100 / worst).otherwise(0.0).alias("calmar"))
    return out.select("n", *[F.when(F.col("n") < 2, 0.0).otherwise(F.col(c)).alias(c) for c in out.columns if c != "n"])


def sortino(returns: DataFrame, rate: float = RISK_FREE) -> DataFrame:
    """One row: annual return above the rate over downside deviation, shortfalls averaged over all sessions."""
    n = F.count("ret")
    annual = F.pow(F.exp(F.sum(F.log1p("ret"))), 250.0 / n) - 1
    down = F.sqrt(F.avg(F.pow(F.least(F.col("ret") - rate / 250.0, F.lit(0.0)), 2.0))) * F.sqrt(F.lit(250.0))
    return returns.agg(((annual - rate) / F.nullif(down, F.lit(0.0))).alias("sortino"))


def alpha_beta(returns: DataFrame, benchmark: DataFrame, rate: float = RISK_FREE, sessions: float = 250.0) -> DataFrame:
    """One row: beta, alpha, and the information ratio of returns (date, ret) against benchmark (date, ret); sessions: of a year."""
    both = returns.select("date", "ret").join(benchmark.select("date", F.col("ret").alias("bench")), "date")
    n = F.count("ret")
    year = lambda c: F.pow(F.exp(F.sum(F.log1p(c))), sessions / n) - 1
    beta = F.covar_samp("ret", "bench") / F.nullif(F.var_samp("bench"), F.lit(0.0))
    active = F.stddev_samp(F.col("ret") - F.col("bench")) * F.sqrt(F.lit(float(sessions)))
    return both.agg(beta.alias("beta"), (year("ret") - rate - beta * (year("bench") - rate)).alias("alpha"), ((year("ret") - year("bench")) / F.nullif(active, F.lit(0.0))).alias("information_ratio"))


def benchmark_curve(dates: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(date, bench): the benchmark's last value up to each date over its base, less 1. benchmark: date, value, base."""
    both = dates.select("date").join(benchmark, "date", "full_outer")
    value = F.last("value", ignorenulls=True).over(_so_far())
    base = F.max("base").over(Window.partitionBy())
    filled = both.select("date", (F.coalesce(value, base) / base - 1).alias("bench"))
    return filled.join(dates.select("date"), "date", "left_semi")


def excess_curve(curve: DataFrame, bench: DataFrame) -> DataFrame:
    """(date, equity, bench, excess): equity over 1 + bench."""
    return curve.join(bench, "date").select("date", "equity", "bench", (F.col("equity") / (1 + F.col("bench"))).alias("excess"))


#: Returns that differ by no more than this are ties: sums of doubles in another order.
TIE = 1e-12


def win_rate(returns: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """One row: share of sessions above the benchmark (by more than TIE), or above 0 without one."""
    if benchmark is None:
        return returns.agg((F.count_if(F.col("ret") > 0) / F.count(F.lit(1))).alias("win_rate"))
    both = returns.select("date", "ret").join(benchmark.select("date", F.col("ret").alias("bench")), "date")
    return both.agg((F.count_if(F.col("ret") > F.col("bench") + TIE) / F.count(F.lit(1))).alias("win_rate"))


def report(**parts: Column) -> Column:
    """The parts as one JSON text."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]))
