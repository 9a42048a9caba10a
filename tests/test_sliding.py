"""Rolling calls as one pass over batches."""

import random

import pytest

from factorloom.plans.compiler import Frame, compile_factors

CALLS = {
    "mean": "Mean($x, 4)", "sum": "Sum($x, 4)", "std": "Std($x, 4)", "var": "Var($x, 5)", "max": "Max($x, 4)", "min": "Min($x, 4)", "skew": "Skew($x, 5)", "kurt": "Kurt($x, 6)",
    "med": "Med($x, 4)", "quantile": "Quantile($x, 4, 0.3)", "mad": "Mad($x, 4)", "rank": "Rank($x, 4)", "idxmax": "IdxMax($x, 4)", "idxmin": "IdxMin($x, 4)", "count": "Count(Gt($x, 2), 4)",
    "ema": "EMA($x, 3)", "wma": "WMA($x, 3)", "delta": "Delta($x, 2)", "slope": "Slope($x, 4)", "rsquare": "Rsquare($x, 4)", "resi": "Resi($x, 4)", "corr": "Corr($x, $y, 4)", "cov": "Cov($x, $y, 4)",
    "nested": "Std(Ref(Mean($x, 2), 3), 3)", "ranked": "Mean(CSRank($x), 3)",
}


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(5)
    rows = [(a, i, None if rng.random() < 0.1 else float(rng.randrange(6)), rng.random()) for a in range(7) for i in range(23)]
    return spark.createDataFrame(rows, "asset long, date int, x double, y double").repartition(3)


def test_no_aggregate_slides_over_frames(panel):
    plan = compile_factors(panel, {k: v for k, v in CALLS.items() if k != "ranked"})._jdf.queryExecution().toString()
    assert "RowFrame, -3" not in plan and "RowFrame, -4" not in plan
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("strict", [True, False])
def test_frames_reach_over_batches(spark, panel, strict):
    def rows():
        return {(r["asset"], r["date"]): r for r in compile_factors(panel, CALLS, Frame(strict=strict), keep=["asset", "date"]).collect()}

    whole, key = rows(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        assert rows() == whole and len(whole) == 7 * 23
    finally:
        spark.conf.set(key, before)
    assert all(any(r[c] not in (None, 0.0) for r in whole.values()) for c in CALLS)


def test_infinite_values_are_forgotten(spark):
    rows = [(1, i, float("inf") if i == 3 else float(i % 5)) for i in range(160)]
    panel = spark.createDataFrame(rows, "asset long, date int, x double")
    got = {r["date"]: r for r in compile_factors(panel, {"one": "EMA($x, 1)", "five": "EMA($x, 5)", "r2": "Rsquare($x, 4)"}).collect()}
    assert got[3]["one"] is None and got[4]["one"] == 4.0
    assert got[2]["five"] is not None and got[50]["five"] is None and got[159]["five"] is not None
    assert got[5]["r2"] is None and got[7]["r2"] is not None
