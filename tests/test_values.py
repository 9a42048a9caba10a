"""Values of the queries that have no SQL, against plain numpy."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.catalog import QUERIES
from factorloom.catalog.evaluation import factor_returns
from factorloom.catalog.portfolio import _ML, _dataset
from factorloom.plans.atoms import atomic_factors
from factorloom.plans.compiler import compile_factors

FIELDS = ("open", "high", "low", "close", "volume", "amount", "vwap", "turn", "pe", "pb", "ps", "circ_mv", "total_mv")


def rolled(x, n, f):
    """f of each full window without gaps, NaN elsewhere."""
    out = np.full(len(x), np.nan)
    for i in range(n - 1, len(x)):
        w = x[i - n + 1 : i + 1]
        if not np.isnan(w).any():
            out[i] = f(w)
    return out


def paired(x, y, n, f):
    out = np.full(len(x), np.nan)
    for i in range(n - 1, len(x)):
        out[i] = f(x[i - n + 1 : i + 1], y[i - n + 1 : i + 1])
    return out


def shift(x, n):
    return np.concatenate([np.full(n, np.nan), x[:-n]])


def line(w, i):
    t = np.arange(len(w), dtype=float)
    b, a = np.polyfit(t, w, 1)
    fit = a + b * t
    return b, 1 - ((w - fit) ** 2).sum() / ((w - w.mean()) ** 2).sum(), w[-1] - fit[-1]


def skew(w):
    n, d = len(w), w - w.mean()
    return np.sqrt(n * (n - 1)) / (n - 2) * (d**3).mean() / (d**2).mean() ** 1.5


def kurt(w):
    n, d = len(w), w - w.mean()
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ((d**4).mean() / (d**2).mean() ** 2 - 3) + 6)


def ema(x, n):
    out, a = np.array(x), 2 / (n + 1)
    for i in range(1, len(x)):
        out[i] = out[i - 1] * (1 - a) + x[i] * a
    return out


def wma(w):
    k = np.arange(1, len(w) + 1)
    return (w * k).sum() / k.sum()


CALLS = {
    "Add": lambda a, b: a + b, "Sub": lambda a, b: a - b, "Mul": lambda a, b: a * b, "Div": lambda a, b: a / b, "Log": np.log,
    "Ref": shift, "Delta": lambda x, n: x - shift(x, n), "EMA": ema, "WMA": lambda x, n: rolled(x, n, wma),
    "Corr": lambda x, y, n: paired(x, y, n, lambda a, b: np.corrcoef(a, b)[0, 1]), "Cov": lambda x, y, n: paired(x, y, n, lambda a, b: np.cov(a, b)[0, 1]),
} | {name: (lambda f: lambda x, n: rolled(x, n, f))(f) for name, f in {
    "Mean": np.mean, "Sum": np.sum, "Max": np.max, "Min": np.min, "Med": np.median, "Skew": skew, "Kurt": kurt,
    "Std": lambda w: w.std(ddof=1), "Mad": lambda w: np.abs(w - w.mean()).mean(), "Rank": lambda w: (w < w[-1]).sum() / (len(w) - 1),
    "IdxMax": np.argmax, "IdxMin": np.argmin, "Slope": lambda w: line(w, 0)[0], "Rsquare": lambda w: line(w, 0)[1], "Resi": lambda w: line(w, 0)[2],
}.items()}


def test_all_atoms_against_numpy(spark):
    rng = np.random.default_rng(3)
    n, assets = 60, (1, 2)
    data = {a: {f: rng.uniform(1, 20, n) for f in FIELDS} for a in assets}
    rows = [(a, i, *(float(data[a][f][i]) for f in FIELDS)) for a in assets for i in range(n)]
    panel = spark.createDataFrame(rows, "asset long, date int, " + ", ".join(f"{f} double" for f in FIELDS))
    atoms = atomic_factors()
    assert len(atoms) == 88
    got = {(r["asset"], r["date"]): r for r in compile_factors(panel, atoms, keep=["asset", "date"]).collect()}
    for name, text in atoms.items():
        for a in assets:
            want = eval(re.sub(r"\$(\w+)", r"p['\1']", text), CALLS | {"p": data[a]})
            have = np.array([np.nan if got[a, i][name] is None else got[a, i][name] for i in range(n)])
            assert np.allclose(have, want, rtol=1e-6, atol=1e-7, equal_nan=True), name


def test_all_atoms_summary(spark, sf):
    rows = QUERIES["dsl_all_atoms"](spark, sf).collect()
    assert {r["atom"] for r in rows} == set(atomic_factors()) and len(rows) == 88
    bars = QUERIES["bars_monthly"](spark, sf).count()
    for r in rows:
        assert 0 <= r["n"] and (r["mean"] is None) == (r["n"] == 0)
    assert next(r for r in rows if r["atom"] == "range_hl")["n"] <= bars


def rank(x):
    order = np.argsort(x, kind="stable")
    out = np.empty(len(x))
    out[order] = np.arange(1, len(x) + 1)
    for v in np.unique(x):
        out[x == v] = out[x == v].mean()
    return out


def test_gp_fitness_against_numpy(spark, sf):
    tiny = 1e-10
    div = lambda a, b: np.where(np.abs(b) > tiny, a / np.where(b == 0, 1, b), 0.0)
    programs = {"Sub($f, $turn)": lambda f, t: f - t, "Mul($f, $f)": lambda f, t: f * f, "Div($f, Add($turn, 0.01))": lambda f, t: div(f, t + 0.01), "Abs($turn)": lambda f, t: np.abs(t)}
    days = {}
    for r in factor_returns(spark, sf).select("date", "f", "turn", "ret").collect():
        days.setdefault(r["date"], []).append((r["f"], r["turn"], r["ret"]))
    got = {r["program"]: r["fitness"] for r in QUERIES["gp_fitness"](spark, sf).collect()}
    assert set(got) <= set(programs) and got
    for p, fitness in got.items():
        ics = []
        for rows in days.values():
            v = np.array([[np.nan if x is None else x for x in r] for r in rows])
            x = programs[p](v[:, 0], v[:, 1])
            fine = np.isfinite(x) & np.isfinite(v[:, 2])
            if fine.sum() >= 10:
                a, b = rank(x[fine]), rank(v[fine, 2])
                if a.std() and b.std():
                    ics.append(np.corrcoef(a, b)[0, 1])
        assert fitness == pytest.approx(np.mean(ics), abs=2e-6)


def test_ridge_scores_against_numpy(spark, sf):
    rows = _dataset(spark, sf).collect()
    x, y = np.array([[r[c] for c in _ML] for r in rows]), np.array([r["label"] for r in rows])
    fit = np.array([r["split"] == "train" for r in rows])
    mean, scale, y0, ys = x[fit].mean(0), x[fit].std(0, ddof=1), y[fit].mean(), y[fit].std(ddof=1)
    z = (x[fit] - mean) / scale  # the penalty is on standardised columns and labels
    w = np.linalg.solve(z.T @ z / len(z) + np.eye(len(_ML)), z.T @ ((y[fit] - y0) / ys) / len(z))
    guess = (x - mean) / scale @ w
    want = {}
    for day in {r["date"] for r in rows if r["split"] == "test"}:
        at = [i for i, r in enumerate(rows) if r["date"] == day]
        g = guess[at]
        s = g.std(ddof=1) if len(g) > 1 else 0.0
        want |= {(day, rows[i]["asset"]): (v - g.mean()) / s if s > 0 else 0.0 for i, v in zip(at, g)}
    got = {(r["date"], r["asset"]): r["score"] for r in QUERIES["ridge_scores"](spark, sf).collect()}
    assert set(got) == set(want) and got
    a, b = (np.array([d[k] for k in got]) for d in (got, want))
    assert np.corrcoef(a, b)[0, 1] > 0.999


def test_boosted_scores_are_z_scores_of_their_day(spark, sf):
    scores = QUERIES["gbt_scores"](spark, sf)
    assert scores.count() == _dataset(spark, sf).where("split = 'test'").count()
    for r in scores.groupBy("date").agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("s"), F.count("score").alias("n")).collect():
        assert abs(r["m"]) < 1e-6 and (r["n"] < 2 or r["s"] == pytest.approx(1, abs=1e-6) or r["s"] == pytest.approx(0, abs=1e-9))


def test_approximate_counts_are_near(spark, sf):
    from factorloom.sources.bars import table

    exact = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("n"))
    both = QUERIES["approx_distinct"](spark, sf).join(exact, "l_suppkey", "full").collect()
    assert both and all(abs(r["orders"] - r["n"]) <= max(2, 0.1 * r["n"]) for r in both)


def test_training_and_scoring_make_their_rows_once(spark):
    from factorloom.operators import ml

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    days = spark.range(40).selectExpr("date_add(DATE '2024-01-01', int(id)) AS date")
    panel = days.crossJoin(spark.range(12).withColumnRenamed("id", "asset")).select("date", "asset", (F.hash("date", "asset") % 97 / 7.0).alias("x"), (F.hash("asset", "date") % 89 + 200.0).alias("close"))
    factors = panel.select("date", "asset", "x").mapInArrow(counted, "date date, asset long, x double")
    data = ml.build_dataset(factors, panel.select("date", "asset", "close"), ["x"], horizon=1)
    for kind in ("ridge", "gbdt"):
        assert ml.predict(ml.train(data, ["x"], kind), data.where("split = 'test'")).count() == data.where("split = 'test'").count() > 0
    assert seen.value <= 2 * 480  # for the medians, and for the rows


def test_training_makes_lazy_rows_once(spark):
    from factorloom.operators import ml

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(600).selectExpr("date_add(DATE '2024-01-01', int(id div 12)) AS date", "id % 12 AS asset", "double(hash(id) % 97) AS x", "double(hash(id, 1) % 89) AS label", "'train' AS split")
    ml.train(rows.mapInArrow(counted, rows.schema), ["x"], "gbdt")
    assert seen.value == 600
