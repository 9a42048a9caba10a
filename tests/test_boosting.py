"""Boosted trees equal plain numpy ones, tree by tree."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import boosting as bo
from factorloom.operators import ml


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        a, b, c = rng.uniform(-1, 1), rng.choice([0.0, 1.0, 2.0, None]), rng.gauss(0, 1)
        y = 2 * (a > 0.2) * (1 if b is None else b) + 0.3 * c + rng.gauss(0, 0.05)
        rows.append((i, float("nan") if i % 37 == 0 else a, b, c, y if i % 53 else None))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(3)
    return df, rows


def plain_fit(x, y, edges, p, rounds, sample=None):
    """The same trees over arrays; bins by counting edges below."""
    bins = np.zeros(x.shape, dtype=int)
    for j, e in enumerate(edges):
        ok = ~np.isnan(x[:, j])
        bins[ok, j] = 1 + np.searchsorted(e, x[ok, j], side="left")
    f, out = np.full(len(y), y.mean()), []
    score = lambda g, h: max(abs(g) - p.l1, 0) ** 2 / (h + p.l2) if h + p.l2 > 0 else 0.0
    for k in range(rounds):
        g = f - y
        use = np.ones(len(y), bool) if sample is None else sample(k)
        node, splits = np.ones(len(y), int), {}

        def find(n):
            rows, best = (node == n) & use, None
            for j in range(x.shape[1]):
                G, H = g[rows].sum(), rows.sum()
                there = sorted(set(bins[rows, j]) - {0})
                lost = rows & (bins[:, j] == 0)
                for b in there if lost.any() else there[:-1]:
                    for ml in (True, False) if lost.any() else (True,):
                        go = rows & np.where(bins[:, j] == 0, ml, bins[:, j] <= b)
                        lg, lh = g[go].sum(), go.sum()
                        if min(lh, H - lh) < p.min_hessian or not lh or lh == H:
                            continue
                        gain = 0.5 * (score(lg, lh) + score(G - lg, H - lh) - score(G, H))
                        if gain > p.min_gain + 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                            best = (gain, j, b, ml)
            return best

        leaves = {1: find(1)}
        while True:
            ready = {n: s for n, s in leaves.items() if s and n.bit_length() - 1 < p.depth}
            if p.growth == "leaf":
                ready = dict(sorted(ready.items(), key=lambda z: (-z[1][0], z[0]))[: min(1, p.leaves - 1 - len(splits))])
            if not ready:
                break
            for n, (_, j, b, ml) in ready.items():
                go = np.where(bins[:, j] == 0, ml, bins[:, j] <= b)
                node = np.where(node == n, np.where(go, 2 * n, 2 * n + 1), node)
                splits[n] = ready[n]
                del leaves[n]
            leaves |= {c: find(c) for n in ready for c in (2 * n, 2 * n + 1)}
        values = {n: -p.rate * math.copysign(max(abs(t := g[(node == n) & use].sum()) - p.l1, 0), t) / (((node == n) & use).sum() + p.l2) for n in leaves}
        f = f + np.array([values[n] for n in node])
        out.append((splits, values))
    return out, f


@pytest.mark.parametrize("p", [bo.Params(rounds=3, depth=3, bins=8), bo.Params(rounds=2, growth="leaf", leaves=5, depth=6, bins=8, l1=2.0, l2=0.5, min_hessian=15), bo.Params(rounds=2, depth=2, bins=4, min_gain=3.0)])
def test_equal_to_numpy(data, p):
    df, rows = data
    model = bo.fit_boosted(df, ["a", "b", "c"], "y", ["id"], p)
    good = [r for r in rows if r[4] is not None]
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in good])
    y = np.array([r[4] for r in good])
    trees, f = plain_fit(x, y, model.edges, p, len(model.trees))
    assert model.base == pytest.approx(y.mean()) and len(model.trees) >= 1
    for tree, (splits, values) in zip(model.trees, trees, strict=True):
        assert {n: (s.feature, s.bin, s.missing_left) for n, s in tree.splits.items()} == {n: s[1:] for n, s in splits.items()}
        assert tree.values == {n: pytest.approx(v) for n, v in values.items()}
        if p.growth == "leaf":
            assert len(tree.values) <= p.leaves
    got = {r["id"]: r["prediction"] for r in model.predict(df).collect()}
    assert [got[r[0]] for r in good] == pytest.approx(f.tolist())


def test_presets_learn_and_are_kept(data):
    df, rows = data
    held = F.col("id") % 4 == 0
    var = np.var([r[4] for r in rows if r[4] is not None])
    for name in bo.PRESETS:
        p = bo.preset(name, rounds=4, rate=0.6, patience=3, min_hessian=5.0, depth=3)
        model = bo.fit_boosted(df, ["a", "b", "c"], "y", ["id"], p, valid=held)
        mse = model.predict(df.where(held & F.col("y").isNotNull())).agg(F.avg(F.pow(F.col("prediction") - F.col("y"), 2))).first()[0]
        assert mse < 0.35 * var, name
        imp = model.importances()
        assert sum(imp.values()) == pytest.approx(1) and imp["a"] > imp["c"]
    again = bo.BoostedModel.from_json(model.to_json())
    assert again == model
    assert bo.fit_boosted(df, ["a", "b", "c"], "y", ["id"], p, valid=held) == model  # reruns agree


def test_trained_by_name(spark, data, tmp_path):
    days = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 10).cast("int"))
    panel = data[0].where("y IS NOT NULL").select(days.alias("date"), F.col("id").alias("asset"), "a", "b", "c", F.col("y").alias("label"))
    split = ml.chronological_split(panel)
    model = ml.train(split, ["a", "b", "c"], "histogram", rounds=6, rate=0.5)
    ml.save_model(model, str(tmp_path / "m"), {"horizon": 1})
    again, meta = ml.load_model(str(tmp_path / "m"))
    assert again == model and meta == {"horizon": 1} and ml.importances(again, ["a", "b", "c"])["a"] > 0.3
    test = ml.predict(again, split.where("split = 'test'"))
    assert test.select(F.corr("prediction", "label")).first()[0] > 0.8
    with pytest.raises(ValueError):
        ml.train(split, ["a"], "no such model")


def test_early_stopping_keeps_the_best(data):
    df, _ = data
    noise = df.select("id", "a", "b", "c", F.when(F.col("y").isNotNull(), (F.hash("id") % 1000) / 1000.0).alias("y"))
    model = bo.fit_boosted(noise, ["a", "b", "c"], "y", ["id"], bo.Params(rounds=12, depth=4, bins=16, rate=0.5, l2=0.0, patience=2), valid=F.col("id") % 3 == 0)
    assert 1 <= len(model.trees) < 12


def test_nothing_to_learn(spark, data):
    df, _ = data
    flat = bo.fit_boosted(df.withColumn("y", F.lit(2.0)), ["a"], "y", ["id"], bo.Params(rounds=3))
    assert flat.trees == [] and flat.predict(df).agg(F.min("prediction"), F.max("prediction")).first() == (2.0, 2.0)
    none = bo.fit_boosted(df.limit(0), ["a", "b"], "y", ["id"], bo.Params(rounds=2))
    assert none.trees == [] and none.base == 0.0
