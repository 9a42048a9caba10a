"""Learning on factor panels: datasets, models of pyspark.ml, scores, sequences."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .boosting import PRESETS, BoostedModel, fit_boosted
from .calendar import forward_returns, sessions
from .cross import cs_zscore, median_impute


def chronological_split(panel: DataFrame, valid: float = 0.15, test: float = 0.15, date: str = "date") -> DataFrame:
    """panel with split train, valid or test by session: the last shares of the calendar are held out."""
    calendar = sessions(panel, date).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy()))  # panel is read once for both
    cut = F.when(F.col("ordinal") >= F.floor(F.col("__n") * (1 - test)), "test").when(F.col("ordinal") >= F.floor(F.col("__n") * (1 - test - valid)), "valid").otherwise("train")
    named = calendar.select(date, cut.alias("split"))
    return panel.join(F.broadcast(named), date)  # a row per session


def made_once(df: DataFrame) -> DataFrame:
    """df made now, by the executors, for what reads it more than once; Spark drops it when nothing refers to it any more."""
    return df.localCheckpoint()


def build_dataset(factors: DataFrame, prices: DataFrame, columns: Sequence[str], horizon: int = 5, valid: float = 0.15, test: float = 0.15, date: str = "date", asset: str = "asset") -> DataFrame:
    """(date, asset, columns, label, split): imputed features and forward returns; rows without a label go.

    Features of a session join the return that begins there on (asset, date); imputation is by session, so nothing of
    a later session enters. Rows are made once: their calendar, training and scoring all read them.
    """
    label = forward_returns(prices, (horizon,), asset, date).select(date, asset, F.col(f"ret_{horizon}").alias("label"))
    rows = median_impute(factors.select(date, asset, *columns), list(columns), date)
    return chronological_split(made_once(rows.join(label.where(F.col("label").isNotNull()), [date, asset])), valid, test, date)


def _model(kind: str, seed: int):
    to = {"featuresCol": "features", "labelCol": "label", "predictionCol": "prediction"}
    if kind in ("ridge", "lasso"):
        return LinearRegression(elasticNetParam=1.0 if kind == "lasso" else 0.0, regParam=0.001 if kind == "lasso" else 1.0, solver="auto", **to)
    if kind == "rf":
        return RandomForestRegressor(numTrees=50, maxDepth=6, seed=seed, **to)
    if kind == "gbdt":
        return GBTRegressor(maxIter=30, maxDepth=4, stepSize=0.1, seed=seed, validationIndicatorCol="__early", **to)
    raise ValueError(f"unknown model {kind}")


def train(dataset: DataFrame, columns: Sequence[str], kind: str = "ridge", seed: int = 7, date: str = "date", asset: str = "asset", **changes) -> PipelineModel | BoostedModel:
    """Fits on the training sessions; boosted trees stop early on the last 15 % of them. xgboost, lightgbm and histogram are
    second-order boosters of this library (see boosting.PRESETS; changes go to their Params), the others models of pyspark.ml.

    Fitting passes over its rows many times, so the training rows are made once and kept until it ends.
    """
    needed = [F.col(f"`{c}`") for c in dict.fromkeys([date, asset, *columns, "label"])]
    kept = dataset.where("split = 'train'").select(*needed).persist()
    try:
        last = chronological_split(kept, valid=0.0, test=0.15, date=date)
        rows = last.withColumn("__early", F.col("split") == "test")
        if kind in PRESETS:
            return fit_boosted(rows, columns, "label", [date, asset], replace(PRESETS[kind], seed=seed, **changes), valid=F.col("__early"))
        return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), _model(kind, seed)]).fit(rows)
    finally:
        kept.unpersist()


def predict(model: PipelineModel | BoostedModel, dataset: DataFrame, date: str = "date") -> DataFrame:
    """dataset with prediction and score, its z-score of the session (flat sessions give 0)."""
    if isinstance(model, BoostedModel):
        out = model.predict(dataset)
    else:
        out = model.transform(dataset.withColumn("__early", F.lit(False))).drop("features", "__early")
    return out.withColumn("score", cs_zscore(F.col("prediction"), date, flat_as_one=True, missing_as_zero=True))


def importances(model: PipelineModel | BoostedModel, columns: Sequence[str]) -> dict[str, float]:
    """Of each column: tree importance, or the absolute coefficient."""
    if isinstance(model, BoostedModel):
        return model.importances()
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return {c: abs(float(v)) for c, v in zip(columns, values.toArray(), strict=True)}


def save_model(model: PipelineModel | BoostedModel, path: str, meta: dict) -> None:
    """The model, and what it needs to be used again (columns, horizon, metrics) as JSON beside it."""
    spark = SparkSession.getActiveSession()
    boosted = isinstance(model, BoostedModel)
    if not boosted:
        model.write().overwrite().save(f"{path}/model")
    said = json.dumps({"meta": meta, "boosted": model.to_json() if boosted else None}, sort_keys=True)
    spark.createDataFrame([(said,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(path: str) -> tuple[PipelineModel | BoostedModel, dict]:
    said = json.loads(SparkSession.getActiveSession().read.text(f"{path}/meta").first()[0])
    return BoostedModel.from_json(said["boosted"]) if said["boosted"] else PipelineModel.load(f"{path}/model"), said["meta"]


def expanding_zscore(panel: DataFrame, columns: Sequence[str], lookback: int, date: str = "date", asset: str = "asset") -> DataFrame:
    """Each value against its asset's history so far (ddof 1, a deviation of 0 as 1); NULL before `lookback` values."""
    w = Window.partitionBy(asset).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)

    def z(c: str):
        s = F.coalesce(F.nullif(F.stddev_samp(c).over(w), F.lit(0.0)), F.lit(1.0))
        return F.when(F.count(c).over(w) >= lookback, (F.col(c) - F.avg(c).over(w)) / s)

    return panel.withColumns({c: z(c) for c in columns})


def sequences(panel: DataFrame, columns: Sequence[str], lookback: int, date: str = "date", asset: str = "asset") -> DataFrame:
    """(asset, date, sequence): the `lookback` rows before each, oldest first, each an array of the columns; NULL where
    there are fewer. Frames are of fixed length, so no asset's history is gathered."""
    w = Window.partitionBy(asset).orderBy(date).rowsBetween(-lookback, -1)
    rows = F.collect_list(F.struct(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))).over(w)
    return panel.select(asset, date, F.when(F.size(rows) == lookback, F.transform(rows, lambda e: e["x"])).alias("sequence"))


def feature_matrix(long: DataFrame, names: Sequence[str], date: str = "date", asset: str = "asset") -> DataFrame:
    """(date, asset, one column per name) from (date, asset, name, value): conditional aggregates, no distinct-value scan."""
    return long.groupBy(date, asset).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
