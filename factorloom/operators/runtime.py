"""Scores of single sessions from a saved model and the last few sessions, equal to those of a run over all history."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.plans.compiler import Frame, compile_factors, depth_of
from factorloom.plans.parser import nodes, parse
from factorloom.sources.partitions import partition_values

from .calendar import densify, instruments
from .cross import cs_zscore, top_n

Predictor = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class LinearModel:
    """A saved linear model: a weight for each named expression, and what it adds to all."""

    expressions: Mapping[str, str]
    weights: Mapping[str, float]
    intercept: float = 0.0
    meta: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if set(self.weights) != set(self.expressions):
            raise ValueError("each expression needs its weight")

    def prediction(self) -> Column:
        return reduce(lambda total, name: total + F.col(name) * float(self.weights[name]), self.weights, F.lit(float(self.intercept)))

    def predict(self, features: DataFrame) -> DataFrame:
        return features.withColumn("prediction", self.prediction())

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON line under path."""
        said = json.dumps(asdict(self), sort_keys=True)
        spark.createDataFrame([(said,)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearModel:
        return cls(**json.loads(spark.read.text(path).first()[0]))


class RuntimeScorer:
    """Scores sessions as they come in, from no more sessions than the expressions look back on.

    bars: a row per (asset, date) that traded; listed: (asset, first, last) of all instruments, kept beside the bars (see
    calendar.instruments and extend_instruments), as an asset's own first session decides which windows are full.
    Scores of a session are those that a run over all history gives its rows: features of the assets with a bar on the day,
    missing ones as 0, the model's prediction, and its z-score over the day (population deviation; a flat day gives 0).
    """

    def __init__(self, expressions: Mapping[str, str], predict: Predictor, frame: Frame = Frame(strict=False)):
        self.expressions, self.predict, self.frame = dict(expressions), predict, frame
        self.back = max(map(depth_of, self.expressions.values()), default=0)
        parts = {n for text in self.expressions.values() for n in nodes(parse(text))}
        self.fields = sorted({str(n.value) for n in parts if n.op == "field"})

    @classmethod
    def of(cls, model: LinearModel, frame: Frame = Frame(strict=False)) -> RuntimeScorer:
        return cls(model.expressions, model.predict, frame)

    def windows(self, calendar: Sequence[datetime.date], days: Sequence[datetime.date]) -> list[tuple[list[datetime.date], list[datetime.date]]]:
        """(sessions to read, days to score) of each run of days whose reads touch; calendar: the sessions, a list of at most
        some ten thousand days."""
        order = sorted(set(calendar))
        place = {d: i for i, d in enumerate(order)}
        unknown = [d for d in days if d not in place]
        if unknown:
            raise ValueError(f"no session on {unknown[0]}")
        out: list[tuple[int, int, list[datetime.date]]] = []
        for i in sorted({place[d] for d in days}):
            lo = max(0, i - self.back)
            if out and lo <= out[-1][1] + 1:
                out[-1] = (out[-1][0], i, [*out[-1][2], order[i]])
            else:
                out.append((lo, i, [order[i]]))
        return [(order[lo : hi + 1], scored) for lo, hi, scored in out]

    def features(self, bars: DataFrame, listed: DataFrame, sessions: Sequence[datetime.date], days: Sequence[datetime.date]) -> DataFrame:
        """(asset, date, the expressions) of the days, from the bars of the sessions alone: the filter on dates prunes partitions."""
        asset, date = self.frame.asset, self.frame.date
        columns = [c for c in dict.fromkeys([asset, date, *self.fields, *([self.frame.industry] if self.frame.industry else [])])]
        lo, hi = F.lit(sessions[0]), F.lit(sessions[-1])
        part = bars.where(F.col(date).between(lo, hi)).select(*columns, F.lit(True).alias("__traded"))
        # Who was listed before has a row, if an empty one, from the first session on.
        older = listed.where(F.col("first") < lo).select(F.col(asset))
        begun = part.groupBy(asset).agg(F.min(date).alias("__lo")).where(F.col("__lo") > lo)
        anchors = begun.join(older, asset, "left_semi").select(asset, lo.cast(part.schema[date].dataType).alias(date))
        panel = densify(part.unionByName(anchors, allowMissingColumns=True), asset, date)
        got = compile_factors(panel, self.expressions, self.frame, keep=[asset, date, "__traded"])
        got = got.where(F.col(date).isin(list(days)) & F.col("__traded"))
        return got.select(asset, date, *[F.coalesce(name, F.lit(0.0)).alias(name) for name in self.expressions])

    def scores(self, bars: DataFrame, listed: DataFrame, calendar: Sequence[datetime.date], days: Sequence[datetime.date]) -> DataFrame:
        """(asset, date, prediction, score) of the days."""
        asset, date = self.frame.asset, self.frame.date
        parts = [self.features(bars, listed, s, d) for s, d in self.windows(calendar, days)]
        said = self.predict(reduce(DataFrame.unionByName, parts))
        z = cs_zscore(F.col("prediction"), date, flat_as_one=True, missing_as_zero=True, ddof=0)
        return said.select(asset, date, "prediction", z.alias("score"))

    def picks(self, scores: DataFrame, n: int) -> DataFrame:
        """(asset, date, weight): the n best of each day in equal parts, ties to the smaller asset."""
        asset, date = self.frame.asset, self.frame.date
        best = top_n(scores, "score", n, date, asset)
        held = best.groupBy(date).agg(F.count(F.lit(1)).alias("__n"))
        return best.join(held, date).select(asset, date, (F.lit(1.0) / F.col("__n")).alias("weight"))


class BarStore:
    """Bars in a folder of one partition a session, with the instruments' ranges beside them."""

    def __init__(self, spark: SparkSession, path: str, asset: str = "asset", date: str = "date"):
        self.spark, self.path, self.asset, self.date = spark, path.rstrip("/"), asset, date

    def append(self, bars: DataFrame) -> None:
        """Writes sessions; one that is there already is replaced. Instruments then know the new rows."""
        bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.date).parquet(f"{self.path}/bars")
        ranges = instruments(bars, self.asset, self.date)
        versions = partition_values(self.spark, f"{self.path}/instruments", "version")
        if versions:
            ranges = extend_instruments(self.instruments(), ranges, self.asset)
        ranges.write.parquet(f"{self.path}/instruments/version={max(map(int, versions), default=0) + 1:08d}")

    def bars(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/bars")

    def instruments(self) -> DataFrame:
        """The newest version that was written whole."""
        for v in sorted(partition_values(self.spark, f"{self.path}/instruments", "version", whole=True), reverse=True):
            return self.spark.read.parquet(f"{self.path}/instruments/version={v}")
        raise ValueError(f"{self.path} holds no bars")

    def calendar(self) -> list[datetime.date]:
        """The sessions, from the names of partitions: no file is read."""
        return sorted(map(datetime.date.fromisoformat, partition_values(self.spark, f"{self.path}/bars", self.date)))


def extend_instruments(old: DataFrame, new: DataFrame, asset: str = "asset") -> DataFrame:
    """Ranges of instruments after new bars."""
    return old.unionByName(new).groupBy(asset).agg(F.min("first").alias("first"), F.max("last").alias("last"))
