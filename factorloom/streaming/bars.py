"""Ticks to bars as streams, and incremental loads."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factorloom.sources.upsert import keep_last, upsert

TICKS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_ticks(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """A stream of the parquet files that arrive in a folder; ts as a zoned timestamp, as watermarks need it."""
    rows = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_bars(ticks: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "2 days", asset: str = "user_id") -> DataFrame:
    """Bars of each asset by tumbling (or sliding) windows; batch and stream alike. Ticks later than the watermark are dropped."""
    rows = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.groupBy(span.alias("span"), F.col(asset).alias("asset")).agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
        F.count("value").alias("volume"),
        F.sum("value").alias("amount"),
    )
    return out.select("asset", F.col("span.start").alias("start"), F.col("span.end").alias("end"), "open", "high", "low", "close", "volume", "amount")


def sessions_of(ticks: DataFrame, gap: str = "6 hours", late: str = "2 days", asset: str = "user_id") -> DataFrame:
    """Runs of an asset's ticks with no pause of `gap`: start, end (the last tick and the gap), count, sum."""
    rows = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    out = rows.groupBy(F.session_window("ts", gap).alias("span"), F.col(asset).alias("asset")).agg(F.count("value").alias("n"), F.sum("value").alias("total"))
    return out.select("asset", F.col("span.start").alias("start"), F.col("span.end").alias("end"), "n", "total")


def running_ema(ticks: DataFrame, span: int, asset: str = "user_id") -> DataFrame:
    """The exponential mean of each asset's values up to each micro-batch: state is (mean, count) per asset."""
    alpha = 2.0 / (span + 1)

    def update(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, n = state.get if state.exists else (0.0, 0)
        for v in pd.concat(list(frames)).sort_values("ts")["value"].dropna():  # one key's ticks of one batch
            mean = float(v) if n == 0 else mean + alpha * (float(v) - mean)
            n += 1
        state.update((mean, n))
        yield pd.DataFrame({"asset": [key[0]], "ema": [mean], "n": [n]})

    grouped = ticks.select(F.col(asset).alias("asset"), "ts", "value").groupBy("asset")
    return grouped.applyInPandasWithState(update, "asset long, ema double, n long", "ema double, n long", "update", GroupStateTimeout.NoTimeout)


def upsert_stream(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Merges each micro-batch into a parquet table by key, the last row by `order` winning; a replayed batch changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        upsert(batch.sparkSession, path, keep_last(batch, key, [order]), key)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
