"""A stream over table APIs whose offsets are high-water marks: of each API, the last date that was read.

    table = VersionedTable(spark, path, ["api", "trade_date", "ts_code"], "trade_date")
    options = {"url": ..., "apis": "daily,adj_factor", "start": "2010-01-01"}
    load_stream(read_apis(spark, "api string, trade_date string, ...", options, table), table, "trade_date", checkpoint, every="1 hour")

A micro-batch holds the dates after the marks up to what the API says is its newest, `batch_days` of each API at most, so
that a long backlog is many batches. Spark keeps the marks in the checkpoint and asks for the same dates again after a
failure; the table takes rows and marks in one commit, so a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .http_api import RateLimiter, fetch, post, spans
from .versioned import VersionedTable


class ApiSpan(InputPartition):
    def __init__(self, api: str, start: date, end: date, calls: int):
        self.api, self.start, self.end, self.calls = api, start, end, calls


class ApiStreamReader(DataSourceStreamReader):
    """Options: url, apis (by comma), start (first date), calls_per_minute, tasks (that run at once), days (of a partition),
    batch_days (of a batch), marks (what the table holds by now, as JSON), cap (rows of an answer), token.

    Spark doesn't say from where it goes on when it asks for the latest offset, so a batch is bounded only where marks are
    given or a batch has been planned before.
    """

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, dict(options)
        self.apis = [a.strip() for a in self.options["apis"].split(",") if a.strip()]
        marks = self.options.get("marks")
        self.reached: dict[str, str] | None = None if marks is None else self.initialOffset() | {k: str(date.fromisoformat(v)) for k, v in json.loads(marks).items()}

    def initialOffset(self) -> dict:
        before = date.fromisoformat(self.options["start"]) - timedelta(days=1)
        return {api: before.isoformat() for api in self.apis}

    def newest(self, api: str) -> date:
        """The last date for which the API has rows, by its own word."""
        body = {"api_name": "newest_date", "token": self.options.get("token", ""), "params": {"api": api}}
        return date.fromisoformat(post(self.options["url"], body)["data"]["date"])

    def latestOffset(self) -> dict:
        out = {}
        for api in self.apis:
            newest = self.newest(api)
            if self.reached is not None:
                mark = date.fromisoformat(self.reached.get(api, self.initialOffset()[api]))
                newest = max(mark, min(mark + timedelta(days=int(self.options.get("batch_days", "3650"))), newest))
            out[api] = newest.isoformat()
        return out

    def partitions(self, start: dict, end: dict) -> list[ApiSpan]:
        self.reached = end
        out = []
        for api in self.apis:
            lo = date.fromisoformat(start.get(api, self.initialOffset()[api])) + timedelta(days=1)
            hi = date.fromisoformat(end.get(api, start.get(api, self.initialOffset()[api])))
            out += [ApiSpan(api, s.start, s.end, 1) for s in spans(lo, hi, int(self.options.get("days", "30")))]
        at_once = max(1, min(len(out), int(self.options.get("tasks", "8"))))
        for part in out:
            part.calls = max(1, int(self.options.get("calls_per_minute", "200")) // at_once)
        return out

    def commit(self, end: dict) -> None:
        self.reached = end

    def read(self, partition: ApiSpan) -> Iterator[tuple]:
        o, names = self.options, self.schema.fieldNames()
        limiter = RateLimiter(partition.calls)

        def call(start: date, end: date, offset: int = 0) -> list[tuple]:
            limiter.acquire()
            more = {"offset": offset} if offset else {}
            asked = ",".join(n for n in names if n != "api")
            data = post(o["url"], {"api_name": partition.api, "token": o.get("token", ""), "fields": asked, "params": {"start_date": f"{start:%Y%m%d}", "end_date": f"{end:%Y%m%d}"} | more})["data"]
            at = {f: i for i, f in enumerate(data["fields"])}
            return [tuple(partition.api if n == "api" else row[at[n]] if n in at else None for n in names) for row in data["items"]]

        yield from fetch(call, partition.start, partition.end, int(o.get("cap", "6000")))


class ApiStreamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "api_stream"

    def schema(self) -> str:
        raise ValueError("give the schema with .schema(...)")

    def streamReader(self, schema: StructType) -> ApiStreamReader:
        return ApiStreamReader(schema, self.options)


def read_apis(spark: SparkSession, schema: str, options: Mapping[str, str], table: VersionedTable) -> DataFrame:
    """The stream of what the APIs have beyond the table's marks."""
    spark.dataSource.register(ApiStreamSource)
    return spark.readStream.format("api_stream").schema(schema).options(**options).option("marks", json.dumps(marks_of(table))).load()


def load_stream(stream: DataFrame, table: VersionedTable, date_column: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Merges a stream of api, date_column, ... into a table by its key, and the last date of each API with it.

    Without `every` (a processing-time interval) it stops after the batch that it finds; see catch_up().
    """

    def merge_batch(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            last = rows.groupBy("api").agg(F.max(date_column).cast("string")).collect()  # a row for each API
            marks = {f"mark:{api}": day for api, day in last if day is not None}
            if marks:
                held = table.marks()
                marks = {k: max(v, held.get(k, v)) for k, v in marks.items()}
                table.upsert(rows, marks | {"batch": str(number)})
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def catch_up(spark: SparkSession, schema: str, options: Mapping[str, str], table: VersionedTable, date_column: str, checkpoint: str) -> int:
    """Runs batch after batch until the APIs have no more; returns the table's version."""
    while True:
        query = load_stream(read_apis(spark, schema, options, table), table, date_column, checkpoint)
        try:
            query.awaitTermination()
        finally:
            query.stop()
        if not any(p.numInputRows for p in query.recentProgress):
            return max(table.versions(), default=0)


def marks_of(table: VersionedTable) -> dict[str, str]:
    """The high-water mark of each API in a table that load_stream() fills."""
    return {k.removeprefix("mark:"): v for k, v in table.marks().items() if k.startswith("mark:")}
