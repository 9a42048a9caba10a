"""Reports as files that appear all at once or not at all: holdings as CSV, metrics and trades as JSON lines.

    spark.dataSource.register(ReportSink)
    df.write.format("report").option("kind", "csv").mode("overwrite").save("/shared/reports/run1")

Each task writes a file of its own into a hidden folder beside the others and tells the driver its name, rows and digest. Only
the commit, after all tasks, moves the files to their names and writes _manifest.json; an abort, or a job that never
ends, leaves nothing that a reader looks at. A task that is run again writes another file, and the one that is
committed counts.
"""

from __future__ import annotations

import csv
import datetime
import decimal
import hashlib
import io
import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "_manifest.json"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def plain(value: object) -> object:
    """A value as JSON has it: rows are objects, dates text, NaN and infinities null."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value.hex() if isinstance(value, (bytes, bytearray)) else value


@dataclass
class PartWritten(WriterCommitMessage):
    name: str
    rows: int
    sha256: str


class ReportWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        self.names, self.kind, self.path, self.overwrite = schema.fieldNames(), options.get("kind", "csv"), options["path"].rstrip("/"), overwrite
        if self.kind not in ("csv", "json"):
            raise ValueError(f"a report is csv or json, not {self.kind}")
        self.hidden = f"{self.path}/.report-{uuid.uuid4().hex}"

    def _line(self, row: Row) -> str:
        if self.kind == "json":
            return json.dumps({n: plain(v) for n, v in zip(self.names, row, strict=True)}, ensure_ascii=False) + "\n"
        out = io.StringIO()
        cells = [plain(v) for v in row]
        csv.writer(out, lineterminator="\n").writerow([json.dumps(c, ensure_ascii=False) if isinstance(c, (dict, list)) else c for c in cells])
        return out.getvalue()

    def write(self, iterator: Iterator[Row]) -> PartWritten:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, at = _filesystem(self.hidden)
        fs.create_dir(at, recursive=True)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.{self.kind}"
        digest, rows = hashlib.sha256(), 0
        with fs.open_output_stream(f"{at}/{name}") as out:
            head = io.StringIO()
            if self.kind == "csv":
                csv.writer(head, lineterminator="\n").writerow(self.names)
            lines = [head.getvalue()]
            for row in iterator:
                lines.append(self._line(row))
                rows += 1
                if len(lines) >= 1000:
                    block = "".join(lines).encode()
                    digest.update(block)
                    out.write(block)
                    lines = []
            block = "".join(lines).encode()
            digest.update(block)
            out.write(block)
        return PartWritten(name, rows, digest.hexdigest())

    def commit(self, messages: Sequence[WriterCommitMessage | None]) -> None:
        from pyarrow import fs as pafs

        fs, at = _filesystem(self.path)
        hidden = _filesystem(self.hidden)[1]
        fs.create_dir(at, recursive=True)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.is_file]
        parts = [m for m in messages if isinstance(m, PartWritten) and m.rows]
        if old and not self.overwrite:
            held = self._manifest(fs, at)
        else:
            held = []
        fresh = [{"name": f"{uuid.uuid4().hex[:8]}-{m.name}", "rows": m.rows, "sha256": m.sha256} for m in parts]
        for m, f in zip(parts, fresh, strict=True):
            fs.move(f"{hidden}/{m.name}", f"{at}/{f['name']}")
        with fs.open_output_stream(f"{hidden}-manifest") as out:
            out.write(json.dumps({"kind": self.kind, "columns": self.names, "files": held + fresh}, indent=1).encode())
        fs.move(f"{hidden}-manifest", f"{at}/{MANIFEST}")  # from here on readers see the new files
        if self.overwrite:
            for path in old:
                if not path.endswith(MANIFEST):
                    fs.delete_file(path)
        self._forget(fs, hidden)

    def _manifest(self, fs, at: str) -> list[dict]:
        try:
            with fs.open_input_stream(f"{at}/{MANIFEST}") as f:
                return json.loads(f.read())["files"]
        except FileNotFoundError:
            return []

    def abort(self, messages: Sequence[WriterCommitMessage | None]) -> None:
        fs, hidden = _filesystem(self.hidden)
        self._forget(fs, hidden)

    @staticmethod
    def _forget(fs, hidden: str) -> None:
        if fs.get_file_info(hidden).type.name == "Directory":
            fs.delete_dir(hidden)


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(schema, dict(self.options), overwrite)


def report_files(path: str) -> list[str]:
    """The files of a report that was committed whole, by its manifest; none without one."""
    fs, at = _filesystem(path.rstrip("/"))
    try:
        with fs.open_input_stream(f"{at}/{MANIFEST}") as f:
            return [f"{at}/{x['name']}" for x in json.loads(f.read())["files"]]
    except FileNotFoundError:
        return []


def write_report(df: DataFrame, path: str, kind: str = "csv", overwrite: bool = True) -> None:
    """df as a report under path, a folder that driver and executors share."""
    df.sparkSession.dataSource.register(ReportSink)
    df.write.format("report").option("kind", kind).mode("overwrite" if overwrite else "append").save(path)


def holdings_report(holdings: DataFrame, date: str = "date", asset: str = "asset", weight: str = "weight", files: int | None = None) -> DataFrame:
    """Holdings as they are exported: (date, asset, weight) of positive weights, in order of (date, asset) within files that are
    cut by ranges of dates (as many as `files`, else as Spark sees fit)."""
    rows = holdings.where(F.col(weight) > 0).select(date, asset, F.round(weight, 6).alias(weight))
    return (rows.repartitionByRange(files, date) if files else rows.repartitionByRange(date)).sortWithinPartitions(date, asset)


def metrics_json(metrics: DataFrame, key: str) -> DataFrame:
    """(key, metrics): all other columns as one JSON object; NaN and infinities as null, nulls kept."""
    others = [F.when(F.isnan(c) | (F.abs(F.col(c)) == F.lit(math.inf)), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in metrics.dtypes if c != key]
    return metrics.select(key, F.to_json(F.struct(*others), {"ignoreNullFields": "false"}).alias("metrics"))
