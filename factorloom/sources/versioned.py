"""Parquet tables in versions: readers see the newest whole one, and rows and marks change together."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .upsert import merge

_WHOLE = "__all__"


class VersionedTable:
    """A table under a folder: data/ holds parquet folders that are never written twice, versions/ one small JSON file for each
    version, which names the folder of every partition, and the marks.

    A version appears by one rename, so a reader sees the old one or the new one. An upsert writes only the
    partitions that it touches (all rows, where the table has no partition column), and leaves the old folders to readers
    that still use them until vacuum(). Versions have numbers; of two writers that make the same one, the second fails.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], partition: str | None = None):
        self.spark, self.path, self.key, self.partition = spark, path.rstrip("/"), list(key), partition
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/versions")
        names = [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int | None = None) -> dict:
        have = self.versions()
        if not have:
            return {"folders": {}, "marks": {}, "schema": None, "version": 0}
        stream = self._files.open(self._path(f"{self.path}/versions/{version or have[-1]:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def marks(self) -> dict[str, str]:
        """What was committed with the newest version: high-water marks, the last batch."""
        return self._manifest()["marks"]

    def _frame(self, manifest: dict, folders: Sequence[str]) -> DataFrame:
        from pyspark.sql import types as T

        schema = T.StructType.fromJson(manifest["schema"])
        reader = self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.path}/data/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of another that is still there."""
        manifest = self._manifest(version)
        if manifest["schema"] is None:
            raise ValueError(f"{self.path} has no version yet")
        return self._frame(manifest, sorted(set(manifest["folders"].values())))

    def upsert(self, new: DataFrame, marks: Mapping[str, str] | None = None) -> int:
        """Merges rows by key, of equal keys in new any one, and sets marks; returns the version that holds them.

        Where all given marks are what the table has already, nothing is done: a batch that is replayed after its commit.
        """
        manifest = self._manifest()
        marks = dict(marks or {})
        if marks and all(manifest["marks"].get(k) == v for k, v in marks.items()):
            return manifest["version"]
        new = new.dropDuplicates(self.key)
        value = F.coalesce(F.col(self.partition).cast("string"), F.lit("__null__")) if self.partition else F.lit(_WHOLE)
        folder = f"{manifest['version'] + 1:010d}-{uuid.uuid4().hex}"
        touched = [r[0] for r in new.select(value).distinct().collect()]  # names of partitions
        old = sorted({manifest["folders"][t] for t in touched if t in manifest["folders"]})
        rows = merge(self._frame(manifest, old).where(value.isin(touched)), new, self.key) if old else new
        rows.withColumn("__part", value).write.partitionBy("__part").parquet(f"{self.path}/data/{folder}")
        written = self._path(f"{self.path}/data/{folder}")
        names = [s.getPath().getName() for s in self._files.listStatus(written)]
        fresh = {_unescape(n.removeprefix("__part=")): f"{folder}/{n}" for n in names if n.startswith("__part=")}
        schema = json.loads(rows.schema.json()) if manifest["schema"] is None or old else manifest["schema"]
        return self._commit({"folders": manifest["folders"] | fresh, "marks": manifest["marks"] | marks, "schema": schema, "version": manifest["version"] + 1})

    def _commit(self, manifest: dict) -> int:
        name = f"{self.path}/versions/{manifest['version']:010d}.json"
        beside = self._path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = self._files.create(beside)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        if self._files.exists(self._path(name)) or not self._files.rename(beside, self._path(name)):
            self._files.delete(beside, False)
            raise RuntimeError(f"another writer has made version {manifest['version']}")
        return manifest["version"]

    def vacuum(self, keep: int = 2) -> int:
        """Removes all versions but the last `keep`, and the folders that none of those names; returns how many folders went.
        No writer may be at work."""
        have = self.versions()
        named = {f.split("/")[0] for v in have[-keep:] for f in self._manifest(v)["folders"].values()}
        for v in have[:-keep]:
            self._files.delete(self._path(f"{self.path}/versions/{v:010d}.json"), False)
        gone = 0
        at = self._path(f"{self.path}/data")
        for s in self._files.listStatus(at) if self._files.exists(at) else []:
            if s.getPath().getName() not in named:
                gone += bool(self._files.delete(s.getPath(), True))
        return gone


def _unescape(name: str) -> str:
    from urllib.parse import unquote

    return unquote(name)
