"""Token ids in seekable files: independent zstandard frames with a trailing seek table.

A shard is one file:
* frames, each of whole documents up to `frame_ids` ids (a longer document has frames of its own), as little-endian
  unsigned 32-bit ids, with zstandard's own checksum;
* a skippable frame with the index of documents: doc_ids, null marks and token counts;
* a skippable frame with the seek table of the public seekable format: for each frame its compressed and decompressed
  bytes and the low 32 bits of the XXH64 of its content.

Any zstandard reader decompresses a shard to all its ids; read_shard() decompresses only the frames it needs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage
from .tokens import encoder, slices

# Fixed values of the zstandard seekable format.
INDEX_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_frames long"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; documents come in ascending order."""

    def __init__(self, out, frame_ids: int, level: int):
        import zstandard

        self.out, self.frame_bytes = out, 4 * frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.buffer: list[bytes] = []
        self.size = 0
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def _flush(self) -> None:
        import xxhash

        if self.size:
            raw = b"".join(self.buffer)
            done = self.zstd.compress(raw)
            self.out.write(done)
            self.table.append((len(done), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.buffer, self.size = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        if self.size + len(ids) > self.frame_bytes:
            self._flush()
        for i in range(0, len(ids), self.frame_bytes):
            self.buffer.append(ids[i : i + self.frame_bytes])
            self.size += len(self.buffer[-1])
            if self.size == self.frame_bytes:
                self._flush()

    def close(self) -> None:
        self._flush()
        known = np.array([x is not None for x in self.ids], dtype="u1")
        doc_ids = np.array([x or 0 for x in self.ids], dtype="<i8")
        index = self.zstd.compress(doc_ids.tobytes() + known.tobytes() + np.array(self.counts, dtype="<u4").tobytes())
        index += struct.pack("<QQ", len(self.ids), len(index))
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)


class ShardReader:
    """Finds documents in a shard by its index; `frames_read` counts the frames decompressed."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd, self.frames_read = source, zstandard.ZstdDecompressor(), 0
        end = source.size()
        n, flag, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != FOOTER_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("not a shard of this format")
        at = end - 9 - 12 * n
        table = np.frombuffer(self._at(at, 12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        n_docs, size = struct.unpack("<QQ", self._at(at - 8 - 16, 16))
        index = self.zstd.decompress(self._at(at - 8 - 16 - size, size), max_output_size=13 * n_docs + 1)
        self.doc_ids = np.frombuffer(index, dtype="<i8", count=n_docs)
        self.known = np.frombuffer(index, dtype="u1", count=n_docs, offset=8 * n_docs).astype(bool)
        self.counts = np.frombuffer(index, dtype="<u4", count=n_docs, offset=9 * n_docs).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        self.sums = table[:, 2]
        self.file_at = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.byte_at = np.concatenate(([0], np.cumsum(table[:, 1])))
        self._held: tuple[int, bytes] = (-1, b"")

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        import xxhash

        if self._held[0] != k:
            size = int(self.byte_at[k + 1] - self.byte_at[k])
            raw = self.zstd.decompress(self._at(int(self.file_at[k]), int(self.file_at[k + 1] - self.file_at[k])), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self._held = (k, raw)
            self.frames_read += 1
        return self._held[1]

    def document(self, i: int) -> bytes:
        """The ids of the i-th document of the shard."""
        lo, hi = 4 * int(self.starts[i]), 4 * int(self.starts[i + 1])
        parts = []
        k = int(np.searchsorted(self.byte_at, lo, side="right")) - 1
        while lo < hi:
            start, stop = int(self.byte_at[k]), int(self.byte_at[k + 1])
            parts.append(self.frame(k)[lo - start : min(hi, stop) - start])
            lo, k = stop, k + 1
        return b"".join(parts)

    def find(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, bytes]]:
        """The documents of some doc_ids; only their frames are read."""
        wanted = np.isin(self.doc_ids, np.array(list(doc_ids), dtype=np.int64)) & self.known
        for i in np.flatnonzero(wanted):
            yield int(self.doc_ids[i]), self.document(int(i))


def write_tokens(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 2, frame_ids: int = 1 << 16, level: int = 3) -> DataFrame:
    """Encodes documents and writes them in ascending doc_id order as shards under out_dir; returns the manifest.

    docs: doc_id, text (more columns are ignored). Null texts count as empty: their only id is end_id. Null doc_ids come
    first; repeated doc_ids stand together, each with its ids. The order is cut by ranges of (doc_id, hash of the text),
    one shard for each; an empty table has no shards. A shard appears under its name only when whole, so a task that is
    run again leaves one copy.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        fs, base = filesystem(out_dir)
        path, tmp = f"{base}/shard-{shard:06d}.zst", f"{base}/.shard-{shard:06d}-{TaskContext.get().taskAttemptId()}"
        code = encoder(tokenizer)
        end = struct.pack("<I", end_id)
        out = writer = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(tmp)
                    writer = ShardWriter(out, frame_ids, level)
                for doc_id, raw in zip(ids[a:b], code.encode([t or "" for t in texts[a:b]]), strict=True):
                    writer.add(doc_id, raw + end)
        if writer is not None:
            writer.close()
            out.close()
            if fs.get_file_info(path).type.name != "NotFound":
                fs.delete_file(path)
            fs.move(tmp, path)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{out_dir}/shard-{shard:06d}.zst"], "n_docs": [len(writer.ids)], "n_tokens": [sum(writer.counts)], "n_frames": [len(writer.table)]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return stage(rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(write, MANIFEST), "token-manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Reads the shards of a manifest: doc_id, start (ids of all documents before it), n_tokens, ids, one task for each shard."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("path", before.alias("before"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as source:
                    shard = ShardReader(source)
                    n = len(shard.counts)
                    for lo in range(0, n, 512):
                        hi = min(n, lo + 512)
                        doc_ids = pa.array(shard.doc_ids[lo:hi], mask=~shard.known[lo:hi])
                        ids = [shard.document(i) for i in range(lo, hi)]
                        yield pa.RecordBatch.from_arrays([doc_ids, pa.array(shard.starts[lo:hi] + base), pa.array(shard.counts[lo:hi]), pa.array(ids, pa.binary())], schema=schema)

    n_shards = manifest.count()
    return shards.repartition(max(1, n_shards)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


