"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet."""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage
from .tokens import slices

#: Where both tokenizers always begin a new token: before spaces, tabs and line feeds that follow anything else. Texts with
#: other white space, which pieces may end with, are runs as a whole.
_RUN = re.compile(r"[ \t\n]*[^ \t\n]+|[ \t\n]+")
_OTHER_SPACE = re.compile(r"[^\S \t\n]")
CACHE_RUNS, CACHE_CHARS = 400_000, 40
#: Tokens of one side in an event row; longer texts go on in further rows.
BLOCK_TOKENS = 1 << 14
#: Id pairs whose counts one task holds at a time, about.
BUCKET_PAIRS = 200_000
#: Groups with more token pairs than these are counted by distinct ids.
WIDE_GROUP = 4096


class TokenTable:
    """The bytes of each id of a tokenizer file: byte-level BPE as json, or a sentencepiece model."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.bpe, self.pieces = Tokenizer.from_file(path), None
            self.bpe.encode_special_tokens = True  # their strings in a text are ordinary text
            alphabet = self._byte_alphabet()
            names = [self.bpe.id_to_token(i) or "" for i in range(self.bpe.get_vocab_size())]
            self.bytes = [bytes(map(alphabet.__getitem__, t)) if all(c in alphabet for c in t) else t.encode() for t in names]
        else:
            import sentencepiece

            self.bpe, self.pieces = None, sentencepiece.SentencePieceProcessor(model_file=path)
            names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
            self.bytes = [bytes([int(t[3:5], 16)]) if self.pieces.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
            if any(re.search(r"[\t\n]|[^▁]▁", t) for t in names):
                raise ValueError("pieces of this model run on over white space")
            self.space = self.pieces.piece_to_id("▁")
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)

    @staticmethod
    def _byte_alphabet() -> dict[str, int]:
        """The public byte-level alphabet: printable bytes stand for themselves, the others for what follows 255, in order."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space or stand after one's end, each as it would be encoded there."""
        if self.bpe is not None:
            return [e.ids for e in self.bpe.encode_batch_fast(texts, add_special_tokens=False)]
        # The model puts a space before what it is given. After other white space, none belongs there: a line feed, which
        # joins nothing, takes it.
        cut = [t[1:] if t[0] == " " else "\n" + t for t in texts]
        done = self.pieces.encode(cut, num_threads=1)
        return [([self.space] if t == " " else ids) if t[0] == " " else ids[2:] for t, ids in zip(texts, done, strict=True)]

    def spells(self, ids: list[int], text: str) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids)) == text.encode()


_encoders: dict[tuple[str, str], PairEncoder] = {}


class PairEncoder:
    """Ids of the same texts by two tokenizers, as unsigned 32-bit integers; None where either doesn't spell the text's bytes."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = TokenTable(path_a), TokenTable(path_b)
        self.cache: dict[str, tuple[bytes, bytes] | None] = {}

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """texts: none is empty, each begins with a space."""
        cache = self.cache
        runs = [_RUN.findall(t) if not _OTHER_SPACE.search(t) else [t] for t in texts]
        new = list(set().union(*runs).difference(cache))
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            for run, x, y in zip(part, self.a.encode(part), self.b.encode(part), strict=True):
                good = self.a.spells(x, run) and self.b.spells(y, run)
                cache[run] = (np.array(x, dtype=np.uint32).tobytes(), np.array(y, dtype=np.uint32).tobytes()) if good else None
        out = []
        for parts in (list(map(cache.__getitem__, r)) for r in runs):
            out.append(None if None in parts else (b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])))
        full = len(cache) > CACHE_RUNS
        for k in new:
            if full or len(k) > CACHE_CHARS:
                del cache[k]
        return out


def pair_encoder(path_a: str, path_b: str) -> PairEncoder:
    """The worker's encoder; it outlives tasks."""
    key = (path_a, path_b)
    if key not in _encoders:
        _encoders[key] = PairEncoder(path_a, path_b)
    return _encoders[key]


EVENTS = "row long, doc_id long, side int, start long, ids binary"


def end_events(numbered: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The ends of both sides' tokens in texts of row, doc_id, text: side (0: A, 1: B), start (the byte before the first token of
    the row) and ids, whose bytes say where each token ends. A text without tokens has one row of side 0 without ids.
    """
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("side", pa.int32()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = pair_encoder(path_a, path_b)
        narrow = [np.uint16 if len(t.bytes) <= 1 << 16 else np.uint32 for t in (code.a, code.b)]
        for batch in batches:
            rows, docs, texts = (batch.column(i).to_pylist() for i in range(3))
            for lo, hi in slices(texts):
                out: list[tuple] = []
                told = [i for i in range(lo, hi) if texts[i]]
                done = dict(zip(told, code.encode([" " + texts[i] for i in told]), strict=True))
                for i in range(lo, hi):
                    if not (both := done.get(i)):
                        out.append((rows[i], docs[i], 0, 0, b""))
                        continue
                    for side, (raw, table) in enumerate(zip(both, (code.a, code.b), strict=True)):
                        ids, start = np.frombuffer(raw, dtype=np.uint32), 0
                        for k in range(0, len(ids), BLOCK_TOKENS):
                            part = ids[k : k + BLOCK_TOKENS]
                            out.append((rows[i], docs[i], side, start, part.astype(narrow[side]).tobytes()))
                            start += int(table.lengths[part].sum())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return numbered.select("row", "doc_id", "text").mapInArrow(run, EVENTS)


class Sweep:
    """What is open of one document while its end events pass in order: the tokens after the last end that both sides share, and
    running totals. Ids of a closed group are linked, counted and forgotten."""

    def __init__(self, row: int, doc_id: int | None, tables: tuple[np.ndarray, np.ndarray], said: tuple[list[str], ...]):
        self.row, self.doc_id, self.lengths, self.said = row, doc_id, tables, said
        self.ids = [np.zeros(0, dtype=np.int64)] * 2
        self.base = 0
        self.n = [0, 0]
        self.groups = self.links = 0
        self.digest = hashlib.sha256()
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, side: int, ids: np.ndarray) -> None:
        self.n[side] += len(ids)
        self.ids[side] = np.concatenate((self.ids[side], ids)) if len(self.ids[side]) else ids.astype(np.int64)

    def close(self) -> None:
        """Cuts what has come at the ends that both sides share, and takes the groups before the last of them."""
        a, b = self.ids
        if not len(a) or not len(b):
            return
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        size = int(min(ends_a[-1], ends_b[-1])) + 1
        seen = np.zeros(size, dtype=np.int8)
        seen[ends_a[ends_a < size]] = 1
        seen[ends_b[ends_b < size]] += 2
        shared = seen == 3
        n = int(np.count_nonzero(shared))
        if not n:
            return
        last = int(np.flatnonzero(shared)[-1])
        na, nb = int(np.searchsorted(ends_a, last)) + 1, int(np.searchsorted(ends_b, last)) + 1
        before = np.cumsum(shared) - shared  # shared ends before a place: the group of a token that ends there
        group_a, group_b = before[ends_a[:na]], before[ends_b[:nb]]
        self.ids = [a[na:], b[nb:]]
        self._take(a[:na], b[:nb], group_a, group_b, n)

    def _take(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n: int) -> None:
        count_a, count_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        both = count_a * count_b
        self.links += int(both.sum())
        self._say(a, b, group_a, group_b, count_a, count_b)
        n_b = len(self.lengths[1])
        wide = np.flatnonzero(both > WIDE_GROUP)
        first_a, first_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
        for g in wide.tolist():  # ids and how often, not tokens
            x, times_x = np.unique(a[first_a[g] : first_a[g] + count_a[g]], return_counts=True)
            y, times_y = np.unique(b[first_b[g] : first_b[g] + count_b[g]], return_counts=True)
            self.pairs.append(((x[:, None] * n_b + y).ravel(), (times_x[:, None] * times_y).ravel()))
        repeat = np.where(both > WIDE_GROUP, 0, count_b)[group_a]
        total = int(repeat.sum())
        at = np.arange(total) - np.repeat(np.cumsum(repeat) - repeat, repeat) + np.repeat(first_b[group_a], repeat)
        self.pairs.append((np.repeat(a, repeat) * n_b + b[at], np.ones(total, dtype=np.int64)))
        if sum(len(p[0]) for p in self.pairs[1:]) > 4 * BLOCK_TOKENS:
            self.pairs = [self.distinct()]

    def _say(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray) -> None:
        """Feeds the groups' text to the digest: each token with the mark that follows it."""
        last_a, last_b = np.ones(len(a), dtype=bool), np.ones(len(b), dtype=bool)
        last_a[:-1], last_b[:-1] = group_a[1:] != group_a[:-1], group_b[1:] != group_b[:-1]
        tokens = np.empty(len(a) + len(b), dtype=np.int64)
        tokens[np.arange(len(a)) + (np.cumsum(count_b) - count_b)[group_a]] = 2 * a + last_a
        tokens[np.arange(len(b)) + np.cumsum(count_a)[group_b]] = 2 * b + last_b + 2 * len(self.lengths[0])
        text = "".join(map(self.said[0].__getitem__, tokens.tolist()))
        self.digest.update((";" * bool(self.groups) + text[:-1]).encode())
        self.groups += len(count_a)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The document's linked id pairs, sorted, and how many links each has."""
        codes = np.concatenate([p[0] for p in self.pairs]) if self.pairs else np.zeros(0, dtype=np.int64)
        times = np.concatenate([p[1] for p in self.pairs]) if self.pairs else codes
        order = np.argsort(codes, kind="stable")
        codes, times = codes[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, dtype=np.int64)
        return codes[first], np.add.reduceat(times, first) if len(first) else times

    def result(self) -> tuple:
        codes, times = self.distinct()
        digest = self.digest.hexdigest() if self.groups else ""
        return self.row, self.doc_id, *self.n, self.groups, self.links, digest, codes.astype("<i8").tobytes(), times.astype("<i8").tobytes()


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def align_events(events: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Sweeps each document's end events in order of their place: a row a document with its groups and its linked id pairs (A's id
    times B's vocabulary plus B's id, sorted, as 64-bit integers) and their times."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = pair_encoder(path_a, path_b)
        sizes = len(code.a.bytes), len(code.b.bytes)
        types = [np.dtype(np.uint16 if n <= 1 << 16 else np.uint32) for n in sizes]
        marks = [[f"{i}{m}" for i in range(n) for m in (",", end)] for n, end in zip(sizes, "|;", strict=True)]
        said = (marks[0] + marks[1],)
        sweep: Sweep | None = None
        ready: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready, strict=True), schema, strict=True)], schema=schema)
            ready.clear()
            return done

        for batch in batches:
            sides = batch.column(2).to_pylist()
            for row, doc_id, side, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sides, batch.column(4), strict=True):
                if sweep is None or row != sweep.row:
                    if sweep is not None:
                        sweep.close()
                        ready.append(sweep.result())
                        if len(ready) >= 500:
                            yield batch_of()
                    sweep = Sweep(row, doc_id, (code.a.lengths, code.b.lengths), said)
                sweep.add(side, np.frombuffer(ids.as_buffer(), dtype=types[side]))
                if max(map(len, sweep.ids)) > 2 * BLOCK_TOKENS:
                    sweep.close()
        if sweep is not None:
            sweep.close()
            ready.append(sweep.result())
        if ready:
            yield batch_of()

    by_place = events.repartition("row").sortWithinPartitions("row", "start", "side")
    return by_place.mapInArrow(run, ALIGNED)


def _int64(column: pa.Array, i: int) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), dtype="<i8")


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): in how many documents an id pair is linked, counted inside tasks first, and whether that is the highest
    of its A id, ties included. An A id has no more pairs than B has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total, size = (np.zeros(0, dtype=np.int64),) * 2, 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            fresh, n = np.unique(np.concatenate(held), return_counts=True) if held else (total[0][:0], total[1][:0])
            codes, place = np.unique(np.concatenate((total[0], fresh)), return_inverse=True)
            return codes, np.bincount(place, weights=np.concatenate((total[1], n)), minlength=len(codes)).astype(np.int64)

        for batch in batches:
            column = batch.column(0)
            for i in range(len(column)):
                held.append(_int64(column, i))
                size += len(held[-1])
                if size > 2_000_000:
                    total, held, size = merged(), [], 0
                    if len(total[0]) > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in total], names=["pair", "n"])
                        total = (total[0][:0], total[1][:0])
        total = merged()
        if len(total[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in total], names=["pair", "n"])

    counted = aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / n_b))
    return counted.select("pair", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))


def links_counted(aligned: DataFrame, counts: DataFrame, n_pairs: int) -> DataFrame:
    """(row, n_best, count_sum): each document's links against the counts of their pairs.

    Pairs are dealt by hash to buckets of about BUCKET_PAIRS. A bucket's counts come to a task before the documents' pairs
    of that bucket, which then pass by in blocks; documents of a bucket are dealt to several tasks, each with the counts.
    """
    spark = aligned.sparkSession
    n_buckets = max(1, -(-n_pairs // BUCKET_PAIRS))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    salts = max(4, -(-width // n_buckets))
    columns = "bucket int, salt int, kind int, rows binary, sizes binary, pairs binary, more binary"
    names = [c.split()[0] for c in columns.split(", ")]

    def bucket_of(pairs: np.ndarray) -> np.ndarray:
        mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)

    def rows_of(parts: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32()] * 3 + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), types, strict=True)], names=names)

    def deal_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, batch.num_rows, 400):
                hi, parts = min(batch.num_rows, lo + 400), []
                salt += 1
                rows = batch.column(0).to_numpy()[lo:hi]
                held = [_int64(batch.column(1), i) for i in range(lo, hi)]
                sizes, pairs = np.array([len(h) for h in held]), np.concatenate(held)
                times = np.concatenate([_int64(batch.column(2), i) for i in range(lo, hi)])
                owner = np.repeat(np.arange(hi - lo), sizes)
                bucket = bucket_of(pairs)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                for k, (a, b) in enumerate(itertools.pairwise(edges.tolist())):
                    if a < b:
                        own = order[a:b]
                        each = np.bincount(owner[own], minlength=hi - lo)
                        parts.append((k, salt % salts, 1, rows.tobytes(), each.tobytes(), pairs[own].tobytes(), times[own].tobytes()))
                if parts:
                    yield rows_of(parts)

    def deal_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n, best = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            bucket = bucket_of(pairs)
            parts = []
            for k in np.unique(bucket).tolist():
                own = bucket == k
                parts += [(k, s, 0, b"", b"", pairs[own].tobytes(), (2 * n[own] + best[own]).tobytes()) for s in range(salts)]
            yield rows_of(parts)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known = None, [], (np.zeros(0, dtype=np.int64),) * 2
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for i, (bucket, salt, kind) in enumerate(keys):
                if (bucket, salt) != now:
                    now, held = (bucket, salt), []
                if kind == 0:
                    held.append((_int64(batch.column(5), i).copy(), _int64(batch.column(6), i).copy()))
                    continue
                if held:
                    pairs, n = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(pairs)
                    known, held = (pairs[order], n[order]), []
                rows, sizes, pairs, times = (_int64(batch.column(c), i) for c in (3, 4, 5, 6))
                found = known[1][np.searchsorted(known[0], pairs)]
                owner = np.repeat(np.arange(len(rows)), sizes)
                edges = np.concatenate(([0], np.cumsum(sizes)))
                best = np.concatenate(([0], np.cumsum(times * (found & 1))))
                total = np.concatenate(([0], np.cumsum(times * (found >> 1))))
                has = np.unique(owner)
                yield pa.RecordBatch.from_arrays([pa.array(rows[has]), pa.array((best[edges[1:]] - best[edges[:-1]])[has]), pa.array((total[edges[1:]] - total[edges[:-1]])[has])], names=["row", "n_best", "count_sum"])

    dealt = aligned.where("n_links > 0").select("row", "pairs", "times").mapInArrow(deal_documents, columns)
    dealt = dealt.unionByName(counts.select("pair", "n", "best").mapInArrow(deal_counts, columns))
    dealt = dealt.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "kind")
    parts = dealt.mapInArrow(look_up, "row long, n_best long, count_sum long")
    return parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Aligns the tokens of two tokenizers over space+text, and counts how often their ids meet.

    docs: doc_id, text (more columns are ignored). Returns row (the place in the input), doc_id, n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups_sha256, pairs, times - a row per row of docs. Null and empty texts, and texts whose bytes
    the joined tokens of A or B don't spell, have no tokens: zeros and ''. Repeated rows count each as a document; null
    doc_ids stay; an empty table gives an empty table.

    Byte offsets where tokens of both sides end cut them into groups, and all pairs of a group's A and B tokens are links.
    Both sides' end events are brought together by document and swept in order; a group's pairs are made from its ids and
    their times once it is wide. A pair's count is the number of documents that hold it linked; n_best counts links whose
    pair has its A id's highest count, count_sum adds the counts up over all links.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    aligned = stage(align_events(end_events(numbered, path_a, path_b), path_a, path_b), "aligned", "zstd")
    n_b = len(TokenTable(path_b).bytes)
    counts = stage(pair_counts(aligned, n_b), "aligned-counts")
    sums = links_counted(aligned, counts, counts.count())
    both = aligned.join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return both.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", "pairs", "times")
