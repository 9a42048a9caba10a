"""Packing documents into windows by non-negative least squares over the histogram of lengths."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage
from .tokens import CACHE_RUNS, encoder, slices

#: Combinations that enter the plan by least squares; with their lengths they bound the broadcast table.
MOST_COMBINATIONS = 4096


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Pairs and triples (in order, shorter ones led by 0) of the given lengths that fill a window."""
    have = np.zeros(window + 1, dtype=bool)
    have[lengths] = True
    triples = [np.zeros((0, 3), dtype=np.int64)]
    for a in lengths[lengths * 3 <= window].tolist():
        b = lengths[(lengths >= a) & (lengths * 2 <= window - a)]
        b = b[have[window - a - b]]
        triples.append(np.stack([np.full(len(b), a), b, window - a - b], axis=1))
    low = lengths[lengths * 2 <= window]
    low = low[have[window - low]]
    pairs = np.stack([np.zeros_like(low), low, window - low], axis=1)
    return np.concatenate([pairs, *triples]).astype(np.int64)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, steps: int = 200) -> np.ndarray:
    """Non-negative x of little ||A x - histogram||, A's columns being the combinations: multiplicative steps, which keep
    the sign and never raise the error."""
    if not len(combos):
        return np.zeros(0)
    h = histogram.astype(float).copy()
    h[0] = 0.0  # row 0 pads the pairs
    up = h[combos].sum(axis=1)
    x = np.full(len(combos), h.sum() / max(1, combos.size))
    for _ in range(steps):
        fit = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=len(h))
        fit[0] = 0.0
        down = fit[combos].sum(axis=1)
        x = x * np.divide(up, down, out=np.zeros_like(up), where=down > 0)
    return x


def plan_windows(histogram: np.ndarray, window: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(lengths, repeats) of full windows, and the histogram of the lengths left over.

    histogram[k]: how many pieces have length k < window. Least squares gives the repeats, rounded and taken while
    pieces last; what is left is packed greedily, longest first, into windows that fill exactly.
    """
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    combos = combinations(np.flatnonzero(left), window)
    x = repeat_counts(combos, left)
    for k in np.argsort(-x, kind="stable")[:MOST_COMBINATIONS]:
        parts, counts = np.unique(combos[k][combos[k] > 0], return_counts=True)
        n = int(min(round(float(x[k])), (left[parts] // counts).min()))
        if n > 0:
            left[parts] -= n * counts
            plan.append((tuple(int(v) for v in combos[k] if v), n))
    spare = np.zeros_like(left)
    for first in range(window - 1, 0, -1):
        while left[first]:
            use, gap = [first], window - first
            left[first] -= 1
            fits = np.flatnonzero(left[: gap + 1])
            while gap and len(fits):
                use.append(int(fits[-1]))
                left[use[-1]] -= 1
                gap -= use[-1]
                fits = np.flatnonzero(left[: gap + 1])
            parts, counts = np.unique(use, return_counts=True)
            if gap:  # doesn't fill: the first piece is left for the tail, the others go back
                left[parts] += counts
                spare[first] += left[first]
                left[first] = 0
                break
            n = 1 + int((left[parts] // counts).min())
            left[parts] -= (n - 1) * counts
            plan.append((tuple(use), n))
    return plan, spare


def plan_tables(histogram: np.ndarray, window: int, first_sequence: int) -> tuple[list[tuple], list[tuple], list[tuple[int, int, int]], int]:
    """What the pieces of each length look up by their rank: places in full windows, places in the tail, its end's parts."""
    plan, spare = plan_windows(histogram, window)
    used = np.zeros(len(histogram), dtype=np.int64)
    slots, sequence = [], first_sequence
    for parts, n in plan:
        offsets: dict[int, list[int]] = {}
        at = 0
        for v in parts:
            offsets.setdefault(v, []).append(at)
            at += v
        for v, where in offsets.items():
            slots.append((v, int(used[v]), int(used[v] + n * len(where)), where, sequence))
            used[v] += n * len(where)
        sequence += n
    tail, at = [], 0
    for v in np.flatnonzero(spare)[::-1]:
        tail.append((int(v), int(used[v]), at))
        at += int(v) * int(spare[v])
    whole, rest = divmod(at, window)
    parts, lo = [], whole * window
    for bit in range(window.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            parts.append((lo, lo + (1 << bit), sequence + whole + len(parts)))
            lo += 1 << bit
    return slots, tail, parts, sequence


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, cache_runs: int = CACHE_RUNS) -> DataFrame:
    """Packs the ids of documents into sequences of at most `window` ids.

    docs: doc_id, text (more columns are ignored). A document is its ids and end_id; null texts count as empty and null
    doc_ids are packed like others, repeated rows each. Returns one row per piece: doc_id, start, length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. An empty table gives an empty table.

    Whole windows of a document are sequences. The rests, shorter than a window, are counted by length; the counts
    alone (fewer than `window`) come to the driver, where plan_windows() fills windows exactly. Ranks among rests of
    equal length, by sums over the tasks that encoded them, say which rest goes where. Rests that the plan leaves are
    laid end to end and cut at windows; the last, short window is cut into powers of two. No sequence needs padding.

    cache_runs: pieces of texts whose ids a worker remembers, some 250 bytes each; fewer cost time, not results.
    """
    spark = docs.sparkSession
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    schema = "part int, doc_id long, doc_tokens long, rest int, rank long, full_before long, ids binary"
    fields = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("rest", pa.int32()), ("rank", pa.int64()), ("full_before", pa.int64()), ("ids", pa.binary())])
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, code = TaskContext.get().partitionId(), encoder(tokenizer, cache_runs)
        ranks, full = [0] * window, 0
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids = [x + end for x in code.encode([t or "" for t in texts[a:b]])]
                rows = []
                for x in ids:
                    n = len(x) // 4
                    rest = n % window
                    rows.append((n, rest, ranks[rest], full))
                    ranks[rest] += 1
                    full += n // window
                n, rest, rank, before = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), doc_ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(rest, pa.int32()), pa.array(rank, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())], schema=fields)

    coded = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, schema), "pack-coded", "zstd")
    by_part = stage(coded.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("doc_tokens") / window)).alias("full")), "pack-counts")
    histogram = np.zeros(window, dtype=np.int64)
    for rest, n in by_part.groupBy("rest").agg(F.sum("n")).collect():  # at most `window` rows
        histogram[rest] = n
    histogram[0] = 0
    n_full = by_part.agg(F.sum("full")).first()[0] or 0
    slots, tail, ends, tail_sequence = plan_tables(histogram, window, n_full)

    earlier = lambda *by: Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    full_base = by_part.groupBy("part").agg(F.sum("full").alias("full")).select("part", F.coalesce(F.sum("full").over(earlier()), F.lit(0)).alias("base"))
    rank_base = by_part.where("rest > 0").select("part", "rest", F.coalesce(F.sum("n").over(earlier("rest")), F.lit(0)).alias("base"))
    cols = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    long = lambda x: x.cast("long")

    whole = coded.where(F.col("doc_tokens") >= window).join(full_base, "part")
    whole = whole.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("doc_tokens") / window) - 1)))
    full = whole.select("doc_id", long(F.col("k") * window).alias("start"), F.lit(window).cast("long").alias("length"), F.substring("ids", (F.col("k") * (4 * window) + 1).cast("int"), F.lit(4 * window)).alias("ids"), "doc_tokens", long(F.col("base") + F.col("full_before") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    start = F.col("doc_tokens") - F.col("rest")
    rests = coded.where("rest > 0").select("part", "doc_id", "doc_tokens", "rest", "rank", start.alias("start"), F.substring("ids", (start * 4 + 1).cast("int"), F.lit(4 * window)).alias("ids"))
    rests = rests.join(rank_base, ["part", "rest"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    # At most 3 rows for each of MOST_COMBINATIONS and a few for each length: small at any size of the input.
    slot_table = F.broadcast(spark.createDataFrame(slots, "rest int, lo long, hi long, offsets array<long>, first long"))
    tail_table = F.broadcast(spark.createDataFrame(tail, "rest int, lo long, at long"))
    m = F.size("offsets")
    step = F.col("rank") - F.col("lo")
    in_slots = rests.join(slot_table, "rest").where("rank >= lo AND rank < hi")
    in_slots = in_slots.select("doc_id", "start", long(F.col("rest")).alias("length"), "ids", "doc_tokens", long(F.col("first") + F.floor(step / m)).alias("sequence_id"), F.element_at("offsets", (step % m + 1).cast("int")).alias("offset"))

    in_tail = rests.join(tail_table, "rest").where("rank >= lo").withColumn("at", F.col("at") + (F.col("rank") - F.col("lo")) * F.col("rest"))
    stop = F.col("at") + F.col("rest")
    n_whole = (ends[0][0] // window) if ends else None
    last = F.floor((stop - 1) / window)
    first_seq = F.floor(F.col("at") / window)
    if n_whole is not None:
        last = F.least(last, F.lit(n_whole - 1))
    spans = F.when(first_seq <= last, F.transform(F.sequence(first_seq, last), lambda q: F.struct((q * window).alias("lo"), ((q + 1) * window).alias("hi"), (q + F.lit(tail_sequence)).alias("seq"))))
    spans = F.coalesce(spans, F.array().cast("array<struct<lo:bigint,hi:bigint,seq:bigint>>"))
    if ends:
        short = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(("lo", "hi", "seq"), e, strict=True)]) for e in ends])
        spans = F.concat(spans, F.filter(short, lambda s: (s["lo"] < stop) & (s["hi"] > F.col("at"))))
    cut = in_tail.withColumn("span", F.explode(spans))
    lo, hi = F.greatest("at", F.col("span.lo")), F.least(stop, F.col("span.hi"))
    cut = cut.select("doc_id", (F.col("start") + lo - F.col("at")).alias("start"), (hi - lo).alias("length"), F.substring("ids", ((lo - F.col("at")) * 4 + 1).cast("int"), ((hi - lo) * 4).cast("int")).alias("ids"), "doc_tokens", F.col("span.seq").alias("sequence_id"), (lo - F.col("span.lo")).alias("offset"))
    return full.select(*cols).unionByName(in_slots.select(*cols)).unionByName(cut.select(*cols))
