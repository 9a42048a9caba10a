"""Removal of repeated passages by a run-length index over the contexts of shared anchors."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage
from .textblocks import blocks, mix64

#: Bytes of the k-gram that stands for a window.
GRAM = 32
#: Bytes of text taken at once; longer texts go on in further pieces.
PIECE = 1 << 20
#: Bytes of contexts in one index, about; contexts of one anchor that are more than these go another exact way.
INDEX_BYTES, MOST_CONTEXTS = 1 << 20, 20_000
#: Texts and contexts that a task remembers, so that it settles by itself what comes again.
MOST_SEEN = 1_500_000
_BASE = 0x9E3779B97F4A7C15


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base: int) -> np.ndarray:
        p = np.full(n, base, dtype=np.uint64)
        p[:1] = 1
        return np.cumprod(p, dtype=np.uint64)

    return table(_BASE), table(pow(_BASE, -1, 1 << 64))


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The windows of `length` bytes of each text, gathered by the k-gram of least hash in each (the leftmost of equals).

    Returns for each gathering: the text, the start of its first window in the text, how many windows follow that, the
    k-gram's hash, and a digest of 128 bits of the bytes under the windows, in halves. Equal windows have equal k-grams at
    equal places; k-grams whose hashes meet cost time only.
    """
    import xxhash

    out: list[tuple[np.ndarray, ...]] = []
    n = len(raw)
    reach = length - GRAM + 1  # k-grams in a window
    for at in range(0, max(0, n - length + 1), PIECE):
        part = raw[at : at + PIECE + length - 1]
        m = len(part)
        up, down = _powers(PIECE + length + 1)
        sums = np.zeros(m + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:m], out=sums[1:])
        g = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: m - GRAM + 1])
        key = (g & ~np.uint64(0xFFFFFF)) | np.arange(len(g), dtype=np.uint64)
        least, width = key, 1
        while width * 2 <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < reach:
            least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
        starts = np.arange(at, at + len(least))
        text = np.searchsorted(offsets, starts, side="right") - 1
        good = np.flatnonzero(starts + length <= offsets[text + 1])
        if not len(good):
            continue
        chosen, text = (least[good] & np.uint64(0xFFFFFF)).astype(np.int64), text[good]
        new = np.ones(len(good), dtype=bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1]) | (np.diff(good) > 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(good)) - 1
        lo, hi = good[first], good[last]
        view = memoryview(part.tobytes())
        digests = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)]
        content = np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2)
        out.append((text[first], lo + at - offsets[text[first]], hi - lo, g[chosen[first]], content[:, 0], content[:, 1]))
    if not out:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class RunLengthIndex:
    """A Burrows-Wheeler transform in runs: their lengths and bytes, the suffixes at their beginnings and ends, and what each
    beginning shares with the end before it. The suffix order that it is made from isn't kept.

    text: bytes in which no two suffixes agree on `depth` bytes or more.
    """

    def __init__(self, text: np.ndarray, depth: int = 512):
        n = len(text)
        padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
        words = np.zeros(n, dtype=np.uint64)
        for k in range(8):
            words = (words << np.uint64(8)) | padded[k : n + k].astype(np.uint64)
        order = np.argsort(words, kind="stable")
        rank = self._ranks(order, words[order])
        width = 8
        while width < depth and rank[order[-1]] + 1 < n:
            after = np.zeros(n, dtype=np.int64)
            after[: max(0, n - width)] = rank[width:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            rank = self._ranks(order, key[order])
            width *= 2
        bwt = text[order - 1].astype(np.int16)
        bwt[order == 0] = -1  # nothing stands before the text's first byte: a run of its own
        heads = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        self.size = n
        self.run_lengths = np.diff(np.append(heads, n))
        self.run_bytes = bwt[heads]
        self.head_suffixes = order[heads]  # sampled run beginnings ...
        self.end_suffixes = order[np.append(heads[1:], n) - 1]  # ... and ends
        self.head_shared = np.zeros(len(heads), dtype=np.int64)
        self.head_shared[1:] = self._common(words, self.head_suffixes[1:], self.end_suffixes[:-1], depth)

    @staticmethod
    def _ranks(order: np.ndarray, keys: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(keys[1:] != keys[:-1])))
        return rank

    @staticmethod
    def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Bytes on which suffixes a and b agree, up to about `most`; words: the eight bytes from each place on."""
        n, got = len(words), np.zeros(len(a), dtype=np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live] + got[live], b[live] + got[live]
            inside = np.maximum(x, y) < n
            live, x, y = live[inside], x[inside], y[inside]
            differ = words[x] ^ words[y]
            whole = differ == 0
            top = sum((differ < np.uint64(1 << (8 * k)) for k in range(1, 8)), np.zeros(len(live), dtype=np.int64))
            got[live] += np.where(whole, 8, top)
            live = live[whole]
            live = live[got[live] < most]
        return np.minimum(got, n - np.maximum(a, b))

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the text, in order: the bytes that its suffix shares with the suffix before it in sorted order, and
        where that one begins (-1: none).

        Both come from the samples alone. A place that begins no run shares a byte less than the place to its left, and its
        neighbour is the one after that place's neighbour.
        """
        at = np.full(self.size, -1, dtype=np.int64)
        at[self.head_suffixes] = np.arange(len(self.head_suffixes))
        places = np.arange(self.size)
        run = at[np.maximum.accumulate(np.where(at >= 0, places, 0))]
        past = places - self.head_suffixes[run]
        shared = np.maximum(self.head_shared[run] - past, 0)
        neighbour = np.where(run > 0, self.end_suffixes[run - 1] + past, -1)
        return shared, neighbour


def repeated_windows(contexts: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context a mask of the windows in it that also start earlier in any: in an earlier document (docs ranks
    them), or in the same one at an earlier start."""
    sizes = np.array([len(c) + 1 for c in contexts])
    text = np.frombuffer(b"\xff".join(contexts) + b"\xff", dtype=np.uint8)  # a byte that no text holds
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    owner = np.repeat(np.arange(len(contexts)), sizes)
    inside = np.arange(len(text)) - begin[owner]
    place = (docs[owner].astype(np.int64) << 40) + starts[owner] + inside
    valid = inside + length < sizes[owner]
    place[~valid] = np.iinfo(np.int64).max
    # Contexts differ, so suffixes do before the end of the second one's context.
    shared, neighbour = RunLengthIndex(text, max(512, 2 * int(sizes.max()))).matching_statistics()
    # Places that share a window with their neighbour follow it to the first place of the window's group.
    first = np.where(shared >= length, neighbour, np.arange(len(text)))
    while (after := first[first])[valid].tobytes() != first[valid].tobytes():
        first = after
    earliest = np.full(len(text), np.iinfo(np.int64).max)
    np.minimum.at(earliest, first, place)
    later = valid & (place > earliest[first])
    return [later[b : b + max(0, s - length)] for b, s in zip(begin, sizes, strict=True)]


def spans_of(mask: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    """(from, to) in bytes of what marked windows cover, window 0 being at start."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return [(start + int(a), start + int(b) - 1 + length) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def repeated_spans(numbered: DataFrame, length: int = 100, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(row, from, to): bytes of texts that are covered by windows of `length` bytes that also start earlier.

    numbered: row (unique), doc_id, text. Earlier: in a smaller doc_id (null first), a smaller row, or at an earlier
    start; windows are judged on the input and never cross texts.
    """
    # Equal texts and equal contexts are known by 128 bits.
    cid = [F.xxhash64("text").alias("cid"), F.xxhash64(F.lit(7), "text").alias("cid2")]
    names = ["gram", "cid", "cid2", "start", "more", "content", "content2", "settled"]
    docs = numbered.select("row", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = stage(docs.select("row", "doc_id", *cid, F.octet_length("text").cast("long").alias("n_bytes")), "repeat-docs")
    firsts = known.where(F.col("n_bytes") >= length).groupBy("cid", "cid2").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("cid", "cid2", "first.doc_id", "first.row")
    copies = known.where(F.col("n_bytes") >= length).join(firsts.select("row"), "row", "left_anti")  # equal texts stand earlier
    copies = copies.select("row", F.lit(0).cast("long").alias("from"), F.col("n_bytes").alias("to"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        contexts: set[tuple[int, int]] = set()
        last, ordered = None, True
        for batch in batches:
            rows, order = batch.column(3).to_numpy(), batch.column(4)
            known = order.to_numpy(zero_copy_only=False)
            ordered = ordered and not order.null_count and bool((np.diff(known) >= 0).all()) and (last is None or known[0] >= last)
            last = known[-1]
            ids, more_ids = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for a, b, raw, offsets in blocks(batch.column(0), PIECE):
                fresh = np.zeros(b - a, dtype=bool)
                for i, c in enumerate(zip(ids[a:b].tolist(), more_ids[a:b].tolist(), strict=True)):
                    fresh[i] = c not in seen  # a text that this task has had
                    seen.add(c)
                found = anchors(raw, offsets, length)
                keep = fresh[found[0]]
                text, start, more, gram, content, content2 = (x[keep] for x in found)
                own = rows[a:b][text]
                # While documents come in order, a context that this task has had stands earlier: it is settled here, under a
                # k-gram of its own, so that a passage of very many documents is a row for each task in its list.
                settled = np.zeros(len(gram), dtype=bool)
                if ordered:
                    settled = np.ones(len(gram), dtype=bool)
                    for i, c in enumerate(zip(content.tolist(), content2.tolist(), strict=True)):
                        if c not in contexts:
                            contexts.add(c)
                            settled[i] = False
                    gram = np.where(settled, mix64(own.astype(np.uint64) * np.uint64(_BASE) + start.astype(np.uint64)), gram)
                if len(seen) + len(contexts) > MOST_SEEN:  # what comes again is settled beyond the task then
                    seen.clear()
                    contexts.clear()
                columns = [gram.view(np.int64), ids[a:b][text], more_ids[a:b][text], start, more, content.view(np.int64), content2.view(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(own, mask=~settled)], names=names)

    found = docs.select("text", *cid, "row", "doc_id").mapInArrow(gather, ", ".join(f"{c} long" for c in names))
    same = Window.partitionBy("gram")
    place = F.struct("cid", "cid2", "start")
    lists = found.withColumn("lo", F.min(place).over(same)).withColumn("hi", F.max(place).over(same)).where("lo <> hi OR settled IS NOT NULL").drop("lo", "hi")
    lists = stage(lists.distinct().join(firsts, ["cid", "cid2"]), "repeat-lists")
    settled = lists.where("settled IS NOT NULL").select(F.col("settled").alias("row"), F.col("start").alias("from"), (F.col("start") + F.col("more") + length).alias("to"))
    lists = lists.where("settled IS NULL")

    # Of equal contexts the earliest keeps its windows for now; all windows of the others start earlier too.
    order = Window.partitionBy("gram", "content", "content2").orderBy(F.col("doc_id").asc_nulls_first(), "row", "start")
    ranked = lists.withColumn("nth", F.row_number().over(order))
    later = ranked.where("nth > 1").select("row", F.col("start").alias("from"), (F.col("start") + F.col("more") + length).alias("to"))
    lead = ranked.where("nth = 1").withColumn("contexts", F.count(F.lit(1)).over(same)).where("contexts > 1")
    lead = stage(lead.select("gram", "row", "doc_id", "start", "more", "contexts"), "repeat-contexts")

    wanted = lead.groupBy("row").agg(F.collect_list(F.struct("gram", "start", "more", "contexts", "doc_id")).alias("wanted"))  # of one text
    slices = docs.select(F.col("row"), F.encode("text", "utf-8").alias("raw")).join(wanted, "row").select("row", "raw", F.explode("wanted").alias("w"))
    slices = slices.select("w.gram", "w.contexts", "row", "w.doc_id", "w.start", F.substring("raw", (F.col("w.start") + 1).cast("int"), (F.col("w.more") + length).cast("int")).alias("bytes"))
    slices = stage(slices, "repeat-slices")

    total = slices.agg(F.sum(F.length("bytes"))).first()[0] or 0
    n_buckets = max(1, math.ceil(total / INDEX_BYTES))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        names = list(zip(pdf["doc_id"].isna().map(lambda x: 0 if x else 1), pdf["doc_id"].fillna(0), pdf["row"], strict=True))
        rank = {x: i for i, x in enumerate(sorted(set(names)))}
        docs_at = np.array([rank[x] for x in names], dtype=np.int64)
        starts = pdf["start"].to_numpy(dtype=np.int64)
        masks = repeated_windows([bytes(x) for x in pdf["bytes"]], docs_at, starts, length)
        rows = [(r, a, b) for r, s, m in zip(pdf["row"], starts, masks, strict=True) for a, b in spans_of(m, int(s), length)]
        return pd.DataFrame(rows, columns=["row", "from", "to"], dtype="int64")

    light = slices.where(F.col("contexts") <= most_contexts).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(n_buckets)))
    indexed = light.groupBy("bucket").applyInPandas(index, "row long, from long, to long")

    # Anchors with very many contexts: window by window, keyed by content.
    heavy = slices.where(F.col("contexts") > most_contexts)
    heavy = heavy.select("row", "doc_id", "start", "bytes", F.explode(F.sequence(F.lit(0), F.length("bytes") - length)).alias("k"))
    heavy = heavy.select("row", "doc_id", (F.col("start") + F.col("k")).alias("from"), F.substring("bytes", F.col("k") + 1, F.lit(length)).alias("window"))
    earliest = heavy.groupBy("window").agg(F.min(F.struct("doc_id", "row", "from")).alias("first"))
    heavy = heavy.join(earliest, "window").where(~F.struct("doc_id", "row", "from").eqNullSafe(F.col("first")))
    heavy = heavy.select("row", "from", (F.col("from") + length).alias("to"))
    return copies.unionByName(settled).unionByName(later).unionByName(indexed).unionByName(heavy)


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Removes from each text the bytes covered by `length`-byte strings that also start earlier.

    docs: doc_id, text (more columns are ignored); null texts count as empty. Returns for each document doc_id, n_bytes,
    n_removed, spans (the maximal removed runs, as from and to) and kept (the remaining bytes, which may cut characters).
    Texts are ordered by doc_id, null first, then by place in the input; repeated rows lose all to the first where they
    are long enough. An empty table gives an empty table.

    Any two equal windows hold the same k-gram of least hash at the same place, so only texts around k-grams that occur
    twice can repeat. Equal contexts of a k-gram are settled by order. Contexts that differ are indexed together: the samples
    at the ends of a Burrows-Wheeler transform's runs give, streamed through the text, how much each suffix shares with its
    neighbour in sorted order, and where that stands; neighbours that share a whole window form groups, of which the
    earliest stays. `length` is at least the k-gram's.
    """
    if length < GRAM:
        raise ValueError(f"passages are of {GRAM} bytes at least")
    # Rows are told apart by their place in the input, which must read alike each time.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = stage(repeated_spans(numbered, length), "repeat-spans")
    by_row = spans.groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("marks"))  # of one text
    both = numbered.join(by_row, "row", "left").select("doc_id", "text", F.coalesce("marks.from", F.array().cast("array<bigint>")).alias("a"), F.coalesce("marks.to", F.array().cast("array<bigint>")).alias("b"))
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<from:long,to:long>>, kept binary"
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, merged, kept = [], [], [], []
            for text, starts, stops in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = (text or "").encode()
                runs: list[list[int]] = []
                for x, y in sorted(zip(starts, stops, strict=True)):
                    if runs and x <= runs[-1][1]:
                        runs[-1][1] = max(y, runs[-1][1])
                    else:
                        runs.append([x, y])
                left, at = [], 0
                for x, y in runs:
                    left.append(raw[at:x])
                    at = y
                left.append(raw[at:])
                kept.append(b"".join(left))
                sizes.append(len(raw))
                gone.append(len(raw) - len(kept[-1]))
                merged.append([{"from": x, "to": y} for x, y in runs])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(merged, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return both.mapInArrow(cut, schema)


