"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with a temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .textblocks import _SPACE, blocks, mix64, word_hashes

#: Words share this many slots (a bounded table of word vectors at any size of the corpus), of this many dimensions.
SLOTS, DIM, NONZERO = 1 << 15, 32, 4
#: Labelled rows that the network is fitted on, at most.
MOST_LABELLED = 20_000
_GROUP = 512
#: Parts that the tasks' tables are added up in first.
SALTS = 64


def index_vectors(slots: int = SLOTS, dim: int = DIM, nonzero: int = NONZERO) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few entries of each slot's random index vector."""
    h = mix64(np.arange(slots * nonzero, dtype=np.uint64) + np.uint64(1)).reshape(slots, nonzero)
    return (h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def word_slots(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's own slot and that of its ending (its last three bytes and whether it has more), and the texts' bounds.

    Most words of a corpus are rare; endings let a rare word share what is known of its like.
    """
    hashes, bounds = word_hashes(raw, offsets)
    own = (hashes % np.uint64(SLOTS // 2)).astype(np.int64)
    if not len(own):
        return own, own, bounds
    inside = ~_SPACE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]  # words end with their text
    first[edge], last[edge - 1] = inside[edge], inside[edge - 1]
    start, at = np.flatnonzero(first), np.flatnonzero(last)
    code = raw[at].astype(np.uint64)
    for k in (1, 2, 3):
        code = (code << np.uint64(8)) | np.where(at - k >= start, raw[np.maximum(at - k, 0)] if k < 3 else 1, 0).astype(np.uint64)
    return own, (mix64(code) % np.uint64(SLOTS // 2)).astype(np.int64) + SLOTS // 2, bounds


def add_contexts(total: np.ndarray, raw: np.ndarray, offsets: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Adds to each slot the index vectors of the words next to its words."""
    own, ending, bounds = word_slots(raw, offsets)
    if len(own) < 2:
        return
    apart = np.zeros(len(own), dtype=bool)
    apart[bounds[1:-1][bounds[1:-1] < len(own)]] = True
    left = np.flatnonzero(~apart[1:])
    right = left + 1
    flat = total.reshape(-1)
    for word, other in ((left, right), (right, left)):
        for slot in (own, ending):
            base = slot[word] * DIM
            for k in range(NONZERO):
                flat += np.bincount(base + places[ending[other], k], weights=signs[ending[other], k], minlength=flat.size)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of all slots over the whole corpus, as unit vectors: a table of fixed size.

    Each task sums its texts into one table; tables are summed by groups of slots, in two levels, and only the last one
    comes here.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        places, signs = index_vectors()
        total = np.zeros((SLOTS, DIM))
        for batch in batches:
            for _, _, raw, offsets in blocks(batch.column(0)):
                add_contexts(total, raw, offsets, places, signs)
        yield tables(total)

    def tables(total: np.ndarray) -> pa.RecordBatch:
        parts = [total[g * _GROUP : (g + 1) * _GROUP].astype("<i8") for g in range(SLOTS // _GROUP)]
        some = [(g, p.tobytes()) for g, p in enumerate(parts) if p.any()]
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in some], pa.int32()), pa.array([p for _, p in some], pa.binary())], names=["slots", "sums"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, dtype="<i8")
                sums[g] = sums[g] + part if g in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([p.tobytes() for p in sums.values()], pa.binary())], names=["slots", "sums"])

    schema = "slots int, sums binary"
    # First the tables of every SALTS-th task meet, group by group, then theirs: no task is sent those of all.
    salted = docs.select("text").mapInArrow(gather, schema).repartition("slots", F.spark_partition_id() % SALTS).mapInArrow(add_up, schema)
    rows = salted.repartition("slots").mapInArrow(add_up, schema).collect()  # SLOTS x DIM numbers in all
    total = np.zeros((SLOTS // _GROUP, _GROUP * DIM))
    for g, raw in rows:
        total[g] = np.frombuffer(raw, dtype="<i8")
    total = total.reshape(SLOTS, DIM)
    total = total - total.sum(axis=0) / max(1.0, np.abs(total).sum()) * np.abs(total).sum(axis=1, keepdims=True)  # what all words share
    size = np.linalg.norm(total, axis=1, keepdims=True)
    return np.divide(total, size, out=np.zeros_like(total), where=size > 0).astype(np.float32)


FEATURES = 4 * DIM + 2


def pooled(vectors: np.ndarray, raw: np.ndarray, offsets: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Mean word vector, mean vector of endings, mean index vector and its spread, of each text; zeros without words."""
    own, ending, bounds = word_slots(raw, offsets)
    n = np.diff(bounds)
    out = np.zeros((len(n), FEATURES), dtype=np.float32)
    some = np.flatnonzero(n)
    if len(some):
        starts, count = bounds[:-1][some], n[some][:, None]
        step = 1 << 16
        parts = np.zeros((len(some), 3 * DIM))
        for a in range(0, len(own), step):  # long texts in pieces
            b = min(a + step, len(own))
            lo, hi = np.searchsorted(bounds[1:][some], a, side="right"), np.searchsorted(starts, b, side="left")
            cut = np.maximum(starts[lo:hi], a) - a
            for k, rows in enumerate((vectors[own[a:b]], vectors[ending[a:b]], dense[ending[a:b]])):
                parts[lo:hi, k * DIM : (k + 1) * DIM] += np.add.reduceat(rows, cut, axis=0, dtype=np.float64)
        mean = parts / count
        out[some, : 3 * DIM] = mean
        out[some, 3 * DIM : 4 * DIM] = np.sign(mean[:, 2 * DIM :]) * np.sqrt(np.abs(mean[:, 2 * DIM :]))
        out[some, 4 * DIM] = np.log1p(n[some])
    out[:, 4 * DIM + 1] = n == 0
    return out


def dense_index() -> np.ndarray:
    places, signs = index_vectors()
    out = np.zeros((SLOTS, DIM), dtype=np.float32)
    np.add.at(out, (np.arange(SLOTS)[:, None], places), signs)
    return out


@dataclass
class Network:
    """Two layers, standardised input, and the temperature of its probabilities."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, steps: int = 600, rate: float = 0.01, decay: float = 1e-3, seed: int = 5) -> Network:
    """Fits the network by Adam on four fifths of the rows; the rest sets the temperature. One class gives its constant share."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1)
    net = Network(np.zeros(width), np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    if len(y) < 10 or y.min() == y.max():
        return net
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    net.mean, net.scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    net.w1 = rng.normal(0, 1 / np.sqrt(width), (width, hidden))
    net.w2 = rng.normal(0, 1 / np.sqrt(hidden), hidden)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    z = (x - net.mean) / net.scale
    for step in range(1, steps + 1):
        rows = used[rng.integers(0, len(used), 256)]
        a = np.tanh(z[rows] @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(a @ params[2] + params[3][0], -40, 40)))
        d = (p - y[rows]) / len(rows)
        back = np.outer(d, params[2]) * (1 - a * a)
        grads = [z[rows].T @ back + decay * params[0], back.sum(axis=0), a.T @ d + decay * params[2], np.array([d.sum()])]
        speed = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            params[k] = params[k] - speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logit = net.logits(x[held])
    loss = lambda t: np.logaddexp(0, -np.where(y[held] > 0, 1, -1) * logit / t).mean()
    net.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
    return net


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the doc_id as text leaves 0 by 5: rows whose labels are never learnt from. Null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """All columns of docs and held_out, score (0 to 1), predicted (1 where score >= threshold).

    docs: doc_id, text; labels: doc_id, quality. Word vectors come from all texts. The network is fitted on at most
    `most_labelled` labelled rows that aren't held out, the first by a hash of doc_id; null labels are passed over. Repeated
    labels and repeated documents are learnt from once; of a doc_id with several texts, all are.
    Only the text bears on a score; null and empty texts are scored as texts without words. Without labels of both
    kinds the score is the share of label 1 (half without any). Repeated rows get equal scores.

    Columns of docs by the names of the result are replaced.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    sample = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = sample.select(F.col("doc_id").alias("__doc_id"), F.col("quality").cast("int").alias("__quality")).distinct().orderBy(F.xxhash64("__doc_id"), "__doc_id", "__quality").limit(most_labelled)
    shared = spark.sparkContext.broadcast(vectors)  # SLOTS x DIM numbers

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        dense = dense_index()
        for batch in batches:
            for a, b, raw, offsets in blocks(batch.column(0)):
                x = pooled(shared.value, raw, offsets, dense)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in (1, 2, 3)), pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())], names=["quality", "id", "digest", "x"])

    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__doc_id"))  # at most most_labelled rows
    labelled = labelled.select("text", "__quality", F.col("__doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))
    got = labelled.mapInArrow(features, "quality int, id string, digest string, x binary").distinct().select("quality", "x").collect()
    got.sort(key=lambda r: (bytes(r[1]), r[0]))
    x = np.array([np.frombuffer(r[1], dtype="<f4") for r in got]).reshape(-1, FEATURES)
    net = fit(x, np.array([1.0 if r[0] > 0 else 0.0 for r in got]))
    model = spark.sparkContext.broadcast(net)

    kept = [f for f in docs.schema.fields if f.name not in ("held_out", "score", "predicted")]
    out = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    schema = out.withColumn("score", F.lit(0.0)).schema
    text_at = [f.name for f in kept].index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        dense = dense_index()
        for batch in batches:
            for a, b, raw, offsets in blocks(batch.column(text_at)):
                s = model.value.scores(pooled(shared.value, raw, offsets, dense).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(s)], names=[*batch.schema.names, "score"])

    scored = out.mapInArrow(score, schema)
    return scored.select(*[F.col(f"`{f.name}`") for f in kept], held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
