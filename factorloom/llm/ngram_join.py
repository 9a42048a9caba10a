"""Components of documents whose sets of word n-grams are alike, by an exact size-aware heavy-light Jaccard join."""

from __future__ import annotations

import bisect
import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage
from .textblocks import blocks, mix64, shingles, word_hashes

#: Bits of the map of set ids that may be needed: a broadcast of fixed size. It only saves work.
MAP_BITS = 20
#: Bits of the slots of set ids that a comparison reads: another broadcast of fixed size. Parts of which a first comparison sees one.
SLOT_BITS, SAMPLE = 17, 8
#: Longs of a set's sketch.
WORDS = 8
SKETCH = [f"k{i}" for i in range(WORDS)]
#: Where the size classes of large sets begin: each half as large again.
EDGES = [1]
while EDGES[-1] < 1 << 40:
    EDGES.append(max(EDGES[-1] + 1, EDGES[-1] * 3 // 2))


def least_overlap(n: int, m: int, percent: int) -> int:
    """Least overlap of linked sets of n and m elements."""
    return -(-percent * (n + m) // (100 + percent))


def smallest_partner(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of the subsets that a small set of n elements enumerates: with each linked set it shares one of them."""
    sizes = {least_overlap(n, m, percent): m for m in range(smallest_partner(n, percent), 100 * n // percent + 1)}
    return sorted(c for c, m in sizes.items() if c <= min(n, m))


def size_class(n: int) -> int:
    return bisect.bisect_right(EDGES, n) - 1


def most_differing(c: int, percent: int) -> int:
    """In how many elements a set of class c can differ from a linked set that is no smaller."""
    m = EDGES[c + 1] - 1
    return (m + 100 * m // percent) * (100 - percent) // (100 + percent)


def n_parts(c: int, percent: int) -> int:
    """Parts that sets of class c are cut into: enough for most_differing() + 1 of them to hold elements, nearly always."""
    k = most_differing(c, percent)
    return k + 2 + k // 8


def heavy_classes(n: int, percent: int) -> range:
    """Classes by whose rule a large set of n is cut: its own, and those of linked sets that are smaller."""
    return range(size_class(smallest_partner(n, percent)), size_class(n) + 1)


@functools.cache
def boundary(percent: int) -> int:
    """Largest size of a small set: up to it, enumerating subsets costs no more keys than the lists of a large set."""
    best = 0
    for n in range(1, 64):
        if sum(math.comb(n, c) for c in subset_sizes(n, percent)) > sum(n_parts(c, percent) for c in heavy_classes(n, percent)):
            break
        best = n
    return best


@functools.cache
def _subsets(n: int, c: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), c)), dtype=np.int64).reshape(-1, c)


def keys_of(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which any two linked sets share one.

    s: distinct hashes. Small sets enumerate their subsets of the sizes that an overlap may need. Large sets stand in
    inverted lists, one for each part of the set: by the rule of a class, elements fall into n_parts() parts by hash; as
    linked sets differ in k elements at most, of k + 1 parts that hold elements one is equal. Where a set has fewer such
    parts, its empty ones count as lists too. (Lists of single elements would be as long as a passage is common; a list
    of a whole part holds sets that are alike.) The boundary between small and large goes by cost.
    """
    n, light = len(s), boundary(percent)
    out: list[np.ndarray] = []
    if n and smallest_partner(n, percent) <= light:
        for c in subset_sizes(n, percent):
            out.append(mix64(mix64(s[_subsets(n, c)]).sum(axis=1, dtype=np.uint64) ^ np.uint64(c)))
    if n > light:
        own = mix64(s)
        for c in heavy_classes(n, percent):
            parts = n_parts(c, percent)
            part = (mix64(s + np.uint64(c)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at, first = np.unique(part[order], return_index=True)
            name = lambda p: mix64(p.astype(np.uint64) + np.uint64((c + 1) << 40))  # noqa: B023, E731
            out.append(mix64(np.add.reduceat(own[order], first) ^ name(at)))
            if len(at) <= most_differing(c, percent):
                out.append(mix64(name(np.setdiff1d(np.arange(parts), at))))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)


def set_id(s: np.ndarray) -> int:
    """64 bits that stand for a set; 0 for the empty one."""
    return int(mix64(mix64(s).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s)))[0].astype(np.int64)) if len(s) else 0


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for a, _, raw, offsets in blocks(column):
        hashes, bounds = word_hashes(raw, offsets, lower=True)
        yield from enumerate(shingles(hashes, bounds, size), a)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of how many elements fall in each of 64 * WORDS slots: sets differ in no fewer elements than sketches in bits."""
    slots = (mix64(s ^ np.uint64(0xA5A5)) % np.uint64(64 * WORDS)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=64 * WORDS) & 1).astype(np.uint8).view(np.int64)


def differing(x: list[Column], y: list[Column]) -> Column:
    """Bits in which two sketches differ."""
    return sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(x[1:], y[1:], strict=True)), F.bit_count(x[0].bitwiseXOR(y[0])))


def may_link(n: Column, m: Column, x: list[Column], y: list[Column], percent: int) -> Column:
    """Whether sets of n and m elements can link, by sizes and sketches."""
    need = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))
    return (F.least(n, m) >= need) & (differing(x, y) <= n + m - 2 * need)


def document_sets(docs: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """The columns of `keep`, n_shingles, set_id and the sketch (SKETCH) of each document."""
    schema = docs.select(*keep, *[F.lit(0).cast("long").alias(c) for c in ("n_shingles", "set_id", *SKETCH)]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(len(s), set_id(s), *sketch(s).tolist()) for _, s in _sets(batch.column(0), size)]
            columns = zip(*got, strict=True) if got else [()] * (2 + WORDS)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, pa.int64()) for c in columns)], names=schema.names)

    return docs.select("text", *keep).mapInArrow(run, schema)


def set_keys(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, set_id) for each key of each set; a task gives equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, ids, held = [], [], 0
            for _, s in _sets(batch.column(0), size):
                name = set_id(s)
                if name in seen:
                    continue
                seen.add(name)
                keys.append(keys_of(s, percent))
                ids.append(np.full(len(keys[-1]), name, dtype=np.int64))
                held += len(keys[-1])
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(ids))], names=["key", "set_id"])
                    keys, ids, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(ids))], names=["key", "set_id"])

    return docs.select("text").mapInArrow(run, "key long, set_id long")


def needed_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(set_id, elements) of the wanted set ids, each once."""
    slot = F.pmod("set_id", F.lit(1 << MAP_BITS)).cast("int")
    marks = np.zeros(1 << MAP_BITS, dtype=bool)
    marks[[r[0] for r in wanted.select(slot).distinct().collect()]] = True  # at most 2**MAP_BITS slots
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))
    names = ["set_id", "elements"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(shared.value).astype(bool)
        seen: set[int] = set()
        for batch in batches:
            ids, sets, held = [], [], 0
            for _, s in _sets(batch.column(0), size):
                name = set_id(s)
                if name not in seen and marked[name % (1 << MAP_BITS)]:
                    seen.add(name)
                    ids.append(name)
                    sets.append(s.tobytes())
                    held += s.nbytes
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=names)
                        ids, sets, held = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=names)

    found = docs.select("text").mapInArrow(run, "set_id long, elements binary").join(wanted, "set_id", "left_semi")
    return found.groupBy("set_id").agg(F.first("elements").alias("elements"))


def _named(sets: DataFrame, prefix: str) -> DataFrame:
    return sets.select(*[F.col(c).alias(f"{prefix}{c}") for c in ("set_id", "n", *SKETCH)])


def _sketch_of(x: str) -> list[Column]:
    return [F.col(f"{x}{k}") for k in SKETCH]


def _fit(x: str, y: str, percent: int) -> Column:
    return may_link(F.col(f"{x}n"), F.col(f"{y}n"), _sketch_of(x), _sketch_of(y), percent)


def sampled(sets: DataFrame) -> DataFrame:
    """(set_id, n, elements): of each set the elements whose hash falls in one of SAMPLE parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(1).to_pylist()]
            parts = [s[mix64(s) % np.uint64(SAMPLE) == 0].tobytes() for s in whole]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in whole], pa.int64()), pa.array(parts, pa.binary())], names=["set_id", "n", "elements"])

    return sets.select("set_id", "elements").mapInArrow(run, "set_id long, n long, elements binary")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets link, or may link where sets (set_id, n, elements) hold only some of their elements:
    of what is left out the smaller set's rest may be shared, at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                s, t = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = np.concatenate([s, t])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum()) + min(n - len(s), m - len(t))
                keep.append(100 * shared >= percent * (n + m - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    one = sets.select(F.col("set_id").alias("a"), F.col("elements").alias("of_a"), F.col("n").alias("n_a"))
    two = sets.select(F.col("set_id").alias("b"), F.col("elements").alias("of_b"), F.col("n").alias("n_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets link. A part of each set rules out most of those that don't; the others' sets are
    compared in whole. Only sets of pairs are moved, but for some that share a slot of a broadcast of fixed size with one."""

    def of_pairs(sets: DataFrame, pairs: DataFrame) -> DataFrame:
        slot = lambda c: F.pmod(c, F.lit(1 << SLOT_BITS)).cast("int")
        slots = pairs.select(F.explode(F.array(slot(F.col("a")), slot(F.col("b")))).alias("slot")).distinct()
        return sets.join(F.broadcast(slots), slot(F.col("set_id")) == F.col("slot"), "left_semi")  # at most 2**SLOT_BITS rows

    likely = stage(compared(pairs, sampled(of_pairs(sets, pairs)), percent), "likely")
    whole = of_pairs(sets, likely).withColumn("n", (F.octet_length("elements") / 8).cast("long"))
    return compared(likely, whole, percent)


def components(edges: DataFrame) -> DataFrame:
    """(set_id, label) for the ends of edges (a, b): label is the least id of the component.

    Each round takes the least label among neighbours, then that label's own label, so that chains halve.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "set_id"), "labels")
    while True:
        near = both.join(labels.select(F.col("set_id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("set_id") == F.col("a")).select("set_id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("set_id").alias("label"), F.col("label").alias("further"))
        after = stage(lower.join(jump, "label", "left").select("set_id", "was", F.least("label", "further").alias("label")), "labels")
        labels = after.select("set_id", "label")
        if after.where("label < was").isEmpty():
            return labels


#: Rounds in which each list is compared with a few of its sets, at most, and how many.
ROUNDS, PIVOTS = 2, 3


def set_components(docs: DataFrame, found: DataFrame, size: int, percent: int) -> DataFrame:
    """(set_id, label) of the sets that link with a different one; found: document_sets() of docs.

    Sets that share a key are candidates; sizes and sketches rule out nearly all that don't link, and full sets, read
    for what is left alone, decide. In each round every set of a list that is still in more than one component meets a
    few sets of it, others each time, and is compared with the likeliest of all of these: a group of near copies costs a
    few rows for each set and list, not one for each pair. After the rounds, what is still apart in a list is compared pair by pair, but for pairs compared before.
    """
    window = Window.partitionBy("key")
    lists = set_keys(docs, size, percent).withColumn("least", F.min("set_id").over(window)).withColumn("most", F.max("set_id").over(window))
    lists = stage(lists.where("least <> most").select("key", "set_id").distinct(), "lists")
    sketches = found.select("set_id", F.col("n_shingles").alias("n"), *SKETCH).distinct().join(lists.select("set_id").distinct(), "set_id", "left_semi")
    sketches = stage(sketches, "sketches")
    x, y = _named(sketches, "x_"), _named(sketches, "y_")
    spark = docs.sparkSession
    nothing = spark.createDataFrame([], "a long, b long")
    tested = edges = nothing
    sets = spark.createDataFrame([], "set_id long, elements binary")
    labels = spark.createDataFrame([], "set_id long, label long")
    last = False
    for round_ in range(ROUNDS + 1):
        last = last or round_ == ROUNDS
        named = lists.join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
        named = named.withColumn("low", F.min("label").over(window)).withColumn("high", F.max("label").over(window)).where("low <> high")
        pivots = [F.min(F.struct(F.xxhash64(F.lit(PIVOTS * round_ + k), F.col("set_id")).alias("h"), "set_id", "label")).over(window) for k in range(PIVOTS)]
        open_ = stage(named.select("key", "set_id", "label", F.array(*pivots).alias("pivots")), "open")
        if open_.isEmpty():
            break
        if last:
            one = open_.drop("pivots").join(x, F.col("set_id") == F.col("x_set_id")).drop("x_set_id")
            two = open_.select("key", F.col("set_id").alias("other"), F.col("label").alias("other_label")).join(y, F.col("other") == F.col("y_set_id")).drop("y_set_id")
            apart = (F.col("set_id") < F.col("other")) & (F.col("label") != F.col("other_label")) & _fit("x_", "y_", percent)
            pairs = one.join(two, "key").where(apart).select(F.col("set_id").alias("a"), F.col("other").alias("b"))
        else:
            star = open_.select("set_id", "label", F.explode("pivots").alias("pivot")).where("label <> pivot.label")
            star = star.select("set_id", F.col("pivot.set_id").alias("other")).distinct()
            near = star.join(x, F.col("set_id") == F.col("x_set_id")).join(y, F.col("other") == F.col("y_set_id")).where(_fit("x_", "y_", percent))
            near = near.select("set_id", F.least("set_id", "other").alias("a"), F.greatest("set_id", "other").alias("b"), differing(_sketch_of("x_"), _sketch_of("y_")).alias("differ"))
            best = near.join(tested, ["a", "b"], "left_anti").groupBy("set_id").agg(F.min(F.struct("differ", "a", "b")).alias("best"))
            pairs = best.select("best.a", "best.b")
        pairs = stage(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        ends = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
        missing = stage(ends.join(sets.select("set_id"), "set_id", "left_anti"), "missing")
        if not missing.isEmpty():
            sets = sets.unionByName(stage(needed_sets(docs, missing, size), "sets"))
        fresh = stage(linked(pairs, sets, percent), "edges")
        tested, edges = tested.unionByName(pairs), edges.unionByName(fresh)
        linked_some = not fresh.isEmpty()
        if linked_some:
            labels = components(edges)
        if last:
            break
        last = not linked_some
    return labels


def similar_components(docs: DataFrame, size: int = 4, percent: int = 85, keep: tuple[str, ...] = ()) -> DataFrame:
    """The component of each document under links of 100 |A and B| >= percent |A or B|.

    docs: doc_id, text, and the columns of `keep`, which are passed on. A document's set is its distinct n-grams of
    `size` words, A-Z in lower case; all its words as one where they are fewer. Returns doc_id, n_shingles,
    component_id (the smallest doc_id that links reach; null doc_ids are passed over), component_key (a name of the
    component, null without words) and `keep`, a row for each document. Documents without words link with nothing, not even each other: component_id is their own doc_id.
    Repeated rows and copies are of one component. 64-bit hashes stand for words, n-grams and sets; pairs are compared
    on full sets of n-grams.
    """
    found = stage(document_sets(docs, size, ["doc_id", *keep]), "documents")
    labels = set_components(docs, found, size, percent)
    named = found.where("n_shingles > 0").join(labels, "set_id", "left").withColumn("__label", F.coalesce("label", "set_id"))
    least = named.groupBy("__label").agg(F.min("doc_id").alias("component_id"))
    cols = ["doc_id", "n_shingles", "component_id", "component_key", *keep]
    out = named.join(least, "__label").withColumn("component_key", F.col("__label")).select(*cols)
    empty = found.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("component_key", F.lit(None).cast("long"))
    return out.unionByName(empty.select(*cols))


def first_of_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: of the smallest doc_id (null last), the first in the input. Rows without
    words stay. Rows are told apart by their place in the input, which must read alike each time."""
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    found = similar_components(numbered.select("doc_id", "text", "__row"), size, percent, keep=("__row",))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row")
    first = found.where("component_key IS NOT NULL").groupBy("component_key").agg(F.min(place).alias("first")).select(F.col("first.__row").alias("__row"))
    # Fewer rows go than stay, so those that go are what texts are held against.
    gone = stage(found.where("component_key IS NOT NULL").select("__row").join(first, "__row", "left_anti"), "gone-rows")
    return numbered.join(gone, "__row", "left_anti").select(*docs.columns)
