"""How filters of whole texts interact: what each removes alone, after others, and in every order."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Filters by letter; bit k of a mask is the k-th. E is "repeats a text of a smaller doc_id".
FILTERS = "ABCDE"
#: Code points at which a text's blocks end; the last block is the rest.
BLOCK_ENDS = (128, 1024, 8192)
_MARKS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def failures(text: str) -> int:
    """The mask of the filters A to D that a text fails: too few words, too few distinct ones, too many capitals, odd marks."""
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII white space alone
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 3 * len(text)) << 2 | (_MARKS.search(raw) is not None) << 3


def text_facts(numbered: DataFrame) -> DataFrame:
    """(row, doc_id, part, mask, length, block_0 ...) of each text, from row, doc_id, part, text: what later steps need of it."""
    fields = [pa.field("row", pa.int64()), pa.field("doc_id", pa.int64()), pa.field("part", pa.string()), pa.field("mask", pa.int32()), pa.field("length", pa.int64())]
    fields += [pa.field(f"block_{k}", pa.int64()) for k in range(len(BLOCK_ENDS) + 1)]
    edges = list(itertools.pairwise((0, *BLOCK_ENDS, None)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def block(text: str, a: int, b: int | None) -> int:
            return xxhash.xxh3_64_intdigest(text[a:b].encode()) - (1 << 63) if a < len(text) else 0

        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            columns = [*batch.columns[:3], pa.array(map(failures, texts), pa.int32()), pa.array(map(len, texts), pa.int64())]
            columns += [pa.array([block(t, a, b) for t in texts], pa.int64()) for a, b in edges]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    schema = "row long, doc_id long, part string, mask int, length long, " + ", ".join(f"block_{k} long" for k in range(len(BLOCK_ENDS) + 1))
    return numbered.select("row", "doc_id", "part", "text").mapInArrow(run, schema)


def repeated_rows(facts: DataFrame, numbered: DataFrame) -> DataFrame:
    """The rows whose text stands under a smaller doc_id too, by partition refinement.

    Texts are split by length in code points, then by the hashes of successive blocks; after each split, texts that are alone
    in their class go. Full texts of what is left are compared with that of the class's smallest doc_id: equal ones are
    settled, others (hashes that met by chance) go round again among themselves. A class is never gathered: its size
    and smallest row come from partial aggregates, and rows meet them by joins that Spark may split.
    """
    blocks = [c for c in facts.columns if c.startswith("block_")]
    alive, keys = facts.select("row", "doc_id", "length", *blocks).where("doc_id IS NOT NULL"), ["length"]
    for block in [*blocks, None]:
        shared = alive.groupBy(*keys).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(*keys)
        alive = stage(alive.join(shared, keys, "left_semi"), "audit-classes")
        keys = [*keys, block] if block else keys

    spark, found = facts.sparkSession, []
    texts = numbered.select("row", F.coalesce("text", F.lit("")).alias("text"))
    # Merged at any size: what is left grows with the input, so its broadcast would end somewhere.
    open_rows = stage(alive.select("row", "doc_id", *keys).join(texts.hint("merge"), "row"), "audit-texts", "zstd")
    while not open_rows.isEmpty():
        first = open_rows.groupBy(*keys).agg(F.min(F.struct("doc_id", "row")).alias("f")).select("f.row", F.col("f.doc_id").alias("first_id"))
        first = open_rows.join(first, "row").select(*keys, "first_id", F.col("text").alias("first_text"))
        told = open_rows.join(first.hint("merge"), keys).select("row", "doc_id", "first_id", (F.col("text") == F.col("first_text")).alias("same"))
        told = stage(told, "audit-told")
        found.append(told.where("same AND doc_id > first_id").select("row"))
        if told.where("NOT same").isEmpty():
            break
        open_rows = stage(open_rows.join(told.where("NOT same").select("row"), "row", "left_semi"), "audit-texts", "zstd")
    rows = found[0] if found else spark.createDataFrame([], "row long")
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Tells for each part and each order of the five filters what every step removes.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic (more columns are ignored). Null texts are empty, null langs
    part ''. Returns part, filter_order, step and counts of documents: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley; a part has 600 rows. Empty docs give no rows. A null doc_id is neither smaller nor larger than
    any, so its text counts for no other and it is no repeat; rows of one doc_id don't repeat each other. A doc_id that
    labels hold more than once is good, or toxic, if any of its rows says so; null labels say nothing.

    Each text is read once for its mask; repeats come from repeated_rows(). Documents are then counted by (part, mask) in
    partial aggregates, 32 masks a part, and all orders follow from these counts.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    facts = stage(text_facts(numbered), "audit-facts")
    repeats = repeated_rows(facts, numbered).select("row", F.lit(1 << 4).alias("repeat"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    masked = facts.join(repeats, "row", "left").withColumn("mask", F.col("mask").bitwiseOR(F.coalesce("repeat", F.lit(0))))
    counts = masked.select("doc_id", "part", "mask").join(marks, "doc_id", "left")
    counts = counts.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return every_order(counts)


def every_order(counts: DataFrame) -> DataFrame:
    """All orders of the filters for each part, from counts by mask: part, mask, n, good, toxic."""
    masks = F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks")  # 2^5 at most
    steps = []
    for order in itertools.permutations(range(len(FILTERS))):
        done = 0
        for k, f in enumerate(order):
            steps.append(F.struct(F.lit("".join(FILTERS[i] for i in order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(1 << f).alias("own"), F.lit(done).alias("done")))
            done |= 1 << f
    parts = counts.groupBy("part").agg(masks).select("part", "masks", F.explode(F.array(*steps)).alias("s")).select("part", "masks", "s.*")

    def total(chosen, value: str = "n") -> Column:
        return F.aggregate(F.filter("masks", lambda m: chosen(m["mask"])), F.lit(0).cast("long"), lambda acc, m: acc + m[value])

    own, done = F.col("own"), F.col("done")
    fails = lambda m: m.bitwiseAND(own) != 0
    lost = lambda m: fails(m) & (m.bitwiseAND(done) == 0)
    # Of the orders of a document's failed filters, each filter comes first in an equal share.
    orders = F.aggregate(F.filter("masks", lambda m: fails(m["mask"])), F.lit(0).cast("long"), lambda acc, m: acc + (m["n"] * 120 / F.bit_count(m["mask"])).cast("long"))
    return parts.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: m.bitwiseAND(own.bitwiseOR(done)) == 0).alias("kept"),
        total(lost).alias("removed"),
        total(lambda m: fails(m) & (m.bitwiseAND(done) != 0)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"),
        total(lost, "good").alias("good_lost"),
        total(lost, "toxic").alias("toxic_lost"),
        orders.alias("shapley"),
    )


ORACLE = r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
    ), w AS (
        SELECT *, min(doc_id) OVER (PARTITION BY t) AS first_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d
    ), f AS (
        SELECT doc_id, part,
               (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) AS a,
               (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 1 ELSE 0 END) AS b,
               (CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 1 ELSE 0 END) AS c,
               (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END) AS d,
               (CASE WHEN doc_id > first_id THEN 1 ELSE 0 END) AS e
        FROM w
    ), l AS (
        SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
        FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
    ), m AS (
        SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
        FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL
    ), orders(o) AS (
        SELECT '' UNION ALL
        SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)
    ), s AS (
        SELECT part, o AS filter_order, step, n, good, toxic, fails,
               fails[ascii(o[step]) - 64] AS own,
               list_sum([0] || list_transform(range(1, step), lambda i: fails[ascii(o[i]) - 64])) AS before
        FROM m, (SELECT o FROM orders WHERE length(o) = 5), (SELECT unnest(range(1, 6)) AS step)
    ), r AS (
        SELECT part, filter_order, step,
               sum(CASE WHEN own = 0 AND before = 0 THEN n ELSE 0 END)::BIGINT AS kept,
               sum(CASE WHEN own = 1 AND before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
               sum(CASE WHEN own = 1 AND before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
               sum(CASE WHEN own = 1 AND list_sum(fails) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
               sum(CASE WHEN own = 1 AND before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
               sum(CASE WHEN own = 1 AND before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
        FROM s GROUP BY ALL
    )
    SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley
    FROM r"""
