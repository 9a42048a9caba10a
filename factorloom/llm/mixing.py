"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_RE, hash_order, running_total, stage, word_count

#: 2**32 over the golden ratio, odd: its multiples modulo 2**32 are the golden-ratio sequence in integers.
GOLDEN_32 = 2654435769
ONE_32 = 1 << 32
CELL_SHIFT = 20  # the unit interval in 4096 cells
#: Rows, about, that a window brings together in one group, at most.
TOGETHER = 1 << 17


def golden_point(n):
    """n -> frac(n / golden ratio) in 2**-32 steps; halves of n keep every product below 2**63."""
    lo, hi = n.bitwiseAND(F.lit(0xFFFF)), F.shiftright(n, 16).bitwiseAND(F.lit(0xFFFF))
    high = F.shiftleft((hi * F.lit(GOLDEN_32)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (lo * F.lit(GOLDEN_32) + high).bitwiseAND(F.lit(ONE_32 - 1))


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """One row per source: source, rank, source_size, target, and its share of the unit interval as [lo, hi).

    Targets share `share` times all sizes by weight and stop at `max_repeat` times the source's size; the excess is
    reshared among the rest until none is above. With sources in order of cap / weight, that level is the largest of
    (budget - caps before) / (weights from here on). The windows span the table of sources, never documents.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("source_rank", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_rank") % len(weights)) + 1)
    ranked = ranked.withColumn("weight", w).withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    whole = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levelled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    out = levelled.withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
    upto = F.sum("target").over(Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("target").over(whole)
    hi = F.when(total > 0, F.least(F.floor(upto / F.when(total > 0, total) * F.lit(float(ONE_32))), F.lit(ONE_32))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("hi", hi)
    out = out.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("source_rank")), F.lit(0)).cast("long"))
    return out.select("source", "source_rank", "source_size", "target", "lo", "hi")


def mix_to_weights(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_repeat: float = 2.0, block_words: int = 128, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Draws documents so that sources come near target shares, in a reproducible order.

    docs: doc_id, text, source (more columns are ignored). Returns three tables:
    * placed: doc_id, source, source_rank, size (words), order (its hash), doc_start (the words of its source before it in
      shuffled order) - one row per document;
    * sources: source, source_rank, source_size, target and its interval;
    * pieces: slot, source_rank, epoch, doc_id, size, order, doc_start, word_start, words - what each slot of the schedule
      takes.

    Slot n stands at the n-th golden-ratio point; cumulative targets map it to a source, its rank among the source's
    slots to a block of `block_words` words of the shuffled source, wrapping round for a second pass. A source's slots
    end at its target, rounded down; slots that it lacks until then follow at the end of the schedule, source by source. Null sources are a source; null or empty texts have size 0 and are never taken; equal rows are
    taken on their own. An empty table gives empty tables. The same rows give the same mix.
    """
    spark = docs.sparkSession
    order = hash_order(F.lit(seed), F.col("doc_id"), F.col("text"))
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("order")), "mix-sized")
    bits = min(40, max(10, (sized.count() // TOGETHER).bit_length()))  # of the order, as buckets of about TOGETHER documents at most
    sized = sized.withColumn("bucket", F.shiftright("order", 63 - bits))
    sources = stage(source_targets(sized, weights, share, max_repeat), "mix-sources")
    known = sources.select(F.col("source").alias("__source"), "source_rank")
    ranked_docs = sized.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    placed = stage(running_total(ranked_docs, ["source_rank"], "bucket", ["order", "doc_id", "size"], "size", "doc_start"), "mix-placed")
    total, n_sources = sources.agg(F.sum("target"), F.count(F.lit(1))).first()
    block = F.lit(block_words)

    slots_wanted = math.ceil((total or 0) / block_words)
    n_slots = math.ceil(slots_wanted * 1.01) + 16 * n_sources if slots_wanted else 0
    # Beyond 2**32 slots the sequence of points begins again, so a source's share of them stays what it is.
    chunk = max(1, min(math.ceil(n_slots / 1024), TOGETHER))
    points = spark.range(1, n_slots + 1).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point"), F.floor(F.col("id") / chunk).alias("chunk"))
    points = points.withColumn("cell", F.shiftright("point", CELL_SHIFT))
    cells = sources.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.shiftright("lo", CELL_SHIFT), F.shiftright(F.col("hi") - 1, CELL_SHIFT))))
    drawn = points.join(cells, "cell").where("point >= lo AND point < hi").select("slot", "chunk", "source_rank", "source_size", F.floor("target").cast("long").alias("target"), F.lit(1).alias("one"))
    ranked = running_total(drawn, ["source_rank"], "chunk", ["slot"], "one", "rank")
    n_blocks = F.ceil(F.col("source_size") / block)
    # The short last block of a pass takes a slot too, and small sources may get few: what is lacking stands at the end.
    needed = F.expr("target div source_size") * n_blocks + F.ceil(F.expr("target % source_size") / block)
    counts = drawn.groupBy("source_rank").agg(F.count(F.lit(1)).alias("got"))
    ends = sources.where("source_size > 0").select("source_rank", "source_size", F.floor("target").cast("long").alias("target")).join(counts, "source_rank", "left")
    ends = ends.withColumn("got", F.coalesce("got", F.lit(0)).cast("long")).withColumn("lacks", F.greatest(needed - F.col("got"), F.lit(0)).cast("long"))
    ends = ends.withColumn("upto", F.sum("lacks").over(Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, 0))).where("lacks > 0")
    ends = ends.withColumn("rank", F.explode(F.expr("sequence(got, got + lacks - 1)")))
    ends = ends.withColumn("slot", F.lit(n_slots) + F.col("upto") - F.col("lacks") + F.col("rank") - F.col("got") + 1)
    columns = ["slot", "source_rank", "source_size", "target", "rank"]
    ranked = ranked.select(*columns).unionByName(ends.select(*columns))
    ranked = ranked.withColumn("epoch", F.floor(F.col("rank") / n_blocks)).withColumn("block", F.col("rank") % n_blocks)
    left = F.col("target") - F.col("epoch") * F.col("source_size") - F.col("block") * block
    ranked = ranked.withColumn("take", F.least(left, block.cast("long"))).where("take > 0")

    first, last = F.floor(F.col("doc_start") / block), F.floor((F.col("doc_start") + F.col("size") - 1) / block)
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    cut = cut.withColumn("from", F.greatest("doc_start", F.col("block") * block)).withColumn("to", F.least(F.col("doc_start") + F.col("size"), (F.col("block") + 1) * block))
    taken = cut.join(ranked.select("source_rank", "block", "slot", "epoch", "take"), ["source_rank", "block"])
    words = F.least("to", F.col("block") * block + F.col("take")) - F.col("from")
    pieces = taken.select("slot", "source_rank", "epoch", "doc_id", "size", "order", "doc_start", (F.col("from") - F.col("doc_start")).alias("word_start"), words.cast("long").alias("words")).where("words > 0")
    return placed, sources, pieces


def words_taken(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted)."""
    placed, sources, pieces = mix_to_weights(docs, **options)
    rows = placed.join(sources.select("source_rank", "source_size", "target"), "source_rank")
    got = pieces.groupBy("source_rank", "doc_start").agg(F.sum("words").alias("taken"))
    # A document's place in its source is its key. Documents of no words share theirs with the next, and take nothing.
    rows = rows.join(got, ["source_rank", "doc_start"], "left")
    taken = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of `docs`: a row for each pass that takes words of a document.

    A pass that takes part of a document keeps its leading words, as written (blocks end inside documents). Rows come in
    no order; mix_to_weights has the schedule. Documents of no words are never drawn.
    """
    options = {"seed": 17} | options
    _, _, pieces = mix_to_weights(docs, **options)
    order = hash_order(F.lit(options["seed"]), F.col("doc_id"), F.col("text"))
    passes = pieces.groupBy("order", "doc_id", "size", "doc_start", "epoch").agg(F.sum("words").alias("words"))
    # Equal documents have equal keys: the n-th of them takes what the n-th place gives.
    nth = F.dense_rank().over(Window.partitionBy("order", "doc_id").orderBy("doc_start"))
    passes = passes.select(F.col("order").alias("__order"), F.col("doc_id").alias("__doc_id"), nth.alias("__nth"), F.col("size").alias("__size"), F.col("words").alias("__words"))
    own = docs.withColumn("__own_order", order)
    own = own.withColumn("__own_nth", F.row_number().over(Window.partitionBy("__own_order", "doc_id").orderBy(F.lit(1))))
    both = own.join(passes, (F.col("__own_order") == F.col("__order")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("__own_nth") == F.col("__nth")))
    cut = F.array_join(F.slice(F.split("text", rf"(?<={WORD_RE[:-1]})(?=[\x20\x09-\x0D])"), 1, F.col("__words").cast("int")), "")
    text = F.when(F.col("__words") < F.col("__size"), cut).otherwise(F.col("text"))
    return both.withColumn("text", text).select(*docs.columns)
