"""From raw documents to packed sequences: five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs;
a stage frees the scratch tables of the stage before it. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import common, line_dedup, mixing, ngram_join, packing, quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def _aside(docs: DataFrame, made: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs whose columns by names that a stage makes itself stand under others, and what gives docs' columns back."""
    moved = {c: f"{c}__own" for c in docs.columns if c in made}
    return docs.withColumnsRenamed(moved), lambda out: out.select(*[F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns])


def _scoped(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, "pipeline")
        common.give_back(spark)
        with common.scope("pipeline"):
            return stage(spark, docs, sf_dir)

    run_stage.__name__ = stage.__name__
    run_stage.__doc__ = stage.__doc__
    return run_stage


@_scoped
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, back = _aside(docs, ("held_out", "score", "predicted"))
    return back(quality.score_quality(docs, labels, threshold=0.3).where("predicted = 1"))


@_scoped
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that share four fifths of their words with an earlier line go; documents stay."""
    docs, back = _aside(docs, ("n_lines", "n_removed"))
    return _recounted(back(line_dedup.dedup_lines(docs, percent=80)))


@_scoped
def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word n-grams, Jaccard 0.8 and more."""
    return ngram_join.first_of_components(docs, size=5, percent=80)


@_scoped
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken, in part or twice, until sources have their target shares."""
    return _recounted(mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, max_repeat=2.0))


@_scoped
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are encoded and packed into sequences of 1024 ids, a row for each piece."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0, cache_runs=200_000)  # workers keep other stages' memory, too
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: A fitted network stands at the beginning, which SQL can't express; tests hold the stages after it against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = stage(spark, docs, sf_dir)
        with common.scope("pipeline-run"):
            docs = common.stage(done, name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
