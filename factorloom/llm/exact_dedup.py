"""Exact dedup of whole texts by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, stage

#: Salts of a digest group. A hot group meets in this many tasks, each fed one row by each task of the scan.
SALTS = 64


def normalised(text):
    """A text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RE, " ")


def dedup_exact(docs: DataFrame, digest_bits: int = 256) -> DataFrame:
    """Says for each document which of the equal ones stays.

    docs: doc_id, text (more columns are ignored). Returns doc_id, keep_id (the smallest doc_id of the equal texts),
    group_size, kept, text_sha256 - one row per document, repeated rows too, of which one stays.

    Texts are combined in three steps, all keyed by digest and full content, so that a digest shared by different
    texts never merges them: inside each task of the scan (the partial aggregate), among the rows of a salt, and among
    the winners of the salts. Documents then take their winner by digest and SHA-256 of the content. digest_bits below
    256 shortens the digest, which forces collisions in tests.

    Null texts count as empty, and empty texts are equal. Null doc_ids are passed over for keep_id unless there is no
    other; then one of the rows stays. Repeated rows count each. An empty table gives an empty table.
    """
    sha = F.sha2(F.col("norm"), 256)
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("sha", sha).withColumn("digest", F.substring("sha", 1, digest_bits // 4))
    local = texts.withColumn("salt", F.spark_partition_id() % SALTS)
    salted = local.groupBy("digest", "salt", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = stage(merged.select("digest", F.sha2("norm", 256).alias("win_sha"), "keep_id", "group_size"), "dedup-winners")

    # Equal rows take one decision, so that a third of all rows being one row is one row here.
    rows = texts.groupBy("digest", "sha", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    decided = rows.join(winners, (rows["digest"] == winners["digest"]) & (rows["sha"] == winners["win_sha"]))
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    out = decided.select("doc_id", "keep_id", "group_size", F.col("sha").alias("text_sha256"), nth.alias("nth"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
