"""The training-data operators over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_output, chat, disclosure, exact_dedup, filter_audit, line_dedup, mixing, ngram_join, packing, quality, rindex_dedup, token_alignment, topk
from .common import new_path

Query = Callable[[SparkSession, str], DataFrame]
BPE = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.words_taken(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_repeat=2.0)
    return got.select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = binary_output.write_tokens(_table(spark, sf_dir, "documents"), new_path(spark, "tokens"), public_tokenizers.path(BPE), end_id=2)
    read = binary_output.read_tokens(spark, manifest)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE), window=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    tokenizer = public_tokenizers.path(BPE)
    return chat.conversation_digests(chat.format_conversations(rows.unionByName(extra), tokenizer), tokenizer)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), percent=80)
    return got.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rindex_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=100)
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ngram_join.similar_components(_table(spark, sf_dir, "documents"), size=4, percent=85)
    return got.select("doc_id", "n_shingles", "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.score_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"), threshold=0.3)
    return got.select("doc_id", "held_out", "score", "predicted")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.span_digests(disclosure.find_personal_data(_table(spark, sf_dir, "documents")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_alignment.align_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE), public_tokenizers.path("piece_bpe_32k.model"))
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mix_sources, op2_token_output, op3_pack_sequences, op4_exact_top_k, op5_exact_dedup, op6_chat_format, op7_line_dedup, op8_suffix_dedup, op9_ngram_jaccard, op10_quality, op11_filter_audit, op12_personal_data, op13_token_alignment)}

ORACLES: dict[str, str] = {
    "op4_exact_top_k": """
        WITH v AS (
            SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.row AS query_row, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.row <> q.row
        ), r AS (
            SELECT query_id, (row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size,
               (t.doc_id IS NOT DISTINCT FROM g.keep_id AND row_number() OVER (PARTITION BY t.norm, t.doc_id) = 1) AS kept,
               sha256(t.norm) AS text_sha256
        FROM t JOIN g ON t.norm = g.norm""",
    "op11_filter_audit": filter_audit.ORACLE,
}

