"""Each stage of the pipeline over a written table of hard rows, against plain Python; clashing columns; empty tables."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_llm_operators import WORD, jaccard_components, near_lines, plain_ids, rows_of, targets

import corpus_pipeline
from factorloom.llm import quality

#: Names that stages use themselves.
CLASH = ("held_out", "score", "predicted", "n_lines", "n_removed", "taken", "set_id", "label", "component_id", "row", "rest")
STAGES = [stage for _, stage in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def folder(spark, hard, tmp_path_factory):
    """documents and labels; each clashing column holds the row's tag."""
    d = str(tmp_path_factory.mktemp("stages"))
    rows = hard.where("doc_id IS NULL OR doc_id <> 99").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.concat(F.lit("tag"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias("tag"))
    rows.select("*", *[F.col("tag").alias(c) for c in CLASH]).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 90)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def staged(spark, stage, docs, folder, tmp_path):
    stage(spark, docs, folder).write.parquet(str(tmp_path / "out"))
    return spark.read.parquet(str(tmp_path / "out"))


def own_columns(out, docs):
    """The columns of documents, each clashing one still with its row's tag."""
    assert out.columns == docs.columns
    for r in out.select("tag", *CLASH).collect():
        assert set(r) == {r["tag"]}


def test_quality_stage(spark, docs, folder, tmp_path):
    out = staged(spark, STAGES[0], docs, folder, tmp_path)
    own_columns(out, docs)
    scored = quality.score_quality(docs.select("doc_id", "text", "tag"), spark.read.parquet(f"{folder}/labels.parquet"), threshold=0.3)
    assert Counter(rows_of(out, "tag", "text")) == Counter(rows_of(scored.where("score >= 0.3"), "tag", "text"))


def test_line_stage(spark, docs, folder, tmp_path):
    out = staged(spark, STAGES[1], docs, folder, tmp_path)
    own_columns(out, docs)
    plain = rows_of(docs, "doc_id", "text")
    gone = near_lines(plain)
    want = Counter()
    for i, t in plain:
        left = None if t is None else "\n".join(x for m, x in enumerate(t.split("\n")) if (i, m) not in gone)
        want[i, left, None if left is None else len(left)] += 1
    assert gone and Counter(rows_of(out, "doc_id", "text", "n_chars")) == want


def test_near_copy_stage(spark, docs, folder, tmp_path):
    out = staged(spark, STAGES[2], docs, folder, tmp_path)
    own_columns(out, docs)
    parts = jaccard_components(rows_of(docs, "doc_id", "text"), 5, 80)
    want = Counter({c for _, n, c in parts if n}) + Counter(i for i, n, _ in parts.elements() if not n)
    assert Counter(i for (i,) in rows_of(out, "doc_id")) == want and sum(want.values()) < docs.count()
    assert set(rows_of(out, "doc_id", "text")) <= set(rows_of(docs, "doc_id", "text"))


def test_mixing_stage(spark, docs, folder, tmp_path):
    out = staged(spark, STAGES[3], docs, folder, tmp_path)
    own_columns(out, docs)
    size, source, taken, by_source = {}, {}, Counter(), defaultdict(int)
    for i, t, s in rows_of(docs, "doc_id", "text", "source"):
        size[i], source[i] = len(WORD.findall(t or "")), s
        by_source[s] += size[i]
    texts = {i: t for i, t in rows_of(docs, "doc_id", "text")}
    for i, t, n in rows_of(out, "doc_id", "text", "n_chars"):
        assert WORD.findall(t) == WORD.findall(texts[i]) or t in texts[i]
        assert n == len(t)
        taken[i] += len(WORD.findall(t))
    assert all(taken[i] <= 2 * size[i] for i in taken)
    got, want = Counter(), targets(by_source)
    for i, n in taken.items():
        got[source[i]] += n
    assert all(want[s] - 1 <= got[s] <= want[s] for s in want)


def test_packing_stage(spark, docs, folder, tmp_path):
    out = staged(spark, STAGES[4], docs, folder, tmp_path)
    rows = rows_of(docs, "doc_id", "text")
    tokens = dict(zip([i for i, _ in rows], map(len, plain_ids([t or "" for _, t in rows]))))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out.collect():
        assert r["doc_tokens"] == tokens[r["doc_id"]] + 1
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == {i for i, _ in rows}
    for i, parts in pieces.items():
        ends = [0, *[a + n for a, n in sorted(parts)]]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] == tokens[i] + 1
    for parts in sequences.values():
        ends = [0, *[a + n for a, n in sorted(parts)]]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024


@pytest.mark.parametrize("k", range(len(STAGES)))
def test_empty_tables(spark, docs, folder, tmp_path, k):
    spark.createDataFrame([], docs.schema).write.parquet(str(tmp_path / "none"))
    none = spark.read.parquet(str(tmp_path / "none"))
    out = staged(spark, STAGES[k], none, folder, tmp_path)
    assert out.count() == 0 and (k == len(STAGES) - 1 or out.columns == docs.columns)
