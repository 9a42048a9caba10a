"""The registered queries over whole small tables, against SQL; and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from factorloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(r[c] for c in cols) for r in df.collect())
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert got == sorted(want) and got


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        if k == 0:
            left = {r["doc_id"] for r in docs.collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in left for i in good) >= 0.97 * len(good) and len(left) < before
    assert counts[1] == counts[0] and counts[2] <= counts[1] and counts[4] > 0
    assert corpus_pipeline.run(spark, sf).count() == counts[4]
