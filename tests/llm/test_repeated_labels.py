"""The quality network learns from every labelled document, however often rows before it are repeated."""

from factorloom.llm import quality


def test_repeats_crowd_out_no_labelled_document(spark, tmp_path, monkeypatch):
    ids = list(range(12))
    rows = [(0, "the first text")] * 200 + [(i, f"text number {i} " + "word " * i) for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    labels = spark.createDataFrame([(0, 1)] * 50 + [(i, i % 2) for i in ids], "doc_id long, quality int")
    docs = spark.read.parquet(str(tmp_path / "docs"))
    learnt = {i: q for i, q in labels.where(~quality.held_out(labels.doc_id)).collect()}
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x, y)) or fit(x, y))
    most = len(ids) + 1  # doc 0 has two labels
    assert quality.score_quality(docs, labels, most_labelled=most).count() == len(rows)
    x, y = seen[0]
    # doc 0: two texts, each by its labels 0 and 1 (where it is learnt from); the others once.
    want = sum(1 for i in learnt if i) + (4 if 0 in learnt else 0)
    assert len(x) == len(y) == want
