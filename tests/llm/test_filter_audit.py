"""The filter audit against plain Python: hard rows, clashing columns, hashes that meet, empty tables."""

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factorloom.llm import filter_audit


def plain_masks(rows):
    """The mask of each (doc_id, text), by the definitions."""
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t in rows:
        words = [w for w in _split(t or "") if w]
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t or "") > 3 * len(t or ""), any(c in "#$%&*|" for c in t or ""), i is not None and first[t or ""] < i]
        out.append(tuple(fails))
    return out


def _split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return text.split(" ")


def plain_audit(rows, labels):
    """rows: doc_id, text, lang; labels: doc_id -> (good, toxic)."""
    masks = plain_masks([(r[0], r[1]) for r in rows])
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], m) for r, m in zip(rows, masks, strict=True) if (r[2] or "") == part]
        removed = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order):
                k = "ABCDE".index(f)
                gone = [x for x in left if x[1][k]]
                seen = {id(x) for x in left}
                left = [x for x in left if not x[1][k]]
                lost = [labels.get(i, (0, 0)) for i, _ in gone]
                out[part, "".join(order), step + 1] = [len(left), len(gone), sum(x[1][k] and id(x) not in seen for x in mine), sum(x[1][k] and sum(x[1]) == 1 for x in mine), sum(g for g, _ in lost), sum(t for _, t in lost)]
                removed[f] += len(gone)
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                out[part, "".join(order), step + 1].append(removed[f])
    return out


def rows_of(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in df.collect()}


@pytest.fixture(scope="module")
def table(spark, hard, tmp_path_factory):
    """The hard rows, long copies, texts of one length that differ in their last block only, and columns named like inner ones."""
    long = "word " * 2000
    more = [(200 + i, long, "en") for i in range(4)] + [(210, long[:-2] + "x ", None), (211, long[:-2] + "y ", ""), (212, long[:-2] + "x ", "de")]
    more += [(220, "A B C # " * 60, "de"), (221, "A B C # " * 60, "fr"), (None, long, "en"), (222, "漢" * 300, "zh"), (223, "漢" * 300, "zh")]
    extra = spark.createDataFrame(more, "doc_id long, text string, lang string")
    path = str(tmp_path_factory.mktemp("audit") / "documents.parquet")
    both = hard.select("doc_id", "text", "lang").unionByName(extra)
    both.select("*", *[F.lit(1).alias(c) for c in ("row", "part", "mask", "length", "block_0", "good")]).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, i % 3 == 0) for i in range(100)] + [(200, 1, 1), (201, 0, 0), (201, 1, 0), (202, None, 1), (None, 1, 1), (7, None, None)]
    return spark.createDataFrame([(i, q, None if t is None else int(t), 9) for i, q, t in rows], "doc_id long, quality int, toxic int, n long")


def marks(labels):
    out = {}
    for r in labels.collect():
        if r["doc_id"] is not None:
            g, t = out.get(r["doc_id"], (0, 0))
            out[r["doc_id"]] = max(g, int(r["quality"] == 1)), max(t, int(r["toxic"] == 1))
    return out


def test_against_plain_python(table, labels):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in table.collect()]
    got = rows_of(filter_audit.audit_filters(table, labels))
    assert got == plain_audit(rows, marks(labels)) and len(got) % 600 == 0
    assert any(v[4] for v in got.values()) and any(v[2] for v in got.values())


def test_hashes_that_meet(spark, table, monkeypatch):
    """With blocks that say nothing, only lengths and the full texts tell repeats."""
    facts = filter_audit.text_facts(table.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.lit("p").alias("part"), "text"))
    facts = facts.select("row", "doc_id", "part", "mask", "length", *[F.lit(0).cast("long").alias(f"block_{k}") for k in range(4)])
    numbered = table.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    got = sorted(r["row"] for r in filter_audit.repeated_rows(facts, numbered).collect())
    rows = numbered.collect()
    want = sorted(r["row"] for r, m in zip(rows, plain_masks([(r["doc_id"], r["text"]) for r in rows]), strict=True) if m[4])
    assert got == want and got


def test_empty(spark, empty, labels):
    got = filter_audit.audit_filters(empty, labels)
    assert got.count() == 0 and "shapley" in got.columns
    nobody = filter_audit.audit_filters(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), labels.limit(0))
    assert nobody.count() == 600 and nobody.where("good_lost <> 0 OR part <> ''").count() == 0
