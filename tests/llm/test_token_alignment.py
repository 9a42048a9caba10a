"""Token alignment against plain Python over whole encodings."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factorloom.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), ta.TokenTable(A), ta.TokenTable(B)


def whole(encoders, text):
    """Groups of (A ids, B ids) of one text, from encodings of the whole; None without tokens."""
    a, b, table_a, table_b = encoders
    if not text:
        return None
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    said = (" " + text).encode()
    if b"".join(table_a.bytes[i] for i in x) != said or b"".join(table_b.bytes[i] for i in y) != said:
        return None
    ends = [np.cumsum([len(t.bytes[i]) for i in ids]).tolist() for t, ids in ((table_a, x), (table_b, y))]
    place = [{e: k + 1 for k, e in enumerate(side)} for side in ends]
    groups, i, j = [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        u, v = place[0][e], place[1][e]
        groups.append((x[i:u], y[j:v]))
        i, j = u, v
    assert (i, j) == (len(x), len(y))
    return groups


def expected(encoders, texts):
    groups = [whole(encoders, t) for t in texts]
    links = [Counter((x, y) for g, h in gs or [] for x in g for y in h) for gs in groups]
    counts = Counter(p for c in links for p in c)
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for gs, c in zip(groups, links, strict=True):
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in gs) if gs else None
        out.append((sum(len(g) for g, _ in gs or []), sum(len(h) for _, h in gs or []), len(gs or []), sum(c.values()), sum(n for p, n in c.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in c.items()), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


HARD = ["▁ is taken for a space", "line\r\nends);\r\n\r\nx", "tabs\t\tand \n mixed  \n\n   runs ", "<s> </s> <|endoftext|> <unk> <0x41>", "nul\x00here", "a  b c\x0bd\x0ce", "   ", " ", "\n", "é ü – ñ 漢字かな 😀👩‍👩‍👧", "́combining", "aaaa" * 300, " " * 300, "ab" * 400, "don't we'll 1234567 x=1;\n\treturn;"]
HARD = HARD[:-4] + HARD[-1:] + HARD[-4:-1]  # the ones that repeat a character come last


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("ab ZTh's\n\t\r ▁é漢1);\x0b"), min_size=1, max_size=40))
def test_runs_encode_as_the_whole(encoders, text):
    a, b = encoders[0].encode(" " + text, add_special_tokens=False).ids, encoders[1].encode(text)
    got = ta.pair_encoder(A, B).encode([" " + text])[0]
    if whole(encoders, text) is None:
        assert got is None
    else:
        assert [np.frombuffer(x, np.uint32).tolist() for x in got] == [a, b]


@pytest.fixture(scope="module")
def table(spark, hard, tmp_path_factory):
    rng = random.Random(1)
    rows = [(300 + i, t) for i, t in enumerate(HARD)] + [(400, " ".join(rng.choice(HARD[1:-3]) + str(rng.random()) for _ in range(1200)))]
    rows += [(401, "the same text twice")] * 2 + [(None, "no id"), (402, None)]
    both = hard.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    path = str(tmp_path_factory.mktemp("aligned") / "documents.parquet")
    both.select("*", *[F.lit(0).alias(c) for c in ("row", "side", "start", "ids", "pairs", "n", "best", "bucket")]).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("bucket", [200_000, 300])
def test_against_whole_encodings(spark, encoders, table, bucket, monkeypatch):
    monkeypatch.setattr(ta, "BUCKET_PAIRS", bucket)
    rows = table.select("doc_id", "text").collect()
    got = sorted(ta.align_tokens(table, A, B).collect(), key=lambda r: r["row"])
    want = expected(encoders, [r["text"] for r in rows])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    for g, w, r in zip(got, want, rows, strict=True):
        assert tuple(g)[2:9] == w, r
    assert any(r["n_a"] > ta.BLOCK_TOKENS for r in got) and sum(r["n_a"] == 0 for r in got) >= 4


def test_sweep_in_small_steps(encoders, monkeypatch):
    """Tokens that come one at a time, and wide groups by ids, give the same groups and links."""
    x, y = [5, 6, 5, 7, 5, 5], [3, 4, 3, 3]
    lengths = np.ones(8, dtype=np.int64), np.full(8, 2, dtype=np.int64)
    lengths[1][4] = 0 + 1
    lengths[0][7] = 2
    said = ([f"{i}{m}" for i in range(8) for m in ",|"] + [f"{i}{m}" for i in range(8) for m in ",;"],)
    results = []
    for wide, step in ((4096, 100), (4096, 1), (1, 1), (0, 100)):
        monkeypatch.setattr(ta, "WIDE_GROUP", wide)
        sweep = ta.Sweep(1, 2, lengths, said)
        for k in range(0, 6, step):
            for side, ids in ((0, x), (1, y)):
                sweep.add(side, np.array(ids[k : k + step], dtype=np.int64))
                sweep.close()
        results.append(sweep.result())
    assert all(r == results[0] for r in results[1:]) and results[0][4] >= 2


def test_empty(empty):
    got = ta.align_tokens(empty, A, B)
    assert got.count() == 0 and "groups_sha256" in got.columns
