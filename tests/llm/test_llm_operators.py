"""Each operator against a plain Python version, on hard rows and on empty tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from factorloom.llm import binary_output, chat, common, exact_dedup, line_dedup, mixing, ngram_join, packing, quality, rindex_dedup, topk
from factorloom.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def rows_of(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_exact_dedup(hard, empty):
    plain = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows_of(hard, "doc_id", "text")]
    groups = defaultdict(list)
    for i, t in plain:
        groups[t].append(i)
    for bits in (256, 8):
        got = rows_of(exact_dedup.dedup_exact(hard, bits), "doc_id", "keep_id", "group_size", "text_sha256")
        least = lambda t: min((x for x in groups[t] if x is not None), default=None)
        assert Counter(got) == Counter((i, least(t), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in plain)
        kept = rows_of(exact_dedup.dedup_exact(hard, bits).where("kept"), "doc_id", "text_sha256")
        assert Counter(kept) == Counter((least(t), hashlib.sha256(t.encode()).hexdigest()) for t in groups)
    assert exact_dedup.dedup_exact(empty).count() == 0


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, budget = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in fixed]
        level = (budget - sum(fixed.values())) / sum(w[s] for s in rest) if rest else 0
        over = {s: cap * sizes[s] for s in rest if level * w[s] > cap * sizes[s]}
        if not over:
            return fixed | {s: level * w[s] for s in rest}
        fixed |= over


def test_mixing(hard, empty):
    sizes = defaultdict(int)
    for s, t in rows_of(hard, "source", "text"):
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    got = mixing.words_taken(hard, block_words=8)
    taken = defaultdict(int)
    for s, size, total, target, n in rows_of(got, "source", "size", "source_size", "target", "taken"):
        assert total == sizes[s] and abs(target - want[s]) < 1e-6 and 0 <= n <= 2 * size
        taken[s] += n
    assert all(abs(taken[s] - want[s]) <= 8 * 12 for s in want)
    assert got.count() == hard.count()
    again = mixing.words_taken(hard.repartition(5), block_words=8)
    assert Counter(rows_of(got, "doc_id", "taken")) == Counter(rows_of(again, "doc_id", "taken"))
    assert mixing.words_taken(empty).count() == 0


def test_mixed_documents_take_what_the_schedule_says(hard):
    got = Counter()
    for i, t in rows_of(mixing.mixed_documents(hard, block_words=8), "doc_id", "text"):
        got[i] += len(WORD.findall(t))
    want = Counter()
    for i, n in rows_of(mixing.words_taken(hard, block_words=8), "doc_id", "taken"):
        want[i] += n
    assert +got == +want


def test_golden_points(spark):
    got = [r[0] for r in spark.range(1, 2000).select(mixing.golden_point(F.col("id"))).collect()]
    assert got == [n * mixing.GOLDEN_32 % 2**32 for n in range(1, 2000)]


def plain_ids(texts):
    code = Encoder(BPE).tokenizer
    return [code.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_matches_the_library():
    texts = ["don't stop", "a\u00a0 b", "\n\n x", "éα1'st", "  ", "", "<|endoftext|> x", "x" * 3000, "$$$ ab%%% c!!"] * 2
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in Encoder(BPE).encode(texts)] == plain_ids(texts)


def test_token_files(spark, hard, empty):
    out = common.new_path(spark, "test-tokens")
    manifest = binary_output.write_tokens(hard, out, BPE, frame_ids=64)
    got = rows_of(binary_output.read_tokens(spark, manifest), "doc_id", "start", "n_tokens", "ids")
    rows = rows_of(hard, "doc_id", "text")
    want = Counter((i, struct.pack(f"<{len(x) + 1}I", *x, 2)) for (i, t), x in zip(rows, plain_ids([t for _, t in rows]), strict=True))
    assert Counter((i, bytes(x)) for i, _, _, x in got) == want
    got.sort(key=lambda r: r[1])
    at, before = 0, -1
    for i, start, n, x in got:
        assert start == at and n == len(x) // 4 and (-1 if i is None else i) >= before
        at, before = at + n, -1 if i is None else i
    assert binary_output.read_tokens(spark, binary_output.write_tokens(empty, common.new_path(spark, "none"), BPE)).count() == 0

    import zstandard

    path = next(r["path"] for r in manifest.collect() if r["n_docs"] > 20)
    fs, at = binary_output.filesystem(path)
    with fs.open_input_file(at) as source:
        shard = binary_output.ShardReader(source)
        wanted = [int(x) for x in shard.doc_ids[shard.known][[2, 3]]]
        found = dict(shard.find(wanted))
        assert set(found) == set(wanted) and shard.frames_read < len(shard.sums) // 2
        source.seek(0)
        whole = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True).read()
        assert whole == b"".join(shard.document(i) for i in range(len(shard.counts)))


def test_damaged_frames_are_noticed(tmp_path):
    path = tmp_path / "x.zst"
    with path.open("wb") as f:
        w = binary_output.ShardWriter(f, 16, 3)
        for i in range(20):
            w.add(i, struct.pack("<8I", *range(i, i + 8)))
        w.close()
    raw = bytearray(path.read_bytes())
    raw[12] ^= 0xFF
    path.write_bytes(raw)
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(path)) as source, pytest.raises(Exception):
        binary_output.ShardReader(source).frame(0)


@pytest.mark.parametrize("window", [16, 1024])
def test_packing(hard, empty, window):
    rows = rows_of(hard, "doc_id", "text")
    want = Counter((i, struct.pack(f"<{len(x) + 1}I", *x, 0)) for (i, t), x in zip(rows, plain_ids([t for _, t in rows]), strict=True))
    got = rows_of(packing.pack(hard, BPE, window), "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    docs = defaultdict(list)
    for r in got:
        docs[r[0]].append(r)
    # The row that is there three times: each of its ids lies in three pieces.
    (same,) = [x for i, x in want if i == 99]
    assert Counter((r[1] + k, bytes(r[3])[4 * k : 4 * k + 4]) for r in docs[99] for k in range(r[2])) == Counter({(k, same[4 * k : 4 * k + 4]): 3 for k in range(len(same) // 4)})
    for i, parts in docs.items():
        if i == 99:
            continue
        parts.sort(key=lambda r: r[1])
        assert [r[1] for r in parts] == [sum(r[2] for r in parts[:k]) for k in range(len(parts))]
        assert (i, b"".join(bytes(r[3]) for r in parts)) in want and all(r[4] == sum(p[2] for p in parts) for r in parts)
    assert sum(r[2] for r in got) == sum(len(x) // 4 * n for (_, x), n in want.items())
    sequences = defaultdict(list)
    for r in got:
        sequences[r[5]].append((r[6], r[2]))
    for places in sequences.values():
        places.sort()
        assert [p for p, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        size = sum(n for _, n in places)
        assert size <= window and size & (size - 1) == 0  # nothing to pad
    assert packing.pack(empty, BPE).count() == 0


def test_plan_uses_every_length_once():
    rng = np.random.default_rng(1)
    h = np.bincount(rng.integers(1, 64, 5000), minlength=64)
    plan, spare = packing.plan_windows(h, 64)
    used = np.zeros(64, dtype=int)
    for parts, n in plan:
        assert sum(parts) == 64
        for v in parts:
            used[v] += n
    assert (used + spare == h).all() and spare.sum() < 200


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(0, 0.2, 8)], 0) for i in range(300)]
    rows += [(310, [2.0**21, 1.0] + [0.0] * 6, 1), (311, [2.0**22] * 8, 1), (400, [2.0**24, -3.0] + [2.0**-9] * 6, 1)]
    rows += [(300, [0.5] * 8, 0), (301, [0.5] * 8, 0), (302, [0.5] * 8, 0), (303, None, 1), (304, [1.0, None] + [0.0] * 6, 1), (305, [float("nan")] * 8, 1), (306, [0.0] * 8, 1), (None, [9.0] * 8, 1), (307, [0.3, -0.2], 1), (308, [], 1), (350, [float("inf")] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    good = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in good if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])}
    topk_small = topk.CANDIDATES, topk.QUERIES
    topk.CANDIDATES, topk.QUERIES = 64, 3
    try:
        assert set(rows_of(topk.top_k(df, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score")) == want
        more = [(0, [2.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.0]), (50, [0.25, 1.0]), (50, [0.25, 1.0])]
        again = spark.createDataFrame(more, "vec_id long, embedding array<float>")
        got = Counter(rows_of(topk.top_k(again, F.col("vec_id") % 50 == 0, k=3), "query_id", "rank", "vec_id", "score"))
        twice: Counter = Counter()
        for i, (q, v) in enumerate(more):
            scored = sorted((-sum(int(256 * x) * int(256 * y) for x, y in zip(v, w)), c) for j, (c, w) in enumerate(more) if j != i)
            twice.update((q, k + 1, c, -s) for k, (s, c) in enumerate(scored[:3]) if q % 50 == 0)
        assert got == twice and sum(got.values()) == 12
    finally:
        topk.CANDIDATES, topk.QUERIES = topk_small
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a </s> b \\ [INST]x[/INST] <s>"), (1, 1, "assistant", " \n ok </s>[INST]\\"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, None, "é漢\\\\"), (2, None, "assistant", "first \\</s"), (None, 0, "assistant", "no id"), (3, 0, "we[INST]ird\n", "x")]
    rows += [(7, i, "user" if i % 2 else "assistant", f"turn {i} of many [/INST]") for i in range(200)]
    rows += [(8, 0, "assistant", "twice")] * 2
    rows += [(9, i, "assistant", x) for i, x in enumerate(["ok.", "\n\n begins blank", "ends blank \t\n", " ", "\u00a0x\u2003", "\\;", ";", "<", "'s", "1", "\x1c", "\x85"])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segment string").repartition(4)
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    for chars in (1 << 18, 300):
        formatted = chat.format_conversations(df, BPE, segment_chars=chars).cache()
        code = Encoder(BPE).tokenizer
        whole = defaultdict(str)
        ids = defaultdict(list)
        for r in sorted(formatted.collect(), key=lambda r: r["segment"]):
            whole[r["conv_id"]] += r["formatted"]
            ids[r["conv_id"]] += r["ids"]
            assert len(r["ids"]) == len(r["token_loss"])
            spans = list(zip(r["loss_from"], r["loss_to"]))
            for (a, b), on in zip(code.encode(r["formatted"], add_special_tokens=False).offsets, r["token_loss"], strict=True):
                assert on == any(x <= a and b <= y for x, y in spans) and (on or not any(a < y and x < b for x, y in spans))
        assert all(code.encode(t, add_special_tokens=False).ids == ids[c] for c, t in whole.items())
        got = {r["conv_id"]: r for r in chat.conversation_digests(formatted, BPE).collect()}
        assert set(got) == set(convs)
        for c, turns in convs.items():
            turns = [(t[3], t[5]) for t in sorted(turns)]
            learnt = "".join(x for r, x in turns if r == "assistant")
            assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["formatted_chars"]) == (len(turns), len(learnt), len(whole[c]))
            assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
            assert got[c]["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
        formatted.unpersist()
    assert chat.conversation_digests(chat.format_conversations(df.limit(0), BPE), BPE).count() == 0


def near_lines(rows, percent=80):
    lines = [(i is not None, i or 0, n, frozenset(WORD.findall(x))) for i, t in rows for n, x in enumerate((t or "").split("\n"))]
    lines.sort(key=lambda r: r[:3])
    kept, gone = [], set()
    for known, i, n, s in lines:
        if s and any(100 * len(s & e) >= percent * len(s | e) for e in kept):
            gone.add((i if known else None, n))
        if s:
            kept.append(s)
    return gone


def line_rows():
    base = "one two three four five six seven eight nine ten".split()
    rows = [(i, "\n".join([" ".join(base[: 10 - i % 3]), f"own line {i} alone here", "", "the end"])) for i in range(30)]
    rows += [(33 + i, " ".join([*base[:8], f"v{i}", f"u{i % 4}"])) for i in range(20)]
    rows += [(60 + i, " ".join(f"t{k}" if k != i % 40 else f"r{i}" for k in range(40))) for i in range(80)]  # near copies
    return rows + [(30, None), (31, ""), (32, "x y\nx y\ny x\n \t\r\n\x0bx\x0cy")]


@pytest.mark.parametrize(("long_list", "pivots"), [(16, (8,)), (2, (1, 3))])
def test_line_dedup(spark, hard, tmp_path, long_list, pivots, monkeypatch):
    monkeypatch.setattr(line_dedup, "LONG_LIST", long_list)
    monkeypatch.setattr(line_dedup, "PIVOTS", pivots)
    spark.createDataFrame(line_rows(), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    for df in (spark.read.parquet(str(tmp_path / "d")), hard.where("doc_id <> 99")):
        plain = rows_of(df, "doc_id", "text")
        gone = near_lines(plain)
        got = {i: r for i, *r in rows_of(line_dedup.dedup_lines(df), "doc_id", "text", "n_lines", "n_removed")}
        for i, before in plain:
            want = None if before is None else "\n".join(x for m, x in enumerate(before.split("\n")) if (i, m) not in gone)
            assert got[i] == [want, 0 if before is None else before.count("\n") + 1, sum(a == i for a, _ in gone)]
        assert len(got) == len(plain)


def test_line_dedup_of_repeated_rows(hard, empty):
    got = line_dedup.dedup_lines(hard)
    assert got.count() == hard.count() and got.columns[:6] == hard.columns
    assert sorted(r[0] for r in rows_of(got.where("doc_id = 99"), "text")) == ["", "", "a repeated row of the table"]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_small_and_large_sets(spark, tmp_path):
    """Sets on both sides of SMALL_SET, which have parities in 64 and in 128 slots, and one far above it."""
    words = [f"w{i}" for i in range(80)]
    rows = [(i, "\n".join(" ".join([*words[i % 7 : i % 7 + 48 + (i * 5 + k) % 17], *(f"x{i}-{k}-{j}" for j in range((i + k) % 9))]) for k in range(3))) for i in range(40)]
    rows += [(50 + i, " ".join(f"v{j}" for j in range(i * 30, i * 30 + 300))) for i in range(4)]
    assert {len(x.split()) > line_dedup.SMALL_SET for _, t in rows for x in t.split("\n")} == {True, False}
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    gone = near_lines(rows)
    got = dict(rows_of(line_dedup.dedup_lines(spark.read.parquet(str(tmp_path / "d"))), "doc_id", "text"))
    assert got == {i: "\n".join(x for m, x in enumerate(t.split("\n")) if (i, m) not in gone) for i, t in rows}


def test_line_dedup_makes_words_once(spark, tmp_path):
    """Pairs that can't link where they first meet are not put out, and what pairs share is named once in the plan."""
    sets = [(row, row, 0, 10, 0, 0, [row, 100, 101]) for row in (1, 2)]
    late = [(row, row, 0, 10, 0, 0, [10 * row, 10 * row + 1, 200]) for row in (3, 4)]
    schema = "__row long, doc_id long, line_no int, n int, p0 long, p1 long, prefix array<long>"
    assert rows_of(line_dedup.open_pairs(spark.createDataFrame(sets + late, schema), None, 80), "__row", "early_row") == [(2, 1)]  # 3 and 4 share 8 words at most
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e f")], "__row long, text string")
    linked = line_dedup.verified(docs, spark.createDataFrame([(2, 0, 1, 0)], "__row long, line_no int, early_row long, early_line int"), 80)
    assert linked._jdf.queryExecution().optimizedPlan().toString().count("array_intersect(") == 1
    assert rows_of(linked, "__row", "line_no") == [(2, 0)]


def test_words_of_a_regular_pattern_are_told_apart():
    """The Thue-Morse sequence and its complement: alike to any hash that is a polynomial modulo 2**64."""
    from factorloom.llm.textblocks import word_hashes

    for n in (64, 1024, 4096):
        bits = [bin(i).count("1") & 1 for i in range(n)]
        words = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
        raw = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
        hashes, _ = word_hashes(raw, np.array([0, len(raw)]))
        assert len(set(hashes.tolist())) == 2


def jaccard_components(rows, size, percent):
    sets = []
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])))
    to = list(range(len(sets)))

    def root(k):
        while to[k] != k:
            k = to[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                to[root(a)] = root(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return Counter((i, len(s), least.get(root(k)) if s else i) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(hard, empty, size, percent):
    got = ngram_join.similar_components(hard, size, percent)
    assert Counter(rows_of(got, "doc_id", "n_shingles", "component_id")) == jaccard_components(rows_of(hard, "doc_id", "text"), size, percent)
    assert ngram_join.similar_components(empty).count() == 0


def test_ngram_join_of_small_sets_and_chains(spark, tmp_path):
    words = [f"x{i}" for i in range(60)]
    rows = [(i, " ".join(words[i : i + 12 + i % 5])) for i in range(40)] + [(100 + i, " ".join(words[:n])) for i, n in enumerate(range(1, 30))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    for size, percent in ((1, 80), (2, 85), (4, 85)):
        assert Counter(rows_of(ngram_join.similar_components(df, size, percent), "doc_id", "n_shingles", "component_id")) == jaccard_components(rows, size, percent)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(4)
    for percent in (80, 85):
        for n in [*range(1, 40), 100, 300]:
            for _ in range(12):
                s = rng.integers(0, 2**63, n).astype(np.uint64)
                t = s.copy()
                drop = rng.integers(0, n // 4 + 1)
                t = np.unique(np.concatenate([t[drop:], rng.integers(0, 2**63, rng.integers(0, n // 4 + 1)).astype(np.uint64)]))
                s = np.unique(s)
                both = len(np.intersect1d(s, t))
                if len(t) and 100 * both >= percent * (len(s) + len(t) - both):
                    assert len(np.intersect1d(ngram_join.keys_of(s, percent), ngram_join.keys_of(t, percent)))
                    bits = sum(bin(int(a ^ b) & 0xFFFFFFFFFFFFFFFF).count("1") for a, b in zip(ngram_join.sketch(s), ngram_join.sketch(t)))
                    assert bits <= len(s) + len(t) - 2 * both


def test_first_of_components(hard):
    kept = rows_of(ngram_join.first_of_components(hard), "doc_id")
    parts = jaccard_components(rows_of(hard, "doc_id", "text"), 5, 80)
    want = {c for _, n, c in parts if n} | {i for i, n, _ in parts if not n}
    assert sorted(Counter(kept)[(c,)] for c in want) == [1] * len(want) and len(kept) == len(want)


def repeats(rows, length):
    texts = sorted(((i is not None, i or 0, (t or "").encode()) for i, t in rows), key=lambda r: r[:2])
    seen, out = set(), Counter()
    for known, i, raw in texts:
        mark = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                mark[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, m in zip(raw, mark) if not m)
        out[i if known else None, len(raw), sum(mark), len(re.findall(b"\1+", bytes(mark))), kept] += 1
    return out


@pytest.mark.parametrize("most", [20_000, 1])
def test_suffix_dedup(spark, hard, empty, most, monkeypatch, tmp_path):
    monkeypatch.setattr(rindex_dedup, "MOST_CONTEXTS", most)
    monkeypatch.setattr(rindex_dedup.repeated_spans, "__defaults__", (100, most))
    passage = "passage " * 3 + "of many words that several documents share, éü included, and that goes on for a while; " * 2
    rows = [(i, f"{i} before " * (i % 4) + passage[i % 7 :] + f" after {i}" * 5) for i in range(20)]
    rows += [(20, "ab" * 300), (21, "x" * 250), (22, passage[:99]), (23, passage[:100]), (24, None), (25, ""), (26, passage + "!" + passage), (None, passage)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    for df, length in ((spark.read.parquet(str(tmp_path / "d")), 100), (hard, 100), (hard, 40)):
        got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in rindex_dedup.remove_repeats(df, length).collect())
        assert got == repeats(rows_of(df, "doc_id", "text"), length)
    assert rindex_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_of_long_passages_and_texts(spark, tmp_path):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, long = noise(1400), noise((1 << 20) + 5000)
    rows = [(0, noise(50) + passage + noise(700)), (1, passage[200:] + noise(300)), (2, noise(10) + passage[:900] + "!" + passage[300:]), (3, noise(590)), (4, long), (5, noise(300) + long[(1 << 20) - 1500 : (1 << 20) + 900] + noise(80))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    for length in (100, 600):
        got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in rindex_dedup.remove_repeats(df, length).collect())
        assert got == repeats(rows, length)


@pytest.mark.parametrize("length", [100, 1024, 2048, 4096])
def test_suffix_dedup_of_patterned_texts(spark, tmp_path, length):
    """The Thue-Morse sequence and its complement, which share no window as long as they are, and more of either."""
    word = "a"
    while len(word) < length:
        word += word.translate(str.maketrans("ab", "ba"))
    word = word[:length] if length == 100 else word
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(0, word), (1, other), (2, "x" + word), (3, other + word)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in rindex_dedup.remove_repeats(spark.read.parquet(str(tmp_path / "d")), length).collect())
    assert got == repeats(rows, length)


@pytest.mark.parametrize("text", [b"mississippi\xffmississippi river\xffmiss\xff", b"a\xffab\xffaba\xff", b"\xfe\x00x\xff\x00\xfex\xff\xfe\x00x\xff"])
def test_run_length_index(text):
    text = np.frombuffer(text, dtype=np.uint8)
    index = rindex_dedup.RunLengthIndex(text)
    raw = text.tobytes()
    order = sorted(range(len(raw)), key=lambda i: raw[i:])
    transform = [raw[i - 1] if i else -1 for i in order]
    assert np.repeat(index.run_bytes, index.run_lengths).tolist() == transform
    shared, neighbour = index.matching_statistics()
    assert neighbour[order[0]] == -1
    for a, b in zip(order, order[1:]):
        same = next((k for k in range(len(raw)) if raw[a + k : a + k + 1] != raw[b + k : b + k + 1] or b + k >= len(raw)), 0)
        assert (shared[b], neighbour[b]) == (same, a)


def test_quality(spark, sf, hard, empty):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score_quality(docs.select("doc_id", "text"), labels)
    for i, held in rows_of(scored, "doc_id", "held_out"):
        assert held == (zlib.crc32(str(i).encode()) % 5 == 0)
    got = rows_of(scored.join(labels, "doc_id"), "score", "predicted", "quality", "held_out")
    assert all(0 <= s <= 1 and p == (s >= 0.3) for s, p, _, _ in got)
    test = [(s, q) for s, _, q, h in got if h]
    good, bad = [s for s, q in test if q == 1], [s for s, q in test if q == 0]
    assert not bad or np.mean([a > b for a in good for b in bad]) > 0.85
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.score_quality(docs.select("doc_id", "text"), flipped)
    assert sorted(rows_of(scored, "doc_id", "score")) == sorted(rows_of(again, "doc_id", "score"))
    assert quality.score_quality(hard, labels).count() == hard.count()
    assert quality.score_quality(hard, labels.limit(0)).where("score = 0.5").count() == hard.count()
    assert quality.score_quality(empty, labels).count() == 0


def test_features_do_not_depend_on_blocks():
    import pyarrow as pa

    from factorloom.llm.textblocks import blocks

    texts = pa.array(["ab cd ef.", None, "", "one two three four five" * 50, "x"])
    v = np.random.default_rng(0).normal(size=(quality.SLOTS, quality.DIM)).astype("f4")
    each = [quality.pooled(v, raw, off, quality.dense_index()) for most in (1, 10**6) for _, _, raw, off in [b for b in blocks(texts, most)]]
    assert np.allclose(np.concatenate(each[:-1]), each[-1], atol=1e-5)
