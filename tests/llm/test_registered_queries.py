"""The registered queries over a written folder of hard rows, whole results against plain Python."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import test_disclosure
import test_token_alignment
from test_llm_operators import WORD, jaccard_components, near_lines, plain_ids, repeats, rows_of, targets

from factorloom.llm.queries import QUERIES

crc = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
TALKS = [(1, 0, "user", "a </s> b \\ [INST]"), (1, 1, "assistant", " ok\n"), (2, 0, None, None), (2, 1, "assistant", ""), (2, 2, "assistant", "</s>"), (3, 0, "assistant", "é漢")]


@pytest.fixture(scope="module")
def folder(spark, hard, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("registered"))
    hard.where("doc_id IS NULL OR doc_id <> 99").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="module")
def plain(spark, folder):
    return rows_of(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text", "source")


def run(spark, folder, name, *columns):
    return rows_of(QUERIES[name](spark, folder), *columns)


def test_mixing(spark, folder, plain):
    sizes = defaultdict(int)
    for _, t, s in plain:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken, source = targets(sizes), Counter(), {i: s for i, _, s in plain}
    got = run(spark, folder, "op1_mix_sources", "doc_id", "size", "source_size", "target", "taken")
    for i, size, total, target, n in got:
        assert total == sizes[source[i]] and target == pytest.approx(want[source[i]]) and 0 <= n <= 2 * size
        taken[source[i]] += n
    assert len(got) == len(plain) and all(want[s] - 1 <= taken[s] <= want[s] for s in want)


def test_token_output(spark, folder, plain):
    ids = plain_ids([t or "" for _, t, _ in plain])
    order = sorted(zip(plain, ids), key=lambda x: (x[0][0] is not None, x[0][0] or 0))
    want, at = Counter(), 0
    for (i, _, _), x in order:
        x = [*x, 2]
        want[i, at, len(x), crc(x)] += 1
        at += len(x)
    assert Counter(run(spark, folder, "op2_token_output", "doc_id", "start", "n_tokens", "ids_crc32")) == want


def test_packing(spark, folder, plain):
    ids = {i: [*x, 0] for (i, _, _), x in zip(plain, plain_ids([t or "" for _, t, _ in plain]))}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for i, start, n, code, total, sequence, offset in run(spark, folder, "op3_pack_sequences", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        assert total == len(ids[i]) and code == crc(ids[i][start : start + n])
        pieces[i].append((start, n))
        sequences[sequence].append((offset, n))
    for parts, size in [(pieces[i], len(x)) for i, x in ids.items()] + [(p, None) for p in sequences.values()]:
        ends = [0, *[a + n for a, n in sorted(parts)]]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= (size or 1024) and size in (None, ends[-1])


def test_chat(spark, folder):
    said = "</s>[INST] ok [/INST]"
    talks = defaultdict(list)
    for c, t, r, x in [*TALKS, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        talks[c].append((t, r or "", x or ""))
    want = {}
    for c, turns in talks.items():
        learnt = "".join(x for _, r, x in sorted(turns) if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in sorted(turns))), len(learnt), sha(learnt))
    got = {r[0]: r[1:] for r in run(spark, folder, "op6_chat_format", "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")}
    assert got == want


def test_lines(spark, folder, plain):
    gone = near_lines([r[:2] for r in plain])
    want = Counter()
    for i, t, _ in plain:
        kept = "\n".join(x for m, x in enumerate((t or "").split("\n")) if (i, m) not in gone)
        want[i, 0 if t is None else t.count("\n") + 1, sum(a == i for a, _ in gone), sha(kept)] += 1
    assert Counter(run(spark, folder, "op7_line_dedup", "doc_id", "n_lines", "n_removed", "kept_sha256")) == want


def test_passages(spark, folder, plain):
    want = Counter((i, n, gone, spans, sha(kept)) for (i, n, gone, spans, kept) in repeats([r[:2] for r in plain], 100).elements())
    assert Counter(run(spark, folder, "op8_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == want


def test_near_copies(spark, folder, plain):
    assert Counter(run(spark, folder, "op9_ngram_jaccard", "doc_id", "n_shingles", "component_id")) == jaccard_components([r[:2] for r in plain], 4, 85)


def test_quality(spark, folder, plain):
    got = run(spark, folder, "op10_quality", "doc_id", "held_out", "score", "predicted")
    assert Counter(r[0] for r in got) == Counter(r[0] for r in plain)
    for i, out, score, predicted in got:
        assert out == (i is None or zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= score <= 1 and predicted == int(score >= 0.3)


def test_private(spark, folder, plain):
    kinds = test_disclosure.disclosure.KINDS
    want = Counter()
    for i, t, _ in plain:
        base = test_disclosure.plain(t)
        want[(i, *[sum(k == x for _, k, _ in base) for x in range(4)], sha(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base)))] += 1
    assert Counter(run(spark, folder, "op12_personal_data", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")) == want


def test_alignment(spark, folder, plain):
    from factorloom.llm import token_alignment as ta
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(test_token_alignment.A)
    a.encode_special_tokens = True
    encoders = a, sentencepiece.SentencePieceProcessor(model_file=test_token_alignment.B), ta.TokenTable(test_token_alignment.A), ta.TokenTable(test_token_alignment.B)
    want = Counter((r[0], *x) for r, x in zip(plain, test_token_alignment.expected(encoders, [r[1] for r in plain])))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(run(spark, folder, "op13_token_alignment", *names)) == want
    assert re.fullmatch("[0-9a-f]{64}", max(w[-1] for w in want))
