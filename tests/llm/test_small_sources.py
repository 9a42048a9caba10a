"""Sources far smaller than the rest of a mix, down to less than a block, against their targets in plain Python."""

import math
from collections import defaultdict

import pytest

from factorloom.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, budget = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in fixed]
        level = (budget - sum(fixed.values())) / sum(w[s] for s in rest) if rest else 0
        over = {s: cap * sizes[s] for s in rest if level * w[s] > cap * sizes[s]}
        if not over:
            return fixed | {s: level * w[s] for s in rest}
        fixed |= over


@pytest.mark.parametrize("small", [1, 50, 300, 1000])
def test_small_sources_reach_their_targets(spark, tmp_path, small):
    sizes = {f"large{i}": 400_000 for i in range(3)} | {f"small{i}": small for i in range(6)}
    rows, n = [], 0
    for s, size in sizes.items():
        step = 5000 if s.startswith("large") else 37
        for at in range(0, size, step):
            rows.append((n, " ".join(f"w{n}x{k}" for k in range(min(step, size - at))), s))
            n += 1
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got, most = defaultdict(int), 0
    for r in mixing.words_taken(docs).collect():
        got[r.source] += r.taken
        most = max(most, r.taken - 2 * r.size)
    assert most <= 0
    assert got == {s: math.floor(t + 1e-6) for s, t in targets(sizes).items()}
    _, _, pieces = mixing.mix_to_weights(docs)
    assert pieces.groupBy("slot").agg({"source_rank": "min"}).count() == pieces.select("slot", "source_rank", "epoch").distinct().count()
