"""When the driver collects its garbage as tables are staged."""

import re

import corpus_pipeline
from factorloom.llm import common


def test_heap_that_has_grown_is_collected_even_if_little_is_in_use():
    assert common.crowded(free=350, total=450, most=750)
    assert common.crowded(free=100, total=360, most=750)
    assert not common.crowded(free=100, total=300, most=750)


def test_free_memory_goes_back_to_the_machine_at_cuts(spark, monkeypatch):
    assert re.search(r"RSS\+Swap: \d+\w->\d+\w", common.give_back(spark))  # needs a JVM on glibc that can: 17.0.9 or later
    calls = []
    monkeypatch.setattr(common, "give_back", calls.append)
    assert common.stage(spark.range(5), "cut").count() == 5 and calls == [spark]
    corpus_pipeline.dedup_lines(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
    assert len(calls) > 2
