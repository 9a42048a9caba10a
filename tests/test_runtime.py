"""Runtime scores equal those over all history, and read no older partition."""

import datetime
import random
import shutil

import pytest
from pyspark.sql import functions as F

from factorloom.operators.calendar import densify, instruments
from factorloom.operators.cross import cs_zscore
from factorloom.operators.runtime import BarStore, LinearModel, RuntimeScorer, extend_instruments
from factorloom.plans.compiler import Frame, compile_factors, depth_of
from factorloom.sources import partitions

EXPRESSIONS = {
    "a": "$close / Mean($close, 5) - 1",
    "b": "EMA($close, 2) - Ref($close, 3)",
    "c": "Mean(CSRank($volume), 3) + Std($close, 4)",
    "d": "Slope($close, 4) * Rank($volume, 3) + Delta($close, 2)",
    "e": "Corr($close, $volume, 5) + WMA($volume, 3)",
}
MODEL = LinearModel(EXPRESSIONS, {"a": 1.0, "b": -0.5, "c": 0.25, "d": 0.1, "e": 2.0}, 0.5, {"horizon": 5})
DAYS = [datetime.date(2024, 1, 1) + datetime.timedelta(days=i) for i in range(80)]


def rows():
    """Assets that come, go, pause and come again; one is new in each window."""
    rng = random.Random(4)
    out = []
    for asset in range(14):
        first, last = rng.choice([0, 0, 0, 30, 72, 78]), rng.choice([79, 79, 79, 76, 40])
        for i in range(first, last + 1):
            if rng.random() < 0.8 or i in (first, last):
                out.append((asset, DAYS[i], round(rng.uniform(5, 9), 3), float(rng.randint(1, 4)) if rng.random() < 0.95 else None))
    return out + [(99, d, 1.0, 1.0) for d in DAYS]


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(rows(), "asset long, date date, close double, volume double").cache()


@pytest.fixture(scope="module")
def store(spark, bars, tmp_path_factory):
    s = BarStore(spark, str(tmp_path_factory.mktemp("store")))
    cut = F.lit(DAYS[60])
    s.append(bars.where(F.col("date") <= cut))
    s.append(bars.where(F.col("date") > cut))
    return s


def batch(bars, days, strict):
    panel = densify(bars.withColumn("t", F.lit(True)))
    got = compile_factors(panel, EXPRESSIONS, Frame(strict=strict), keep=["asset", "date", "t"]).where(F.col("t") & F.col("date").isin(days))
    got = got.select("asset", "date", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in EXPRESSIONS]).withColumn("prediction", MODEL.prediction())
    got = got.withColumn("score", cs_zscore(F.col("prediction"), ddof=0, flat_as_one=True, missing_as_zero=True))
    return {(r["asset"], r["date"]): (r["prediction"], r["score"]) for r in got.collect()}


@pytest.mark.parametrize("strict", [True, False])
def test_equal_to_the_batch(store, bars, strict):
    days = [DAYS[20], DAYS[78], DAYS[79]]
    got = RuntimeScorer.of(MODEL, Frame(strict=strict)).scores(store.bars(), store.instruments(), store.calendar(), days).collect()
    want = batch(bars, days, strict)
    assert {(r["asset"], r["date"]) for r in got} == set(want) and len(got) == len(want) > 25
    for r in got:
        assert (r["prediction"], r["score"]) == pytest.approx(want[r["asset"], r["date"]], abs=1e-9)


def test_reads_no_older_partition(spark, store, tmp_path):
    """Older partitions' files hold nonsense here: whoever reads one fails."""
    scorer = RuntimeScorer.of(MODEL)
    assert scorer.back == max(map(depth_of, EXPRESSIONS.values()))
    ((read, scored),) = scorer.windows(store.calendar(), [DAYS[79]])
    assert scored == [DAYS[79]] and read == DAYS[79 - scorer.back :]
    want = sorted(map(tuple, scorer.scores(store.bars(), store.instruments(), store.calendar(), scored).collect()))
    shutil.copytree(store.path, tmp_path / "copy")
    broken = [f for f in (tmp_path / "copy/bars").glob("date=*/*.parquet") if f.parent.name[5:] < str(read[0])]
    for f in broken:
        f.write_bytes(b"nonsense")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert len(broken) >= 79 - scorer.back
    bars = spark.read.schema("asset long, close double, volume double, date date").parquet(str(tmp_path / "copy/bars"))
    assert sorted(map(tuple, scorer.scores(bars, store.instruments(), store.calendar(), scored).collect())) == want
    with pytest.raises(Exception, match="(?i)parquet|cannot read|nonsense"):
        bars.where(F.col("date") < F.lit(read[0])).select(F.sum("close")).collect()


def test_windows_that_touch_are_one(store):
    scorer = RuntimeScorer({"x": "Mean($close, 3)"}, lambda f: f)
    runs = scorer.windows(DAYS, [DAYS[30], DAYS[31], DAYS[10], DAYS[28]])
    assert runs == [(DAYS[8:11], [DAYS[10]]), (DAYS[26:32], [DAYS[28], DAYS[30], DAYS[31]])]
    with pytest.raises(ValueError):
        scorer.windows(DAYS, [datetime.date(1999, 1, 1)])


def test_saved_model_and_picks(spark, store, tmp_path):
    MODEL.save(spark, str(tmp_path / "m"))
    again = LinearModel.load(spark, str(tmp_path / "m"))
    assert again == MODEL
    scorer = RuntimeScorer.of(again)
    scores = scorer.scores(store.bars(), store.instruments(), store.calendar(), [DAYS[79]])
    picks = scorer.picks(scores, 4).collect()
    best = sorted(scores.collect(), key=lambda r: (-r["score"], r["asset"]))[:4]
    assert {p["asset"] for p in picks} == {b["asset"] for b in best} and all(p["weight"] == 0.25 for p in picks)
    with pytest.raises(ValueError):
        LinearModel({"a": "$close"}, {})


def test_instruments_are_extended(spark, store, bars):
    want = sorted(map(tuple, instruments(bars).collect()))
    assert sorted(map(tuple, store.instruments().collect())) == want
    more = spark.createDataFrame([(99, DAYS[0], DAYS[0]), (100, DAYS[5], DAYS[6])], "asset long, first date, last date")
    assert {tuple(r) for r in extend_instruments(store.instruments(), more).where("asset > 98").collect()} == {(99, DAYS[0], DAYS[79]), (100, DAYS[5], DAYS[6])}


def test_probe_back_in_time(spark, tmp_path):
    path = str(tmp_path / "days")
    df = spark.createDataFrame([(f"c{i}", d) for d in range(1, 6) for i in range(d)], "code string, d int")
    for d in range(1, 10):
        df.where(f"d = {d}").drop("d").coalesce(1).write.parquet(f"{path}/day=2024-01-0{d}")  # 6 to 9 are empty
    assert partitions.last_day_with_rows(spark, path, "day") == "2024-01-05"
    assert partitions.last_day_with_rows(spark, path, "day", most=3) is None
    assert partitions.last_day_with_rows(spark, path, "day", until="2024-01-03") == "2024-01-03"
    tried = [v for v, _ in partitions.latest_days(spark, path, "day", 20)]
    assert tried[:5] == [f"2024-01-0{d}" for d in (9, 8, 7, 6, 5)]
    found = partitions.discover_universe(spark, path, "day", "code")
    assert {r["code"] for r in found.collect()} == {f"c{i}" for i in range(5)}
    files = found.inputFiles()
    pruned = [f for f in spark.read.parquet(path).where("day = '2024-01-05'").inputFiles() if "2024-01-05" in f]
    assert set(pruned) <= set(files)
    assert partitions.discover_universe(spark, path, "day", "code", most=2).count() == 0
    assert partitions.partition_values(spark, str(tmp_path / "none"), "day") == []
