"""Reports appear whole or not at all."""

import csv
import hashlib
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from factorloom.sources.report_sink import MANIFEST, holdings_report, metrics_json, report_files, write_report


def rows_of(path):
    out = []
    for f in report_files(path):
        with open(f, newline="") as file:
            out += list(csv.reader(file))[1:]
    return out


def visible(path):
    return [f for f in os.listdir(path) if not f.startswith(".")] if os.path.isdir(path) else []


@pytest.fixture
def holdings(spark):
    return spark.range(400).select((F.lit("2024-01-01").cast("date") + (F.col("id") % 20).cast("int")).alias("date"), F.concat(F.lit('c,"'), F.col("id")).alias("asset"), (F.col("id") / 400).alias("weight"))


def test_holdings_csv(holdings, tmp_path):
    path = str(tmp_path / "r")
    write_report(holdings_report(holdings.repartition(5), files=3), path)
    want = sorted([str(r["date"]), r["asset"], str(round(r["weight"], 6))] for r in holdings.where("weight > 0").collect())
    got = rows_of(path)
    assert sorted(got) == want and len(report_files(path)) > 1
    for f in report_files(path):
        with open(f, newline="") as file:
            part = list(csv.reader(file))
        assert part[0] == ["date", "asset", "weight"] and part[1:] == sorted(part[1:], key=lambda r: (r[0], r[1]))
    files = json.load(open(f"{path}/{MANIFEST}"))["files"]
    assert sum(f["rows"] for f in files) == 399 and all(hashlib.sha256(open(f"{path}/{f['name']}", "rb").read()).hexdigest() == f["sha256"] for f in files)


def test_a_failing_task_leaves_no_visible_file(spark, holdings, tmp_path):
    path = str(tmp_path / "r")

    def explode(batches):
        for b in batches:
            yield b
            if b["weight"].max() > 0.9:
                raise ValueError("a task fails")

    broken = holdings.repartitionByRange(6, "weight").mapInPandas(explode, holdings.schema)
    with pytest.raises(Exception, match="a task fails"):
        write_report(broken, path)
    assert visible(path) == [] and report_files(path) == []
    write_report(holdings, path)
    before = sorted(rows_of(path))
    with pytest.raises(Exception, match="a task fails"):
        write_report(broken, path)
    assert sorted(rows_of(path)) == before and len(before) == 400
    assert not [f for f in os.listdir(path) if f.startswith(".report")]


def test_overwrite_and_append(holdings, tmp_path):
    path = str(tmp_path / "r")
    write_report(holdings.limit(30), path)
    first = set(report_files(path))
    write_report(holdings.limit(20), path, overwrite=False)
    assert len(rows_of(path)) == 50 and first < set(report_files(path))
    write_report(holdings.limit(7), path)
    assert len(rows_of(path)) == 7 and len(visible(path)) == len(report_files(path)) + 1
    write_report(holdings.limit(0), path)
    assert rows_of(path) == []


def test_json_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None, [1, 2]), ("b", float("nan"), "x", None), ("c", float("inf"), "é", [])], "name string, ir double, note string, ids array<int>")
    path = str(tmp_path / "j")
    write_report(df, path, "json")
    got = sorted((json.loads(line) for f in report_files(path) for line in open(f)), key=lambda r: r["name"])
    assert got == [{"name": "a", "ir": 1.5, "note": None, "ids": [1, 2]}, {"name": "b", "ir": None, "note": "x", "ids": None}, {"name": "c", "ir": None, "note": "é", "ids": []}]
    said = {r["name"]: json.loads(r["metrics"]) for r in metrics_json(df.drop("ids"), "name").collect()}
    assert said == {"a": {"ir": 1.5, "note": None}, "b": {"ir": None, "note": "x"}, "c": {"ir": None, "note": "é"}}
    assert not any(isinstance(v["ir"], float) and math.isnan(v["ir"]) for v in said.values())
    with pytest.raises(Exception, match="csv or json"):
        write_report(df, path, "xml")
