"""Streams over table APIs: a run that is killed repeats no row and loses none; tables in versions."""

import json
import threading
from datetime import date, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from factorloom.sources.api_stream import catch_up, marks_of
from factorloom.sources.versioned import VersionedTable

FIRST = date(2024, 1, 1)
SCHEMA = "api string, trade_date string, ts_code string, close double"


class Api:
    """Three codes a day for each API, up to a day that the test moves on; asks are recorded."""

    def __init__(self):
        self.last = {"daily": FIRST + timedelta(days=9), "fund": FIRST + timedelta(days=4)}
        self.asked = []
        api = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                out = json.dumps({"data": api.answer(body)}).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(out)

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/"

    def rows(self, name, lo, hi):
        days = [FIRST + timedelta(days=i) for i in range(400)]
        return [[f"{d:%Y%m%d}", f"{name}{k}", float(d.day + k)] for d in days if lo <= d <= min(hi, self.last[name]) for k in range(3)]

    def answer(self, body):
        if body["api_name"] == "newest_date":
            return {"date": self.last[body["params"]["api"]].isoformat()}
        lo, hi = (date.fromisoformat(body["params"][k]) for k in ("start_date", "end_date"))
        self.asked.append((body["api_name"], lo, hi))
        return {"fields": ["trade_date", "ts_code", "close"], "items": self.rows(body["api_name"], lo, hi)[:7]}

    def all(self):
        return sorted((n, *r) for n in self.last for r in self.rows(n, FIRST, self.last[n]))


@pytest.fixture
def api():
    a = Api()
    yield a
    a.server.shutdown()


def run(spark, api, table, checkpoint):
    o = {"url": api.url, "apis": "daily,fund", "start": str(FIRST), "days": "3", "batch_days": "4", "cap": "7", "calls_per_minute": "60000"}
    try:
        catch_up(spark, SCHEMA, o, table, "trade_date", checkpoint)
    except StreamingQueryException as e:
        return e
    return None


def rows_of(table):
    return sorted((r["api"], r["trade_date"], r["ts_code"], r["close"]) for r in table.read().collect())


def test_killed_between_commit_and_checkpoint(spark, api, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), ["api", "trade_date", "ts_code"], "trade_date")
    upsert, calls = VersionedTable.upsert, []

    def once_more(self, new, marks=None):
        calls.append(dict(marks or {}))
        if len(calls) == 2:
            raise RuntimeError("killed before the commit")
        done = upsert(self, new, marks)
        if len(calls) == 4:
            raise RuntimeError("killed after the commit")
        return done

    monkeypatch.setattr(VersionedTable, "upsert", once_more)
    failed = 0
    for _ in range(5):
        failed += run(spark, api, table, str(tmp_path / "cp")) is not None
        if failed == 2 and rows_of(table) == api.all():
            break
    assert failed == 2 and rows_of(table) == api.all()
    assert marks_of(table) == {"daily": f"{api.last['daily']:%Y%m%d}", "fund": f"{api.last['fund']:%Y%m%d}"}
    versions = table.versions()
    assert run(spark, api, table, str(tmp_path / "cp")) is None  # the batch that was committed comes again, and changes nothing
    assert rows_of(table) == api.all() and table.versions() == versions
    before = len(api.asked)
    api.last["fund"] += timedelta(days=2)
    assert run(spark, api, table, str(tmp_path / "cp")) is None
    assert rows_of(table) == api.all() and len(table.versions()) > len(versions)
    later = api.asked[before:]
    assert later and all(lo > FIRST + timedelta(days=4) for name, lo, _ in later if name == "fund") and not [x for x in later if x[0] == "daily"]


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], "day")
    row = lambda *r: spark.createDataFrame(list(r), "k long, day string, v string")
    with pytest.raises(ValueError):
        table.read()
    assert table.upsert(row((1, "a", "x"), (2, "b/c", "x"), (3, None, "x")), {"m": "1"}) == 1
    old = table.read()
    assert table.upsert(row((2, "b/c", "y"), (4, "a", "y"), (4, "a", "y")), {"m": "2"}) == 2
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", "x"), (2, "b/c", "y"), (3, None, "x"), (4, "a", "y")]
    assert sorted(map(tuple, old.collect())) == [(1, "a", "x"), (2, "b/c", "x"), (3, None, "x")]  # a reader of the old one still reads it
    assert table.upsert(row((9, "z", "z")), {"m": "2"}) == 2 and table.read().count() == 4  # replayed
    wider = row((5, "d", "w")).withColumn("more", F.lit(1))
    table.upsert(wider.drop("more"), {"m": "3"})
    assert table.versions() == [1, 2, 3] and table.read(1).count() == 3
    assert table.vacuum(keep=1) >= 0 and table.versions() == [3] and table.read().count() == 5
    plain = VersionedTable(spark, str(tmp_path / "p"), ["k"])
    plain.upsert(row((1, "a", "x")))
    plain.upsert(row((1, "a", "y"), (2, "a", "x")))
    assert sorted(map(tuple, plain.read().collect())) == [(1, "a", "y"), (2, "a", "x")] and plain.vacuum(1) == 1


def test_two_writers(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    rows = spark.createDataFrame([(1,)], "k long")
    table.upsert(rows)
    manifest = table._manifest()
    table.upsert(rows)
    with pytest.raises(RuntimeError):
        table._commit(manifest | {"version": 2})
    assert table.versions() == [1, 2]
