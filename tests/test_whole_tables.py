"""Queries that must see every row of their tables, against plain Python over a small written table."""

import datetime
import random
from collections import defaultdict

import pytest

from factorloom.catalog import QUERIES

LINES = "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp"


def day(n):
    return datetime.datetime(1995, 10, 1) + datetime.timedelta(days=n)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(5)
    lines = [(i, rng.randint(1, 8), float(rng.randint(1, 50)), float(rng.randint(100, 900)), rng.choice([0.0, 0.05]), rng.choice("ANR"), rng.choice("FO"), day(rng.randrange(400))) for i in range(300)]
    orders = [(i, rng.randrange(40), rng.choice("FOP"), float(rng.randint(1, 99)), day(rng.randrange(-10, 420))) for i in range(120)]
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(lines, LINES).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame(orders, ORDERS).write.parquet(f"{d}/orders.parquet")
    return d, lines, orders


def test_interval_membership_all(spark, tables):
    d, lines, orders = tables
    want, met = {}, set()
    for k, customer, _, _, at in orders:
        held = []
        for n, (line, supplier, quantity, _, _, flag, status, start) in enumerate(lines):
            open_end = flag == "N" and status == "O"
            if supplier == customer % max(x[1] for x in lines) + 1 and start <= at and (open_end or at < start + datetime.timedelta(days=quantity)):
                held.append(line)
                met.add(n)
        if held:
            want[k] = (len(held), min(held))
    got = {r.o_orderkey: (r.n, r.first_k) for r in QUERIES["interval_membership_all"](spark, d).collect()}
    assert got == want
    assert {lines[n][0] % 50 for n in met} > {7} and {k % 4 for k in want} == {0, 1, 2, 3}


def test_upsert_merge_all(spark, tables):
    d, _, orders = tables
    want = {k: (v, "old") if s == "F" else (v * 2, "new") for k, _, s, v, _ in orders}
    rows = QUERIES["upsert_merge_all"](spark, d).collect()
    assert len(rows) == len(orders) and {r.k: (r.v, r.src) for r in rows} == want


def test_benchmark_ffill_all(spark, tables):
    d, lines, _ = tables
    own = defaultdict(list)
    for _, supplier, quantity, price, tax, _, _, at in lines:
        if supplier == 7:
            own[at.date()].append((price, quantity, tax))
    value = {t: sum(x[0] for x in v) / sum(x[1] for x in v) * (1 + sum(x[2] for x in v) / len(v)) for t, v in own.items()}
    days = sorted({x[7].date() for x in lines})
    base = last = value[max(t for t in value if t < datetime.date(1996, 1, 1))]
    want = {}
    for t in (t for t in days if t >= datetime.date(1996, 1, 1)):
        last = value.get(t, last)
        want[t] = last / base - 1
    got = {r.date: r.bench for r in QUERIES["benchmark_ffill_all"](spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 2e-6 for t in want)
    assert any(t not in value for t in want) and {t.month % 3 for t in value} == {0, 1, 2}
