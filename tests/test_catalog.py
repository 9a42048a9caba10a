"""Every catalogued query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from factorloom.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return str(v.replace(tzinfo=None))
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = con.execute(ORACLES[name])
    names = [c[0] for c in got.description]
    cols = sorted(names)
    assert sorted(df.columns) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=str)
    have = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x))) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf, name):
    """Those without SQL give rows; test_values.py and test_engine_operators.py have their values."""
    assert QUERIES[name](spark, sf).count()
