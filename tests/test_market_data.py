"""The strategy data API: nothing later than the day enters an answer."""

import datetime

import pytest

from factorloom.operators.fundamentals import query, valuation
from factorloom.operators.market_data import MarketData, stored


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


@pytest.fixture(scope="module")
def market(spark):
    bars = [("600000.SH", day(n), 10.0 + n, 1.0 if n < 5 else 2.0, 100.0 * n) for n in range(10) if n != 3] + [("000001.SZ", day(n), 5.0, None, 7.0) for n in (0, 8)] + [("300001.SZ", day(9), 3.0, 1.0, 1.0)]
    securities = [("600000.SH", "stock", day(0), None), ("510050.SH", "etf", day(2), day(6)), ("000001.SZ", "stock", day(7), None)]
    weights = [("000300.SH", "600000.SH", day(1)), ("000300.SH", "000001.SZ", day(1)), ("000300.SH", "600000.SH", day(6)), ("000016.SH", "000001.SZ", day(1))]
    industries = [("600000.SH", "banks", day(0), day(5)), ("600000.SH", "brokers", day(5), None), ("000001.SZ", "banks", day(6), None)]
    values = [("600000.SH", day(2), 9.0, 1.0), ("000001.SZ", day(2), 4.0, 2.0), ("600000.SH", day(7), 1.0, 3.0)]
    return MarketData(
        spark.createDataFrame(bars, "ts_code string, date date, close double, adj_factor double, volume double"),
        spark.createDataFrame(securities, "ts_code string, kind string, list_date date, delist_date date"),
        spark.createDataFrame(weights, "index_code string, con_code string, trade_date date"),
        spark.createDataFrame(industries, "ts_code string, l1_name string, in_date date, out_date date"),
        spark.createDataFrame(values, "ts_code string, trade_date date, pe double, pb double"),
    )


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_history(market):
    got = rows(market.attribute_history(["600000.XSHG", " 000001.xshe"], 3, str(day(6)), ["close", "volume"]))
    assert got == [("000001.XSHE", day(0), 5.0, 7.0), ("600000.XSHG", day(2), 6.0, 200.0), ("600000.XSHG", day(4), 7.0, 400.0), ("600000.XSHG", day(5), 15.0, 500.0)]
    early = rows(market.attribute_history(["600000.SH"], 2, str(day(4)), ["close"]))
    assert early == [("600000.XSHG", day(1), 11.0), ("600000.XSHG", day(2), 12.0)]  # the later factor isn't known yet
    assert {r[0] for r in rows(market.attribute_history(None, 1, str(day(9)), ["close"]))} == {"600000.XSHG", "000001.XSHE"}
    assert rows(market.attribute_history(["999999.SH"], 5, str(day(9)), ["close"])) == []
    with pytest.raises(ValueError, match="vwap"):
        market.attribute_history(None, 1, str(day(3)), ["vwap"])


def test_members_and_securities(market):
    members = lambda n: {r[0] for r in rows(market.get_index_stocks("000300.XSHG", str(day(n))))}
    assert members(0) == set() and members(3) == {"600000.XSHG", "000001.XSHE"} and members(6) == {"600000.XSHG"}
    listed = lambda n, *k: {r[0] for r in rows(market.get_all_securities(str(day(n)), k))}
    assert listed(3) == {"600000.XSHG", "510050.XSHG"} and listed(6) == {"600000.XSHG"} and listed(8, "stock") == {"600000.XSHG", "000001.XSHE"} and listed(3, "etf") == {"510050.XSHG"}


def test_industry_and_fundamentals(market):
    assert rows(market.get_industry(None, str(day(4)))) == [("600000.XSHG", "banks")]
    assert rows(market.get_industry(["600000.XSHG"], str(day(5)))) == [("600000.XSHG", "brokers")]
    q = query(valuation.code).filter(valuation.pe_ratio > 3)
    assert {r[0] for r in market.get_fundamentals(q, str(day(3))).collect()} == {"600000.XSHG", "000001.XSHE"}
    assert market.get_fundamentals(q, str(day(8))).count() == 0


def test_missing_tables_and_codes():
    with pytest.raises(ValueError, match="weights"):
        MarketData().get_index_stocks("000300.XSHG", "2024-01-01")
    assert [stored(c) for c in ("600000.xshg", "000001.XSHE", "510050.SH", "IF2401.CFF", "600000")] == ["600000.SH", "000001.SZ", "510050.SH", "IF2401.CFF", "600000"]
