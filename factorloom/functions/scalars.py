"""Column functions: codes, classes, safe arithmetic, prices and lots, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_tushare_code(c: Column) -> Column:
    """600000.XSHG -> 600000.SH, 000001.XSHE -> 000001.SZ, in upper case without outer blanks."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"\.XSHG$", ".SH"), r"\.XSHE$", ".SZ")


def to_joinquant_code(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"\.SH$", ".XSHG"), r"\.SZ$", ".XSHE")


def to_store_code(c: Column) -> Column:
    """600000.SH -> SH600000."""
    return F.concat(F.upper(F.split_part(c, F.lit("."), F.lit(2))), F.split_part(c, F.lit("."), F.lit(1)))


def from_store_code(c: Column) -> Column:
    """SH600000 -> 600000.SH."""
    return F.concat(F.substring(c, 3, 1000), F.lit("."), F.upper(F.substring(c, 1, 2)))


def normalize_codes(codes: Column) -> Column:
    """An array of codes in one form, blanks dropped, each once in its first place."""
    return F.array_distinct(F.transform(F.filter(codes, lambda c: F.trim(c) != ""), to_tushare_code))


def classify_asset(c: Column) -> Column:
    """stock, etf, index or futures by exchange suffix and number prefix; unknown codes are stocks."""
    code = to_tushare_code(c)
    body, suffix = F.split_part(code, F.lit("."), F.lit(1)), F.split_part(code, F.lit("."), F.lit(2))
    fund = ((suffix == "SH") & body.startswith("5")) | ((suffix == "SZ") & F.substring(body, 1, 2).isin("15", "16", "18"))
    index = ((suffix == "SH") & body.startswith("000")) | ((suffix == "SZ") & body.startswith("399"))
    return F.when(suffix.isin("SHF", "DCE", "CZC", "CFF", "INE"), "futures").when(fund, "etf").when(index, "index").otherwise("stock")


#: Bounds of the safe arithmetic of the factor search.
SAFE_LIMIT, SAFE_TINY = 1e6, 1e-10


def clip(x: Column, low: float = -SAFE_LIMIT, high: float = SAFE_LIMIT) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > SAFE_TINY, clip(a / b)).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def safe_log(x: Column) -> Column:
    return F.ln(F.abs(x) + SAFE_TINY)


def round_price(x: Column, tick: float = 0.001) -> Column:
    """To the nearest tick, halves to the even one."""
    return F.rint(x / tick) * tick


def round_lot(amount: Column, lot: int = 100) -> Column:
    """Buys in whole lots, toward 0; sells (negative) as they are."""
    return F.when(amount > 0, F.floor(amount / lot) * lot).otherwise(amount).cast("long")


def fill_price(price: Column, amount: Column, slippage: float, tick: float = 0.001) -> Column:
    """The price after half the slippage against the order, to the tick."""
    return round_price(price * (1 + F.signum(amount) * slippage / 2), tick)


def commission(value: Column, rate: float, least: float) -> Column:
    return F.when(value == 0, F.lit(0.0)).otherwise(F.greatest(F.abs(value) * rate, F.lit(least)))


def stamp_duty(value: Column, amount: Column, kind: Column, rate: float = 0.0005) -> Column:
    """On sales of stocks only."""
    return F.when((amount < 0) & (kind == "stock"), F.abs(value) * rate).otherwise(F.lit(0.0))


def limit_reject(amount: Column, open_: Column, pre_close: Column, kind: Column, limit: float = 0.1, slack: float = 1e-3) -> Column:
    """Stock orders against the day's price limit: buys at the upper, sells at the lower."""
    up, down = open_ >= pre_close * (1 + limit) - slack, open_ <= pre_close * (1 - limit) + slack
    hit = F.when(amount > 0, up).otherwise(down)
    return F.coalesce((kind == "stock") & (pre_close > 0) & hit, F.lit(False))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def unique_name(name: Column, expression: Column) -> Column:
    """The slug and six characters of a digest of the expression without blanks."""
    return F.concat_ws("_", slug(name), F.substring(F.sha1(F.regexp_replace(expression, r"\s+", "")), 1, 6))


def percent_text(x: Column, digits: int = 2) -> Column:
    """12.34%, or -- where there is no finite number."""
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(fine, F.format_string(f"%.{digits}f%%", x * 100)).otherwise(F.lit("--"))


def referenced_codes(c: Column) -> Column:
    """Codes that a text names, each once, in one form."""
    return normalize_codes(F.regexp_extract_all(c, F.lit(r"(\b\d{6}\.(?:XSHG|XSHE|SH|SZ|BJ)\b)"), F.lit(1)))
