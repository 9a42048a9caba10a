"""The expression language: parsing, validation, and hand-made series."""

import math

import pytest

from factorloom.plans.atoms import atomic_factors
from factorloom.plans.compiler import Frame, compile_factors, depth_of
from factorloom.plans.parser import FIELDS, OPERATORS, ExpressionError, parse, strip_cross_sectional, validate_expression


def test_valid_expression():
    r = validate_expression("Mean($close, 5) / Mean($close, 20)")
    assert r.ok and r.fields == ("close",) and r.operators == ("Mean",)


@pytest.mark.parametrize("text", ["   ", "Mean($close, 5", "Mean($close, 5))", "5 + 3", "$close; import os"])
def test_invalid_expressions(text):
    assert not validate_expression(text).ok


def test_unknown_names():
    assert "unknown fields" in validate_expression("Mean($bogus, 5)").error
    assert "unknown calls" in validate_expression("Frobnicate($close, 5)").error
    assert len(OPERATORS) == 48 and len(FIELDS) == 14


@pytest.mark.parametrize("text", ["Mean($close 5)", "$close, $open", "Mean($close, )", "Mean($close, 5) 3", "Mask($close, $open)", "Mean($close)", "Mean($close, $open)", "Mean($close, 2.5)", "Mean($close, 0)", "Quantile($close, 5, 2)", "If($close, 1)", "Mean(close, 5)", "", "Corr($close, 5)"])
def test_what_validates_parses_and_compiles(panel, text):
    assert not validate_expression(text).ok
    if text not in ("Mask($close, $open)", "Mean($close, 2.5)", "Mean($close, 0)", "Quantile($close, 5, 2)"):  # the compiler has no opinion on these
        with pytest.raises((ExpressionError, TypeError, IndexError)):
            compile_factors(panel, {"v": text.replace("$open", "$volume")})


@pytest.mark.parametrize("text", ["Sqrt($close)", "Median($close, 3)", "-$close % 2", "!($close > 1) || $volume == 2", "Quantile($close, 3, 0.25)", "Ref($close, 0)", "CSRank(Corr($close, $volume, 4))", "If($close > 2, $close, 1e3)"])
def test_what_compiles_validates(panel, text):
    assert validate_expression(text).ok
    compile_factors(panel, {"v": text})


def test_lenient_windows_may_be_left_out():
    assert validate_expression("Mean($close)", strict=False).ok and not validate_expression("Mean($close)").ok


def test_precedence_and_signs():
    assert str(parse("1 + 2 * 3")) == "Add(1, Mul(2, 3))"
    assert str(parse("-2 * $close")) == "Mul(-2, $close)"
    assert str(parse("$a - $b - $c")) == "Sub(Sub($a, $b), $c)"
    assert str(parse("($a - $b) / $c > 0 && $d < 1")) == "And(Gt(Div(Sub($a, $b), $c), 0), Lt($d, 1))"
    for bad in ("$a $b", "Mean($a, 5) 3", "1 +", "($a", "Mean($a,)"):
        with pytest.raises(ExpressionError):
            parse(bad)


def test_strip_and_depth():
    assert strip_cross_sectional("CSRank(Mean($close, 5))") == ("Mean($close, 5)", "CSRank")
    assert strip_cross_sectional("CSRank($a) + 1")[1] is None
    assert depth_of("Mean(Ref($close, 3), 5)") == 7 and depth_of("$close") == 0
    assert len(atomic_factors()) == 88 and all(validate_expression(e).ok for e in atomic_factors().values())


X = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
Y = [1.0, 2.0, 2.0, 5.0, 3.0, 7.0, 1.0, 4.0]


@pytest.fixture(scope="module")
def panel(spark):
    rows = [("a", i, x, y) for i, (x, y) in enumerate(zip(X, Y))]
    rows += [("flat", i, 7.0, 1.0 * i) for i in range(6)] + [("one", 0, 5.0, 1.0)]
    rows += [("gap", i, None if i == 3 else float(i), 1.0) for i in range(6)]
    return spark.createDataFrame(rows, "asset string, date int, close double, volume double")


def values(panel, expression, asset="a", **frame):
    out = compile_factors(panel, {"v": expression}, Frame(**frame)).where(f"asset = '{asset}'").orderBy("date")
    return [r["v"] for r in out.collect()]


def test_strict_windows(panel):
    assert values(panel, "Mean($close, 3)")[:3] == [None, None, pytest.approx(8 / 3)]
    assert values(panel, "Rank($close, 3)")[2:] == [1.0, 0.0, 1.0, 1.0, 0.0, 0.5]
    assert values(panel, "EMA($close, 3)") == [3, 2, 3, 2, 3.5, 6.25, 4.125, 5.0625]
    assert values(panel, "Std($close, 8)")[-1] == pytest.approx(2.748376143938713)
    assert values(panel, "Skew($close, 8)")[-1] == pytest.approx(0.833503138533666)
    assert values(panel, "Kurt($close, 8)")[-1] == pytest.approx(0.2766058045369954)
    assert values(panel, "Corr($close, $volume, 8)")[-1] == pytest.approx(0.6218381993294013)
    assert values(panel, "Slope($close, 2)")[1:] == [b - a for a, b in zip(X, X[1:])]
    assert values(panel, "WMA($close, 2)")[1] == pytest.approx((2 * 1 + 3) / 3)
    assert values(panel, "Ref($close, 0)") == X and values(panel, "Ref($close, 2)")[:3] == [None, None, 3.0]
    assert values(panel, "Mad($close, 2)")[1] == 1.0


def test_lenient_windows(panel):
    assert values(panel, "Rank($close, 3)", strict=False) == pytest.approx([1, 0.5, 1, 2 / 3, 1, 1, 1 / 3, 2 / 3])
    assert values(panel, "IdxMax($close, 3)", strict=False) == [0, 0, 2, 1, 2, 2, 1, 0]
    assert values(panel, "Ref($close, 2)", strict=False)[:2] == [0, 0]
    assert values(panel, "$close / ($close - $close)", strict=False) == [0.0] * 8
    assert values(panel, "Corr($close, $volume, 4)", "flat", strict=False) == [0.0] * 6
    assert values(panel, "WMA($close, 4)", "one", strict=False) == [5.0]


def test_flat_missing_and_single(panel):
    assert values(panel, "Rsquare($close, 3)", "flat")[2:] == [0.0] * 4
    assert values(panel, "Corr($close, $volume, 3)", "flat") == [None] * 6
    assert values(panel, "Std($close, 2)", "one") == [None]
    assert values(panel, "Mean($close, 2)", "gap") == [None, 0.5, 1.5, 1.0, 2.0, 4.5]
    assert values(panel, "Max($close, 2)", "gap") == [None, 1.0, 2.0, None, None, 5.0]
    assert values(panel, "Log($close - 10)", "gap") == [None] * 6
    assert values(panel, "EMA($close, 3)", "gap")[3] is None
    assert math.isclose(values(panel, "Quantile($close, 4, 0.25)")[3], 1.0)


def test_shared_subtrees_share_a_column(panel):
    wide = compile_factors(panel, {"a": "Mean($close, 3) - $close", "b": "Mean($close, 3) / $close", "c": "Std(Mean($close, 3), 2)"})
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_cross_section_anywhere(spark, panel):
    out = compile_factors(panel, {"r": "CSRank($close)", "z": "Abs(CSZScore($close))"}, Frame()).where("date = 0").orderBy("asset").collect()
    assert [r["r"] for r in out] == [0.5, 1.0, 0.25, 0.75]
    with pytest.raises(ExpressionError):
        compile_factors(panel, {"n": "Neu($close)"})
    with pytest.raises(ExpressionError):
        compile_factors(panel, {"n": "Mask($close, $volume)"})
