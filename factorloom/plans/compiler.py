"""Compiles factor expressions to window columns, each distinct subtree once.

Rolling calls are formulas over aggregates of each asset's last rows. A window numbers the rows by date, for which Spark deals and
sorts them once; one pass over the sorted batches (see sliding) then makes all aggregates of a stage, each (aggregate, series,
frame) once. Where only earlier rows are asked for, they come by lag. Subtrees are added in stages by depth, as plain columns.

Two modes. strict: a value needs a full window of observed rows, else NULL (Mean and Sum count missing rows as 0 in a full
window). lenient: windows grow from the first row, undefined values are 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .parser import CROSS_SECTIONAL, ExpressionError, Node, nodes, parse
from .sliding import ROW, Ask, slide

_TINY = 1e-10
#: A default window of each kind of rolling call in lenient mode.
_DEFAULTS = {"Ref": [1], "Delta": [1], "EMA": [5], "WMA": [5], "Quantile": [20, 0.5]}


@dataclass(frozen=True)
class Frame:
    """Whose rows stand in which order."""

    asset: str = "asset"
    date: str = "date"
    industry: str | None = None
    strict: bool = True
    greater_as: str = "compare"

    def series(self) -> WindowSpec:
        return Window.partitionBy(self.asset).orderBy(self.date)

    def day(self) -> WindowSpec:
        return Window.partitionBy(self.date)


def _flag(c: Column) -> Column:
    return c.cast("double")


def _true(x: Column) -> Column:
    return x != 0


def finite(x: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(math.inf)), None).otherwise(x)


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is next to 0."""
    return F.when(F.abs(b) > _TINY, a / b).otherwise(F.when(a.isNull() | b.isNull(), None).otherwise(F.lit(0.0)))


def _elementwise(f: Frame) -> dict[str, Callable[..., Column]]:
    compare = {"Gt": lambda a, b: a > b, "Ge": lambda a, b: a >= b, "Lt": lambda a, b: a < b, "Le": lambda a, b: a <= b, "Eq": lambda a, b: a == b, "Ne": lambda a, b: a != b}
    out: dict[str, Callable[..., Column]] = {name: (lambda a, b, g=g: _flag(g(a, b))) for name, g in compare.items()}
    most, least = (F.greatest, F.least) if f.greater_as == "max" else (out["Gt"], out["Lt"])
    return out | {
        "Neg": lambda a: -a,
        "Add": lambda a, b: a + b,
        "Sub": lambda a, b: a - b,
        "Mul": lambda a, b: a * b,
        "Div": F.try_divide if f.strict else safe_divide,
        "Mod": lambda a, b: F.try_mod(a, b),
        "Power": F.pow,
        "Greater": most,
        "Less": least,
        "And": lambda a, b: _flag(_true(a) & _true(b)),
        "Or": lambda a, b: _flag(_true(a) | _true(b)),
        "Not": lambda a: _flag(~_true(a)),
        "If": lambda c, a, b: F.when(_true(c), a).otherwise(b),
        "Abs": F.abs,
        "Sign": F.signum,
        "Log": (lambda a: F.ln(a)) if f.strict else (lambda a: F.ln(F.abs(a) + _TINY)),
        "Sqrt": lambda a: F.sqrt(F.abs(a)),
    }


#: Gives what sliding.Ask says of a series over its last rows, or of two: kind, series, rows, then y or param by name.
Over = Callable[..., Column]


def corrected_skew(x: Column, rows: int, over: Over) -> Column:
    n, m2 = over("count", x, rows), over("m2", x, rows)
    return F.when(n > 2, F.try_divide(F.sqrt(n) * over("m3", x, rows), F.sqrt(m2 * m2 * m2)) * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(x: Column, rows: int, over: Over) -> Column:
    n, m2 = over("count", x, rows), over("m2", x, rows)
    excess = F.try_divide(n * over("m4", x, rows), m2 * m2) - 3.0
    return F.when(n > 3, ((n + 1) * excess + 6) * (n - 1) / ((n - 2) * (n - 3)))


def ema_terms(alpha: float) -> int:
    """Rows after which a row's weight in an exponential mean is below double precision."""
    return 2 + math.ceil(math.log(1e-17) / math.log(1 - alpha)) if alpha < 1 else 1


def _rolling(f: Frame, row_no: Column, over: Over) -> dict[str, Callable[..., Column]]:
    """Calls over one series; x is a column, n the window. Calls that need the same aggregate of the same frame share it."""

    def full(x: Column, n: int, value: Column) -> Column:
        return F.when(over("count", x, n) == n, value)

    def gate(least: int) -> Callable[[Column, int, Column], Column]:
        if f.strict:
            return full
        return lambda x, n, value: F.when(over("count", x, n) >= least, value).otherwise(F.lit(0.0))

    def total(x: Column, n: int) -> Column:
        s = over("sum", x, n)
        return F.when(row_no >= n, s) if f.strict else s

    def mean(x: Column, n: int) -> Column:
        return total(x, n) / (F.lit(float(n)) if f.strict else F.least(row_no, F.lit(n)))

    def shift(x: Column, n: int) -> Column:
        if n <= 0:
            return x
        return over("lag", x, n, param=None if f.strict else 0.0)

    def delta(x: Column, n: int) -> Column:
        d = x - over("lag", x, n)
        return d if f.strict else F.when(row_no > n, d).otherwise(F.lit(0.0))

    def weighted(x: Column, n: int) -> Column:
        lags = [x, *(over("lag", x, k) for k in range(1, n))]
        if f.strict:
            return sum((c * float(n - k) for k, c in enumerate(lags[1:], 1)), lags[0] * float(n)) / (n * (n + 1) / 2)
        top = sum((F.coalesce(c, F.lit(0.0)) * float(n - k) for k, c in enumerate(lags[1:], 1)), F.coalesce(x, F.lit(0.0)) * float(n))
        rows = F.least(row_no, F.lit(n))
        return top / (rows * (F.lit(2 * n + 1) - rows) / 2)  # the weights n, n-1, ... of the rows there are

    def spread(x: Column, n: int) -> Column:
        return F.try_divide(over("m2", x, n), over("count", x, n) - 1)

    def at(x: Column) -> Column:
        return F.when(x.isNotNull(), row_no.cast("double"))

    def slope(x: Column, n: int) -> Column:
        return F.try_divide(over("ck", at(x), n, y=x), over("m2", at(x), n))

    def intercept(x: Column, n: int) -> Column:
        return over("mean", x, n) - slope(x, n) * over("mean", at(x), n)

    def r2(x: Column, n: int) -> Column:
        r = F.try_divide(over("ck", x, n, y=at(x)), F.sqrt(over("m2", at(x), n) * over("m2", x, n)))
        return r * r

    def rank(x: Column, n: int) -> Column:
        if f.strict:
            return full(x, n, F.when(x.isNotNull(), over("below", x, n) / F.lit(max(1, n - 1))))
        return F.try_divide(over("upto", x, n), over("count", x, n))

    def quantile(x: Column, n: int, q: float = 0.5) -> Column:
        return gate(1)(x, n, over("quantile", x, n, param=float(q)))

    plain = lambda kind: lambda x, n: gate(1)(x, n, over(kind, x, n))
    flat = lambda x, n: over("m2", x, n) == 0
    return {
        "Ref": shift,
        "Delta": delta,
        "Mean": mean,
        "Sum": total,
        "Std": lambda x, n: gate(2)(x, n, F.sqrt(spread(x, n))),
        "Var": lambda x, n: gate(2)(x, n, spread(x, n)),
        "Max": plain("max"),
        "Min": plain("min"),
        "Skew": lambda x, n: gate(3)(x, n, corrected_skew(x, n, over)),
        "Kurt": lambda x, n: gate(4)(x, n, corrected_kurtosis(x, n, over)),
        "Count": lambda x, n: (full if f.strict else (lambda _x, _n, v: v))(x, n, over("sum", _flag(_true(x)), n)),
        "EMA": lambda x, n: over("ema", x, n, param=float(ema_terms(2.0 / (n + 1)))),
        "WMA": weighted,
        "Slope": lambda x, n: gate(2)(x, n, slope(x, n)),
        "Rsquare": lambda x, n: gate(2)(x, n, F.when(flat(x, n), F.lit(0.0)).otherwise(r2(x, n))),
        "Resi": lambda x, n: gate(2)(x, n, x - (intercept(x, n) + slope(x, n) * row_no)),
        "Med": quantile,
        "Quantile": quantile,
        "Mad": plain("mad"),
        "Rank": rank,
        "IdxMax": plain("idxmax"),
        "IdxMin": plain("idxmin"),
    }


def _pairwise(f: Frame, over: Over) -> dict[str, Callable[..., Column]]:
    def both(x: Column, y: Column, n: int) -> tuple[Column, Column, Column]:
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        return x, y, over("count", x, n)

    def corr(x: Column, y: Column, n: int) -> Column:
        x, y, seen = both(x, y, n)
        std = lambda c: F.sqrt(F.try_divide(over("m2", c, n), seen))
        r = F.try_divide(F.try_divide(over("ck", x, n, y=y), seen), std(x) * std(y))
        return F.when((seen == n) & F.lit(n > 2), r) if f.strict else F.coalesce(F.when(seen >= 3, r), F.lit(0.0))

    def cov(x: Column, y: Column, n: int) -> Column:
        x, y, seen = both(x, y, n)
        c = F.try_divide(over("ck", x, n, y=y), seen - 1)
        return F.when((seen == n) & F.lit(n > 1), c) if f.strict else F.coalesce(F.when(seen >= 3, c), F.lit(0.0))

    return {"Corr": corr, "Cov": cov}


def average_rank(x: Column, day: list[str]) -> Column:
    """Rank within the day, ties averaged; NULL for NULL."""
    asc = F.rank().over(Window.partitionBy(*day).orderBy(x.asc_nulls_last()))
    ties = F.count(x).over(Window.partitionBy(*day, x))
    return F.when(x.isNotNull(), asc + (ties - 1) / 2.0)


def _cross_sectional(f: Frame) -> dict[str, Callable[[Column], Column]]:
    def rank(x: Column) -> Column:
        return average_rank(x, [f.date]) / F.count(x).over(f.day())

    def zscore(x: Column) -> Column:
        return (x - F.avg(x).over(f.day())) / F.nullif(F.stddev_samp(x).over(f.day()), F.lit(0.0))

    def neutral(x: Column) -> Column:
        if f.industry is None:
            raise ExpressionError("Neu needs an industry column")
        mean = F.avg(x).over(Window.partitionBy(f.date, f.industry))
        return F.when(F.col(f.industry).isNull(), x).otherwise(x - mean)

    return {"CSRank": rank, "CSZScore": zscore, "Neu": neutral}


#: Names of staged columns.
_STAGED = re.compile(r"__\d+_[ax]?\d+")


def _names(columns: Iterable[Column]) -> set[str]:
    return {name for c in columns for name in _STAGED.findall(str(c))}


class Stage:
    """Columns that only need those of earlier levels: what is asked of series, then any other."""

    def __init__(self, level: int) -> None:
        self.level = level
        self.inputs: dict[str, Column] = {}
        self.names: dict[str, str] = {}
        self.asks: list[Ask] = []
        self.columns: dict[str, Column] = {}
        self.crosses = False

    def _input(self, x: Column) -> str:
        name = self.names.setdefault(str(x), f"__{self.level}_x{len(self.names)}")
        self.inputs.setdefault(name, x.cast("double"))
        return name

    def ask(self, kind: str, x: Column, rows: int, y: Column | None, param: float | None) -> Column:
        name = f"__{self.level}_a{len(self.asks)}"
        self.asks.append(Ask(name, kind, rows, self._input(x), None if y is None else self._input(y), param))
        return F.col(name)

    def put(self, made: Column, crosses: bool) -> Column:
        name = f"__{self.level}_{len(self.columns)}"
        self.columns[name] = made
        self.crosses = self.crosses or crosses
        return F.col(name)


def compile_factors(panel: DataFrame, expressions: Mapping[str, str], frame: Frame = Frame(), keep: list[str] | None = None) -> DataFrame:
    """panel with one column per named expression.

    panel: a row per (asset, date), each asset's rows being its own range of the calendar (see calendar.densify), so that
    offsets count sessions; `$name` is column `name`. Rows of missing sessions hold NULL. Cross-sectional calls may stand
    anywhere. Returns the columns of `keep` (all of panel's when None) and the expressions.
    """
    trees = {name: parse(text) for name, text in expressions.items()}
    order: dict[Node, None] = {}
    for tree in trees.values():
        for n in nodes(tree):
            order[n] = None
    kept = panel.columns if keep is None else keep
    read = {n.value for n in order if n.op == "field"} | {frame.asset, frame.date, frame.industry, *kept}
    out = panel.select(*[F.col(f"`{c}`") for c in panel.columns if c in read]).withColumn(ROW, F.row_number().over(frame.series()))
    plain, across = _elementwise(frame), _cross_sectional(frame)
    column: dict[Node, Column] = {}
    depth: dict[Node, int] = {}
    staged: list[Stage] = []

    def stage_at(level: int) -> Stage:
        while len(staged) <= level:
            staged.append(Stage(len(staged)))
        return staged[level]

    shared: dict[tuple, Column] = {}
    level = 0

    def over(kind: str, x: Column, rows: int, y: Column | None = None, param: float | None = None) -> Column:
        """What sliding.Ask says of a series, staged once at the level of the call that asks first."""
        key = kind, str(x), rows, str(y), param
        if key not in shared:
            shared[key] = stage_at(level).ask(kind, x, rows, y, param)
        return shared[key]

    rolling, pairs = _rolling(frame, F.col(ROW), over), _pairwise(frame, over)

    def number(n: Node, what: str) -> float:
        if n.op != "const":
            raise ExpressionError(f"{what} takes a number, not {n}")
        return float(n.value)

    for n in order:
        if n.op == "const":
            column[n], depth[n] = F.lit(n.value), 0
            continue
        if n.op == "field":
            if n.value not in panel.columns:
                raise ExpressionError(f"unknown field ${n.value}")
            column[n], depth[n] = F.col(f"`{n.value}`").cast("double"), 0
            continue
        level = max((depth[a] for a in n.args), default=0)
        if n.op in plain:
            column[n], depth[n] = plain[n.op](*(column[a] for a in n.args)), level
            continue
        crosses = n.op in across
        if n.op in pairs or n.op in rolling:
            series = 2 if n.op in pairs else 1
            params = [number(a, n.op) for a in n.args[series:]]
            if not params and frame.strict:
                raise ExpressionError(f"{n.op} needs a window")
            params = params or _DEFAULTS.get(n.op, [20])
            if len(params) == 1 and n.op == "Quantile":
                params.append(0.5)
            made = (pairs.get(n.op) or rolling[n.op])(*(column[a] for a in n.args[:series]), int(params[0]), *params[1:])
            level += 1
        elif crosses:
            made = across[n.op](column[n.args[0]])
        else:
            raise ExpressionError(f"unknown operator {n.op}")
        column[n], depth[n] = stage_at(level).put(made, crosses), level + 1
    values = {name: finite(column[t].cast("double")) for name, t in trees.items()}
    wanted = [_names(values.values())]  # by the number of stages still to come: the staged columns that are read then
    for stage in reversed(staged):
        wanted.append(wanted[-1] | _names(stage.columns.values()) | _names(stage.inputs.values()))
    sorted_rows, moved = True, False  # the row numbers' window has dealt and sorted them; whether batches passed a function
    for later, stage in zip(reversed(wanted[:-1]), staged, strict=True):
        if stage.columns and not stage.crosses:
            out = out.withColumns(stage.columns)
        if stage.asks and not moved and all(a.kind == "lag" for a in stage.asks):
            out = out.withColumns(stage.inputs).withColumns({a.name: F.lag(a.x, a.n, a.param).over(frame.series()) for a in stage.asks}).drop(*stage.inputs)
        elif stage.asks:
            if not sorted_rows:
                out = out.repartition(frame.asset).sortWithinPartitions(frame.asset, ROW)
            later = later | (_names(stage.columns.values()) if stage.crosses else set())
            read_on = [c for c in out.columns if c in later or not _STAGED.fullmatch(c)]
            out = slide(out.select(*[F.col(f"`{c}`") for c in read_on], *[x.alias(name) for name, x in stage.inputs.items()]), stage.asks, set(stage.inputs))
            sorted_rows = moved = True
        if stage.crosses:
            out, sorted_rows = out.withColumns(stage.columns), False
    return out.select(*[F.col(f"`{c}`") for c in kept], *[value.alias(name) for name, value in values.items()])


def depth_of(text: str) -> int:
    """Rows before a date that an expression looks at: what an incremental run must load besides the new rows."""

    def need(n: Node) -> int:
        own = 0
        if n.op not in ("const", "field") and n.args and n.args[-1].op == "const" and n.op not in CROSS_SECTIONAL:
            window = int((n.args[1] if n.op == "Quantile" else n.args[-1]).value)
            own = window if n.op in ("Ref", "Delta") else ema_terms(2.0 / (window + 1)) if n.op == "EMA" else window - 1
        return max(own, 0) + max((need(a) for a in n.args), default=0)

    return need(parse(text))
