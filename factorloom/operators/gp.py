"""Genetic search for factor expressions: trees bred on the driver, fitness of whole generations by Spark.

Programs are trees of the expression language over terminals, which are columns of the panel: atoms, their ranks (csrank_) and
their values less their industry's mean (neu_). Only fitness values, a row per program, come to the driver.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.plans.compiler import Frame, average_rank, compile_factors
from factorloom.plans.parser import Node, nodes, parse

from .cross import cs_rank, neutralize
from .evaluate import pearson
from .ml import chronological_split

#: What programs are made of: two-place calls, one-place calls.
BINARY, UNARY = ("Add", "Sub", "Mul", "Div"), ("Abs", "Neg", "Log", "Sqrt")
SPLITS = ("train", "valid", "test")


def canonical(tree: Node) -> Node:
    """One tree for all that are sure to have the same values: sums and products in order, signs and sizes not taken twice."""
    args = tuple(canonical(a) for a in tree.args)
    if tree.op in ("Add", "Mul"):
        args = tuple(sorted(args, key=str))
    inner = args[0] if args else None
    if tree.op == "Neg" and inner.op == "Neg":
        return inner.args[0]
    if tree.op in ("Abs", "Sqrt", "Log") and inner.op in ("Neg", "Abs"):  # roots and logarithms are of sizes
        return canonical(Node(tree.op, inner.args))
    return Node(tree.op, args, tree.value)


def size(tree: Node) -> int:
    return 1 + sum(map(size, tree.args))


def depth(tree: Node) -> int:
    return 1 + max(map(depth, tree.args), default=0)


def places(tree: Node) -> Iterator[tuple[int, ...]]:
    """The paths of all nodes, each as the arguments to take from the root."""
    yield ()
    for i, a in enumerate(tree.args):
        for rest in places(a):
            yield (i, *rest)


def at(tree: Node, path: tuple[int, ...]) -> Node:
    return at(tree.args[path[0]], path[1:]) if path else tree


def put(tree: Node, path: tuple[int, ...], new: Node) -> Node:
    if not path:
        return new
    args = tuple(put(a, path[1:], new) if i == path[0] else a for i, a in enumerate(tree.args))
    return Node(tree.op, args, tree.value)


@dataclass(frozen=True)
class Config:
    """Sizes of a search; shares of the ways to breed, what is left of 1 is plain reproduction."""

    population: int = 40
    generations: int = 3
    tournament: int = 5
    init_depth: tuple[int, int] = (1, 3)
    most_nodes: int = 24
    crossover: float = 0.6
    subtree: float = 0.15
    hoist: float = 0.05
    point: float = 0.1
    point_each: float = 0.2
    parsimony: float = 0.001
    min_names: int = 10
    keep: int = 10
    seed: int = 11
    stop_at: float | None = None


@dataclass(frozen=True)
class Found:
    """A program with its mean daily rank IC on the parts of the calendar; None where a part has no day for it."""

    program: str
    train: float | None
    valid: float | None
    test: float | None
    nodes: int = field(default=1, compare=False)


class Breeder:
    """Seeded tree operators; the same seed and fitness give the same programs."""

    def __init__(self, terminals: Sequence[str], config: Config):
        self.terminals, self.config, self.rng = list(terminals), config, random.Random(config.seed)

    def terminal(self) -> Node:
        return Node("field", value=self.rng.choice(self.terminals))

    def grow(self, deep: int, full: bool = False) -> Node:
        """A random tree: all branches as deep as asked where full, else some end early."""
        if deep <= 0 or (not full and self.rng.random() < 0.2):
            return self.terminal()
        if self.rng.random() < 0.3:
            return Node(self.rng.choice(UNARY), (self.grow(deep - 1, full),))
        return Node(self.rng.choice(BINARY), (self.grow(deep - 1, full), self.grow(deep - 1, full)))

    def first(self) -> list[Node]:
        """Half of the trees full, half grown, over the depths in turn."""
        lo, hi = self.config.init_depth
        return [canonical(self.grow(lo + i % (hi - lo + 1), full=i % 2 == 0)) for i in range(self.config.population)]

    def _place(self, tree: Node) -> tuple[int, ...]:
        """A node's path, calls nine times in ten where there are any."""
        paths = list(places(tree))
        calls = [p for p in paths if at(tree, p).args]
        return self.rng.choice(calls if calls and self.rng.random() < 0.9 else paths)

    def crossover(self, a: Node, b: Node) -> Node:
        """a with one of its subtrees exchanged for one of b's."""
        return put(a, self._place(a), at(b, self._place(b)))

    def subtree_mutation(self, a: Node) -> Node:
        return self.crossover(a, self.grow(self.rng.randint(*self.config.init_depth)))

    def hoist_mutation(self, a: Node) -> Node:
        """a with one of its subtrees replaced by a subtree of that: a smaller program."""
        path = self._place(a)
        inner = at(a, path)
        return put(a, path, at(inner, self._place(inner)))

    def point_mutation(self, a: Node) -> Node:
        """a with some nodes exchanged for others of as many arguments."""
        args = tuple(self.point_mutation(x) for x in a.args)
        if self.rng.random() >= self.config.point_each:
            return Node(a.op, args, a.value)
        if not args:
            return self.terminal()
        return Node(self.rng.choice(UNARY if len(args) == 1 else BINARY), args)

    def tournament(self, pool: Sequence[Node], rate: Callable[[Node], float]) -> Node:
        """The best of some programs drawn with replacement; of equal ones the one whose text comes first."""
        drawn = [self.rng.choice(pool) for _ in range(self.config.tournament)]
        return min(drawn, key=lambda t: (-rate(t), str(t)))

    def next(self, pool: Sequence[Node], rate: Callable[[Node], float]) -> list[Node]:
        """The generation after pool."""
        c, out = self.config, []
        while len(out) < c.population:
            parent, way = self.tournament(pool, rate), self.rng.random()
            if way < c.crossover:
                child = self.crossover(parent, self.tournament(pool, rate))
            elif way < c.crossover + c.subtree:
                child = self.subtree_mutation(parent)
            elif way < c.crossover + c.subtree + c.hoist:
                child = self.hoist_mutation(parent)
            elif way < c.crossover + c.subtree + c.hoist + c.point:
                child = self.point_mutation(parent)
            else:
                child = parent
            out.append(canonical(child) if size(child) <= c.most_nodes else parent)
        return out


def with_terminals(panel: DataFrame, atoms: Sequence[str], industry: str | None = None, date: str = "date") -> tuple[DataFrame, list[str]]:
    """panel with csrank_ and (given an industry column) neu_ terminals of its atoms, and the names of all terminals."""
    made = {f"csrank_{a}": cs_rank(F.col(a), date) for a in atoms}
    if industry:
        made |= {f"neu_{a}": neutralize(F.col(a), industry, date, unmapped_as_zero=True) for a in atoms}
    return panel.withColumns(made), [*atoms, *made]


def daily_fitness(panel: DataFrame, programs: Sequence[str], ret: str, min_names: int = 10, date: str = "date", asset: str = "asset") -> DataFrame:
    """(date, program, n, ic): each program's rank IC of each day with min_names values, programs as p0, p1, ...

    All programs are compiled into columns of one plan, in which shared parts are one column; their long form is ranked by
    (date, program), so the work is spread over both.
    """
    names = {f"p{i}": t for i, t in enumerate(programs)}
    wide = compile_factors(panel, names, Frame(asset=asset, date=date, strict=False), keep=[date, asset, ret])
    long = wide.unpivot([date, asset, ret], list(names), "program", "value").where(F.col("value").isNotNull() & F.col(ret).isNotNull())
    day = [date, "program"]
    ranked = long.select(*day, average_rank(F.col("value"), day).alias("a"), average_rank(F.col(ret), day).alias("b"))
    return ranked.groupBy(*day).agg(F.count(F.lit(1)).alias("n"), pearson(F.col("a"), F.col("b")).alias("ic")).where(F.col("n") >= min_names)


def _named(scored: DataFrame, programs: Sequence[str], *columns: str) -> DataFrame:
    number = F.substring("program", 2, 10).cast("int") + 1
    return scored.select(F.element_at(F.array(*[F.lit(t) for t in programs]), number).alias("program"), *columns)


def fitness(panel: DataFrame, programs: Sequence[str], ret: str, min_names: int = 10, date: str = "date", asset: str = "asset") -> DataFrame:
    """(program, fitness): mean daily rank IC of each program."""
    daily = daily_fitness(panel, programs, ret, min_names, date, asset)
    return _named(daily.groupBy("program").agg(F.avg("ic").alias("fitness")), programs, "fitness")


def split_fitness(panel: DataFrame, programs: Sequence[str], ret: str, valid: float = 0.15, test: float = 0.15, min_names: int = 10, date: str = "date", asset: str = "asset") -> DataFrame:
    """(program, train, valid, test): mean daily rank IC of each program on the three parts of the calendar, in one plan."""
    daily = daily_fitness(panel, programs, ret, min_names, date, asset)
    parts = chronological_split(panel.select(date).distinct(), valid, test, date)  # a row per session
    rows = daily.join(F.broadcast(parts), date)
    means = [F.avg(F.when(F.col("split") == s, F.col("ic"))).alias(s) for s in SPLITS]
    return _named(rows.groupBy("program").agg(*means), programs, *SPLITS)


def _order(best: Found) -> tuple:
    """By validation, then training, each missing one last, then text."""
    low = float("-inf")
    return (-(best.valid if best.valid is not None else low), -(best.train if best.train is not None else low), best.program)


def evolve(panel: DataFrame, terminals: Sequence[str], ret: str, config: Config = Config(), valid: float = 0.15, test: float = 0.15, date: str = "date", asset: str = "asset") -> list[Found]:
    """The `keep` best programs of all generations. Breeding sees the training sessions alone; what is returned is sorted by
    validation, then training.

    Equal programs, once canonical, are scored once in the whole search. A program that the training sessions turn upside
    down comes back negated, so that all fitness is of the direction that is kept.
    """
    breeder, known = Breeder(terminals, config), {}
    pool = breeder.first()
    for generation in range(config.generations):
        fresh = [t for t in dict.fromkeys(pool) if t not in known]
        texts = {str(t): t for t in fresh}
        if fresh:
            got = {r["program"]: r for r in split_fitness(panel, list(texts), ret, valid, test, config.min_names, date, asset).collect()}  # a row per program
            for text, tree in texts.items():
                row = got.get(text)
                known[tree] = Found(text, *(row[s] if row else None for s in SPLITS), size(tree))

        def rate(t: Node) -> float:
            return abs(known[t].train or 0.0) - config.parsimony * known[t].nodes

        if config.stop_at is not None and max(abs(known[t].train or 0.0) for t in pool) >= config.stop_at:
            break
        if generation + 1 < config.generations:
            pool = breeder.next(pool, rate)
    return sorted((_kept(t, f) for t, f in known.items()), key=_order)[: config.keep]


def _kept(tree: Node, found: Found) -> Found:
    if found.train is None or found.train >= 0:
        return found
    turned = canonical(Node("Neg", (tree,)))
    return Found(str(turned), *(None if v is None else -v for v in (found.train, found.valid, found.test)), size(turned))


def search(panel: DataFrame, atoms: Sequence[str], ret: str, generations: int = 3, population: int = 40, keep: int = 10, depth: int = 3, seed: int = 11, min_names: int = 10, parsimony: float = 0.001, date: str = "date", asset: str = "asset") -> list[tuple[str, float]]:
    """The `keep` best (program, fitness) over the whole calendar, by fitness less what its size costs."""
    config = Config(population=population, generations=generations, keep=1 << 30, init_depth=(1, depth), seed=seed, min_names=min_names, parsimony=parsimony)
    found = evolve(panel, atoms, ret, config, valid=0.0, test=0.0, date=date, asset=asset)
    ranked = sorted(found, key=lambda f: (-(f.train or 0.0) + parsimony * f.nodes, f.program))
    return [(f.program, f.train or 0.0) for f in ranked[:keep]]


def expand(program: str, atoms: Mapping[str, str]) -> str:
    """A program with its atoms written out."""
    return re.sub(r"\$(\w+)", lambda m: atoms.get(m[1], m[0]), program)


def written_out(program: str, atoms: Mapping[str, str]) -> str:
    """A program in the expression language alone: atoms in full, csrank_ and neu_ terminals as the calls that they stand for."""
    calls = {f"{prefix}_{a}": f"{call}({text})" for a, text in atoms.items() for prefix, call in (("csrank", "CSRank"), ("neu", "Neu"))}
    text = expand(program, dict(atoms) | calls)
    nodes(parse(text))
    return text
