"""Boosted trees by second-order histograms: one aggregate over the table for each level of a tree.

Rows hold the bins of their features, cut at quantiles; the sums of gradients and Hessians by (node, feature, bin) are
partial aggregates, and only they, some thousand numbers, come to the driver, which picks the splits.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bin of a missing value.
MISSING = 0
#: Trees after which their sum becomes a column, in a checkpoint, where the session has a folder for those; until then, and where
#: it has none, it is worked out from the rows' bins in each pass.
FOLD = 10


@dataclass(frozen=True)
class Params:
    """How trees grow. growth: "level" splits all nodes of a depth, "leaf" the leaf of highest gain first, up to `leaves`."""

    rounds: int = 30
    rate: float = 0.1
    growth: str = "level"
    depth: int = 4
    leaves: int = 31
    bins: int = 32
    l1: float = 0.0
    l2: float = 1.0
    min_gain: float = 0.0
    min_hessian: float = 1.0
    rows: float = 1.0
    columns: float = 1.0
    patience: int | None = None
    seed: int = 7


#: The three names that models go by.
PRESETS: dict[str, Params] = {
    "xgboost": Params(growth="level", depth=5, l2=1.0, rows=0.8, columns=0.8, patience=10),
    "lightgbm": Params(growth="leaf", leaves=31, depth=8, l2=0.0, min_hessian=20.0, rows=0.8, columns=0.8, patience=10),
    "histogram": Params(growth="level", depth=4, l2=0.0, min_hessian=1.0, patience=10),
}


@dataclass(frozen=True)
class Split:
    feature: int
    bin: int  # bins up to this one go left
    missing_left: bool
    gain: float


@dataclass
class Tree:
    """Nodes by number, the root being 1 and the children of n being 2n and 2n + 1: a split, or a leaf's value."""

    splits: dict[int, Split] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def column(self, left: list[Column], missing: list[Column], node: int = 1) -> Column:
        """The value as nested conditions; left(f, bin) and missing(f) come as callables."""
        if node not in self.splits:
            return F.lit(self.values[node])
        s = self.splits[node]
        goes_left = F.when(missing(s.feature), F.lit(s.missing_left)).otherwise(left(s.feature, s.bin))
        return F.when(goes_left, self.column(left, missing, 2 * node)).otherwise(self.column(left, missing, 2 * node + 1))

    def node_column(self, left, missing, node: int = 1) -> Column:
        """The number of the leaf that a row is in."""
        if node not in self.splits:
            return F.lit(node)
        s = self.splits[node]
        goes_left = F.when(missing(s.feature), F.lit(s.missing_left)).otherwise(left(s.feature, s.bin))
        return F.when(goes_left, self.node_column(left, missing, 2 * node)).otherwise(self.node_column(left, missing, 2 * node + 1))


def shrunk(g: float, l1: float) -> float:
    return math.copysign(max(abs(g) - l1, 0.0), g)


def worth(g: float, h: float, p: Params) -> float:
    """What a node with these sums takes off the loss."""
    return shrunk(g, p.l1) ** 2 / (h + p.l2) if h + p.l2 > 0 else 0.0


def leaf_value(g: float, h: float, p: Params) -> float:
    return -p.rate * shrunk(g, p.l1) / (h + p.l2) if h + p.l2 > 0 else 0.0


def best_split(sums: Mapping[int, Mapping[int, tuple[float, float]]], p: Params) -> Split | None:
    """The split of highest gain of a node, from (gradient, Hessian) by feature and bin; of equal ones (to nine digits of the
    node's own worth) the first feature and bin, missing values left. None where no split pays."""
    best: tuple[float, Split] | None = None
    for f in sorted(sums):
        bins = sums[f]
        total_g, total_h = sum(g for g, _ in bins.values()), sum(h for _, h in bins.values())
        lost_g, lost_h = bins.get(MISSING, (0.0, 0.0))
        own, g, h = worth(total_g, total_h, p), 0.0, 0.0
        present = sorted(b for b in bins if b != MISSING)
        for b in present[:-1] if not lost_h else present:
            g, h = g + bins[b][0], h + bins[b][1]
            for missing_left in (True, False):
                lg, lh = (g + lost_g, h + lost_h) if missing_left else (g, h)
                rg, rh = total_g - lg, total_h - lh
                if min(lh, rh) < p.min_hessian or rh <= 0 or lh <= 0:
                    continue
                gain = 0.5 * (worth(lg, lh, p) + worth(rg, rh, p) - own)
                if gain > p.min_gain + 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, Split(f, b, missing_left, gain))
                if not lost_h:
                    break
    return best[1] if best else None


@dataclass
class BoostedModel:
    """Trees over named columns; edges cut each column into bins."""

    columns: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree]
    params: Params

    def prediction(self) -> Column:
        """The model as one column over the raw features; missing and NaN go where the training sent them."""
        x = [F.col(f"`{c}`").cast("double") for c in self.columns]
        left = lambda f, b: x[f] <= F.lit(self.edges[f][b - 1]) if b - 1 < len(self.edges[f]) else F.lit(True)
        missing = lambda f: x[f].isNull() | F.isnan(x[f])
        out = F.lit(self.base)
        for t in self.trees:
            out = out + t.column(left, missing)
        return out

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.prediction())

    def importances(self) -> dict[str, float]:
        """Gain by column, as shares."""
        gain = dict.fromkeys(self.columns, 0.0)
        for t in self.trees:
            for s in t.splits.values():
                gain[self.columns[s.feature]] += s.gain
        total = sum(gain.values())
        return {c: g / total if total else 0.0 for c, g in gain.items()}

    def to_json(self) -> str:
        trees = [{"splits": {str(k): asdict(s) for k, s in t.splits.items()}, "values": {str(k): v for k, v in t.values.items()}} for t in self.trees]
        return json.dumps({"columns": self.columns, "edges": self.edges, "base": self.base, "trees": trees, "params": asdict(self.params)})

    @classmethod
    def from_json(cls, text: str) -> BoostedModel:
        d = json.loads(text)
        trees = [Tree({int(k): Split(**s) for k, s in t["splits"].items()}, {int(k): v for k, v in t["values"].items()}) for t in d["trees"]]
        return cls(d["columns"], d["edges"], d["base"], trees, Params(**d["params"]))


def quantile_edges(rows: DataFrame, columns: Sequence[str], bins: int, accuracy: int = 10_000) -> list[list[float]]:
    """The distinct upper edges of each column's bins but the last, from one aggregate of quantile sketches."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    real = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    got = rows.agg(*[F.percentile_approx(real(c), shares, accuracy).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    return [sorted(set(got[f"e{i}"] or [])) for i in range(len(columns))]


def binned(x: Column, edges: Sequence[float]) -> Column:
    """1 and how many edges lie below x; MISSING for none."""
    x = x.cast("double")
    low, high = 0, len(edges)

    def halves(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo + 1)
        mid = (lo + hi) // 2
        return F.when(x <= F.lit(edges[mid]), halves(lo, mid)).otherwise(halves(mid + 1, hi))

    return F.when(x.isNull() | F.isnan(x), F.lit(MISSING)).otherwise(halves(low, high))


def sums_by_node(rows: DataFrame, node: Column, features: Sequence[int], wanted: Sequence[int]) -> dict[int, dict[int, dict[int, tuple[float, float]]]]:
    """(gradient, Hessian) by node, feature and bin, of some nodes: one aggregate."""
    each = F.array(*[F.struct(F.lit(f).alias("f"), F.col("bins")[f].alias("b")) for f in features])
    long = rows.select(node.alias("node"), "g", "h", F.explode(each).alias("x")).where(F.col("node").isin(list(wanted)))
    got = long.groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # nodes x features x bins
    out: dict[int, dict[int, dict[int, tuple[float, float]]]] = {n: {} for n in wanted}
    for r in got:
        out[r["node"]].setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"])
    return out


def _totals(sums: Mapping[int, Mapping[int, tuple[float, float]]]) -> tuple[float, float]:
    bins = sums[min(sums)] if sums else {}
    return sum(g for g, _ in bins.values()), sum(h for _, h in bins.values())


def grow_tree(rows: DataFrame, features: Sequence[int], p: Params) -> Tree:
    """A tree over rows of bins, g and h."""
    left = lambda f, b: F.col("bins")[f] <= F.lit(b)
    missing = lambda f: F.col("bins")[f] == F.lit(MISSING)
    tree, sums = Tree(), {}

    def look(nodes: list[int]) -> None:
        sums.update(sums_by_node(rows, tree.node_column(left, missing), features, nodes))

    def level_of(n: int) -> int:
        return n.bit_length() - 1

    look([1])
    found = {1: best_split(sums[1], p)}
    while ready := {n: s for n, s in found.items() if s is not None and n not in tree.splits and level_of(n) < p.depth}:
        tree.splits |= ready
        children = [c for n in sorted(ready) for c in (2 * n, 2 * n + 1)]
        look(children)
        found |= {c: best_split(sums[c], p) for c in children}
    if p.growth == "leaf":
        # Best first needs only the gains of what it meets, so it picks from the tree that has all splits.
        every, tree.splits, open_nodes = tree.splits, {}, [1]
        while len(tree.splits) < p.leaves - 1 and (can := [n for n in open_nodes if n in every]):
            n = min(can, key=lambda n: (-every[n].gain, n))
            tree.splits[n] = every[n]
            open_nodes = [x for x in open_nodes if x != n] + [2 * n, 2 * n + 1]
    leaves = [1] if not tree.splits else [c for n in tree.splits for c in (2 * n, 2 * n + 1) if c not in tree.splits]
    tree.values = {n: leaf_value(*_totals(sums[n]), p) for n in sorted(leaves)}
    return tree


def fit_boosted(rows: DataFrame, columns: Sequence[str], label: str, key: Sequence[str], params: Params = Params(), valid: Column | None = None) -> BoostedModel:
    """Trees that lower the squared error of label, one after the other.

    rows: the columns, label and key (which rows are sampled by); rows without a label go. With valid (true for rows that
    aren't learnt from) and params.patience, it stops once so many rounds haven't lowered their error, and goes back to the
    best one. Rows of a round are sampled by a hash of key and round, columns by the seed, so reruns agree.
    """
    p = params
    held = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(False)
    base_rows = rows.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    base_rows = base_rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, *key])], F.col(label).cast("double").alias("__y"), held.alias("__held"))
    learnt = base_rows.where(~F.col("__held"))
    edges = quantile_edges(learnt, columns, p.bins)
    base = learnt.agg(F.avg("__y")).first()[0] or 0.0
    current = base_rows.select(F.xxhash64(*[F.col(f"`{c}`") for c in key]).alias("__id"), "__y", "__held", F.array(*[binned(F.col(f"`{c}`"), e) for c, e in zip(columns, edges, strict=True)]).alias("bins"), F.lit(base).alias("f")).persist()
    left = lambda f, b: F.col("bins")[f] <= F.lit(b)
    missing = lambda f: F.col("bins")[f] == F.lit(MISSING)
    rng, trees, errors, late = random.Random(p.seed), [], [], []
    margin = F.col("f")
    may_cut = rows.sparkSession.sparkContext.getCheckpointDir() is not None
    try:
        for k in range(p.rounds):
            share = F.pmod(F.xxhash64("__id", F.lit(p.seed), F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
            drawn = current.where(~F.col("__held") & (share < p.rows)) if p.rows < 1 else current.where(~F.col("__held"))
            picked = sorted(rng.sample(range(len(columns)), max(1, round(p.columns * len(columns)))))
            tree = grow_tree(drawn.select("bins", (margin - F.col("__y")).alias("g"), F.lit(1.0).alias("h")), picked, p)
            if not tree.splits:
                break
            trees.append(tree)
            late.append(tree)
            margin = margin + tree.column(left, missing)
            if may_cut and len(late) >= FOLD:
                before, current = current, current.withColumn("f", margin).checkpoint()
                before.unpersist()
                margin, late = F.col("f"), []
            if p.patience and valid is not None:
                error = current.where("__held").agg(F.avg(F.pow(margin - F.col("__y"), 2))).first()[0]
                if error is not None:
                    errors.append(error)
                    if len(errors) - 1 - errors.index(min(errors)) >= p.patience:
                        break
    finally:
        current.unpersist()
    kept = trees[: errors.index(min(errors)) + 1] if errors else trees
    return BoostedModel(list(columns), edges, base, kept, p)


def preset(name: str, **changes) -> Params:
    return replace(PRESETS[name], **changes)
