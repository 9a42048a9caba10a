"""A loop that mines factors: propose, validate, score, store, feed back; stopped after any step, it goes on where it was."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.plans.parser import FIELDS, validate_expression
from factorloom.sources.versioned import VersionedTable

from .library import Candidate, CandidateProvider

#: The steps of a round, in order; each is written down before the next begins.
STEPS = ("proposed", "valid", "scored", "stored")
STATE = "round int, step string, payload string"
LIBRARY = "key string, name string, expression string, hypothesis string, category string, round int, metrics_json string"
Scorer = Callable[[list[str]], DataFrame]


def plain(expression: str) -> str:
    """What makes two expressions the same one: their text without blanks."""
    return re.sub(r"\s+", "", expression)


@dataclass(frozen=True)
class Round:
    number: int
    step: str
    payload: list[dict]


class MiningLoop:
    """Rounds over a provider of candidates, with their state and the library of what was kept under one folder.

    score(expressions) gives a row for each: expression and metrics, among them `rate`, the figure to rank by, and `good`,
    whether it is kept. A provider isn't asked twice for one round, as its answer is written down first; scoring is the
    only step that is done again if it is stopped in the middle. Batches hold tens of candidates; factor values stay
    in Spark.
    """

    def __init__(self, spark: SparkSession, path: str, provider: CandidateProvider, score: Scorer, fields: Sequence[str] = FIELDS):
        self.spark, self.provider, self.score, self.fields = spark, provider, score, tuple(fields)
        self.state = VersionedTable(spark, f"{path}/state", ["round", "step"])
        self.library = VersionedTable(spark, f"{path}/library", ["key"])

    def _rounds(self) -> list[Round]:
        """All steps that are done, in order; a few rows a round."""
        if not self.state.versions():
            return []
        rows = [Round(r["round"], r["step"], json.loads(r["payload"])) for r in self.state.read().collect()]
        return sorted(rows, key=lambda r: (r.number, STEPS.index(r.step)))

    def _write(self, number: int, step: str, payload: list[dict]) -> Round:
        self.state.upsert(self.spark.createDataFrame([(number, step, json.dumps(payload, sort_keys=True))], STATE))
        return Round(number, step, payload)

    def known(self) -> set[str]:
        """The keys of the library's expressions; a library holds thousands."""
        return {r["key"] for r in self.library.read().select("key").collect()} if self.library.versions() else set()

    def feedback(self, most: int = 5) -> str:
        """What the next proposal is told: the best and the worst of all rounds, and what was wrong with those that didn't count."""
        scored = [x for r in self._rounds() if r.step == "scored" for x in r.payload]
        rejected = [x for r in self._rounds() if r.step == "valid" for x in r.payload if x["error"]]
        ranked = sorted(scored, key=lambda x: (-(x["metrics"].get("rate") or 0.0), x["expression"]))
        say = lambda x: f"{x['expression']}: {x['metrics'].get('rate') or 0.0:.4f}"
        parts = ["best: " + "; ".join(map(say, ranked[:most]))] if ranked else []
        parts += ["worst: " + "; ".join(map(say, ranked[-most:]))] if len(ranked) > most else []
        parts += ["rejected: " + "; ".join(f"{x['expression']} ({x['error']})" for x in rejected[-most:])] if rejected else []
        return "\n".join(parts)

    def _validated(self, proposed: list[dict]) -> list[dict]:
        """Each candidate with what is wrong with it; of equal ones the first counts, and none that was met before."""
        met = self.known() | {plain(x["expression"]) for r in self._rounds() if r.step == "valid" for x in r.payload if not x["error"]}
        out = []
        for c in proposed:
            checked = validate_expression(c["expression"], self.fields)
            error = checked.error or ("seen before" if plain(c["expression"]) in met else None)
            if not error:
                met.add(plain(c["expression"]))
            out.append(c | {"error": error})
        return out

    def _scored(self, valid: list[dict]) -> list[dict]:
        good = [c for c in valid if not c["error"]]
        if not good:
            return []
        got = {r["expression"]: r.asDict() for r in self.score([c["expression"] for c in good]).collect()}  # a row per candidate
        return [c | {"metrics": {k: v for k, v in got.get(c["expression"], {}).items() if k != "expression"}} for c in good]

    def _store(self, number: int, scored: list[dict]) -> list[dict]:
        kept = [c for c in scored if c["metrics"].get("good")]
        if kept:
            rows = [(plain(c["expression"]), c["name"], c["expression"], c["hypothesis"], c["category"], number, json.dumps(c["metrics"], sort_keys=True)) for c in kept]
            self.library.upsert(self.spark.createDataFrame(rows, LIBRARY), {"round": str(number)})
        return [{"name": c["name"], "expression": c["expression"]} for c in kept]

    def run(self, rounds: int) -> DataFrame:
        """Goes on until that many rounds are done in all; returns the library."""
        done = self._rounds()
        last = done[-1] if done else Round(0, STEPS[-1], [])
        while last.number < rounds or last.step != STEPS[-1]:
            number = last.number + (last.step == STEPS[-1])
            step = STEPS[(STEPS.index(last.step) + 1) % len(STEPS)]
            if step == "proposed":
                payload = [asdict(c) for c in self.provider.propose(self.feedback())]
            elif step == "valid":
                payload = self._validated(last.payload)
            elif step == "scored":
                payload = self._scored(last.payload)
            else:
                payload = self._store(number, last.payload)
            last = self._write(number, step, payload)
        return self.library.read() if self.library.versions() else self.spark.createDataFrame([], LIBRARY)


class ListProvider:
    """Candidates from a list, `batch` at a time; what it is told is kept."""

    def __init__(self, candidates: Sequence[Candidate], batch: int):
        self.left, self.batch, self.told = list(candidates), batch, []

    def propose(self, feedback: str) -> list[Candidate]:
        self.told.append(feedback)
        out, self.left = self.left[: self.batch], self.left[self.batch :]
        return out


def panel_scorer(panel: DataFrame, ret: str, min_ic: float = 0.02, min_names: int = 10, date: str = "date", asset: str = "asset") -> Scorer:
    """Scores expressions over a panel by their mean daily rank IC, all of a batch in one plan."""
    from .gp import fitness

    def score(expressions: list[str]) -> DataFrame:
        got = fitness(panel, expressions, ret, min_names, date, asset)
        return got.select(F.col("program").alias("expression"), F.abs("fitness").alias("rate"), F.col("fitness").alias("rank_ic"), (F.coalesce(F.abs("fitness"), F.lit(0.0)) >= min_ic).alias("good"))

    return score
