"""Libraries of factors and strategies: small tables with upsert by name."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.plans.parser import validate_expression
from factorloom.sources.upsert import keep_last
from factorloom.sources.versioned import VersionedTable

FACTORS = "name string, expression string, category string, universe string, ic_mean double, icir double, rank_ic_mean double, coverage double, turnover double, status string, factor_type string, strategy string, metrics_json string, updated long"


class Library:
    """Records by name in versions of a parquet table; saving a name again replaces it, and readers see whole versions."""

    def __init__(self, spark: SparkSession, path: str, schema: str = FACTORS):
        self.spark, self.schema, self.table = spark, T.StructType.fromDDL(schema), VersionedTable(spark, path, ["name"])

    def save(self, records: DataFrame) -> None:
        cols = [(F.col(f.name) if f.name in records.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        self.table.upsert(keep_last(records, ["name"], ["updated"]).select(*cols))

    def all(self) -> DataFrame:
        return self.table.read() if self.table.versions() else self.spark.createDataFrame([], self.schema)

    def find(self, name: str) -> DataFrame:
        return self.all().where(F.col("name") == name)

    def ranked(self, by: str = "icir", k: int = 50) -> DataFrame:
        return self.all().orderBy(F.abs(by).desc_nulls_last(), "name").limit(k)

    def link(self, names: list[str], strategy: str) -> None:
        self.save(self.all().where(F.col("name").isin(names)).withColumn("strategy", F.lit(strategy)).withColumn("updated", F.col("updated") + 1))


def new_candidates(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """Candidates whose expression, blanks aside, the library doesn't have."""
    plain = lambda c: F.regexp_replace(c, r"\s+", "")
    known = library.select(plain(F.col("expression")).alias("__key"))
    return candidates.withColumn("__key", plain(F.col("expression"))).join(known, "__key", "left_anti").drop("__key")


@dataclass(frozen=True)
class Candidate:
    name: str
    expression: str
    hypothesis: str = ""
    category: str = ""


class CandidateProvider(Protocol):
    """Where a mining loop gets expressions from: a list, a search, or a service."""

    def propose(self, feedback: str) -> list[Candidate]: ...


#: Keys under which answers may hold their list.
LIST_KEYS = ("factors", "data", "results", "result", "candidates", "items")


def _items(found: object) -> list[dict]:
    """The entries of the list nearest to the answer's top that has any with an expression; of lists equally near, one under a
    usual key comes first."""
    level = [found]
    while level:
        for part in level:
            entries = [x for x in part if isinstance(x, dict) and x.get("expression")] if isinstance(part, list) else []
            if entries:
                return entries
        below = [(k not in LIST_KEYS, v) for part in level if isinstance(part, dict) for k, v in part.items()]
        below += [(True, v) for part in level if isinstance(part, list) for v in part]
        level = [v for _, v in sorted(below, key=lambda x: x[0]) if isinstance(v, (dict, list))]
    return []


def parse_candidates(text: str) -> list[Candidate]:
    """Candidates from a JSON answer that may be fenced, nested or wordy; those without an expression go, nonsense gives none."""
    body = re.sub(r"^```(?:json)?\s*|\s*```$", "", text.strip())
    for part in (body, *re.findall(r"\{.*\}", body, re.DOTALL)):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        word = lambda x, k: str(x.get(k) or "").strip()
        return [Candidate(word(x, "name") or "factor", word(x, "expression"), word(x, "hypothesis"), word(x, "category")) for x in _items(found) if isinstance(x, dict) and word(x, "expression")]
    return []


def valid_candidates(found: list[Candidate]) -> list[Candidate]:
    """The first candidate of each valid expression."""
    out: dict[str, Candidate] = {}
    for c in found:
        if validate_expression(c.expression).ok:
            out.setdefault(re.sub(r"\s+", "", c.expression), c)
    return list(out.values())
