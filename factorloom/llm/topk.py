"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block of candidates and of a block of queries, which each pair of blocks brings into one task; and queries that are
#: scored at once there, each by a dense row of a block's candidates.
CANDIDATES, QUERIES, AT_ONCE = 8192, 8192, 64


def scaled_vector(embedding: Column, scale: float = 256.0) -> Column:
    """scale * x for each component, x as double; search() takes the floor, as not all of them fit a long."""
    return F.transform(embedding, lambda x: F.lit(scale) * x.cast("double"))


def usable(embedding: Column) -> Column:
    """True for vectors without nulls, NaN or infinities."""
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return embedding.isNotNull() & F.coalesce(whole, F.lit(False))


def outliers(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Which rows have a component so large that the sum of `width` products with the like of it may not fit 64 bits."""
    most = np.array([np.abs(np.floor(v)).max() if len(v) else 0.0 for v in rows])
    return most * most * max(1, width) >= 2.0**62


def as_integers(v: np.ndarray, kind: type) -> np.ndarray:
    """Floors as int64, or as Python's exact integers."""
    v = np.floor(v)
    return v.astype(np.int64) if kind is np.int64 else np.array([int(x) for x in v.tolist()], dtype=object)


def scores(query_terms: list[tuple[np.ndarray, np.ndarray]], postings: dict[int, tuple[np.ndarray, np.ndarray]], n: int, kind: type = np.int64) -> np.ndarray:
    """Inner products of sparse queries with n candidates: each term of a query scatters its weighted postings into the
    query's row of dense scores."""
    out = np.zeros((len(query_terms), n), dtype=kind)
    for row, (terms, weights) in zip(out, query_terms, strict=True):
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            if t in postings:
                at, values = postings[t]
                if len(at) == n:
                    row += w * values
                else:
                    row[at] += w * values
    return out


def best(row: np.ndarray, own: int | None, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the earlier place, without the query's own."""
    pool = np.delete(np.arange(len(row)), own) if own is not None else None
    s = row if pool is None else row[pool]
    if len(s) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        above, at = np.flatnonzero(s > least), np.flatnonzero(s == least)
        take = np.concatenate([above, at[: k - len(above)]])
    else:
        take = np.arange(len(s))
    return take if pool is None else pool[take]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """The k candidates of highest integer inner product for each query row.

    vectors: vec_id, embedding (more columns are ignored). Candidates are all rows but the query's own; others with
    its vec_id are.
    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. Rows with a null vec_id, a null
    vector, or null or non-finite components take no part; components that one vector lacks count as 0. Sums are exact
    whatever the size of the components; a score among the best that a long can't hold is an error. Repeated rows are
    candidates, and queries, each on its own. No candidates, no rows.

    Queries and candidates are dealt into blocks, and each pair of blocks is one group: scores are accumulated term at
    a time over the block's postings, the best k selected by partition, and the winners of the blocks merged by a
    window per query, which holds k rows for each block. Rows with components beyond what 64 bits can add up are scored
    apart, in exact integers, and the others of their block as ever.
    """
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), scaled_vector(F.col("embedding"), scale).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.monotonically_increasing_id().alias("row"))
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    n_blocks, n_query_blocks = max(1, math.ceil(n / CANDIDATES)), max(1, math.ceil(n_queries / QUERIES))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    side = lambda query: F.lit(query).alias("query")
    spread = F.xxhash64("row")
    candidates = rows.select(F.pmod(spread, F.lit(n_blocks)).cast("int").alias("block"), each(n_query_blocks).alias("query_block"), side(False), "vec_id", "row", "vec")
    queries = rows.where("is_query").select(each(n_blocks).alias("block"), F.pmod(spread, F.lit(n_query_blocks)).cast("int").alias("query_block"), side(True), "vec_id", "row", "vec")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["query"].to_numpy()
        q, c = pdf[asks], pdf[~asks].sort_values(["vec_id", "row"], kind="stable")
        out: list[tuple[int, int, int, int]] = []
        if len(q) and len(c):
            ids, rows_of_c = c["vec_id"].to_numpy(), c["row"].to_numpy()
            width = max(map(len, c["vec"]))
            given = [np.asarray(v, dtype=np.float64) for v in c["vec"]]
            asked = [np.asarray(v, dtype=np.float64) for v in q["vec"]]
            far_c, far_q = outliers(given, width), outliers(asked, width)
            for large_c, kinds in ((False, (np.int64, object)), (True, (object, object))):
                mine = np.flatnonzero(far_c == large_c)
                place = {r: i for i, r in enumerate(rows_of_c[mine].tolist())}
                for large_q, kind in zip((False, True), kinds, strict=True):
                    turn = np.flatnonzero(far_q == large_q)
                    if not len(mine) or not len(turn):
                        continue
                    dense = np.zeros((len(mine), width), dtype=kind)
                    for i, j in enumerate(mine):
                        dense[i, : len(given[j])] = as_integers(given[j], kind)
                    postings = {t: (at := np.flatnonzero(col), col[at]) for t, col in enumerate(np.ascontiguousarray(dense.T))}
                    sparse = [(np.flatnonzero(v), v[v != 0]) for v in (as_integers(asked[j], kind) for j in turn)]
                    for lo in range(0, len(turn), AT_ONCE):
                        got = scores(sparse[lo : lo + AT_ONCE], postings, len(mine), kind)
                        for i, row in zip(turn[lo : lo + AT_ONCE], got, strict=True):
                            query_id, query_row = int(q["vec_id"].iloc[i]), int(q["row"].iloc[i])
                            out += [(query_id, query_row, int(ids[mine[j]]), int(row[j])) for j in best(row, place.get(query_row), k)]
        if any(not -(2**63) <= r[3] < 2**63 for r in out):
            raise OverflowError("a score is beyond what a long holds")
        return pd.DataFrame(out, columns=["query_id", "query_row", "vec_id", "score"], dtype="int64")

    found = candidates.unionByName(queries).groupBy("block", "query_block").applyInPandas(search, "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


