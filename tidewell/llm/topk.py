"""Exact top-k inner products by the threshold algorithm (operator 8)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.columns import only

#: Rows of one block of candidates and of queries: what a task holds.
CANDIDATES, QUERIES = 1 << 14, 1 << 11
_FIRST_DEPTH = 32


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, fine)


def scaled(vector: Column, factor: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor))


class SortedLists:
    """One list per dimension, candidates by value; the rows stay at hand for random access."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")  # so that a smaller place is a smaller id
        self.ids, self.rows = ids[order], rows[order]
        self.lists = np.argsort(self.rows, axis=0, kind="stable").astype(np.int32)
        self.top = int(np.abs(self.rows).max(initial=0))
        self.real = self.rows.astype(np.float64)

    def _scores(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        # sums below 2**53 are exact in floating point, and much faster there
        if self.top * int(np.abs(query).max(initial=0)) * max(1, len(query)) < 1 << 53:
            return (self.real[places] @ query.astype(np.float64)).astype(np.int64)
        return self.rows[places] @ query

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows but ``own``, ties to the smaller id."""
        n = len(self.ids)
        dims = np.flatnonzero(query)
        down = query[dims] > 0
        weights = query[dims]
        seen = np.zeros(n, bool)
        own_places = self.ids == own
        seen[own_places] = True
        places, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, reached = _FIRST_DEPTH, 0
        while True:
            until = min(n, depth)
            steps = np.arange(reached, until)
            at = np.where(down[None, :], n - 1 - steps[:, None], steps[:, None])
            fresh = np.zeros(n, bool)
            fresh[self.lists[at, dims[None, :]]] = True
            # past half of the block the rest is looked up at once
            if seen.sum() * 2 > n or not len(dims):
                fresh[:] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            places = np.concatenate([places, new])
            scores = np.concatenate([scores, self._scores(new, query)])
            keep = np.lexsort((places, -scores))[:k]
            places, scores = places[keep], scores[keep]
            if until == n or seen.all():
                break
            last = np.where(down, n - until, until - 1)
            bound = int(self.rows[self.lists[last, dims], dims] @ weights)
            if len(scores) == k and scores[-1] > bound:
                break  # no unseen row can reach the kth result
            depth, reached = depth * 2, until
        return self.ids[places], scores


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def matrix(table: pa.Table, width: int) -> np.ndarray:
        out = np.zeros((table.num_rows, width), np.int64)
        for i, row in enumerate(table["v"]):
            values = row.values.to_numpy()
            out[i, : len(values)] = values
        return out

    def run(table: pa.Table) -> pa.Table:
        asks = pa.compute.equal(table["is_query"], True)
        queries, rows = table.filter(asks), table.filter(pa.compute.invert(asks))
        found = []
        if queries.num_rows and rows.num_rows:
            width = max(pa.compute.max(pa.compute.list_value_length(t["v"])).as_py() for t in (queries, rows))
            lists = SortedLists(rows["vec_id"].to_numpy(), matrix(rows, width))
            for own, query in zip(queries["vec_id"].to_numpy(), matrix(queries, width), strict=True):
                ids, scores = lists.best(query, own, k)
                found.append((np.full(len(ids), own), ids, scores))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.empty(0, np.int64)] * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, factor: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of ``vectors(vec_id, embedding)`` per query.

    A query is a row where ``is_query`` holds; its candidates are all rows of
    other ids.  Scores are inner products of ``floor(factor * x)``; ties go to
    the smaller id.  Each block of candidates meets each block of queries in
    one task, which gives ``k`` rows per query; those are ranked afterwards.
    Within a block the lists of all dimensions are read from their good ends
    until no unseen row can beat the kth.  Rows with a null id, a null vector
    or null or non-finite components take no part; shorter vectors count as
    filled up with zeros; rows that repeat an id are candidates each; other
    columns are not read; no rows give none.
    """
    rows = only(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select("vec_id", scaled(F.col("embedding"), factor).alias("v"), is_query.alias("asks"))
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    parts, groups = -(-n // CANDIDATES), -(-asked // QUERIES)
    if not asked:
        parts = groups = 1
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    candidates = rows.select("vec_id", "v", F.lit(False).alias("is_query"), dealt(parts).alias("part"), every(groups).alias("grp"))
    queries = rows.where("asks").select(
        "vec_id", "v", F.lit(True).alias("is_query"), every(parts).alias("part"), dealt(groups).alias("grp")
    )
    found = (
        candidates.union(queries)
        .groupBy("part", "grp")
        .applyInArrow(_search(k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
