"""Query rows against candidate rows, cell by cell of a grid of blocks.

Queries are dealt by hash into row blocks, candidates into column blocks, and each cell of the grid
joins one of each by an equality join, so a task holds two blocks of bounded size whatever the size
of the tables. Equal rows hash alike, so they are summed first: of a candidate's copies, which share
id and score, the k first are all that a list of k can hold, and a query is asked once for its copies. A cell answers with at most k rows for each of its queries, kept in heaps, and those
short lists are merged by a window that keeps the first k.

The first column of cells is searched on its own. What it finds gives each query the k-th best score
so far, which goes with it to the other cells: there candidates that cannot reach it are dropped at
once, and few rows come back to be merged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import prepare, stored

#: Rows of a block of queries and of a block of candidates, on average.
QUERY_ROWS, CANDIDATE_ROWS = 4096, 16384
FOUND = "query_id long, query_row long, vec_id long, score {}"
#: What stands for a null id where ids are compared; a flag tells it from an id of this value.
NULL_ID = 2**63 - 1


def usable(vector: Column, *, nonzero: bool = False) -> Column:
    """Not null, not empty, all components finite; with nonzero, also not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))
    return kept & F.exists(vector, lambda x: x != 0) if nonzero else kept


class Candidates:
    """Ids of the rows of a block of candidates; those without one are in places where none is True."""

    def __init__(self, ids_: np.ndarray, none: np.ndarray):
        self.ids, self.none = ids_, none

    def are(self, query_id: int) -> np.ndarray:
        """Whether each has the query's own id."""
        return (self.ids == query_id) & ~self.none


def grid_search(rows: DataFrame, is_query: Column, answer: Callable, score_type: str, k: int) -> DataFrame:
    """rows: vec_id, vector. -> query_id, rank, vec_id, score.

    A vec_id names a row: rows with the query's own id are not its candidates, a repeated candidate
    is found as often as it is repeated, and a repeated query is answered as often, too. Only vectors
    of equal length are compared. Rows with a null id are candidates, the last among equal scores.
    answer gets the vectors of both sides, the queries' ids, the Candidates, k and the score that each
    query has k candidates of already; it yields a query's place, and places and scores of candidates.
    """
    prepare(rows.sparkSession)
    asked = rows.where(is_query & F.col("vec_id").isNotNull()).groupBy("vec_id", "vector").agg(F.count("*").alias("times"))
    queries = stored(asked.withColumn("row", F.xxhash64("vec_id", "vector")), "queries")
    n, m = rows.count(), queries.count()
    across, down = max(1, -(-n // CANDIDATE_ROWS)), max(1, -(-m // QUERY_ROWS))
    cells = lambda first, count: F.explode(F.sequence(F.lit(first), F.lit(count - 1)))
    left = queries.select("vec_id", "vector", "row", F.pmod("row", F.lit(down)).cast("int").alias("i"))
    copies = rows.groupBy("vec_id", "vector").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    placed = copies.select("vec_id", "vector", "copies", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(across)).cast("int").alias("j"), cells(0, down).alias("i"))
    right = placed.select("vec_id", "vector", "i", "j", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("col")
    kind = pa.int64() if score_type == "long" else pa.float64()
    schema = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", kind)])

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        found = []
        for width, (q_rows, q_vectors) in by_width(q).items():
            c_rows, c_vectors = by_width(c).get(width, (None, None))
            if c_rows is None:
                continue
            q_ids, q_keys = ids(q, "vec_id", q_rows), ids(q, "row", q_rows)
            none = np.asarray(c.column("vec_id").is_null())[c_rows]
            candidates = Candidates(c.column("vec_id").fill_null(NULL_ID).to_numpy()[c_rows], none)
            floors = q.column("floor").to_numpy()[q_rows]
            for at, places, scores in answer(q_vectors, c_vectors, q_ids, candidates, k, floors):
                found.append((np.full(len(places), q_ids[at]), np.full(len(places), q_keys[at]), candidates.ids[places], scores, none[places]))
        if not found:
            return schema.empty_table()
        *columns, none = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([pa.array(x, t.type, mask=none if t.name == "vec_id" else None) for x, t in zip(columns, schema, strict=True)], schema=schema)

    def search(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(cell, FOUND.format(score_type))

    first = left.withColumn("j", F.lit(0)).withColumn("floor", F.lit(-math.inf))
    found = search(first, right.where(F.col("j") == 0))
    if across > 1:
        found = stored(found, "found")
        reached = found.groupBy(F.col("query_id").alias("vec_id"), F.col("query_row").alias("row")).agg(F.min("score").cast("double").alias("least"), F.count("*").alias("n"))
        floor = F.coalesce(F.when(F.col("n") >= k, F.col("least")), F.lit(-math.inf)).alias("floor")
        rest = left.join(reached, ["vec_id", "row"], "left").select("vec_id", "vector", "row", "i", cells(1, across).alias("j"), floor)
        found = found.unionByName(search(rest, right.where(F.col("j") > 0)))
    best = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    if queries.where(F.col("times") > 1).limit(1).count():
        times = queries.select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
        ranked = ranked.join(times, ["query_id", "query_row"])
    return ranked.select("query_id", "rank", "vec_id", "score")


def ids(t: pa.Table, name: str, rows: np.ndarray) -> np.ndarray:
    return t.column(name).to_numpy()[rows]


def by_width(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The row numbers and the matrix (doubles) of the vectors of each length."""
    column = t.column("vector").combine_chunks()
    if not len(column):
        return {}
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    widths = np.diff(offsets)
    out = {}
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        out[int(width)] = rows, values[offsets[rows][:, None] + np.arange(width)]
    return out


def heap_top(scores: np.ndarray, none: np.ndarray, ids_: np.ndarray, k: int) -> list[int]:
    """The places of the k best: highest score first, ties to the smaller id, those without an id last."""
    return [p for *_, p in heapq.nsmallest(k, zip((-scores).tolist(), none.tolist(), ids_.tolist(), range(len(scores)), strict=True))]
