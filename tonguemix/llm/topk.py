"""Exact top-k search by branch and bound over dimension blocks in vertical layout.

A block of candidates lies dimension by dimension, so a block of dimensions is a run of whole
columns. For each query the partial inner products grow by one block of dimensions at a time. What
the remaining dimensions can still add is at most the product of the remaining norms (Cauchy and
Schwarz); candidates whose most is below the k-th best least are dropped and the survivors are
compacted before the next block. Sums of integers are exact as doubles up to 2**53. Where a block's
components are so large that they may go beyond, the bounds are wider by what rounding may have done,
and the few survivors are summed again as whole numbers, so scores are exact for any components.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Candidates, grid_search, usable

DIMENSION_BLOCK = 16
#: Doubles hold every integer up to this exactly.
EXACT = 2.0**53
LONG = 2**63 - 1


def _suffix_norms(vectors: np.ndarray, starts: range) -> np.ndarray:
    """[block, vector]: the norm of what is left from that block on, rounded upwards; the last row is zero.

    Vectors are measured by their own largest component, so that no square is lost below the least double.
    """
    peak = np.maximum(np.abs(vectors).max(axis=1), np.finfo(float).tiny)
    measured = vectors / peak[:, None]
    squares = np.stack([np.square(measured[:, s : s + DIMENSION_BLOCK]).sum(axis=1) for s in starts])
    left = np.cumsum(squares[::-1], axis=0)[::-1]
    return np.vstack([np.sqrt(left) * peak * (1 + 1e-9), np.zeros((1, len(vectors)))])


def _unit(vectors: np.ndarray) -> float:
    """A power of two that no component exceeds, but for the very largest doubles by less than twice."""
    return float(np.ldexp(1.0, min(int(np.frexp(np.abs(vectors).max())[1]), 1023)))


def _answer(queries: np.ndarray, candidates: np.ndarray, q_ids: np.ndarray, known: Candidates, k: int, floors: np.ndarray):
    width = queries.shape[1]
    q_unit, c_unit = _unit(queries), _unit(candidates)
    exact = width < EXACT / q_unit / c_unit
    q, c = queries / q_unit, candidates / c_unit
    starts = range(0, width, DIMENSION_BLOCK)
    vertical = np.ascontiguousarray(c.T)
    (c_norm, *c_left), (q_norm, *q_left) = _suffix_norms(c, starts), _suffix_norms(q, starts)
    rounding = 0.0 if exact else (width + 8) * 2.0**-52
    for at, query in enumerate(q):
        alive = np.flatnonzero(~known.are(q_ids[at]))
        partial = np.zeros(len(alive))
        reached = np.nextafter(floors[at], -np.inf) / q_unit / c_unit
        for block, s in enumerate(starts):
            columns = vertical[s : s + DIMENSION_BLOCK]
            partial += query[s : s + DIMENSION_BLOCK] @ (columns if len(alive) == len(c) else columns[:, alive])
            spread = q_left[block][at] * c_left[block][alive] + (rounding * q_norm[at] * c_norm[alive] + (0.0 if exact else 1e-290))
            floor = reached
            if len(alive) > k:
                floor = max(floor, np.partition(partial - spread, len(alive) - k)[len(alive) - k])
            kept = partial + spread >= min(floor, LONG / q_unit / c_unit)  # scores beyond a long are equal
            alive, partial = alive[kept], partial[kept]
        if exact:
            scores = (partial * (q_unit * c_unit)).astype(np.int64)
        else:
            own = [int(x) for x in queries[at]]
            sums = (sum(a * int(b) for a, b in zip(own, candidates[j], strict=True)) for j in alive)
            scores = np.array([max(-LONG - 1, min(LONG, x)) for x in sums], dtype=np.int64)
        order = np.lexsort((known.none[alive], known.ids[alive], ~scores))[:k]  # ~ turns the order around without overflow
        yield at, alive[order], scores[order]


def exact_top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, scale: int = 1024, vec_id="vec_id", vector="embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of highest integer inner product.

    Components become floor(scale * x). Vectors that are null, empty or hold null or non-finite
    components take no part; a query with fewer than k candidates gets them all; an empty table
    gives no rows. Ties go to the smaller vec_id, a null one last. Rows with a null id are candidates
    and no queries; repeated rows count each, as candidates and as queries. Vectors may be of any length
    and components of any size; scores beyond a long are held at its ends.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    whole = rows.withColumn("vector", F.transform("vector", lambda x: _floor(x * scale)))
    return grid_search(whole, is_query, _answer, "long", k)


def _floor(x: Column) -> Column:
    """floor as a double, held within doubles: Spark's own gives a long, which large components exceed."""
    x = F.least(F.greatest(x, F.lit(-1.7e308)), F.lit(1.7e308))
    near = F.rint(x)
    return F.when(near > x, near - 1).otherwise(near)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
