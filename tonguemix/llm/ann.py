"""Nearest neighbours by a block matrix join of int8 tiles.

Each vector is quantised to int8 with a scale of its own. The product of a tile of query codes and a
tile of candidate codes gives every inner product up to a bound that follows from the norms of the
quantisation errors: q.c = q'.c' + q'.e + d.c with q = q' + d and c = c' + e, so it differs from
q'.c' by |q'||e| + |d||c| at most. Pairs whose most reaches the k-th best least survive, are summed
again in double precision from the original vectors, and are merged by heaps from tile to tile.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Candidates, grid_search, heap_top, usable

#: Rows of a tile of codes: a tile of products takes 4 bytes times both.
QUERY_TILE, CANDIDATE_TILE = 256, 4096
#: 1,040 products of int8 codes stay below 2**24, which single precision adds exactly.
EXACT_WIDTH = 1040


class Quantised:
    """Codes, scales and the norms that bound the error, for the rows of a matrix."""

    def __init__(self, vectors: np.ndarray):
        peak = np.abs(vectors).max(axis=1)
        self.scale = np.where(peak > 0, peak, 1.0) / 127.0
        self.codes = np.rint(vectors / self.scale[:, None]).astype(np.int8)
        restored = self.codes * self.scale[:, None]
        grow = 1 + 1e-9
        self.norm = np.sqrt(np.square(vectors).sum(axis=1)) * grow
        self.restored_norm = np.sqrt(np.square(restored).sum(axis=1)) * grow
        self.error_norm = np.sqrt(np.square(vectors - restored).sum(axis=1)) * grow


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 codes; single precision runs them fastest."""
    out = np.zeros((len(a), len(b)))
    for s in range(0, a.shape[1], EXACT_WIDTH):
        out += a[:, s : s + EXACT_WIDTH].astype(np.float32) @ b[:, s : s + EXACT_WIDTH].astype(np.float32).T
    return out


def exact_scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component to the last."""
    total = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        total += queries[:, d] * candidates[:, d]
    return total


def _answer(queries: np.ndarray, candidates: np.ndarray, q_ids: np.ndarray, known: Candidates, k: int, floors: np.ndarray):
    q, c = Quantised(queries), Quantised(candidates)
    for top in range(0, len(queries), QUERY_TILE):
        at = slice(top, top + QUERY_TILE)
        heaps = [(np.empty(0, np.int64), np.empty(0)) for _ in range(len(queries[at]))]
        least = floors[at].copy()  # the k-th best exact score so far
        for left in range(0, len(candidates), CANDIDATE_TILE):
            cut = slice(left, left + CANDIDATE_TILE)
            middle = _products(q.codes[at], c.codes[cut]) * q.scale[at, None] * c.scale[None, cut]
            bound = q.restored_norm[at, None] * c.error_norm[None, cut] + q.error_norm[at, None] * c.norm[None, cut]
            bound += 1e-12 * q.norm[at, None] * c.norm[None, cut]
            own = (q_ids[at, None] == known.ids[None, cut]) & ~known.none[None, cut]
            low = np.where(own, -np.inf, middle - bound)
            if low.shape[1] > k:
                least = np.maximum(least, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
            row, column = np.nonzero((middle + bound >= least[:, None]) & ~own)
            scores = exact_scores(queries[at][row], candidates[cut][column])
            edges = np.searchsorted(row, np.arange(len(heaps) + 1))
            for i, (places, held) in enumerate(heaps):
                new = slice(edges[i], edges[i + 1])
                places, held = np.concatenate([places, column[new] + left]), np.concatenate([held, scores[new]])
                best = heap_top(held, known.none[places], known.ids[places], k)
                heaps[i] = places[best], held[best]
                if len(best) == k:
                    least[i] = max(least[i], held[best[-1]])
        for i, (places, held) in enumerate(heaps):
            yield top + i, places, held


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, vec_id="vec_id", vector="embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of largest inner product.

    Vectors that are null, empty, zero or hold null or non-finite components take no part; a query
    with fewer than k candidates gets them all; an empty table gives no rows. Ties go to the smaller
    vec_id, a null one last. Rows with a null id are candidates and no queries; repeated rows count
    each, as candidates and as queries. The bounds are never wrong, so recall is 1.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return grid_search(rows.where(usable(F.col("vector"), nonzero=True)), is_query, _answer, "double", k)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
