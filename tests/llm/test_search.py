import heapq
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonguemix.llm import ann, blocks, topk

SCHEMA = "vec_id long, embedding array<float>"


@pytest.fixture(params=[(4096, 16384), (7, 23)])
def grid(request, monkeypatch):
    monkeypatch.setattr(blocks, "QUERY_ROWS", request.param[0])
    monkeypatch.setattr(blocks, "CANDIDATE_ROWS", request.param[1])
    monkeypatch.setattr(ann, "QUERY_TILE", 3)
    monkeypatch.setattr(ann, "CANDIDATE_TILE", 11)


def vectors(spark, n=150, width=20, seed=1, ties=True):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(size=width).astype("f4").tolist()) for i in range(n)]
    if ties:
        rows += [(1000 + i, rows[3][1]) for i in range(15)] + [(2000, rows[5][1]), (2000, rows[5][1])]
    return spark.createDataFrame(rows, SCHEMA), rows


def brute(rows, every, k, score):
    out = []
    for q, own in rows:
        if q % every == 0:
            scored = [(-score(own, v), i) for i, v in rows if i != q]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(heapq.nsmallest(k, scored), 1)]
    return sorted(out)


def integers(a, b):
    return int((np.floor(1024 * np.array(a, "f8")) * np.floor(1024 * np.array(b, "f8"))).sum())


def in_order(a, b):
    total = 0.0
    for x, y in zip(np.array(a, "f8").tolist(), np.array(b, "f8").tolist(), strict=True):
        total += x * y
    return total


def test_twins_null_ids_and_repeats_against_brute_force(spark, grid):
    """Every row but those of the query's own id is a candidate, a null id too; a repeated query is answered for each row."""
    _, rows = vectors(spark)
    rows += [(None, rows[7][1]), (None, rows[7][1]), (7, rows[9][1]), (40, rows[40][1])]
    table = spark.createDataFrame(rows, SCHEMA)

    def want(k, score):
        out = []
        for q, own in rows:
            if q is not None and q % 10 == 0:
                scored = [(-score(own, v), i is None, i or 0) for i, v in rows if i != q]
                out += [(q, n, None if none else i, -s) for n, (s, none, i) in enumerate(heapq.nsmallest(k, scored), 1)]
        return sorted(out, key=str)

    is_query = F.col("vec_id") % 10 == 0
    assert sorted(map(tuple, topk.exact_top_k(table, is_query, k=10).collect()), key=str) == want(10, integers)
    assert sorted(map(tuple, ann.nearest(table, is_query, k=20).collect()), key=str) == want(20, in_order)


@pytest.mark.parametrize("largest", [1e3, 1e5, 1e12, 1e200, 1e308])
def test_components_of_any_size_against_whole_numbers(spark, grid, largest):
    """Scores are exact and held within a long, whatever the components of other rows."""
    r = np.random.default_rng(8)
    scale = 10.0 ** r.uniform(-2, np.log10(largest), size=(60, 1))
    rows = [(i, (x * min(s, 1e307)).tolist()) for i, (x, s) in enumerate(zip(r.uniform(-1, 1, size=(60, 40)), scale[:, 0], strict=True))]
    rows += [(100 + i, r.integers(-9, 9, 40).astype(float).tolist()) for i in range(60)] + [(200, [largest] * 40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(Fraction(1024) * Fraction(x)) if abs(x) > 1e300 else math.floor(1024 * x) for x in v] for i, v in rows}

    def score(a, b):
        return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))

    want = []
    for q, own in whole.items():
        if q % 10 == 0:
            scored = sorted((-score(own, v), i) for i, v in whole.items() if i != q)[:10]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    found = topk.exact_top_k(table, F.col("vec_id") % 10 == 0, k=10)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_distinct_rows_exactly(spark, grid):
    table, rows = vectors(spark, ties=False)
    found = topk.exact_top_k(table, F.col("vec_id") % 10 == 0, k=10)
    assert sorted(map(tuple, found.collect())) == brute(rows, 10, 10, integers)
    near = ann.nearest(table, F.col("vec_id") % 10 == 0, k=20)
    assert sorted(map(tuple, near.collect())) == brute(rows, 10, 20, in_order)


def test_ties_go_to_the_smaller_id(spark, grid):
    rows = [(i, [1.0, 2.0]) for i in range(40)]
    table = spark.createDataFrame(rows, SCHEMA)
    for search in (topk.exact_top_k, ann.nearest):
        found = search(table, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect()
        assert [r.vec_id for r in found] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4]


def test_rows(spark, grid):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [1.0, None]), (5, [0.0, 0.0]), (6, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (8, []), (6, [0.5, 0.5]), (20, [1.0, 1.0, 2.0])]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("vector", F.lit("clash")).withColumn("score", F.lit(1))
    is_query = F.col("vec_id") % 20 == 0
    top = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(table, is_query).collect())
    assert top == [(0, 1, None, 1024 * 1536), (0, 2, 6, 512 * 1536), (0, 3, 6, 512 * 1536), (0, 4, 5, 0), (20, 1, 7, 4 * 1024 * 1024)]
    near = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(table, is_query).collect())
    assert near == [(0, 1, None, 1.5), (0, 2, 6, 0.75), (0, 3, 6, 0.75), (20, 1, 7, 4.0)]
    for search in (topk.exact_top_k, ann.nearest):
        assert search(table.limit(0), is_query).count() == 0


def test_large_components(spark):
    rows = [(0, [1e12, -1e12]), (1, [3e12, 1.0]), (2, [1.0, 1.0]), (3, [-1e30, 1e30])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.exact_top_k(table, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [1, 2, 3] and found[-1].score == -(2**63)


def test_error_bounds_hold():
    r = np.random.default_rng(2)
    a, b = r.normal(size=(40, 64)), r.normal(size=(60, 64)) * 10 ** r.uniform(-6, 6, size=(60, 1))
    q, c = ann.Quantised(a), ann.Quantised(b)
    middle = ann._products(q.codes, c.codes) * q.scale[:, None] * c.scale
    bound = q.restored_norm[:, None] * c.error_norm + q.error_norm[:, None] * c.norm
    assert (np.abs(a @ b.T - middle) <= bound * (1 + 1e-9)).all()
    wide = r.integers(-127, 128, size=(2, 3000)).astype(np.int8)
    assert ann._products(wide, wide)[0, 1] == int(wide[0].astype(int) @ wide[1].astype(int))


def test_a_candidate_with_very_many_copies(spark, grid):
    """A third of all rows are one row: each copy counts, and no cell holds more of them than a list can."""
    _, rows = vectors(spark, n=60, ties=False)
    hot = (61, [3.0] * 20)
    table = spark.createDataFrame(rows + [hot] * 30, SCHEMA)
    found = sorted(map(tuple, topk.exact_top_k(table, F.col("vec_id") % 10 == 0, k=10).collect()))
    assert found == brute(rows + [hot] * 30, 10, 10, integers)
    found = sorted(map(tuple, ann.nearest(table, F.col("vec_id") % 10 == 0, k=20).collect()))
    assert found == brute(rows + [hot] * 30, 10, 20, in_order)
