import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tonguemix.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Water-filling by rounds: cap what is above, share the excess among the rest, until none is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in fixed]
        share = sum(weight[s] for s in free)
        level = (total - sum(fixed.values())) / share if share else 0
        over = [s for s in free if level * weight[s] > cap * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def many():
    rows = [(i, "w " * (i * 37 % 50 + 1), f"s{i % 7}" if i % 3 else "hot") for i in range(900)]
    return rows + [(9000 + i, "x " * 10, None) for i in range(5)] + [(9100, "y " * 4000, "s1"), (9200, "only", "tiny"), (9300, None, "s2"), (9400, " \n", "void")]


def test_targets_and_bounds(spark):
    rows = mixing.mix_sources(docs(spark, many())).collect()
    sizes = defaultdict(int)
    for _, text, source in many():
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken, largest = targets(sizes), Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken == r.size * r.copies <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert len(rows) == len(many()) and all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)


def test_no_row_is_taken_more_often_than_repeats_allow(spark):
    """A small source stops at three times its size: its wordless rows are taken three times too, not four."""
    rows = [(i, "", "a") for i in range(2000)] + [(5000 + i, "one two three", "a") for i in range(3)] + [(9000, "w " * 100000, "b")]
    plan = mixing.mix_sources(docs(spark, rows)).collect()
    assert {r.copies for r in plan if r.source == "a"} == {3} and max(r.copies for r in plan) <= 3
    applied = Counter(r.doc_id for r in mixing.apply_mix(docs(spark, rows)).collect())
    assert max(applied.values()) == 3 and applied[5000] == 3


@pytest.mark.parametrize("distinct", [1, 3])
def test_twins_are_taken_in_part(spark, distinct, tmp_path):
    """1,000 rows for each of a few texts: the words taken come within half a row of the target, and the mix has as many rows."""
    rows = [(i % distinct, f"w{i % distinct} x y z", "a") for i in range(1000 * distinct)] + [(10**6 + i, "u v w " * (i % 9), "b") for i in range(600)]
    table = docs(spark, rows).repartition(5)
    plan = mixing.mix_sources(table).collect()
    taken, target, times = Counter(), {}, Counter()
    for r in plan:
        taken[r.source] += r.taken
        target[r.source] = r.target
        times[r.doc_id] += r.copies
    assert len(plan) == len(rows) and abs(taken["a"] - target["a"]) <= 2 + 1e-6 and 0 < target["a"] % 4000
    assert Counter(r.doc_id for r in mixing.apply_mix(table).collect()) == +times
    table.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    names = ["doc_id", "size", "source_size", "target", "source", "copies", "taken"]
    assert sorted(map(str, db.execute(f"SELECT {', '.join(names)} FROM ({mixing.SQL})").fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in plan)


def test_reruns_and_partitions_agree(spark):
    one = mixing.mix_sources(docs(spark, many()).repartition(1)).collect()
    assert sorted(map(str, one)) == sorted(map(str, mixing.mix_sources(docs(spark, many()).repartition(13)).collect()))


@pytest.mark.parametrize(("weights", "cap"), [((5, 2, 1), 3), ((1,), 1), ((1000, 1), 2)])
def test_water_filling(spark, weights, cap):
    sizes = {"a": 10, "b": 1000, "c": 3, None: 77, "z": 0}
    table = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(table, weights, 1.0, cap).collect()}
    assert found == pytest.approx(targets(sizes, weights, cap))


def test_rows(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, None, None), (2, "", "t"), (3, "w " * 200000, "u"), (None, "p q r", "s")]
    table = docs(spark, rows).withColumn("size", F.lit(7)).withColumn("hash", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("from", F.lit(2))
    plan = mixing.mix_sources(table).collect()
    assert len(plan) == 6 and {r.size for r in plan} == {2, 0, 200000, 3}
    applied = mixing.apply_mix(table)
    assert applied.columns == table.columns
    copies = Counter()
    for r in plan:
        copies[r.doc_id, r.size] += r.copies
    assert +Counter((r.doc_id, len((r.text or "").split())) for r in applied.collect()) == +copies
    assert mixing.mix_sources(table.limit(0)).count() == 0 and mixing.apply_mix(table.limit(0)).count() == 0
    silent = docs(spark, [(1, None, "a"), (2, " ", "b")])
    assert {r.taken for r in mixing.mix_sources(silent).collect()} == {0}
