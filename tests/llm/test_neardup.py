import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonguemix.llm import components, entries, neardup
from tonguemix.llm import dartminhash as dart

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(5)
    errors = []
    for _ in range(40):
        ids = np.sort(r.choice(2**60, 300, replace=False)).astype(np.uint64)
        a, b = r.integers(0, 9, 300), r.integers(0, 9, 300)
        a[:200] = b[:200]
        sets = [(ids[w > 0], w[w > 0]) for w in (a, b)]
        ranks = dart.signatures(sets, 512)
        errors.append((ranks[0] == ranks[1]).mean() - dart.similarity(*sets))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_signatures_do_not_depend_on_company_or_reach():
    sets = [dart.shingles("one two three"), dart.shingles("a b c d e f g " * 40), dart.shingles(" ".join(map(str, range(900)))), dart.shingles("")]
    together = dart.signatures(sets)
    for i, s in enumerate(sets):
        assert np.array_equal(dart.signatures([s])[0], together[i])
    assert np.isinf(together[3]).all() and np.isfinite(together[:3]).all()


def test_word_hashes_by_piece(monkeypatch):
    text = " ".join(f"word{i % 37} é{i}" for i in range(500))
    whole = dart.word_hashes(text)
    monkeypatch.setattr(dart, "PIECE", 64)
    assert np.array_equal(dart.word_hashes("  " + text.upper() + "\n"), whole) and len(whole) == 1000


def brute(rows):
    """Classes by the exact similarity of all pairs."""
    sets = [dart.shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sizes = np.array([w.sum() for _, w in sets])
    for i in range(len(rows)):
        # Weights that differ more than the threshold allows cannot be similar.
        for j in np.flatnonzero(np.minimum(sizes[:i], sizes[i]) >= neardup.SIMILARITY * np.maximum(sizes[:i], sizes[i])):
            if len(sets[i][0]) and len(sets[j][0]) and dart.similarity(sets[i], sets[j]) >= neardup.SIMILARITY:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return sorted((rows[i][0], min(rows[x][0] for x in g), len(g)) for g in groups.values() for i in g)


def classes(df):
    return sorted((r.doc_id, r.class_id, r.class_size) for r in df.collect())


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert classes(entries.QUERIES["op9_near_duplicates"](spark, folder)) == brute(rows)


def edited(r, words, share):
    return " ".join(w if r.random() > share else f"x{r.randrange(10**6)}" for w in words)


def test_finer_buckets_part_no_pair_that_may_be_similar():
    r = np.random.default_rng(2)
    least = int(np.ceil(neardup.REFUSED * dart.COORDINATES))
    for trial in range(300):
        agree = np.zeros(dart.COORDINATES, bool)
        agree[r.choice(dart.COORDINATES, least, replace=False) if trial else np.arange(least)] = True
        pairs = agree.reshape(-1, 2).all(axis=1)
        assert any(pairs[i] and pairs[j] for i, j in neardup.TWO_PAIRS)


@pytest.mark.parametrize(("share", "hot"), [(0.01, 1 << 22), (0.022, 1 << 22), (0.022, 8)])
def test_groups_whose_members_link_only_through_others(spark, share, hot, monkeypatch):
    """Edits of one base: many members are below the threshold against the first node of their bucket."""
    monkeypatch.setattr(neardup, "SIDE", 7)
    monkeypatch.setattr(neardup, "HOT", hot)
    r = random.Random(3)
    bases = [[f"w{r.randrange(3000)}" for _ in range(150)] for _ in range(3)]
    texts = [edited(r, bases[i % 3], share) for i in range(90)] + [" ".join(b) for b in bases]
    rows = list(enumerate(texts))
    assert classes(neardup.near_duplicate_classes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 100), (7, 7)]
    rows = components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_rows(spark):
    long = "one two three four five six seven eight nine ten " * 20000
    rows = [(3, "a b c"), (2, "a b c"), (2, "a b c"), (None, None), (None, "a  B c"), (5, ""), (6, " \n"), (7, None), (8, long), (9, long + "end"), (10, "other words in here now")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("clash")).withColumn("component", F.lit(1)).withColumn("row", F.lit(2))
    found = sorted((r.doc_id or 0, r.class_id or 0, r.class_size) for r in neardup.near_duplicate_classes(docs).collect())
    assert found == [(0, 0, 1), (0, 2, 4), (2, 2, 4), (2, 2, 4), (3, 2, 4), (5, 5, 1), (6, 6, 1), (7, 7, 1), (8, 8, 2), (9, 8, 2), (10, 10, 1)]
    kept = neardup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 5, 6, 7, 8, 10]
    assert neardup.near_duplicate_classes(docs.limit(0)).count() == 0 and neardup.keep_one_of_each(docs.limit(0)).count() == 0
