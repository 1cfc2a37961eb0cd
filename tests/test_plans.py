"""How often plans read and match the texts."""

import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonguemix.operators import detect, matching, tokens
from tonguemix.plans import registry, shipping, train

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_relational_detection_makes_its_products_once(spark):
    dots = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "doc_id long, lang_id int, dot double").mapInArrow(lambda x: x, "doc_id long, lang_id int, dot double")
    gram = spark.createDataFrame([(i, j, float(i == j)) for i in (0, 1) for j in (0, 1)], "l1 int, l2 int, dot double")
    best = detect.best_mixes(dots, gram, 5, 3)
    assert plan(best).count("MapInArrow") == 1
    assert sorted((r.lang_id, round(r.weight, 9)) for r in best.collect()) == [(0, round(1 / 3, 9)), (1, round(2 / 3, 9))]


def test_accuracy_reads_the_language_with_the_text(spark):
    assert "Join" not in plan(registry.QUERIES["accuracy_confusion"](spark, SF))


def test_columns_to_keep(spark):
    one = registry.detectors(spark, SF)[1]
    docs = registry.items(spark, SF).withColumn("a b", F.col("doc_id") * 2)
    kept = detect.detect(docs, one, keep=("lang", "a b"))
    assert kept.columns[:3] == ["doc_id", "lang", "a b"]
    assert kept.select("doc_id", "lang", "a b").exceptAll(docs.select("doc_id", "lang", "a b")).count() == 0 and kept.count() == docs.count()


@pytest.mark.parametrize("run", [lambda x, f: tokens.term_counts(x, tokens.NGrams(1, 4)), lambda x, f: matching.document_features(x, f), lambda x, f: matching.class_totals(x, f, "lang")])
def test_batches_for_python_are_small(spark, run):
    """A session's own limit is kept if it is smaller."""
    docs = registry.texts(spark, SF)
    features = spark.createDataFrame([(0, b"a")], "feature_id int, term binary")
    setting = shipping._BATCH_SETTING
    before = spark.conf.get(setting)
    try:
        for given, want in (("64m", shipping.BATCH_BYTES), ("1000b", 1000)):
            spark.conf.set(setting, given)
            run(docs, features)
            assert int(spark.conf.get(setting).rstrip("b")) == want
    finally:
        spark.conf.set(setting, before)


@pytest.mark.parametrize("batches", [1, 24])
@pytest.mark.parametrize(("step", "most"), [("term_counts", 44), ("class_totals", 20), ("document_features", 8), ("detect", 8)])
def test_memory_of_a_task_does_not_follow_its_rows(spark, monkeypatch, step, most, batches):
    """Steps as a task runs them: 12 MB of texts, in one batch or in many, take at most so many MB beside themselves."""
    r = np.random.default_rng(3)
    words = [bytes(w) for w in r.integers(97, 123, (3000, 6)).astype(np.uint8)]
    said = [b" ".join(words[k] for k in r.integers(0, 3000, 350)) for _ in range(4900 // batches)]
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(said))), "lang": pa.array(["de", "en", "es", "fr"] * len(said))[: len(said)], "data": pa.array(said, pa.binary())})
    docs = spark.createDataFrame([(0, "de", b"a")], "doc_id long, lang string, data binary")
    known = [bytes([c]) for c in range(97, 123)] + words[:270]
    features = spark.createDataFrame(list(enumerate(known)), "feature_id int, term binary")
    one = detect.Detector(known, np.ones(296), np.random.default_rng(4).random((4, 296)), ["de", "en", "es", "fr"], 5, 3)
    tasks, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *rest: tasks.append(run) or plain(self, run, *rest))
    {
        "term_counts": lambda: tokens.term_counts(docs, tokens.NGrams(1, 4)),
        "class_totals": lambda: matching.class_totals(docs, features, "lang"),
        "document_features": lambda: matching.document_features(docs, features),
        "detect": lambda: detect.detect(docs, one),
    }[step]()
    tracemalloc.start()
    try:
        given = sum(out.num_rows for out in tasks[0](iter([rows] * batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(tasks) == 1 and given and peak < most << 20


def test_classes_beyond_the_limit(spark, monkeypatch):
    """More classes than are numbered at a time, and more numbers than are held."""
    docs = spark.createDataFrame([(i, f"c{i % 7}", f"text {i % 3}".encode()) for i in range(60)], "doc_id long, lang string, data binary")
    features = spark.createDataFrame(list(enumerate([b"t", b"ex", b"text 1"])), "feature_id int, term binary")
    runs = lambda: [sorted(map(str, df.collect())) for df in (tokens.term_counts(docs, tokens.NGrams(1, 4)), tokens.term_counts(docs, tokens.Prager(4)), matching.class_totals(docs, features, "lang"))]
    whole = runs()
    for module, name, value in ((tokens, "HELD", 1), (tokens, "CLASSES", 2), (matching, "HELD", 1), (matching, "CLASSES", 2)):
        monkeypatch.setattr(module, name, value)
    assert runs() == whole


def test_many_lines_are_detected_like_each(spark):
    """The same bits, whatever lines stand beside it."""
    for order in (1, 3):
        one = registry.detectors(spark, SF)[order]
        said = [line for r in registry.texts(spark, SF).limit(40).collect() for line in bytes(r.data).splitlines(keepends=True)] + [b"", b"\n", None]
        many = list(one.dots_of(pa.array(said, pa.binary())))
        assert len(many) == len(said)
        for line, (dots, norm) in zip(said, many, strict=True):
            alone, length = one.dots(line or b"")
            assert dots.tolist() == alone.tolist() and norm == length and one.detect_dots(dots) == one.detect_dots(alone)


def test_what_is_trained_is_in_one_partition(spark):
    """However many partitions a shuffle has, a few hundred features are no task for each of them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        built = train.train(registry.items(spark, SF), train.Settings(count=40))
        kept = {name: df._jdf.rdd().getNumPartitions() for name, df in (("features", built.features), ("prototypes", built.prototypes), ("langs", built.langs), ("gram", built.gram()))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert kept == dict.fromkeys(kept, 1)


def one_by_one(one, dots):
    """The best single language, pair or triple of one text, by trying each."""
    order = sorted(range(len(dots)), key=lambda i: (-dots[i], -i))
    best, length = {order[0]: 1.0}, dots[order[0]]
    g, top = one.gram, order[: one.topn]
    for size in range(2, one.max_order + 1):
        for c in combinations(top, size):
            if size == 2:
                found = detect.mix_of_two(g[c], *dots[list(c)])
            else:
                found = detect.mix_of_three(g[c[0], c[1]], g[c[1], c[2]], g[c[0], c[2]], *dots[list(c)])
            if found and found[-1] > length:
                best, length = dict(zip(c, [*found[:-1], 1 - sum(found[:-1])], strict=True)), found[-1]
    return {one.langs[i]: w for i, w in best.items()}, length


@pytest.mark.parametrize(("n_langs", "topn", "order"), [(1, 5, 3), (2, 5, 3), (4, 5, 1), (6, 5, 2), (7, 5, 3), (7, 2, 3)])
def test_mixes_of_many_texts(monkeypatch, n_langs, topn, order):
    """What each text has alone, with steps by combination of candidates and none by text."""
    rng = np.random.default_rng(n_langs + order)
    features = [bytes([97 + i]) for i in range(12)]
    prototypes = rng.random((n_langs, 12)) ** 4
    prototypes /= np.linalg.norm(prototypes, axis=1)[:, None]
    one = detect.Detector(features, rng.random(12), prototypes, [f"l{i}" for i in range(n_langs)], topn, order)
    texts = [bytes(rng.integers(97, 109, int(k)).astype(np.uint8)) for k in rng.integers(0, 9, 500)] + [b"", b"ZZ", None]
    want = [one_by_one(one, dots) for dots, _ in one.dots_of(texts)]
    calls, plain = [], (detect.mixes_of_two, detect.mixes_of_three)
    monkeypatch.setattr(detect, "mixes_of_two", lambda *x: calls.append(2) or plain[0](*x))
    monkeypatch.setattr(detect, "mixes_of_three", lambda *x: calls.append(3) or plain[1](*x))
    got = detect.detected(one, texts)
    assert len(calls) <= 20
    for found, score, (langs, length) in zip(got["langs"].to_pylist(), got["score"].to_pylist(), want, strict=True):
        assert dict(found) == pytest.approx(langs, abs=1e-9) and score == pytest.approx(length, abs=1e-12)
    assert got["has_features"].to_pylist()[-3:] == [False] * 3
    if order > 1 < n_langs:
        assert max(len(w) for w, _ in want) > 1
    assert detect.detected(one, [])["langs"].to_pylist() == []
    assert detect.detected(detect.Detector([], np.empty(0), np.empty((0, 0)), [], 5, order), [b"a"])["langs"].to_pylist() == [[]]


def test_what_is_trained_carries_no_plan(spark):
    """Steps that led to a model do not stand in each plan that is made of it."""
    docs = registry.items(spark, SF)
    built = train.train(docs, train.Settings(count=40))
    for table in (built.features, built.prototypes, built.langs):
        assert not any(x in plan(table) for x in ("MapInArrow", "InMemoryRelation", "Join"))
    none = train.train(docs.where("false"), train.Settings(count=40))
    assert [df.count() for df in (none.features, none.prototypes, none.langs)] == [0, 0, 0]


def test_no_python_step_of_a_query_follows_its_rows(spark, monkeypatch):
    """Every step in Python that training and bilingual_candidates take: 12 MB of texts in one batch take at most 32, 36 and 8 MB beside themselves."""
    steps, plain = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(registry, "_trained", {})
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, *rest: steps.append((run, self.columns)) or plain(self, run, *rest))
    registry.QUERIES["bilingual_candidates"](spark, SF)
    said = [bytes(r.data) for r in registry.texts(spark, SF).collect()]
    said *= (12 << 20) // sum(map(len, said)) + 1
    values = {"doc_id": range(len(said)), "lang": ["de", "en", "es", "fr"] * len(said), "lang_id": pa.array([0, 1, 2, 3] * len(said), pa.int32()), "data": pa.array(said, pa.binary())}
    peaks = []
    for run, columns in steps:
        rows = pa.RecordBatch.from_pydict({c: pa.array(values[c][: len(said)]) for c in columns})
        tracemalloc.start()
        try:
            assert sum(out.num_rows for out in run(iter([rows])))
            peaks.append(tracemalloc.get_traced_memory()[1] >> 20)
        finally:
            tracemalloc.stop()
    assert len(peaks) == 3 and all(peak < most for peak, most in zip(peaks, (32, 36, 8), strict=True)), peaks
