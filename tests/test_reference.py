"""Hand-derived cases of the semantics, and properties."""

import math
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonguemix.operators import corpus, detect, grams, matching, model, selection, tokens


def items(spark, texts, **columns):
    rows = [(i, t.encode() if isinstance(t, str) else t, *[c[i] for c in columns.values()]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "data binary", *[f"{c} {'string' if isinstance(v[0], str) else 'int'}" for c, v in columns.items()]]))


def terms(spark, tokenizer, text):
    return sorted({bytes(r.term) for r in tokenizer.rows(items(spark, [text])).collect()})


def fast(tokenizer, text):
    out = set()
    for found in tokenizer.distinct(text if isinstance(text, bytes) else text.encode()):
        out |= found if isinstance(found, set) else set(map(bytes, grams.as_bytes(found[1], found[0]).to_pylist()))
    return sorted(out)


CASES = [
    (tokens.NGrams(1, 4), "abc", [b"a", b"b", b"c", b"ab", b"bc", b"abc"]),
    (tokens.NGrams(1, 4), "ab", []),
    (tokens.NGrams(1, 2), "é", [b"\xc3", b"\xa9", b"\xc3\xa9"]),
    (tokens.Prager(4), "the cat", [b"the "]),
    (tokens.Prager(4, True), "the cat", [b"the", b"cat", b"the "]),
    (tokens.Prager(4, True), "of", [b"of"]),
    (tokens.Prager(4, True), "word " + "x" * 31, [b"word", b"ord ", b"xxxx"]),
    (tokens.Prager(1), "a b", [b"a", b" ", b"b"]),
    (tokens.Prager(4), b"ab\xa0cd\x85e\x1cf\x0bgh\x0ci", None),
    (tokens.Scanner([b"a", b"aa", b"aaa", b"zz"]), "aaaa", [b"a", b"aa", b"aaa"]),
]


@pytest.mark.parametrize(("tokenizer", "text", "want"), CASES)
def test_tokenizers(spark, tokenizer, text, want):
    found = terms(spark, tokenizer, text)
    assert found == fast(tokenizer, text) and (want is None or found == sorted(set(want)))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60), st.integers(1, 3), st.integers(0, 3))
def test_ngrams_by_definition(text, low, more):
    high = low + more
    want = {text[i : i + n] for n in range(low, high + 1) for i in range(len(text) - n + 1)} if len(text) >= high - 1 else set()
    assert fast(tokens.NGrams(low, high), text) == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \t\x0b\xa0é", max_size=50).map(str.encode), st.integers(1, 9), st.booleans())
def test_prager_by_definition(text, n, use_words):
    space = b" \t\n\x0b\x0c\r"
    want = {text[i : i + n] for i in range(len(text) - n + 1) if not any(c in space for c in text[i : i + n - 1])}
    want |= {w for w in text.split() if len(w) != n and len(w) <= 30} if use_words else set()
    assert fast(tokens.Prager(n, use_words), text) == sorted(want)


def test_presence_counts_and_sampling(spark):
    docs = items(spark, ["xxxx", "xxyy", "zz"], lang=["l", "l", "m"])
    found = {(bytes(r.term), r.lang): r.n for r in tokens.term_counts(docs, tokens.NGrams(1, 1)).collect()}
    assert found == {(b"x", "l"): 2, (b"y", "l"): 1, (b"z", "m"): 1}
    ten = items(spark, ["0123456789"])
    assert {r["sample"] for r in tokens.sampled(ten, 4, 99).collect()} == set(range(6))
    short = tokens.sampled(items(spark, ["abc"]), 4, 5).collect()
    assert [(r["sample"], bytes(r["data"])) for r in short] == [(0, b"abc")]
    sets = {tuple(sorted(r["sample"] for r in tokens.sampled(ten, 4, 2, seed=s).collect())) for s in range(60)}
    assert all(len(x) == 2 for x in sets) and len(sets) >= 12  # of 15
    two = [tuple(r) for r in tokens.sampled(ten, 4, 2, seed=3).orderBy("sample").collect()]
    assert len(two) == 2 and two == [tuple(r) for r in tokens.sampled(ten, 4, 2, seed=3).orderBy("sample").collect()]


def test_selection(spark):
    counts = spark.createDataFrame([(b"a", "l1", 1), (b"a", "l2", 1), (b"a", "l3", 1), (b"a", "l4", 1), (b"b", "l1", 1), (b"b", "l2", 1), (b"c", "l1", 3), (b"c", "l2", 1)], "term binary, lang string, n long")
    assert {bytes(r.term) for r in selection.select_by_threshold(counts, 0.5).collect()} == {b"b", b"c"}
    assert [(bytes(r.term), r.score) for r in selection.select_top(counts, 2).collect()] == [(b"c", 1.5), (b"b", 0.5)]
    assert selection.select_by_threshold(counts, 0).count() == 3
    with pytest.raises(ValueError):
        selection.select_features(counts, k=1.0, count=1)
    empty = counts.limit(0)
    assert tuple(selection.selection_stats(empty, selection.select_top(empty, 5)).first()) == (0, 0, None)


def test_occurrences(spark):
    features = spark.createDataFrame(list(enumerate([b"a", b"aa", b"aaa", b"the", b"longer than eight"])), "feature_id int, term binary")
    docs = items(spark, ["aaaa", "other", "", "a longer than eight bytes"])
    want = {(0, 0): 4, (0, 1): 3, (0, 2): 2, (1, 3): 1, (3, 0): 2, (3, 4): 1}
    for form in (matching.document_features, matching.match_rows):
        assert {(r.doc_id, r.feature_id): r.tf for r in form(docs, features).collect()} == want


def corpus_rows(spark):
    return spark.createDataFrame([(0, "d1", "a", "p0"), (1, "d2", "a", "p1"), (2, "d3", "b", "p2")], "doc_id long, domain string, lang string, path string")


def test_index_prunes_languages_but_not_domains(spark):
    found = corpus.index_corpus(corpus_rows(spark), min_domain=2)
    assert {r.lang for r in found.items.collect()} == {"a"}
    assert [(r.domain, r.n_docs) for r in found.domain_index.orderBy("domain_id").collect()] == [("d1", 1), ("d2", 1), ("d3", 0)]
    listed = corpus.index_corpus(corpus_rows(spark), langs=["a", "z"])
    assert [(r.lang_id, r.lang, r.n_docs) for r in listed.lang_index.orderBy("lang_id").collect()] == [(0, "a", 2), (1, "z", 0)]
    assert listed.domain_index.where("domain = 'd3'").first().n_docs == 0
    pruned = corpus.index_corpus(corpus_rows(spark), langs=["b", "a", "z"], min_domain=2)
    assert [(r.lang_id, r.lang, r.n_docs) for r in pruned.lang_index.orderBy("lang_id").collect()] == [(0, "a", 2), (1, "z", 0)]
    with pytest.raises(ValueError):
        corpus.index_corpus(corpus_rows(spark), langs=["a", "a"])


def small_model(spark):
    features = spark.createDataFrame([(0, b"x"), (1, b"y"), (2, b"z"), (3, b"never")], "feature_id int, term binary")
    ftc = spark.createDataFrame([(0, 0, 2), (1, 0, 1), (0, 2, 2), (2, 2, 1)], "feature_id int, lang_id int, n long")
    langs = spark.createDataFrame([(0, "L0"), (1, "unused"), (2, "L1")], "lang_id int, lang string")
    return model.build_model(features, ftc, langs), model.unused_languages(langs, ftc)


def test_model(spark):
    built, unused = small_model(spark)
    assert [r.lang for r in unused.collect()] == ["unused"]
    assert [r.ilf for r in built.features.orderBy("feature_id").collect()] == [0.5, 1.0, 1.0, 0.0]
    assert [(r.lang_id, r.lang) for r in built.langs.orderBy("lang_id").collect()] == [(0, "L0"), (1, "L1")]
    one = built.detector()
    assert np.allclose(one.prototypes, np.array([[1, 1, 0, 0], [1, 0, 1, 0]]) / math.sqrt(2))
    assert {(r.l1, r.l2): round(r.dot, 9) for r in built.gram().collect()} == {(0, 0): 1, (1, 1): 1, (0, 1): 0.5, (1, 0): 0.5}


def test_two_languages(spark, tmp_path):
    built, _ = small_model(spark)
    built.save(str(tmp_path / "m"))
    loaded = model.Model.load(spark, str(tmp_path / "m"))
    for source in (built, loaded):
        two = source.detector(max_order=2)
        assert two.score("xxyz") == pytest.approx({"L0": 0.816497, "L1": 0.816497}, abs=1e-6)
        assert source.detector().detect("xxyz") == {"L1": 1.0}
        assert two.detect("xxyz") == pytest.approx({"L0": 0.5, "L1": 0.5})
        assert two.detect_dots(two.dots("xxyz")[0])[1] == pytest.approx(1.632993, abs=1e-6)
        assert two.detect("") == {"L1": 1.0} and math.isnan(two.score("")["L0"])


@pytest.mark.parametrize(("order", "want", "length"), [(1, {"L0": 1.0}, 3), (2, {"L0": 0.6, "L1": 0.4}, math.sqrt(13)), (3, {"L0": 1 / 2, "L1": 1 / 3, "L2": 1 / 6}, math.sqrt(14))])
def test_orders(order, want, length):
    one = detect.Detector([b"x", b"y", b"z"], np.ones(3), np.eye(3), ["L0", "L1", "L2"], 5, order)
    found, score = one.detect_dots(one.dots("xxxyyz")[0])
    assert found == pytest.approx(want) and score == pytest.approx(length)


def test_projections_against_least_squares():
    r = np.random.default_rng(1)
    seen = 0
    for _ in range(400):
        p = np.abs(r.normal(size=(3, 8))) + 0.05
        p /= np.linalg.norm(p, axis=1)[:, None]
        x = r.dirichlet(np.ones(3)) @ p
        g, d = p @ p.T, p @ x
        found = detect.mix_of_three(g[0, 1], g[1, 2], g[0, 2], *d)
        if found:
            seen += 1
            coefficients = np.linalg.solve(g, d)
            assert np.allclose([found[0], found[1]], (coefficients / coefficients.sum())[:2], atol=1e-7)
            assert found[2] ** 2 == pytest.approx(d @ coefficients)
        for i, j in combinations(range(3), 2):
            two = detect.mix_of_two(g[i, j], d[i], d[j])
            if two:
                own = np.linalg.solve(g[np.ix_([i, j], [i, j])], d[[i, j]])
                assert two[0] == pytest.approx(own[0] / own.sum())
    assert seen > 300
    assert detect.mix_of_two(1.0, 1.0, 1.0) is None and detect.mix_of_three(0, 0, 0, 0, 0, 0) is None


def test_arguments():
    for bad in (0, 4):
        with pytest.raises(ValueError):
            detect.check_orders(5, bad)
    with pytest.raises(ValueError):
        detect.check_orders(0, 1)
    with pytest.raises(ValueError):
        tokens.NGrams(3, 2)


def test_relational_form_agrees(spark):
    built, _ = small_model(spark)
    docs = items(spark, ["xxyz", "y", "zzx", "", "xyzzy nothing"])
    vectors = detect.query_vectors(matching.document_features(docs, built.features), built.features)
    dots = detect.dot_products(docs, vectors, built.prototypes, built.langs)
    for order in (1, 2, 3):
        one = built.detector(max_order=order)
        rows = detect.best_mixes(dots, built.gram(), 5, order).join(built.langs, "lang_id").collect()
        want = {(r.doc_id, lang): w for r in docs.collect() for lang, w in one.detect(bytes(r.data)).items()}
        assert {(r.doc_id, r.lang): r.weight for r in rows} == pytest.approx(want)
    scores = {(r.doc_id, r.lang_id): r.score for r in detect.cosine_scores(dots, vectors).collect()}
    assert math.isnan(scores[3, 0]) and scores[0, 0] == pytest.approx(0.816497, abs=1e-6)
    assert detect.detect(docs.limit(0), built.detector()).count() == 0 and F is not None
