import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tonguemix.llm import entries, language_filters

SF = "/root/testdata/sf0.01"
GRAMS = [("a", "the quick brown fox jumps over the lazy dog again"), ("b", "der schnelle braune fuchs springt faul über den hund"), ("b", "und noch einmal über den faulen hund springt er")]


def small(spark, rows=tuple(GRAMS) * 3):
    return spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    found = entries.QUERIES["op6_language_id"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = found.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_filters_against_exact_sets(spark):
    """A filter never misses an n-gram that was put in, and rarely holds one that was not."""
    docs = small(spark)
    filters = language_filters.train(docs, F.lit(True), least=1, share=0.0)
    sets = {g: set() for g in "ab"}
    for g, t in GRAMS:
        sets[g] |= {x for codes in language_filters.letters(t) for x in language_filters.ngrams(codes).tolist()}
    for k, g in enumerate(filters.languages):
        own = np.array(sorted(sets[g]), np.uint64)
        assert filters.counts(own)[k] == len(own)
        other = np.array(sorted(sets["ab".replace(g, "")] - sets[g]), np.uint64)
        assert filters.counts(other)[k] <= 1


def test_more_languages_than_bits():
    grams = [language_filters.ngrams(np.array([32, 200 + k, 300 + k, 400 + k, 32], np.uint64)) for k in range(130)]
    masks = [np.zeros(language_filters.CELLS, np.uint64) for _ in range(3)]
    for k, g in enumerate(grams):
        for places in language_filters.cells(g):
            np.bitwise_or.at(masks[k // language_filters.WORD_BITS], places, np.uint64(1 << k % language_filters.WORD_BITS))
    filters = language_filters.Filters([f"l{k:03}" for k in range(130)], masks)
    assert all(int(np.argmax(filters.counts(g))) == k for k, g in enumerate(grams))


def test_rows(spark):
    docs = small(spark)
    filters = language_filters.train(docs, F.lit(True), least=1)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?\n"), (None, "der hund"), (4, "the dog"), (4, "the dog"), (5, "Über den Hund! " * 200000), (6, "x")], "doc_id long, text string").withColumn("lang_pred", F.lit("clash")).withColumn("row", F.lit(1))
    rows = language_filters.identify(odd, filters).collect()
    pred = {r.doc_id: r.lang_pred for r in rows}
    assert len(rows) == 8 and pred[1] == pred[2] == pred[3] == "und" and pred[None] == pred[5] == "b" and pred[4] == "a"
    assert pred[6] in ("a", "b") and not next(r for r in rows if r.doc_id is None).held_out
    kept = language_filters.keep_identified(odd, filters)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 4, 5}
    assert language_filters.identify(odd.limit(0), filters).count() == 0
    nothing = language_filters.train(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_filters.identify(odd, nothing).collect()} == {"und"}


def test_pieces_of_a_long_text_count_every_ngram_once(monkeypatch):
    for text in ("the quick brown fox über den faulen hund " * 50, "a" + " " * 500 + "b", " " * 300, "x", "", "ab" + "." * 96 + "c" * 97 + "." * 200):
        whole = [language_filters.ngrams(codes) for codes in language_filters.letters(text)]
        assert len(whole) == 1
        with monkeypatch.context() as patch:
            patch.setattr(language_filters, "PIECE", 97)
            assert np.array_equal(np.concatenate([language_filters.ngrams(codes) for codes in language_filters.letters(text)]), whole[0])


def grams_of(text):
    line = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
    return [line[i : i + 4] for i in range(max(1, len(line) - 3))], any(c != " " for c in line)


def test_query_against_exact_sets(spark):
    """The query over a whole table beside sets of strings: Bloom filters shift scores by what their correction leaves, and no decision but near ties."""
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held_out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    counts = {}
    for r in docs.values():
        if not held_out(r.doc_id) and r.text is not None and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(grams_of(r.text)[0])
    kept = {lang: {g: n for g, n in c.items() if n >= 2} for lang, c in counts.items()}
    rates = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in kept.items()}
    most = Counter()
    for c in rates.values():
        for g, x in c.items():
            most[g] = max(most[g], x)
    sets = {lang: {g for g, x in c.items() if x >= 0.25 * most[g]} for lang, c in rates.items()}
    rows = entries.QUERIES["op6_language_id"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        grams, known = grams_of(docs[r.doc_id].text or "")
        share = {lang: sum(g in own for g in grams) / len(grams) for lang, own in sets.items()}
        assert r.held_out == held_out(r.doc_id)
        if not known:
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert abs(r.score - max(share.values())) < 0.02 and share[r.lang_pred] > max(share.values()) - 0.02
