import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tonguemix.llm import dartminhash as dart
from tonguemix.llm import mixing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def steps(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF))
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, told, single, masked, mixed, encoded = [df.collect() for df in steps(spark, docs)]
    assert told == [r for r in start if r.doc_id in {x.doc_id for x in told}] and len(told) == sum(any(c.isalpha() for c in r.text) for r in start)
    # one of each class, by the exact similarity of all pairs
    sets = {r.doc_id: dart.shingles(r.text) for r in told}
    ids, gone = sorted(sets), set()
    root = {i: i for i in ids}
    for n, j in enumerate(ids):
        for i in ids[:n]:
            if dart.similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    gone = {i for i in ids if root[i] != i}
    assert sorted(r.doc_id for r in single) == sorted(set(ids) - gone)
    # secrets are masked, other texts stay
    assert sorted(r.doc_id for r in masked) == sorted(r.doc_id for r in single)
    before = {r.doc_id: r for r in single}
    for r in masked:
        assert r.n_chars == len(r.text) and (r.text == before[r.doc_id].text or "[SECRET]" in r.text)
    # the mix comes near its targets, which follow from the sizes
    copies = Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 3 and set(copies) <= {r.doc_id for r in masked}
    plan = mixing.mix_sources(spark.createDataFrame(masked, docs.schema)).collect()
    assert {r.doc_id: r.copies for r in plan if r.copies} == copies
    # tokens of what the mix takes
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in masked}
    assert Counter(r.doc_id for r in encoded) == copies
    for r in encoded:
        want = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.ids == want and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_run_gives_what_the_stages_give(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(steps(spark, docs)[-1].collect())


def test_rows(spark):
    rows = [(i, f"the quick brown fox number {i} jumps over lazy dogs and cats today", "en", "a", 1) for i in range(12)]
    rows += [(None, None, None, None, None), (20, "", "en", "b", 0), (21, "123", None, None, 3), (None, "over the lazy dogs again jumps a brown fox", None, None, None), (22, "the quick fox " * 20000, "en", "b", 5)] + rows[:2]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("own")).withColumn("size", F.lit(1)).withColumn("text_digest", F.lit("x"))
    out = steps(spark, docs)
    for df in out[1:-1]:
        assert df.columns == docs.columns
    assert {r.doc_id for r in out[1].collect()} == {*range(12), None, 22}
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in out[2].collect()) == [-1, *range(12), 22]
    empty = steps(spark, docs.limit(0))
    assert [df.count() for df in empty] == [0] * 6


def test_languages_not_learned_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = ["Il gatto dorme sul divano mentre fuori piove e la nonna prepara la cena per tutta la famiglia", "O gato dorme no sofá enquanto chove lá fora e a avó prepara o jantar para toda a família", "Katten sover på soffan medan det regnar ute och mormor lagar middag till hela familjen"]
    foreign = spark.createDataFrame([(-1 - i, t, None, "a", len(t)) for i, t in enumerate(texts)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(foreign), SF).collect()}
    assert kept == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text)}
