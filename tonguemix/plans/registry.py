"""The registered queries over the driver's tables, and their SQL.

documents is the corpus: its lang is the language, its source the domain. Models are trained on all
that have both, with the TOP best n-grams of 1 to 4 bytes as features; what needs no label (detection,
scores, counts of bytes and features) runs on all documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import utf8
from ..operators import corpus, detect, matching, model, selection, tokens
from ..sources import corpora, sinks
from ..streaming import lines
from . import oracle, train
from .folders import fresh_path
from .shipping import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = oracle.SQL
_trained: dict[tuple, object] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, labelled or not."""
    return corpora.from_table(table(spark, sf_dir, "documents"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with a language and a domain."""
    return texts(spark, sf_dir).where(F.col("lang").isNotNull() & F.col("domain").isNotNull())


def once(build: Callable) -> Callable:
    """What is trained is kept for a session and a folder: a model and its features are small."""

    def get(spark: SparkSession, sf_dir: str):
        key = (build.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _trained:
            _trained[key] = build(spark, sf_dir)
        return _trained[key]

    return get


def hexed(df: DataFrame) -> DataFrame:
    return df.withColumn("term", F.hex("term"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@once
def trained(spark: SparkSession, sf_dir: str) -> model.Model:
    return train.train(items(spark, sf_dir), train.Settings(tokens.NGrams(1, 4), count=oracle.TOP))


@once
def detectors(spark: SparkSession, sf_dir: str) -> dict[int, detect.Detector]:
    one = trained(spark, sf_dir).detector()
    return {order: detect.Detector(one.features, one.ilf, one.prototypes, one.langs, 5, order) for order in (1, 2, 3)}


def counts(spark: SparkSession, sf_dir: str, by: str = "lang", tokenizer: tokens.Tokenizer = tokens.NGrams(1, 4)) -> DataFrame:
    return tokens.term_counts(items(spark, sf_dir), tokenizer, by)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trained(spark, sf_dir).features


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = corpus.index_corpus(items(spark, sf_dir))
    return matching.class_totals(index.items, features(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.query_vectors(matching.document_features(texts(spark, sf_dir), features(spark, sf_dir)), features(spark, sf_dir))


def dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = trained(spark, sf_dir)
    return detect.dot_products(texts(spark, sf_dir), vectors(spark, sf_dir), m.prototypes, m.langs)


def named(df: DataFrame, spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """Ids of languages (new name = column) as names."""
    for new, old in columns.items():
        langs = trained(spark, sf_dir).langs.select(F.col("lang_id").alias(old), F.col("lang").alias(new))
        df = df.join(F.broadcast(langs), old)  # a row for each language of the model
    return df


def marked(spark: SparkSession, sf_dir: str) -> corpus.CorpusIndex:
    """All documents by language and what their label says of them, if there is one: some of these classes are rare."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("label"))
    named = items(spark, sf_dir).join(labels, "doc_id", "left").withColumn("lang", F.concat("lang", F.lit(":"), F.coalesce("label", F.lit("-"))))
    return corpus.index_corpus(named, min_domain=oracle.LEAST_DOMAINS)


def spread(spark: SparkSession, sf_dir: str) -> corpus.CorpusIndex:
    return corpus.index_corpus(items(spark, sf_dir), min_domain=oracle.LEAST_DOMAINS)


def given(spark: SparkSession, sf_dir: str) -> corpus.CorpusIndex:
    return corpus.index_corpus(items(spark, sf_dir), langs=oracle.GIVEN_LANGS, domains=oracle.GIVEN_DOMAINS)


@query
def corpus_items(spark, sf_dir):
    return corpus.index_corpus(items(spark, sf_dir)).items.select("doc_id", "domain", "lang", "domain_id", "lang_id")


@query
def lang_index(spark, sf_dir):
    return corpus.index_corpus(items(spark, sf_dir)).lang_index


@query
def domain_index(spark, sf_dir):
    return corpus.index_corpus(items(spark, sf_dir)).domain_index


@query
def coverage(spark, sf_dir):
    return corpus.coverage(items(spark, sf_dir))


@query
def min_domain_prune(spark, sf_dir):
    return marked(spark, sf_dir).items.select("doc_id", "domain", "lang", "lang_id")


@query
def min_domain_index(spark, sf_dir):
    return marked(spark, sf_dir).domain_index


@query
def min_domain_prune_documents(spark, sf_dir):
    """The same by language alone."""
    return spread(spark, sf_dir).items.select("doc_id", "domain", "lang", "lang_id")


@query
def min_domain_index_documents(spark, sf_dir):
    """The same as min_domain_index by language alone."""
    return spread(spark, sf_dir).domain_index


@query
def allow_list(spark, sf_dir):
    return given(spark, sf_dir).items.select("doc_id", "domain", "lang", "domain_id", "lang_id")


@query
def allow_list_langs(spark, sf_dir):
    return given(spark, sf_dir).lang_index


@query
def allow_list_domains(spark, sf_dir):
    return given(spark, sf_dir).domain_index


@query
def onehot_classmap(spark, sf_dir):
    return corpus.class_map(items(spark, sf_dir), "lang", ["de", "en", "es", "fr"])


@query
def sample_corpus(spark, sf_dir):
    return corpus.sample_items(items(spark, sf_dir), 0.5, seed=7).select("doc_id", "domain", "lang")


@query
def byte_count(spark, sf_dir):
    return tokens.byte_count(texts(spark, sf_dir))


@query
def ngram_terms(spark, sf_dir):
    return hexed(counts(spark, sf_dir))


@query
def ngram_term_domain(spark, sf_dir):
    return hexed(counts(spark, sf_dir, "domain"))


@query
def prager_terms(spark, sf_dir):
    return hexed(counts(spark, sf_dir, tokenizer=tokens.Prager(4)))


@query
def prager_word_terms(spark, sf_dir):
    return hexed(counts(spark, sf_dir, tokenizer=tokens.Prager(4, use_words=True)))


@query
def sampled_terms(spark, sf_dir):
    return hexed(tokens.term_counts(tokens.sampled(items(spark, sf_dir), oracle.SAMPLE, oracle.SAMPLES, seed=0), tokens.NGrams(1, 4)))


@query
def scanner_terms(spark, sf_dir):
    return hexed(matching.feature_terms(items(spark, sf_dir), features(spark, sf_dir)))


@query
def lang_freq(spark, sf_dir):
    return hexed(selection.language_frequency(counts(spark, sf_dir)))


@query
def prager_select_k(spark, sf_dir):
    return hexed(selection.select_by_threshold(counts(spark, sf_dir), oracle.K))


@query
def tfilf_topn(spark, sf_dir):
    return rounded(hexed(selection.select_top(counts(spark, sf_dir), oracle.TOP)), "score")


@query
def selection_stats(spark, sf_dir):
    found = counts(spark, sf_dir)
    return rounded(selection.selection_stats(found, selection.select_top(found, oracle.TOP)), "share")


@query
def doc_feature_tf(spark, sf_dir):
    return matching.document_features(texts(spark, sf_dir), features(spark, sf_dir))


@query
def ftc(spark, sf_dir):
    return totals(spark, sf_dir)


@query
def ilf(spark, sf_dir):
    return rounded(hexed(model.inverse_language_frequency(features(spark, sf_dir).select("feature_id", "term"), totals(spark, sf_dir))), "ilf").select("feature_id", "term", "lf", "ilf")


@query
def unused_langs(spark, sf_dir):
    langs = corpus.index_corpus(items(spark, sf_dir)).lang_index.select("lang_id", "lang")
    return model.unused_languages(langs.unionByName(spark.range(1).select(F.lit(99).alias("lang_id"), F.lit("none").alias("lang"))), totals(spark, sf_dir))


@query
def prototypes(spark, sf_dir):
    return rounded(trained(spark, sf_dir).prototypes, "w")


@query
def gram(spark, sf_dir):
    return rounded(trained(spark, sf_dir).gram(), "dot")


@query
def query_vectors(spark, sf_dir):
    return rounded(vectors(spark, sf_dir), "v")


@query
def dot_products(spark, sf_dir):
    return rounded(dots(spark, sf_dir), "dot")


@query
def cosine_score(spark, sf_dir):
    scored = detect.score(texts(spark, sf_dir), detectors(spark, sf_dir)[1])
    return rounded(scored.select("doc_id", F.explode("score").alias("lang", "score")), "score")


@query
def topn_candidates(spark, sf_dir):
    return rounded(detect.candidates(dots(spark, sf_dir), 3), "dot")


@query
def detect_mono(spark, sf_dir):
    found = detect.detect(texts(spark, sf_dir), detectors(spark, sf_dir)[1])
    return rounded(found.select("doc_id", F.get(F.map_keys("langs"), F.lit(0)).alias("lang"), "score", "has_features"), "score")


@query
def bilingual_candidates(spark, sf_dir):
    found = detect.pairs(detect.candidates(dots(spark, sf_dir), 5), trained(spark, sf_dir).gram()).where(F.least("a", 1 - F.col("a")) > float(oracle.CLEAR))
    return rounded(named(found, spark, sf_dir, lang1="l1", lang2="l2").select("doc_id", "lang1", "lang2", "a", "score"), "a", "score")


@query
def trilingual_candidates(spark, sf_dir):
    found = detect.triples(detect.candidates(dots(spark, sf_dir), 5), trained(spark, sf_dir).gram()).where(F.least("a", "b", 1 - F.col("a") - F.col("b")) > float(oracle.CLEAR))
    return rounded(named(found, spark, sf_dir, lang1="l1", lang2="l2", lang3="l3").select("doc_id", "lang1", "lang2", "lang3", "a", "b", "score"), "a", "b", "score")


def mixes(spark: SparkSession, sf_dir: str, said: DataFrame, order: int) -> DataFrame:
    return rounded(detect.shares(detect.detect(said, detectors(spark, sf_dir)[order])), "weight")


@query
def detect_bi(spark, sf_dir):
    return mixes(spark, sf_dir, texts(spark, sf_dir), 2)


@query
def detect_tri(spark, sf_dir):
    return mixes(spark, sf_dir, texts(spark, sf_dir), 3)


@query
def detect_relational(spark, sf_dir):
    """The same as detect_tri, in the relational form."""
    best = detect.best_mixes(dots(spark, sf_dir), trained(spark, sf_dir).gram(), 5, 3)
    return rounded(named(best, spark, sf_dir, lang="lang_id").select("doc_id", "lang", "weight"), "weight")


@query
def detect_lines(spark, sf_dir):
    lines = corpora.lines_of(table(spark, sf_dir, "documents"))
    return mixes(spark, sf_dir, lines.select(F.concat_ws(":", "doc_id", "line").alias("doc_id"), "data"), 1)


@query
def detect_conversations(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), utf8(F.col("text")).alias("data"))
    return mixes(spark, sf_dir, said, 2)


@query
def detect_pages(spark, sf_dir):
    return mixes(spark, sf_dir, table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), utf8(F.col("html")).alias("data")), 2)


@query
def detect_benchmark(spark, sf_dir):
    return mixes(spark, sf_dir, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), utf8(F.col("text")).alias("data")), 2)


@query
def detect_json(spark, sf_dir):
    return sinks.json_lines(detect.detect(texts(spark, sf_dir), detectors(spark, sf_dir)[1]), "langs")


@query
def accuracy_confusion(spark, sf_dir):
    found = detect.detect(items(spark, sf_dir), detectors(spark, sf_dir)[1], keep=("lang",)).select("lang", F.get(F.map_keys("langs"), F.lit(0)).alias("detected"))
    return found.groupBy("lang", "detected").agg(F.count("*").alias("n"))


# Files between two steps: what is written is read again.


@once
def index_files(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "index")
    sinks.write_index(corpus.index_corpus(items(spark, sf_dir).withColumn("path", F.col("doc_id").cast("string"))), path)
    return path


@query
def corpus_paths(spark, sf_dir):
    return corpus.paths(items(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path")))


@query
def index_paths_file(spark, sf_dir):
    return corpora.read_index(spark, f"{index_files(spark, sf_dir)}/paths", corpora.PATHS)


@query
def index_langs_file(spark, sf_dir):
    return corpora.read_index(spark, f"{index_files(spark, sf_dir)}/lang_index", corpora.LANGS)


@query
def index_domains_file(spark, sf_dir):
    return corpora.read_index(spark, f"{index_files(spark, sf_dir)}/domain_index", corpora.DOMAINS)


@once
def corpus_folder(spark: SparkSession, sf_dir: str) -> str:
    """The texts as files of text in folders by domain and language, as many files as there are tasks that write."""
    path = fresh_path(spark, "corpus")
    said = items(spark, sf_dir).select("domain", "lang", F.decode("data", "UTF-8").alias("value"))
    said.write.partitionBy("domain", "lang").text(path)
    return path


def bytes_by_class(files: DataFrame) -> DataFrame:
    """Spark's writer names a folder column=value."""
    value = lambda c: F.substring_index(c, "=", -1).alias(c)
    return files.groupBy(value("domain"), value("lang")).agg(F.sum(F.length("data")).alias("n_bytes"))


@query
def directory_corpus(spark, sf_dir):
    return bytes_by_class(corpora.read_directory(spark, corpus_folder(spark, sf_dir)))


@query
def listed_corpus(spark, sf_dir):
    listing = fresh_path(spark, "listing")
    corpus.paths(corpora.read_directory(spark, corpus_folder(spark, sf_dir))).write.text(listing)
    return bytes_by_class(corpora.read_path_list(spark, listing))


@query
def features_file(spark, sf_dir):
    path = fresh_path(spark, "features")
    sinks.write_features(features(spark, sf_dir), path)
    return hexed(corpora.read_features(spark, path))


@query
def weights_file(spark, sf_dir):
    path = fresh_path(spark, "weights")
    sinks.write_weights(features(spark, sf_dir).select(F.col("term").alias("key"), F.col("ilf").alias("value")), path)
    return rounded(corpora.read_weights(spark, path).select(F.hex("key").alias("term"), F.get("values", F.lit(0)).alias("ilf")), "ilf")


@query
def record_counts(spark, sf_dir):
    """Occurrences as they are counted by document, and as they come out summed by class: none may be lost between."""
    return matching.record_counts(matching.document_features(items(spark, sf_dir), features(spark, sf_dir)), totals(spark, sf_dir))


def benchmark_mixes(spark: SparkSession, sf_dir: str, found: model.Model) -> DataFrame:
    said = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), utf8(F.col("text")).alias("data"))
    return rounded(detect.shares(detect.detect(said, found.detector(5, 2))), "weight")


@query
def saved_model(spark, sf_dir):
    path = fresh_path(spark, "model")
    trained(spark, sf_dir).save(path)
    return benchmark_mixes(spark, sf_dir, model.Model.load(spark, path))


@query
def model_string(spark, sf_dir):
    return benchmark_mixes(spark, sf_dir, model.Model.from_string(spark, trained(spark, sf_dir).to_string()))


@query
def detect_in_sql(spark, sf_dir):
    """Detection as a function that SQL calls."""
    spark.udf.register("languages_of", detect.detect_udf(detectors(spark, sf_dir)[1]))
    documents = table(spark, sf_dir, "documents")
    return rounded(spark.sql("SELECT doc_id, explode(languages_of(text)) AS (lang, weight) FROM {documents}", documents=documents), "weight")


@query
def stream_lines(spark, sf_dir):
    """detect_lines on a stream: the table as it arrives, a line of JSON for each line of text, read back when all is done."""
    stored = table(spark, sf_dir, "documents").schema
    arriving = corpora.lines_of(spark.readStream.schema(stored).parquet(f"{sf_dir}/documents.parquet*"))  # a pattern, as the table may be one file
    out, progress = fresh_path(spark, "stream"), fresh_path(spark, "progress")
    named = arriving.select(F.concat_ws(":", "doc_id", "line").alias("doc_id"), "data")
    lines.start(named, detectors(spark, sf_dir)[1], out, progress, once=True).awaitTermination()
    found = spark.read.text(out).select(F.from_json("value", "path string, langs map<string,double>").alias("x"))
    return rounded(detect.shares(found.select(F.col("x.path").alias("doc_id"), "x.langs")), "weight")
