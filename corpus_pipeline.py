"""Documents to training tokens in five stages, each one of the operators in tonguemix.llm.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last keep the columns of documents. Nulls, empty texts,
repeated rows and empty tables have the results that the operators' own docstrings state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemix.llm import language_filters, mixing, neardup, secret_scan, sentencepieces
from tonguemix.llm._common import prepare, stored, table

#: Parameters: the least language score that is kept, and the tokenizer's file.
LEAST_LANGUAGE_SCORE = 0.4
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters, or like no language that was learned, go.

    The filters are learned from a bounded sample of the labelled rows of docs (see language_filters.train).
    """
    prepare(spark)
    filters = language_filters.train(docs, F.col("doc_id").isNotNull() & ~language_filters.is_held_out(F.col("doc_id")))
    return language_filters.keep_identified(docs, filters, least=LEAST_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest doc_id."""
    prepare(spark)
    return neardup.keep_one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked and n_chars set anew."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it: not at all, once, up to three times."""
    return mixing.apply_mix(docs, weights=(5, 2, 1), share=1.0, max_repeats=3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and digests of each document; what the ids decode to is under decoded_sha256."""
    prepare(spark)
    return sentencepieces.round_trip_digests(docs, sentencepieces.model_bytes(PIECE_MODEL), keep_ids=True)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: Classifiers, signatures and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage gives is stored in the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
