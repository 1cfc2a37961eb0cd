"""Occurrences of features in texts: by document, or summed by language.

A feature list that fits the limit goes to every task as a matcher; a longer one is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import prepare
from .grams import Matcher, Tally
from .tokens import CLASSES, HELD, MATCHER_LIMIT, Scanner, term_counts


def feature_list(features: DataFrame) -> list[bytes] | None:
    """The terms by feature_id, or None if there are more than the limit."""
    rows = features.select("feature_id", "term").orderBy("feature_id").limit(MATCHER_LIMIT + 1).collect()
    return None if len(rows) > MATCHER_LIMIT else [bytes(r.term) for r in rows]


def match_rows(items: DataFrame, features: DataFrame) -> DataFrame:
    """items: doc_id, data. -> doc_id, feature_id, tf: the relational form, an equality join of substrings with features."""
    widths = sorted(r[0] for r in features.select(F.length("term")).distinct().collect())  # few: widths of features
    placed = items.select("doc_id", "data", F.explode(F.sequence(F.lit(1), F.greatest(F.length("data"), F.lit(1)))).alias("at"))
    cut = placed.withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths or [1]]))).where(F.col("at") + F.col("width") - 1 <= F.length("data"))
    terms = cut.select("doc_id", F.col("data").substr(F.col("at"), F.col("width")).alias("term"))
    return terms.join(features.select("feature_id", "term"), "term").groupBy("doc_id", "feature_id").agg(F.count("*").alias("tf"))


def document_features(items: DataFrame, features: DataFrame) -> DataFrame:
    """doc_id, feature_id, tf: how often each feature occurs in each document, every place counted."""
    terms = feature_list(features)
    if terms is None:
        return match_rows(items, features)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            for *_, docs, ids, n in matcher.counts(batch.column("data")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(docs)), pa.array(ids, pa.int32()), pa.array(n, pa.int64())], ["doc_id", "feature_id", "tf"])

    prepare(items.sparkSession)
    kind = items.schema["doc_id"].dataType.simpleString()
    return items.select("doc_id", "data").mapInArrow(count, f"doc_id {kind}, feature_id int, tf bigint")


def class_totals(items: DataFrame, features: DataFrame, by: str = "lang_id") -> DataFrame:
    """feature_id, by, n: occurrences of each feature in all documents of a class; classes without any have no rows."""
    terms = feature_list(features)
    if terms is None:
        found = match_rows(items, features)
        return found.join(items.select("doc_id", by), "doc_id").groupBy("feature_id", by).agg(F.sum("tf").alias("n"))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, codes, tally = Matcher(terms), {}, Tally(HELD)
        size = np.uint64(max(1, len(terms)))

        def sent() -> Iterator[pa.RecordBatch]:
            """The class is above the feature in each number."""
            keys = pa.array(list(codes), kind)
            for numbers, n in tally.take():
                yield pa.RecordBatch.from_arrays([pa.array((numbers % size).astype(np.int32)), keys.take(pa.array((numbers // size).astype(np.int64))), pa.array(n, pa.int64())], ["feature_id", by, "n"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(by).type
            if len(codes) > CLASSES:
                yield from sent()
                codes.clear()
            classes = np.array([codes.setdefault(k, len(codes)) for k in batch.column(by).to_pylist()], np.uint64)
            for *_, places, ids, n in matcher.counts(batch.column("data")):
                if tally.add(classes[places] * size + ids.astype(np.uint64), n):
                    yield from sent()
        if kind is not None:
            yield from sent()

    prepare(items.sparkSession)
    kind_name = items.schema[by].dataType.simpleString()
    return items.select(by, "data").mapInArrow(total, f"feature_id int, {by} {kind_name}, n bigint").groupBy("feature_id", by).agg(F.sum("n").alias("n"))


def feature_terms(items: DataFrame, features: DataFrame, by: str = "lang") -> DataFrame:
    """term, by, n: in how many documents of a class each feature occurs; a list of any length."""
    terms = feature_list(features)
    if terms is not None:
        return term_counts(items, Scanner(terms), by)
    found = match_rows(items, features).join(items.select("doc_id", by), "doc_id").groupBy("feature_id", by).agg(F.count("*").alias("n"))
    return found.join(features.select("feature_id", "term"), "feature_id").select("term", by, "n")


def record_counts(by_document: DataFrame, by_class: DataFrame) -> DataFrame:
    """n_written, n_read: occurrences in the documents, and in the sums by class (of the same documents); equal if none was lost."""
    written = by_document.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_written"))
    return written.crossJoin(by_class.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_read")))  # a row and a row
