"""Feature selection from counts of documents by term and language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def language_frequency(term_lang: DataFrame) -> DataFrame:
    """term, lf: in how many languages the term occurs."""
    return term_lang.groupBy("term").agg(F.count("*").alias("lf"))


def _scored(term_lang: DataFrame) -> DataFrame:
    return term_lang.groupBy("term").agg(F.max("n").alias("most"), F.count("*").alias("lf"))


def select_by_threshold(term_lang: DataFrame, k: float) -> DataFrame:
    """term, most, lf of the terms whose count in some language is k times their language frequency or more."""
    return _scored(term_lang).where(F.col("most") >= F.lit(float(k)) * F.col("lf"))


def select_top(term_lang: DataFrame, count: int) -> DataFrame:
    """term, score: the count terms of highest count by language frequency; ties by the term's bytes."""
    if count < 0:
        raise ValueError("count must not be negative")
    return _scored(term_lang).select("term", (F.col("most") / F.col("lf")).alias("score")).orderBy(F.col("score").desc(), "term").limit(count)


def select_features(term_lang: DataFrame, *, k: float | None = None, count: int | None = None) -> DataFrame:
    """term: by threshold or by number; exactly one of both is to be given."""
    if (k is None) == (count is None):
        raise ValueError("give either k or count")
    return (select_by_threshold(term_lang, k) if count is None else select_top(term_lang, count)).select("term")


def selection_stats(term_lang: DataFrame, selected: DataFrame) -> DataFrame:
    """n_selected, n_total, share (null if there are no terms)."""
    total = term_lang.select("term").distinct().agg(F.count("*").alias("n_total"))
    chosen = selected.agg(F.count("*").alias("n_selected"))
    return chosen.crossJoin(total).select("n_selected", "n_total", F.try_divide("n_selected", "n_total").alias("share"))  # one row by one row
