"""Indexing a corpus: items, language and domain dictionaries, coverage, pruning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_share

#: Names up to which a dictionary is broadcast.
BROADCAST_ROWS = 100_000


@dataclass
class CorpusIndex:
    """items: doc_id, domain, lang, domain_id, lang_id and what else the input has; the two indexes: id, name, n_docs."""

    items: DataFrame
    lang_index: DataFrame
    domain_index: DataFrame


def sample_items(items: DataFrame, proportion: float, seed: int = 0) -> DataFrame:
    """Each item with the probability proportion, decided by its doc_id and the seed."""
    return items if proportion >= 1 else items.where(hash_share(F.col("doc_id"), seed) < proportion)


def allow(items: DataFrame, column: str, names: list[str] | None) -> DataFrame:
    return items if names is None else items.where(F.col(column).isin(names))


def coverage(items: DataFrame) -> DataFrame:
    return items.select("domain", "lang").distinct()


def prune_min_domain(items: DataFrame, min_domain: int) -> DataFrame:
    """Items of the languages that occur in min_domain domains or more."""
    if min_domain <= 1:
        return items
    spread = coverage(items).groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= min_domain)
    return items.join(spread.select("lang"), "lang", "left_semi")


def dictionary(names: DataFrame, column: str, given: list[str] | None, id_name: str) -> DataFrame:
    """id_name and column: of given names their place in the list, else the place in order of name."""
    if given is not None:
        if len(set(given)) < len(given):
            raise ValueError(f"{column} names are given twice")
        rows = F.posexplode(F.array(*[F.lit(x) for x in given])) if given else F.posexplode(F.array().cast("array<string>"))
        return names.sparkSession.range(1).select(rows.alias(id_name, column))
    distinct = names.select(column).distinct()  # as many as there are languages or domains
    return distinct.select((F.row_number().over(Window.orderBy(column)) - 1).alias(id_name), column)


def _small(index: DataFrame, items: DataFrame, column: str, given: list[str] | None) -> DataFrame:
    """A dictionary to be joined: broadcast if it is known to be short, else as Spark decides."""
    n = len(given) if given is not None else items.select(column).distinct().limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(index) if n <= BROADCAST_ROWS else index


def _counted(index: DataFrame, items: DataFrame, column: str, id_name: str) -> DataFrame:
    counts = items.groupBy(column).agg(F.count("*").alias("n_docs"))
    return index.join(counts, column, "left").select(id_name, column, F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def index_corpus(items: DataFrame, *, langs: list[str] | None = None, domains: list[str] | None = None, min_domain: int = 1, proportion: float = 1.0, seed: int = 0) -> CorpusIndex:
    """items: doc_id, domain, lang (and more). -> the index of what is sampled, allowed and not pruned.

    Ids follow the order of names, or of the lists given; listed names without documents stay, with
    count 0. Domains are those seen before languages are filtered, so one whose languages all go
    stays with count 0. Items without a language or a domain are left out.
    """
    seen = allow(sample_items(items.where(F.col("lang").isNotNull() & F.col("domain").isNotNull()), proportion, seed), "domain", domains)
    known = allow(seen, "lang", langs)
    kept = prune_min_domain(known, min_domain)
    if langs is not None and min_domain > 1:
        rare = coverage(known).groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") < min_domain)
        gone = {r.lang for r in rare.select("lang").collect()}  # some of the names given
        langs = [x for x in langs if x not in gone]
    lang_index = dictionary(kept, "lang", langs, "lang_id")
    domain_index = dictionary(seen, "domain", domains, "domain_id")
    numbered = kept.join(_small(lang_index, kept, "lang", langs), "lang").join(_small(domain_index, seen, "domain", domains), "domain")
    return CorpusIndex(numbered, _counted(lang_index, kept, "lang", "lang_id"), _counted(domain_index, kept, "domain", "domain_id"))


def class_map(items: DataFrame, column: str, names: list[str]) -> DataFrame:
    """doc_id and a column of 0 or 1 for each name."""
    if not names:
        raise ValueError("no names to map to")
    return items.select("doc_id", *[(F.col(column) == x).cast("int").alias(f"{column}_{x}") for x in names])


def paths(items: DataFrame) -> DataFrame:
    return items.select("path")
