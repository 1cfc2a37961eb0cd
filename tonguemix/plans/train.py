"""Training: from labelled items to a model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.corpus import CorpusIndex, index_corpus
from ..operators.matching import class_totals
from ..operators.model import Model, build_model, number_features
from ..operators.selection import select_features
from ..operators.tokens import NGrams, Tokenizer, sampled, term_counts


#: Features up to which what is trained is kept in one partition, and not in as many as the shuffle before had.
FEW = 10_000


@dataclass(frozen=True)
class Settings:
    """How features are found and chosen: exactly one of k and count."""

    tokenizer: Tokenizer = NGrams(1, 4)
    k: float | None = None
    count: int | None = 300
    sample_size: int = 140
    sample_count: int | None = None
    seed: int = 0


def choose_features(items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """feature_id, term."""
    counts = term_counts(sampled(items, settings.sample_size, settings.sample_count, settings.seed), settings.tokenizer)
    return number_features(select_features(counts, k=settings.k, count=settings.count))


def train(items: DataFrame, settings: Settings = Settings(), index: CorpusIndex | None = None) -> Model:
    """items: doc_id, domain, lang, data. -> a model of the languages whose documents hold a feature.

    The features and the model are small and used again and again, so they are kept in memory, and where
    there are few as rows without the plans they came from, which would stand in every plan made of them; the
    texts are read twice, once to choose features and once to count them.
    """

    def kept(table: DataFrame) -> DataFrame:
        if few and (rows := table.toArrow()).num_rows:
            return items.sparkSession.createDataFrame(rows, table.schema).coalesce(1)
        return (table.repartition(1) if few else table).persist()

    few = settings.count is not None and settings.count <= FEW
    index = index or index_corpus(items)
    features = kept(choose_features(index.items, settings))
    ftc = kept(class_totals(index.items, features))
    model = build_model(features, ftc, index.lang_index.select("lang_id", "lang"))
    return Model(kept(model.features), kept(model.prototypes), kept(model.langs))
