"""Language prototypes: unit vectors of feature occurrences weighted by inverse language frequency."""

from __future__ import annotations

import base64
import bz2
import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import or_zero
from .detect import Detector


def number_features(terms: DataFrame) -> DataFrame:
    """feature_id, term: ids in order of the terms' bytes.

    Terms are numbered within their first two bytes, from where those before end; only counts by two
    bytes, some 66,000 at most, meet in one task.
    """
    distinct = terms.select("term", F.substring("term", 1, 2).alias("lead")).distinct()
    before = Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = distinct.groupBy("lead").agg(F.count("*").alias("n")).select("lead", (F.sum("n").over(before) - F.col("n")).alias("start"))
    within = F.row_number().over(Window.partitionBy("lead").orderBy("term")) - 1
    placed = distinct.withColumn("within", within).join(F.broadcast(starts), "lead")  # bounded, see above
    return placed.select((F.col("start") + F.col("within")).cast("int").alias("feature_id"), "term")


def inverse_language_frequency(features: DataFrame, ftc: DataFrame) -> DataFrame:
    """feature_id, term, lf, ilf: 1 over the number of languages with the feature; 0 if there is none."""
    lf = ftc.where(F.col("n") > 0).groupBy("feature_id").agg(F.count("*").alias("lf"))
    found = features.join(lf, "feature_id", "left").withColumn("lf", F.coalesce("lf", F.lit(0)))
    return found.withColumn("ilf", or_zero(F.try_divide(F.lit(1.0), F.col("lf"))))


def unused_languages(langs: DataFrame, ftc: DataFrame) -> DataFrame:
    """Languages in whose documents no feature occurs."""
    return langs.join(ftc.where(F.col("n") > 0), "lang_id", "left_anti")


def prototypes(ftc: DataFrame, weighted: DataFrame) -> DataFrame:
    """lang_id, feature_id, w: rows of unit length, without zeros."""
    w = ftc.where(F.col("n") > 0).join(weighted.select("feature_id", "ilf"), "feature_id").withColumn("raw", F.col("n") * F.col("ilf"))
    norms = w.groupBy("lang_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return w.join(F.broadcast(norms), "lang_id").select("lang_id", "feature_id", (F.col("raw") / F.col("norm")).alias("w"))  # a row for each language


def gram(prototype: DataFrame) -> DataFrame:
    """l1, l2, dot: inner products of all pairs of prototypes; 0 where they share no feature."""
    left = prototype.select(F.col("lang_id").alias("l1"), "feature_id", F.col("w").alias("w1"))
    right = prototype.select(F.col("lang_id").alias("l2"), "feature_id", F.col("w").alias("w2"))
    dots = left.join(right, "feature_id").groupBy("l1", "l2").agg(F.sum(F.col("w1") * F.col("w2")).alias("dot"))
    langs = prototype.select("lang_id").distinct()
    pairs = langs.select(F.col("lang_id").alias("l1")).crossJoin(langs.select(F.col("lang_id").alias("l2")))  # languages by languages
    return pairs.join(dots, ["l1", "l2"], "left").select("l1", "l2", F.coalesce("dot", F.lit(0.0)).alias("dot"))


@dataclass
class Model:
    """features: feature_id, term, lf, ilf. prototypes: lang_id, feature_id, w. langs: lang_id, lang, without gaps."""

    features: DataFrame
    prototypes: DataFrame
    langs: DataFrame
    _gram: DataFrame | None = field(default=None, repr=False)

    def save(self, path: str) -> None:
        for name in ("features", "prototypes", "langs"):
            getattr(self, name).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    def to_string(self) -> str:
        """The whole model as printable text: a small model may so be kept in a program or a setting."""
        tables = {name: {"columns": df.schema.simpleString()[7:-1], "rows": [[x.hex() if isinstance(x, (bytes, bytearray)) else x for x in r] for r in df.collect()]} for name, df in (("features", self.features), ("prototypes", self.prototypes), ("langs", self.langs))}
        return base64.b64encode(bz2.compress(json.dumps(tables).encode())).decode()

    @classmethod
    def from_string(cls, spark: SparkSession, text: str) -> Model:
        tables = json.loads(bz2.decompress(base64.b64decode(text)))

        def table(name: str) -> DataFrame:
            columns = tables[name]["columns"]
            binary = [c.endswith(":binary") for c in columns.split(",")]
            rows = [tuple(bytes.fromhex(x) if b else x for x, b in zip(r, binary, strict=True)) for r in tables[name]["rows"]]
            return spark.createDataFrame(rows, columns)

        return cls(table("features"), table("prototypes"), table("langs"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in ("features", "prototypes", "langs")])

    def gram(self) -> DataFrame:
        """Inner products of all pairs of languages: small, and looked up for each combination, so kept in memory."""
        if self._gram is None:
            self._gram = gram(self.prototypes).repartition(1).persist()
        return self._gram

    def detector(self, topn: int = 5, max_order: int = 1) -> Detector:
        """The model as arrays, for tasks that detect row by row: features by languages numbers."""
        features = self.features.select("feature_id", "term", "ilf").orderBy("feature_id").collect()
        langs = [r.lang for r in self.langs.orderBy("lang_id").collect()]
        rows = self.prototypes.toArrow()
        weights = np.zeros((len(langs), len(features)))
        weights[rows.column("lang_id").to_numpy(), rows.column("feature_id").to_numpy()] = rows.column("w").to_numpy()
        return Detector([bytes(r.term) for r in features], np.array([r.ilf for r in features], dtype=float), weights, langs, topn, max_order)


def build_model(features: DataFrame, ftc: DataFrame, langs: DataFrame) -> Model:
    """features: feature_id, term. ftc: feature_id, lang_id, n. langs: lang_id, lang. Unused languages are left out and ids closed up."""
    used = langs.join(ftc.where(F.col("n") > 0).select("lang_id").distinct(), "lang_id", "left_semi")
    renumbered = used.select("lang_id", "lang", (F.row_number().over(Window.orderBy("lang_id")) - 1).alias("new"))
    own = ftc.join(F.broadcast(renumbered.select("lang_id", "new")), "lang_id").select("feature_id", F.col("new").alias("lang_id"), "n")
    weighted = inverse_language_frequency(features, own)
    return Model(weighted, prototypes(own, weighted), renumbered.select(F.col("new").alias("lang_id"), "lang"))
