"""Writers: index files, features, weights, and results as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import CorpusIndex


def write_index(index: CorpusIndex, path: str) -> None:
    """paths, lang_index and domain_index below path, as CSV without headers; rows of the indexes in order of id."""
    index.items.select("domain_id", "lang_id", "path").write.mode("overwrite").csv(f"{path}/paths")
    index.lang_index.orderBy("lang_id").select("lang", "n_docs").coalesce(1).write.mode("overwrite").csv(f"{path}/lang_index")
    index.domain_index.orderBy("domain_id").select("domain", "n_docs").coalesce(1).write.mode("overwrite").csv(f"{path}/domain_index")


def write_features(terms: DataFrame, path: str) -> None:
    """Features as upper-case hexadecimal, one on a line, in order of their bytes."""
    terms.orderBy("term").select(F.hex("term")).coalesce(1).write.mode("overwrite").text(path)


def write_weights(weights: DataFrame, path: str) -> None:
    """key (binary), value (a number, or an array of numbers): largest value first; arrays in order of key."""
    many = weights.schema["value"].dataType.typeName() == "array"
    rows = weights.orderBy("key") if many else weights.orderBy(F.col("value").desc(), "key")
    cells = F.array_join(F.transform("value", lambda x: x.cast("string")), ",") if many else F.col("value").cast("string")
    rows.select(F.concat_ws(",", F.hex("key"), cells)).coalesce(1).write.mode("overwrite").text(path)


def json_lines(results: DataFrame, value: str) -> DataFrame:
    """path and value of each result as one JSON object: {"path": ..., value: {language: number}}."""
    return results.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("path"), F.col(value))).alias("value"))


def write_json_lines(results: DataFrame, value: str, path: str) -> None:
    json_lines(results, value).write.mode("overwrite").text(path)
