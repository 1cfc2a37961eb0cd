"""Readers: corpora as directories, lists of paths or tables, lines and whole texts, index files."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import utf8

log = logging.getLogger(__name__)


def _placed(files: DataFrame, path: Column) -> DataFrame:
    """doc_id (the path), domain, lang, path, data: names are the last directories of the path."""
    parts = F.split(path, "/")
    above = lambda n: F.coalesce(F.get(parts, F.size(parts) - n), F.lit(""))
    return files.select(path.alias("doc_id"), above(3).alias("domain"), above(2).alias("lang"), path.alias("path"), F.col("content").alias("data"))


def hidden_files(spark: SparkSession, root: str) -> list[str]:
    """The files below root that Spark's readers pass over: they, or a directory on their way, begin with a dot or an underscore."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(top, True)
    out, above = [], None
    while found.hasNext():
        path = found.next().getPath().toString()
        above = above if above is not None else path.index(top.toUri().getPath().rstrip("/")) + len(top.toUri().getPath().rstrip("/"))
        if any(part[:1] in ("_", ".") for part in path[above:].split("/")):
            out.append(path)
    return sorted(out)


def read_directory(spark: SparkSession, root: str) -> DataFrame:
    """Every file below root, at any depth: its directory is its language, the one above that its domain.

    Spark's readers pass over names that begin with a dot or an underscore; how many such files there
    are is told in a warning, and hidden_files() names them.
    """
    hidden = hidden_files(spark, root)
    if hidden:
        log.warning("%s files below %s have hidden names and are not read", len(hidden), root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return _placed(files, F.regexp_replace("path", "^file:", ""))


def read_path_list(spark: SparkSession, listing: str) -> DataFrame:
    """The files whose paths a text file lists, one on a line; blank lines name none."""
    listed = [r.path for r in spark.read.text(listing).select(F.trim("value").alias("path")).where("path <> ''").collect()]  # file names, as many as a reader is given
    if not listed:
        return spark.createDataFrame([], "doc_id string, domain string, lang string, path string, data binary")
    return _placed(spark.read.format("binaryFile").load(listed), F.regexp_replace("path", "^file:", ""))


def from_table(documents: DataFrame, *, doc_id="doc_id", text="text", lang="lang", domain="source") -> DataFrame:
    """doc_id, domain, lang, data of a table of labelled texts; a null text is empty."""
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(domain).alias("domain"), F.col(lang).alias("lang"), utf8(F.col(text)).alias("data"))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """doc_id (the path as it is given), data: a document from each file."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("doc_id"), F.col("content").alias("data"))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), data: one document from each file of text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), utf8(F.col("value")).alias("data"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (path and place of the line), data: one document from each line, its line feed included."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"), "value")
    return lines.select(F.concat_ws("#", "path", F.col("line").cast("string")).alias("doc_id"), utf8(F.concat("value", F.lit("\n"))).alias("data"))


def lines_of(documents: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, line (from 0), data: the lines of each text with their line feeds; the last may lack one."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "(?<=\n)")
    return documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.filter(parts, lambda x: x != "")).alias("line", "text")).select("doc_id", "line", utf8(F.col("text")).alias("data"))


PATHS, LANGS, DOMAINS = "domain_id int, lang_id int, path string", "lang string, n_docs bigint", "domain string, n_docs bigint"


def read_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An index file without header: paths, or names whose place is their id."""
    rows = spark.read.schema(schema).csv(path)
    if "path" in rows.columns:
        return rows
    name = rows.columns[0]
    in_order = rows.withColumn("__at", F.monotonically_increasing_id())
    return in_order.select((F.row_number().over(Window.orderBy("__at")) - 1).alias(f"{name}_id"), *rows.columns)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """term: features from a text of upper-case hexadecimal, one on a line."""
    return spark.read.text(path).where("value <> ''").select(F.unhex("value").alias("term"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """key, values: keys in hexadecimal with their weights; text that is no number counts as 0."""
    cells = F.split("value", ",")
    number = lambda x: F.coalesce(F.nanvl(x.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return spark.read.text(path).select(F.unhex(F.get(cells, F.lit(0))).alias("key"), F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), number).alias("values"))
