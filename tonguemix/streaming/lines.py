"""Detection line by line on a stream.

Rows are independent, so the stream keeps no state and appends a result for each line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import utf8
from ..operators.detect import Detector, detect
from ..sources.sinks import json_lines


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the line itself), data (with its line feed): lines of the text files that arrive in folder."""
    return spark.readStream.text(folder).select(F.col("value").alias("doc_id"), utf8(F.concat("value", F.lit("\n"))).alias("data"))


def detect_stream(lines: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, langs, score, has_features for each line."""
    return detect(lines, detector)


def start(lines: DataFrame, detector: Detector, out: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Writes JSON lines below out; with once, what is there now and no more."""
    writer = json_lines(detect_stream(lines, detector), "langs").writeStream.outputMode("append").format("text").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(out)
