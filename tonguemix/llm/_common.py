"""What the training-data operators share: tables that every executor can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.folders import drop_tables, fresh_path
from ..plans.shipping import prepare

__all__ = ["BROADCAST_ROWS", "drop_tables", "fresh_path", "prepare", "stored", "table"]

#: Rows up to which a small table (sources, thresholds, histogram strata) is broadcast.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, *, few: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so lost executors cost no rerun.

    few is for tables of ids and links, which are small beside the texts: one file for each core of
    the cluster at most, not one for each partition of the shuffle before, most of which are tiny.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    out = df.coalesce(spark.sparkContext.defaultParallelism) if few else df
    out.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
