"""Folders that every executor can reach, for tables and files between two steps of a query."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

_folders: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own, but only if all of Spark runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "checkpoints")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path for a table of this application, whose tables go with drop_tables() or at the end of the driver."""
    folder = _application_folder(spark)
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_at_exit, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def drop_tables(spark: SparkSession) -> None:
    """Removes the intermediate tables of this application; results that were not written or gathered are gone too."""
    _remove(spark, _application_folder(spark))


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _at_exit(spark: SparkSession, folder: str) -> None:
    with suppress(Py4JError, OSError, AttributeError):  # the session or its JVM may be gone
        _remove(spark, folder)
