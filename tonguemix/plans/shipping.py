"""Sending this package to the executors of a cluster, and how much goes to their Python at a time."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of rows that go to Python at a time: texts and signatures are large, and a worker holds a batch several times over.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Once for each context: the Python of executors need not have the package installed."""
    context, package = spark.sparkContext, Path(__file__).parent.parent
    if any(f"/{package.name}-" in name for name in context.listFiles):
        return
    folder = os.path.realpath(tempfile.mkdtemp())  # the driver serves the file from here as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}-{uuid.uuid4().hex}", "zip", package.parent, package.name))


def prepare(spark: SparkSession) -> None:
    """Sends the package to the executors, and keeps batches for Python small, unless the session has them smaller."""
    ship_package(spark)
    most = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_SETTING))
    if not 0 < most <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
