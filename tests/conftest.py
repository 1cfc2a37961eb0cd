import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return bytes(value) if isinstance(value, (bytes, bytearray)) else value


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Whether a query and its SQL give the same columns and rows on the tables of a folder, the smallest if none is given."""

    def same(query, sql, folder=SF):
        db = duckdb.connect()
        for name in os.listdir(folder):
            files = f"{folder}/{name}/*.parquet" if os.path.isdir(f"{folder}/{name}") else f"{folder}/{name}"
            db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{files}')")
        df = query(spark, folder)
        columns = sorted(df.columns)
        result = db.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        want = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
        got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        assert got == want

    return same
