import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tonguemix.llm import warc
from tonguemix.llm._common import fresh_path

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(params=["64m", "1500b"])
def split_size(spark, request):
    """Splits far smaller than records too."""
    keys = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k in keys:
        spark.conf.unset(k)


def round_trip(spark, pages, files=2, **options):
    path = fresh_path(spark, "test-warc")
    warc.write_archives(warc.record_plan(pages, **options).coalesce(files), path)
    return warc.read_archives(spark, path), path


FAKE = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 666\r\nContent-Length: 5\r\n\r\nHTTP/\r\n\r\n"


def pages_of(spark, n=40):
    rows = [(i, f"http://x/{i}", f"<p>{'é𝔘x' * (i * 7 % 90)}{i % 11}</p>") for i in range(n)]
    rows += [(100, "http://x/WARC/1.1", FAKE * 3), (101, "http://y/\r\nWARC/1.1\r\n", "a" + FAKE + "b" * 3000 + FAKE), (102, "u", "WARC/1.1\r\n" * 40), (103, "v", FAKE[:-8] + "\r\n\r\n"), (104, None, None), (105, "w", ""), (106, "z", "end\r\n\r\n")]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_payloads_come_back_whole(spark, split_size):
    pages, rows = pages_of(spark)
    records, _ = round_trip(spark, pages)
    found = sorted((int(r.headers["x-page-id"]), bytes(r.payload)) for r in records.collect() if r.headers["warc-type"] == "response")
    first = {}
    for i, _, html in rows:
        first.setdefault(html or "", i)
    assert found == sorted((i, html.encode()) for html, i in first.items())


def test_splits_far_smaller_than_records(spark):
    rows = [(1, "http://x/WARC/1.1", "a" + FAKE + "b" * 500 + FAKE), (2, "u", FAKE * 2), (3, "v", "plain")]
    path = fresh_path(spark, "test-warc")
    warc.write_archives(warc.record_plan(spark.createDataFrame(rows, SCHEMA)).coalesce(1), path)
    keys = {"spark.sql.files.maxPartitionBytes": "173b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        found = {int(r.headers["x-page-id"]): r.payload.decode() for r in warc.read_archives(spark, path).collect()}
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert found == {i: html for i, _, html in rows}


def test_rows(spark, split_size):
    rows = [(3, "a", "same"), (1, "b", "same"), (1, "b", "same"), (1, "a", "same"), (None, "c", "same"), (None, None, "lone"), (None, None, "lone"), (7, None, None), (8, None, ""), (9, "long", "é" * 200000)]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit("clash")).withColumn("payload", F.lit(1))
    records, _ = round_trip(spark, pages)
    found = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_records(records).collect()), key=str)
    assert found == sorted([(3, 4, "revisit", 1), (1, 4, "revisit", 1), (1, 4, "revisit", 1), (1, 4, "response", None), (0, 4, "revisit", 1), (0, 4, "response", None), (0, 4, "revisit", None), (7, 0, "response", None), (8, 0, "revisit", 7), (9, 400000, "response", None)], key=str)
    for r in warc.page_records(records).where("page_id = 9").collect():
        assert r.payload_digest == base64.b32encode(hashlib.sha1(("é" * 200000).encode()).digest()).decode()
    empty, _ = round_trip(spark, pages.limit(0))
    assert empty.count() == 0
    few, _ = round_trip(spark, pages, least_bytes=5)
    assert {r.headers["warc-type"] for r in few.collect()} == {"response"}


def test_archives_that_others_wrote(spark, split_size, tmp_path):
    def record(kind, body):
        return b"WARC/1.1\r\nWARC-Type: " + kind + b"\r\nContent-Length:  %d \r\n\r\n" % len(body) + body + b"\r\n\r\n"

    fake = record(b"fake", b"x")
    bodies = [b"\xff\xfe\x00binary" * 30, b"\r\n\r\n" + fake * 5, b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n\r\n\r\n" + fake, b"", b"tail\r\n\r\n"] * 6
    good = b"".join(record(b"resource", b) for b in bodies)
    (tmp_path / "good.warc").write_bytes(good)
    (tmp_path / "torn.warc").write_bytes(good[: len(good) // 2])
    (tmp_path / "late.warc").write_bytes(b"noise\r\n\r\n" + good)
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = warc.read_archives(spark, f"file://{tmp_path}").collect()
    by_file = lambda name: [bytes(r.payload) for r in sorted(rows, key=lambda r: r.start) if r.path.endswith(name)]
    bare = [b.partition(b"\r\n\r\n")[2] if b"\r\n\r\n" in b else b for b in bodies]
    assert by_file("good.warc") == bare and by_file("late.warc") == [] and by_file("empty.warc") == []
    torn = by_file("torn.warc")
    assert torn == bare[: len(torn)] and len(torn) >= 10


def foreign(version, fields, body):
    return version + b"\r\nWARC-Type: resource\r\n" + fields + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


@pytest.mark.parametrize("size", [53, 97, 173, 311, 4096])
def test_headers_with_version_lines_over_any_split(spark, tmp_path, size):
    """WARC/1.0 and 1.1 in one file; headers hold version lines, which splits of many sizes cut in many places."""
    notes = [b"", b"Software: reads WARC/1.0 and WARC/1.1\r\n", b"X: " + b"WARC/1.1 " * 40 + b"\r\n"]
    bodies = [b"plain %d" % i + b" WARC/1.0\r\nContent-Length: 3\r\n\r\nabc" * (i % 3) for i in range(12)]
    (tmp_path / "a.warc").write_bytes(b"".join(foreign((b"WARC/1.0", b"WARC/1.1")[i % 2], notes[i % 3], b) for i, b in enumerate(bodies)))
    (tmp_path / "b.warc").write_bytes(foreign(b"WARC/1.2", b"", b"unknown version"))
    keys = {"spark.sql.files.maxPartitionBytes": f"{size}b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        rows = sorted(warc.read_archives(spark, f"file://{tmp_path}").collect(), key=lambda r: r.start)
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert [bytes(r.payload) for r in rows] == [b.partition(b"\r\n\r\n")[2] or b for b in bodies] and rows[1].headers["software"] == "reads WARC/1.0 and WARC/1.1"


def test_payloads_are_joined_without_a_shuffle(spark, monkeypatch, split_size):
    """Entries are broadcast whatever the session's threshold, in several passes where they are many."""
    monkeypatch.setattr(warc, "ENTRY_ROWS", 2)
    pages, rows = pages_of(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        path = fresh_path(spark, "test-warc")
        warc.write_archives(warc.record_plan(pages).coalesce(5), path)
        records = warc.read_archives(spark, path)
        found = sorted(int(r.headers["x-page-id"]) for r in records.collect())
        plan = records._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == sorted(i for i, *_ in rows)
    if split_size == "64m":  # no record reaches over a split
        assert "hashpartitioning" not in plan and "Sort" not in plan and "BroadcastHashJoin" in plan
