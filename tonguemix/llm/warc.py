"""WARC archives: records written from pages, and read back along verified record boundaries.

Writing stays in Spark's own writer: a record is a string, and records follow one another in a file.

Reading splits files at every place where a version line begins, in payloads too, so a task can
begin anywhere. Each task emits, for its candidates, where the record would end and the next would
begin, and follows these links to the end of its split. The links from split to split are then
followed from the start of each file by pointer jumping, which doubles its stride every round. What
is reached are the records; a version line inside a payload begins a candidate that no chain from
the start of the file reaches. Payloads are not shuffled: where the chain enters each split is a
small table that is broadcast, for as many files at a time as its bound allows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import prepare, stored

#: Fixed values of the format.
MAGIC, VERSIONS, BLANK = "WARC/1.", ("0\r\n", "1\r\n"), "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32, BASE32HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
DATE = "2024-01-01T00:00:00Z"
#: Bytes that a record's header may have at most, and splits whose entries are broadcast at a time: some 30 MB.
HEADER, ENTRY_ROWS = 1 << 20, 200_000


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: each 5 hex digits are 4 digits of base 32, in another alphabet."""
    hex_ = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hex_, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), BASE32HEX, BASE32)


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    at = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", at(1, 8), at(9, 4), at(13, 4), at(17, 4), at(21, 12)), F.lit(">"))


def record_plan(pages: DataFrame, *, page_id="page_id", url="url", html="html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, type, refers_to: what is to be written for each row of pages.

    Of the rows whose payloads are equal and have least_bytes or more, the first is a response and
    the others revisit it: the one with the smallest page_id, nulls last, then the smallest url. A
    null html is an empty payload. Only digests and ids are gathered; payloads stay where they are,
    but for rows that repeat both the payload and the id of their response.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    keyed = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("digest"))
    counts = keyed.where(F.col("payload_bytes") >= least_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("times"))
    best = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "times")).alias("best")
    firsts = counts.groupBy("digest").agg(F.sum("times").alias("n"), best).where(F.col("n") > 1)
    firsts = stored(firsts.select(F.col("digest").alias("of"), F.col("best.page_id").alias("first"), "best.times"), "warc-firsts")
    joined = keyed.join(firsts, F.col("digest") == F.col("of"), "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first"))
    twin = F.coalesce(F.col("of").isNotNull() & is_first & (F.col("times") > 1), F.lit(False))
    planned = joined.where(~twin).withColumn("response", F.col("of").isNull() | is_first)
    if firsts.where(F.col("times") > 1).limit(1).count():
        turn = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url"))
        planned = planned.unionByName(joined.where(twin).withColumn("response", turn == 1))
    kind = F.when(F.col("response"), "response").otherwise("revisit")
    return planned.select("page_id", "url", "payload", "payload_bytes", "digest", kind.alias("type"), F.when(~F.col("response"), F.col("first")).alias("refers_to"))


def write_archives(plan: DataFrame, path: str) -> None:
    """A record for each row of record_plan(), in files below path: text files, whose line end is the record's own.

    A response holds an HTTP header and the payload; a revisit the HTTP header alone, whose length is
    the whole payload's. Ids of pages stand in headers of their own; null ids and urls have none. In
    urls line ends, and what could make a version line, are percent-encoded, so headers hold neither.
    """
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    response = F.col("type") == "response"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(BLANK))
    block = F.when(response, F.concat(http, F.col("payload"))).otherwise(http)
    uri = F.replace(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("WARC/"), F.lit("WARC%2F"))
    own = _record_id(F.col("page_id"), F.col("digest"))
    head = F.concat(
        F.lit(MAGIC + VERSIONS[-1] + "WARC-Type: "), F.col("type"), F.lit("\r\n"),
        line("WARC-Record-ID", F.when(response, own).otherwise(_record_id(F.col("page_id"), F.col("digest"), F.col("type"), F.col("url")))),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(~response, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(~response, _record_id(F.col("refers_to"), F.col("digest")))),
        line("X-Page-ID", F.col("page_id").cast("string")),
        line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(BLANK),
    )
    plan.select(F.concat(head, block, F.lit(BLANK[:-1])).alias("value")).write.option("lineSep", BLANK[-1]).text(path)


_MAGIC, _VERSIONS, _BLANK = MAGIC.encode(), tuple(v.encode() for v in VERSIONS), BLANK.encode()
_LENGTH = re.compile(rb"^content-length:[ \t]*([0-9]+)[ \t]*\r?$", re.I | re.M)


def _block(record: bytes) -> tuple[int, int] | None:
    """Where the block of what follows MAGIC begins and how long it says it is; none if that is no header."""
    end = record.find(_BLANK, 0, HEADER + len(_BLANK)) if record.startswith(_VERSIONS) else -1
    found = end >= 0 and _LENGTH.search(record, 0, end + 2)
    return (end + 4, int(found[1])) if found else None


def _segments(archives: DataFrame) -> DataFrame:
    """path, at (of the split), bytes: what lies between version lines, in the order of the scan."""
    return archives.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("bytes"))


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, at, bytes -> for each split its length, and starts and successors of its candidates from its own start.

    A candidate's version line follows a blank line, as far as the split can tell. A header in which
    MAGIC stands goes on in the next segment; if that is of the next split, the candidate is "open", and
    "held" is its header so far. "lead" is what a header that comes from the split before needs of this
    one: what lies before its first blank line, HEADER bytes at most; "ended" is whether it is not all of it.
    """
    split, place, starts, after, tail, held, lead, ended = None, 0, [], [], b"", b"", None, False

    def row() -> pa.RecordBatch:
        known = [i for i, x in enumerate(after) if x is not None]
        is_open = bool(starts) and after[-1] is None and _BLANK not in held and len(held) < HEADER
        return pa.RecordBatch.from_pydict(
            {
                "path": [split[0]], "at": [split[1]], "length": [place], "starts": [[starts[i] for i in known]], "successors": [[after[i] for i in known]],
                "open": [starts[-1] if is_open else None], "held": [held if is_open else None], "lead": [lead or b""], "ended": [ended],
            },
            schema=_SPLITS,
        )

    for path, at, data in _rows(batches, "path", "at", "bytes"):
        if (path, at) != split:
            if split:
                yield row()
            split, place, starts, after, tail, held, lead, ended = (path, at), 0, [], [], _BLANK, b"", None, False
        if not ended:
            lead = data if lead is None else lead + _MAGIC + data
            stop = lead.find(_BLANK)
            stop = len(lead) if stop < 0 else stop + len(_BLANK)
            ended = stop < len(lead) or lead.endswith(_BLANK) or stop > HEADER
            lead = lead[: min(stop, HEADER)]
        if place or at:
            if tail == _BLANK:
                starts.append(place - len(_MAGIC))
                after.append(None)
                held = data
            elif starts and after[-1] is None and len(held) < HEADER:
                held += _MAGIC + data
            if starts and after[-1] is None and (found := _block(held)):
                after[-1] = starts[-1] + len(_MAGIC) + sum(found) + len(_BLANK)
            tail = data[-4:]
        else:
            tail = _BLANK if not data else b""  # a file begins with a record or has none
        place += len(data) + len(_MAGIC)
    if split:
        yield row()


_LONGS = pa.list_(pa.int64())
_SPLITS = pa.schema([("path", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("starts", _LONGS), ("successors", _LONGS), ("open", pa.int64()), ("held", pa.binary()), ("lead", pa.binary()), ("ended", pa.bool_())])
_SPLITS_DDL = "path string, at bigint, length bigint, starts array<bigint>, successors array<bigint>, open bigint, held binary, lead binary, ended boolean"


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Splits of a file from its last to its first -> start and successor of the open candidates whose headers go on as they should."""
    file, rest = None, b""
    for path, at, start, held, lead, ended in _rows(batches, "path", "at", "open", "held", "lead", "ended"):
        if path != file:
            file, rest = path, None
        found = start is not None and rest is not None and _block(held + _MAGIC + rest)
        if found:
            yield pa.RecordBatch.from_pydict({"path": [path], "at": [at], "start": pa.array([start], pa.int64()), "successor": pa.array([start + len(_MAGIC) + sum(found) + len(_BLANK)], pa.int64())})
        rest = lead if ended or rest is None else (lead + _MAGIC + rest)[:HEADER]


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each candidate of a split where its chain leaves the split; none if it breaks off within it."""
    for path, at, base, length, starts, successors in _rows(batches, "path", "at", "base", "length", "starts", "successors"):
        out: dict[int, int | None] = {}
        for start, to in zip(reversed(starts), reversed(successors), strict=True):
            out[start] = to if to >= length - len(_MAGIC) else out.get(to)
        kept = [(s, e) for s, e in out.items() if e is not None]
        yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(kept), pa.string()), "at": pa.array([at] * len(kept), pa.int64()), "start": pa.array([base + s for s, _ in kept], pa.int64()), "next": pa.array([base + e for _, e in kept], pa.int64())})


def _entries(nodes: DataFrame) -> DataFrame:
    """path, at, entry, next: where the chain from the start of each file enters each split; by pointer jumping.

    Stored candidates are far smaller on disk than as rows, so Spark is kept from broadcasting them.
    """
    reached = stored(nodes.where(F.col("start") == 0).select("path", "start"), "warc-reached")
    nodes = nodes.hint("merge")
    stride = nodes.select("path", "start", "next")
    n = reached.count()
    while True:
        ahead = reached.join(stride, ["path", "start"]).join(nodes.select("path", F.col("start").alias("next")), ["path", "next"], "left_semi")
        reached = stored(reached.unionByName(ahead.select("path", F.col("next").alias("start"))).distinct(), "warc-reached")
        last, n = n, reached.count()
        if n == last:
            return reached.join(nodes, ["path", "start"]).select("path", "at", F.col("start").alias("entry"), "next")
        far = stride.select("path", F.col("start").alias("next"), F.col("next").alias("far"))
        stride = stored(stride.join(far, ["path", "next"]).select("path", "start", F.col("far").alias("next")), "warc-stride").hint("merge")


_PARTS = "path string, upto bigint, start bigint, head boolean, bytes binary"


def _assembled(wanted: bool):
    """Segments of splits, in order -> whole records (wanted) or the parts of those that leave their split.

    Parts of one record have the same upto, where it ends: for its beginning that is where the chain
    leaves the split, for the others where it next enters one.
    """
    schema = pa.schema([("path", pa.string()), ("upto", pa.int64()), ("start", pa.int64()), ("head", pa.bool_()), ("bytes", pa.binary())])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, place, expected, begun, held, leaves, out, size = None, 0, None, None, b"", None, [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        def left_over() -> None:
            if begun is not None and not wanted and leaves is not None:
                out.append((split[0], leaves, begun, True, held))

        for path, at, base, entry, next_, until, data in _rows(batches, "path", "at", "base", "entry", "next", "until", "bytes"):
            if (path, at) != split:
                left_over()
                split, place, expected, begun, held, leaves = (path, at), 0, entry, None, b"", next_
            start = base + place - len(_MAGIC)
            place += len(data) + len(_MAGIC)
            if begun is not None:
                held += _MAGIC + data
            elif start == expected:
                begun, held = start, data
            else:  # before the first record of the split
                if not wanted and (at or start >= 0):
                    out.append((path, until, start, False, _MAGIC + data))
                continue
            found = _block(held)
            if found and len(held) >= sum(found):
                expected = begun + len(_MAGIC) + sum(found) + len(_BLANK)
                if wanted:
                    out.append((path, expected, begun, True, held[: sum(found)]))
                    size += len(held)
                begun, held = None, b""
            if size > 1 << 22 or len(out) >= 4096:
                yield batch()
                out, size = [], 0
        left_over()
        if out:
            yield batch()

    return assemble


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        headers, http, payloads, kept = [], [], [], []
        for i, data in enumerate(batch.column("bytes").to_pylist()):
            begin, size = _block(data) or (0, len(data) + 1)
            if len(data) < begin + size:  # the file ends within it
                continue
            kept.append(i)
            headers.append(_named(data[: begin - 4]))
            head, blank, payload = data[begin : begin + size].partition(_BLANK)
            http.append(_named(head.partition(b"\r\n")[2]) if blank else [])
            payloads.append(payload if blank else head)
        pairs = pa.map_(pa.string(), pa.string())
        batch = batch.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("start"), pa.array(headers, pairs), pa.array(http, pairs), pa.array(payloads, pa.binary())], ["path", "start", "headers", "http", "payload"])


def _named(lines: bytes) -> list[tuple[str, str]]:
    """Header lines by lower-case name; of a name that is repeated the last counts."""
    fields = (x.partition(b":") for x in lines.split(b"\r\n") if b":" in x)
    return list({k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in fields}.items())


def _placed(archives: DataFrame, entries: DataFrame) -> DataFrame:
    """Segments in the order of the scan, with the entries of their splits; these are broadcast, ENTRY_ROWS splits at a time at most.

    Several passes read different files each: which, is told by the file's name alone, before it is opened.
    """
    passes = max(1, -(-entries.count() // ENTRY_ROWS))
    turn = lambda path: F.pmod(F.xxhash64(path), F.lit(passes))
    out = None
    for i in range(passes):
        own, held = _segments(archives), entries
        if passes > 1:
            own, held = _segments(archives.where(turn(F.col("_metadata.file_path")) == i)), entries.where(turn(F.col("path")) == i)
        part = own.join(F.broadcast(held), ["path", "at"])
        out = part if out is None else out.unionByName(part)
    return out.select("path", "at", "base", "entry", "next", "until", "torn", "bytes")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """path, start, headers, http (maps by lower-case name), payload: the records of the files below path, of WARC/1.0 and 1.1.

    Files are read from their start: one that does not begin with a record has none, and one that
    breaks off, or whose lengths are wrong, has those up to there. An empty folder has no records, and
    equal records are rows of their own. Headers have HEADER bytes at most; payloads may have any
    length, and be empty. Payloads are read twice and shuffled never, but for records that reach over a
    split and hold a version line themselves: their parts meet by record.
    """
    prepare(spark)
    archives = spark.read.option("lineSep", MAGIC).text(path)
    splits = stored(_segments(archives).select("path", "at", "bytes").mapInArrow(_candidates, _SPLITS_DDL), "warc-splits")
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(splits.select("path", "at", "length").withColumn("base", F.coalesce(F.sum("length").over(before), F.lit(0))), "warc-bases", few=True)
    chained = splits.hint("merge").join(bases.select("path", "at", "base"), ["path", "at"])
    if splits.where(F.col("open").isNotNull()).limit(1).count():
        backwards = splits.select("path", "at", "open", "held", "lead", "ended").repartition("path").sortWithinPartitions("path", F.col("at").desc())
        closed = backwards.mapInArrow(_closed, "path string, at bigint, start bigint, successor bigint")
        more = lambda list_, one: F.when(F.col("start").isNull(), F.col(list_)).otherwise(F.concat(list_, F.array(one))).alias(list_)
        chained = chained.join(closed, ["path", "at"], "left").select("path", "at", "base", "length", more("starts", "start"), more("successors", "successor"))
    nodes = stored(chained.select("path", "at", "base", "length", "starts", "successors").mapInArrow(_exits, "path string, at bigint, start bigint, next bigint"), "warc-nodes", few=True)
    entries = bases.join(_entries(nodes), ["path", "at"], "left")
    end = F.col("base") + F.col("length") - len(MAGIC)
    after = Window.partitionBy("path").orderBy("at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("path")
    until = F.coalesce(F.first("entry", ignorenulls=True).over(after), F.max(end).over(whole))
    torn = F.coalesce(F.max(F.col("next") > end).over(whole), F.lit(False))
    entries = stored(entries.select("path", "at", "base", "entry", "next", until.alias("until"), torn.alias("torn")), "warc-entries", few=True)
    placed = _placed(archives, entries)
    records = placed.mapInArrow(_assembled(True), _PARTS).select("path", "start", "bytes")
    if entries.where("torn").limit(1).count():
        parts = placed.where("torn").mapInArrow(_assembled(False), _PARTS)
        joined = F.aggregate(F.array_sort(F.collect_list(F.struct("start", "bytes"))), F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["bytes"]))
        met = parts.groupBy("path", "upto").agg(F.min(F.when(F.col("head"), F.col("start"))).alias("start"), joined.alias("bytes"))
        records = records.unionByName(met.where(F.col("start").isNotNull()).select("path", "start", "bytes"))
    return records.mapInArrow(_parsed, "path string, start bigint, headers map<string,string>, http map<string,string>, payload binary")


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: of a response worked out from its payload, of a revisit as it is written."""
    is_response = F.col("headers")["warc-type"] == "response"
    return records.select(
        F.col("headers")["x-page-id"].cast("long").alias("page_id"),
        F.when(is_response, F.octet_length("payload").cast("long")).otherwise(F.col("http")["content-length"].cast("long")).alias("payload_bytes"),
        F.when(is_response, base32_sha1(F.col("payload"))).otherwise(F.substring_index(F.col("headers")["warc-payload-digest"], ":", -1)).alias("payload_digest"),
        F.col("headers")["warc-type"].alias("record_type"),
        F.col("headers")["x-refers-to-page-id"].cast("long").alias("refers_to"),
    )


SQL = """
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
         row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS FIRST) AS turn, min(page_id) OVER (PARTITION BY h) AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN turn = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN turn > 1 THEN first END AS refers_to FROM d
"""
