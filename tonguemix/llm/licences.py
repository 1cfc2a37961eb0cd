"""Licence scans by canonical digests.

Texts that differ in case, punctuation, line breaks, copyright lines or spelling become one
canonical string, whose SHA-256 is looked up among the digests of known licences: the whole text by
a hash join, and each of its lines, which may be a notice of one line, in the same way from an array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_texts import DIGESTS, LEADS, NAMES, RESERVED, TEXTS, TITLES

#: Spellings of words and names that count as equal, after case and punctuation are gone. They are replaced in this order, as whole words.
EQUAL = (
    ("copyright copyright", "copyright"), ("licence", "license"), ("licences", "licenses"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"),
    ("cancelled", "canceled"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("copyright owner", "copyright holder"), ("emphasised", "emphasized"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)
#: Lines that name a holder or a licence and are no part of a text, and lines of prose that begin like them.
ASIDE = "^(portions )?copyrights?( |$)|^all rights reserved|^spdx (license|file|copyright)"
PROSE = "^(portions )?copyrights? (notices?|holders?|laws?|licenses?|and|or|in|on|is|are|to|of|a|an|under|as|statements?|interests?|disclaimers?|treaty|protection|permission|status|for|if|that|this|the software|the program|the work|ownership|rights?|may|claim|with)( |$)"


def canonical_lines(text: Column) -> Column:
    """Lines in lower case, of letters and digits parted by single spaces, in equal spellings; none is empty."""
    marked = F.replace(F.replace(F.lower(text), F.lit("(c)"), F.lit("copyright")), F.lit("©"), F.lit("copyright"))
    flat = F.replace(F.regexp_replace(marked, r"[^\p{L}\p{N}\n]+", " "), F.lit("\n"), F.lit(" \n "))
    padded = F.replace(F.concat(F.lit(" "), flat, F.lit(" ")), F.lit("  "), F.lit(" "))
    # One search for all spellings first: most texts hold none.
    respelled = lambda t: reduce(lambda x, pair: F.replace(x, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), EQUAL, t)
    spelled = F.get(F.transform(F.array(padded), lambda t: F.when(t.rlike(f" ({'|'.join(a for a, _ in EQUAL)}) "), respelled(t)).otherwise(t)), F.lit(0))
    return F.filter(F.transform(F.split(spelled, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def canonical_text(lines: Column) -> Column:
    """One string of all lines but those that only name a holder or a licence."""
    return F.array_join(F.filter(lines, lambda line: ~line.rlike(ASIDE) | line.rlike(PROSE)), " ")


def notices() -> list[tuple[str, str]]:
    """(identifier, line): every lead-in with every name; built by rule."""
    return [(k, f"{lead} {name}") for k, names in NAMES.items() for name in names for lead in LEADS] + [(k, x) for k, lines in RESERVED.items() for x in lines]


def whole_texts() -> list[tuple[str, str]]:
    return [(k, f"{title}\n{text}") for k, text in TEXTS.items() for title in ("", *TITLES.get(k, ()))]


def known_digests(spark: SparkSession) -> DataFrame:
    """license, digest, whole: one row for each known text, as many as the lists above make."""
    rows = [(k, t, True) for k, t in whole_texts()] + [(k, t, False) for k, t in notices()]
    literal = F.explode(F.array(*[F.struct(F.lit(k).alias("license"), F.lit(t).alias("text"), F.lit(w).alias("whole")) for k, t, w in rows]))
    listed = spark.range(1).select(literal.alias("k")).select("k.*")
    lines = canonical_lines(F.col("text"))
    digest = F.sha2(F.when(F.col("whole"), canonical_text(lines)).otherwise(F.array_join(lines, " ")), 256)
    longer = F.explode(F.array(*[F.struct(F.lit(k).alias("license"), F.lit(d).alias("digest"), F.lit(True).alias("whole")) for k, ds in DIGESTS.items() for d in ds]))
    given = spark.range(1).select(longer.alias("k")).select("k.*")
    return listed.select("license", digest.alias("digest"), "whole").unionByName(given).distinct()


def scan_licences(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, text_digest, license, notices: one row for each row of docs.

    license is the known licence that the whole text is, else null; notices are the identifiers, in
    order, once each, comma-joined, of lines that are known notices. A null or empty text has the
    digest of nothing and neither; null ids and repeated rows pass through; an empty table gives no
    rows. Texts of any length are digested whole and not shuffled.
    """
    known = known_digests(docs.sparkSession)
    wholes = known.where("whole").groupBy("digest").agg(F.min("license").alias("license"))
    lines = {r.digest: r.license for r in known.where("NOT whole").groupBy("digest").agg(F.min("license").alias("license")).collect()}
    by_digest = F.create_map(*[F.lit(x) for pair in sorted(lines.items()) for x in pair])
    chosen = docs.select(F.col(doc_id).alias("doc_id"), canonical_lines(F.coalesce(F.col(text), F.lit(""))).alias("lines"))
    longest = max(len(line) for _, line in notices()) + 16  # a longer line is no notice, whatever its digest
    found = F.transform(F.filter("lines", lambda line: F.length(line) <= longest), lambda line: F.element_at(by_digest, F.sha2(line, 256)))
    units = chosen.select("doc_id", F.sha2(canonical_text(F.col("lines")), 256).alias("text_digest"), F.array_join(F.array_sort(F.array_distinct(F.array_compact(found))), ",").alias("notices"))
    return units.join(F.broadcast(wholes), F.col("text_digest") == F.col("digest"), "left").select("doc_id", "text_digest", "license", "notices")


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    padded = r"replace(' ' || replace(regexp_replace(replace(replace(lower(text), '(c)', 'copyright'), '©', 'copyright'), '[^\p{L}\p{N}\n]+', ' ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' ', '  ', ' ')"
    spelled = reduce(lambda t, pair: f"replace({t}, ' {pair[0]} ', ' {pair[1]} ')", EQUAL, padded)
    lines = f"list_filter(list_transform(string_split({spelled}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"
    whole = f"sha256(array_to_string(list_filter(lines, lambda x: NOT regexp_matches(x, '{ASIDE}') OR regexp_matches(x, '{PROSE}')), ' '))"
    values = ", ".join(f"({quoted(k)}, {quoted(t)}, {w})" for w, rows in (("true", whole_texts()), ("false", notices())) for k, t in rows)
    given = ", ".join(f"({quoted(k)}, {quoted(x)})" for k, xs in DIGESTS.items() for x in xs)
    return rf"""
WITH known AS (
  SELECT k, whole, {lines} AS lines FROM (VALUES {values}) AS v(k, text, whole)
), wholes AS (
  SELECT digest, min(k) AS license FROM (SELECT k, {whole} AS digest FROM known WHERE whole UNION ALL SELECT k, digest FROM (VALUES {given}) AS g(k, digest)) GROUP BY 1
), notice AS (
  SELECT array_to_string(lines, ' ') AS line, min(k) AS license FROM known WHERE NOT whole GROUP BY 1
), d AS (
  SELECT row_number() OVER () AS row, doc_id, {lines} AS lines FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
), n AS (
  SELECT row, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT row, unnest(lines) AS line FROM d) u JOIN notice USING (line) GROUP BY row
), t AS (
  SELECT row, doc_id, {whole} AS text_digest FROM d
)
SELECT doc_id, text_digest, license, coalesce(notices, '') AS notices
FROM t LEFT JOIN wholes ON text_digest = digest LEFT JOIN n USING (row)
"""


SQL = _sql()
