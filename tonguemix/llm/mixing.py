"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a 60-bit hash. A source whose target is ``full + f`` times its size takes each
of its documents ``full`` times, and once more those whose hash lies under the source's threshold.
The threshold comes from nested histograms: words are summed by source and by the first 12 bits of
the hash, the bucket in which the running sum crosses the budget is the boundary, and only the
boundary bucket (about one document in 4,096) is summed again by the next 12 bits. Nothing is
sorted by document and nothing but sums by bucket is shuffled. Rows equal in id and text share a
hash; of those at the threshold as many are taken as the budget holds, by counts for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, stored

HASH_BITS, LEVEL_BITS = 60, 12
#: A word is a longest run of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 over id and text; rows that agree in both share a hash and so a decision."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(both), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """(source, source_size) -> the same with weight and target.

    Sources in code point order, null last, take the weights in turn. Targets are proportional to
    weight, stop at ``cap`` times the source's size, and the excess is shared again by weight: in
    the order of size by weight the capped sources come first, so running sums give the one level
    at which every other source is below its cap. One row per source; sizes of zero get zero.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    most = F.col("source_size") * F.lit(cap)
    by_ratio = Window.orderBy((most / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    return (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
        .withColumn("budget", F.sum("source_size").over(all_rows) * F.lit(share))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum(most).over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("fits", F.col("level") * F.col("weight") <= most)
        .withColumn("level", F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("place"))).over(all_rows))
        .withColumn("target", F.coalesce(F.least(most.cast("double"), F.col("level") * F.col("weight")), most.cast("double")))
        .select("source", "source_size", "weight", "target")
    )


def _boundary(rows: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """state: source, prefix (the boundary so far), rest (words still to take in it); one level deeper."""
    shift = HASH_BITS - LEVEL_BITS * level
    running = Window.partitionBy("source").orderBy("prefix")
    return (
        rows.groupBy("source", F.shiftright("hash", shift).alias("prefix"))
        .agg(F.sum("size").alias("held"), F.count("*").alias("twins"))
        .join(_small(state.select(F.col("source").alias("of"), "rest")), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("upto", F.sum("held").over(running))
        .where(F.col("upto") > F.col("rest"))
        .groupBy("source")
        .agg(F.min(F.struct("prefix", (F.col("rest") - (F.col("upto") - F.col("held"))).alias("rest"), "held", "twins")).alias("edge"))
        .select("source", "edge.*")
    )


def _small(df: DataFrame) -> DataFrame:
    """Broadcast, if a count shows it to be small; else Spark chooses the join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _inside(rows: DataFrame, state: DataFrame, level: int) -> DataFrame:
    shift = HASH_BITS - LEVEL_BITS * level
    edge = state.select(F.col("source").alias("of"), F.col("prefix").alias("edge"))
    return rows.join(edge, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("hash", shift) == F.col("edge")), "left_semi")


def mix_plan(docs: DataFrame, *, doc_id="doc_id", text="text", source="source", weights=(5, 2, 1), share=1.0, max_repeats=3) -> tuple[DataFrame, DataFrame]:
    """(sized, thresholds) for ``docs``.

    sized: one row for each row of docs, with doc_id, source, size (words) and hash. thresholds:
    one row for each source, with source_size, weight, target, full (whole passes), edge (hash
    threshold), twins (how many rows have the hash equal to edge) and part (how many of them are taken
    once more: as many as come nearest to the target). No row is taken more than max_repeats times: a
    source whose target is whole passes has no edge. A null text counts no words; null ids and null
    sources are values like any other; an empty table gives two empty tables.
    """
    sized = stored(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), document_hash(F.col(doc_id), F.col(text)).alias("hash")),
        "mix-sized",
    )
    first = stored(sized.groupBy("source", F.shiftright("hash", HASH_BITS - LEVEL_BITS).alias("prefix")).agg(F.sum("size").alias("held")), "mix-histogram")
    targets = stored(source_targets(first.groupBy("source").agg(F.sum("held").alias("source_size")), tuple(weights), share, max_repeats), "mix-targets")
    ratio = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    state = targets.select("source", (F.col("target") - ratio * F.col("source_size")).alias("rest")).where(F.col("rest") > 0)
    state = stored(_boundary(first.select("source", F.shiftleft("prefix", HASH_BITS - LEVEL_BITS).alias("hash"), F.col("held").alias("size")), state, 1), "mix-boundary")
    rows = stored(_inside(sized, _small(state), 1).select("source", "hash", "size"), "mix-inside")
    for level in range(2, HASH_BITS // LEVEL_BITS + 1):
        state = stored(_boundary(rows, state, level), "mix-boundary")
        rows = _inside(rows, _small(state), level)
    part = F.ceil(F.col("rest") / (F.col("held") / F.col("twins")) - 0.5).cast("long")
    edges = state.select(F.col("source").alias("of"), F.col("prefix").alias("edge"), "twins", part.alias("part"))
    thresholds = targets.withColumn("full", ratio).join(edges, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    return sized, stored(thresholds, "mix-thresholds")


def copies(hash_: Column) -> Column:
    """How often a document with this hash is taken; needs full, edge, twins and part of its source. Not for twins of which a part is taken."""
    whole = (hash_ < F.col("edge")) | ((hash_ == F.col("edge")) & (F.col("part") >= F.col("twins")))
    return F.col("full") + F.coalesce(whole, F.lit(False)).cast("long")


def _parted(hash_: Column) -> Column:
    """Whether a document is one of several of its hash of which a part is taken."""
    return F.coalesce((hash_ == F.col("edge")) & (F.col("part") > 0) & (F.col("part") < F.col("twins")), F.lit(False))


def _counted(twins: DataFrame, *kept: str) -> DataFrame:
    """Rows that are parted -> the columns kept, full, n (rows that are equal in them in one task) and more (how many of these are taken once more).

    The first part rows by task are taken. What meets is a row for each source and task, then rows are dealt out by task again.
    """
    by_task = twins.groupBy("of", "full", "part", F.spark_partition_id().alias("task"), *kept).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("of").orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    more = F.greatest(F.least(F.col("part") - before, F.col("n")), F.lit(0).cast("long"))
    return by_task.withColumn("more", more).repartition("of", "task")


def _has_parted(thresholds: DataFrame) -> bool:
    return thresholds.where((F.col("part") > 0) & (F.col("part") < F.col("twins"))).limit(1).count() > 0


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken (words, repeats counted), source, copies.

    Nulls, ties, repeated rows and empty tables are as in mix_plan(); a text of any length is counted whole.
    """
    sized, thresholds = mix_plan(docs, **options)
    joined = sized.join(_small(thresholds.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))
    columns = ["doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"]
    if not _has_parted(thresholds):
        return joined.withColumn("copies", copies(F.col("hash"))).select(columns)
    kept = ("doc_id", "size", "source_size", "target", "source")
    out = joined.where(~_parted(F.col("hash"))).withColumn("copies", copies(F.col("hash"))).select(columns)
    turns = _counted(joined.where(_parted(F.col("hash"))), *kept).withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.unionByName(turns.withColumn("copies", F.col("full") + (F.col("turn") <= F.col("more")).cast("long")).select(columns))


def apply_mix(docs: DataFrame, *, doc_id="doc_id", text="text", source="source", **options) -> DataFrame:
    """docs with its own columns alone, each row as often as the mix takes it, max_repeats times at most.

    Hash and copies are worked out again from the row, so texts are not shuffled, but for one copy for
    each task of a text at the threshold whose rows are taken in part; columns of docs may have any
    names. Nulls, ties, repeated rows and empty tables are as in mix_plan().
    """
    _, thresholds = mix_plan(docs, doc_id=doc_id, text=text, source=source, **options)
    mine = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(mine, F.col(source).alias("from"), document_hash(F.col(doc_id), F.col(text)).alias("hash"))
    joined = keyed.join(_small(thresholds.withColumnRenamed("source", "of")), F.col("from").eqNullSafe(F.col("of")))
    times = copies(F.col("hash"))
    if _has_parted(thresholds):
        parted = _counted(joined.where(_parted(F.col("hash"))), "row").select("row", F.explode(F.array_repeat(F.lit(0), (F.col("n") * F.col("full") + F.col("more")).cast("int"))))
        joined = joined.where(~_parted(F.col("hash")))
        repeated = joined.select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).unionByName(parted)
    else:
        repeated = joined.select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
    return repeated.select([F.col("row").getField(c).alias(c) for c in docs.columns])


SQL = """
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hash
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), p AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS budget,
         row_number() OVER (ORDER BY (3 * source_size)::DOUBLE / weight, source ASC NULLS LAST) AS place FROM w
), l AS (
  SELECT *, (budget - coalesce(sum(3 * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM p
), c AS (
  SELECT min_by(level, place) AS level FROM l WHERE level * weight <= 3 * source_size
), t AS (
  SELECT source, source_size, coalesce(least((3 * source_size)::DOUBLE, c.level * weight), (3 * source_size)::DOUBLE) AS target FROM l LEFT JOIN c ON true
), f AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS full_passes FROM t
), h AS (
  SELECT source, hash, sum(size)::BIGINT AS held, count(*) AS twins FROM d GROUP BY source, hash
), r AS (
  SELECT h.source, hash, held, twins, source_size, target, full_passes, target - full_passes * source_size AS rest,
         sum(held) OVER (PARTITION BY h.source ORDER BY hash) AS upto
  FROM h JOIN f ON h.source IS NOT DISTINCT FROM f.source
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source, hash) AS turn FROM d
), k AS (
  SELECT n.doc_id, n.size, r.source_size, r.target, n.source,
         (full_passes + CASE WHEN rest > 0 AND (upto <= rest OR upto - held <= rest AND turn <= ceil((rest - (upto - held)) / (held / twins) - 0.5)) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM n JOIN r ON n.source IS NOT DISTINCT FROM r.source AND n.hash = r.hash
)
SELECT doc_id, size, source_size, target, source, copies, (size * copies)::BIGINT AS taken FROM k
"""
