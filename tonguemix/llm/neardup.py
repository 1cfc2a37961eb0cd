"""Near-duplicates: DartMinHash signatures, a banded join, and exact similarity where it is close.

1. Equal texts become one node (the MD5 of the text), so copies cost nothing further.
2. Nodes that agree in a band of their signatures share a bucket. Every member is compared with the
   bucket's first node only, so a bucket of any size makes as many pairs as it has members. A pair is
   refused or accepted by the agreement of its signatures if that is far from the threshold, and else
   by the exact similarity of its texts.
3. Links found so far are joined into components. A bucket whose members are all in one component is
   done. Of the others every pair of different components is still compared, in tiles of bounded
   size: first by signatures, which leaves the few texts that may have a link, then exactly. Tiles
   give links between components, never the pairs of a group, and no pair that shares a bucket is
   left out. A bucket with very many pairs of this kind is first dealt anew by further coordinates of
   the signatures, so that only members that agree in more meet, and none that may be similar is parted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dartminhash as dart
from ._common import prepare, stored
from .components import connected_components

SIMILARITY = 0.8
#: Shares of equal coordinates, 4 standard deviations (0.041 at 0.8) from the threshold, beyond which no text is read.
REFUSED, ACCEPTED = 0.62, 0.96
#: Rows of one side of a tile, and pairs of rows from which a bucket is dealt anew.
SIDE, HOT = 256, 1 << 22
#: Pairs of coordinates, groups of them, and each two pairs of a group (see _finer_buckets).
PAIRS = dart.COORDINATES // 2
GROUPS = PAIRS - (dart.COORDINATES - math.ceil(REFUSED * dart.COORDINATES)) - 1
TWO_PAIRS = [two for g in range(GROUPS) for two in combinations(range(g, PAIRS, GROUPS), 2)]


def _node(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        start = 0
        while start < len(texts):
            sets, held, end = [], 0, start
            while end < len(texts) and held < dart.TOGETHER:
                sets.append(dart.shingles(texts[end]))
                held += len(sets[-1][0])
                end += 1
            packed = dart.packed(dart.signatures(sets))
            rows = [packed[i].tobytes() if len(s) else None for i, (s, _) in enumerate(sets)]
            part = batch.slice(start, end - start)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), pa.array(rows, pa.binary())], ["doc_id", "node", "signature"])
            start = end


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), -1)


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        share = (_matrix(batch.column("left")) == _matrix(batch.column("right"))).mean(axis=1) if len(batch) else []
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share, pa.float64())], ["a", "b", "share"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows, which come sorted by tile, tile by tile; a tile is bounded, so it is held whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        tiles = batch.column("tile").to_pylist()
        cuts = [0, *(i for i in range(1, len(tiles)) if tiles[i] != tiles[i - 1]), len(tiles)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if held and held[-1].column("tile")[0].as_py() != tiles[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(tile: pa.Table) -> Iterator[tuple[int, int]]:
    """Rows of one side with rows of the other that are of another component and, if there are signatures, may be similar; side 2: all with all."""
    signatures = _matrix(tile.column("signature")) if "signature" in tile.column_names else None
    side, component = np.array(tile.column("side").to_pylist()), np.array(tile.column("component").to_pylist(), object)
    lefts, rights = (np.flatnonzero(side == 2),) * 2 if (side == 2).all() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for i in lefts:
        others = rights[rights > i] if side[i] == 2 else rights
        others = others[component[others] != component[i]]
        if signatures is not None:
            others = others[(signatures[others] == signatures[i]).mean(axis=1) >= REFUSED]
        for j in others:
            yield int(i), int(j)


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each tile that may be similar to one of another component."""
    for tile in _tiles(batches):
        rows = sorted({x for pair in _pairs(tile) for x in pair})
        if rows:
            yield from tile.take(rows).combine_chunks().to_batches()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components that a tile's texts show, each that is new within the tile."""
    for tile in _tiles(batches):
        component, texts = tile.column("component").to_pylist(), tile.column("text").to_pylist()
        sets: dict[int, tuple] = {}
        root: dict[bytes, bytes] = {}

        def find(x: bytes, root=root) -> bytes:
            while x in root:
                x = root[x]
            return x

        found = []
        for i, j in _pairs(tile):
            a, b = find(component[i]), find(component[j])
            if a == b:
                continue
            for x in (i, j):
                if x not in sets:
                    sets[x] = dart.shingles(texts[x])
            if dart.similarity(sets[i], sets[j]) >= SIMILARITY:
                root[max(a, b)] = min(a, b)
                found.append((component[i], component[j]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], ["a", "b"])


def _exact(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows: tile, side, node, component, perhaps signature. -> links a, b of components, by the texts."""
    whole = rows.join(texts, "node").drop("node")
    return _by_tile(whole).mapInArrow(_links, "a binary, b binary")


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition("tile").sortWithinPartitions("tile")


def _star_links(edges: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """edges: a, b (the first node of a bucket). -> those that are links."""
    signature = lambda name, as_: nodes.select(F.col("node").alias(name), F.col("signature").alias(as_))
    shares = edges.join(signature("a", "left"), "a").join(signature("b", "right"), "b").select("a", "b", "left", "right").mapInArrow(_agreement, "a binary, b binary, share double")
    shares = stored(shares.where(F.col("share") >= REFUSED), "shares", few=True)
    close = shares.where(F.col("share") < ACCEPTED).select("a", "b")
    sizes = close.groupBy("b").agg(F.ceil(F.count("*") / SIDE).alias("parts"))
    members = close.join(sizes, "b").select(F.struct("b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("i"), F.lit(0).cast("long").alias("j")).alias("tile"), F.lit(1).alias("side"), F.col("a").alias("node"))
    firsts = members.select("tile").distinct().select("tile", F.lit(0).alias("side"), F.col("tile.b").alias("node"))
    rows = members.unionByName(firsts).withColumn("component", F.col("node"))
    return shares.where(F.col("share") >= ACCEPTED).select("a", "b").unionByName(_exact(rows, texts))


def _unmet(labelled: DataFrame, least: int) -> DataFrame:
    """bucket, node, component -> with largest, others and work, the rows of buckets of ``least`` rows and of different components.

    largest is the bucket's largest component. others is how many rows are of others, null if these
    are one component. work is how many pairs of rows may have to meet.
    """
    sizes = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    most = F.max(F.struct("n", "component")).alias("most")
    mixed = sizes.groupBy("bucket").agg(F.sum("n").alias("all"), most, F.count("*").alias("components")).where((F.col("components") > 1) & (F.col("all") >= least))
    rest = F.col("all") - F.col("most.n")
    others = F.when(F.col("components") > 2, rest)
    work = F.col("most.n") * rest + F.coalesce(others * others / 2, F.lit(0.0))
    return labelled.join(mixed.select("bucket", F.col("most.component").alias("largest"), others.alias("others"), work.alias("work")), "bucket")


def _finer_buckets(hot: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of hot buckets dealt anew, to smaller buckets: no pair that may be similar is parted.

    Two signatures that agree in the share REFUSED agree in both coordinates of at least GROUPS + 1 of
    the PAIRS fixed pairs of coordinates, so of the GROUPS groups of pairs one holds two on which they
    agree. Each two pairs of a group make one bucket of a row.
    """
    keys = []
    for i, j in TWO_PAIRS:
        at = lambda x: F.substring(F.col("signature"), 8 * x + 1, 8)
        keys.append(F.xxhash64(F.lit(i), at(i), F.lit(j), at(j)))
    rows = hot.select("node", "component").distinct().join(nodes.select("node", "signature"), "node")
    return rows.select(F.explode(F.array(*keys)).alias("bucket"), "node", "component")


def _rest_tiles(bands: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of the tiles in which different components of a bucket of three or more still have to meet.

    In a bucket the largest component meets the others, and the others meet one another. All buckets
    with the same largest component are taken together, so that its members come once and not once
    for each band. Either side is cut into parts of about SIDE rows; each pair of parts is a tile.
    A bucket whose pairs are more than HOT is dealt anew by further coordinates first.
    """
    labelled = bands.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    rows = stored(_unmet(labelled, 3), "rest")  # stored, so that a large bucket can be split
    hot = rows.where(F.col("work") > HOT)
    if hot.limit(1).count():
        finer = stored(_unmet(_finer_buckets(hot, nodes), 2), "finer")
        rows = rows.where(F.col("work") <= HOT).unionByName(finer)
    inner = rows.where(F.col("component") == F.col("largest")).select("largest", "node", "component").distinct()
    outer = rows.where(F.col("component") != F.col("largest"))
    met = outer.select("largest", "node", "component").distinct()
    parts = lambda df, name: df.groupBy("largest").agg(F.ceil(F.count("*") / SIDE).alias(name))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    own = lambda n: F.pmod(F.xxhash64("node"), n)
    tile = lambda b, i, j: F.struct(b.alias("b"), i.alias("i"), j.alias("j")).alias("tile")
    sides = inner.join(parts(met, "small"), "largest").join(parts(inner, "large"), "largest").withColumn("j", F.explode(upto(F.col("small"))))
    sides = sides.select(tile(F.col("largest"), own(F.col("large")), F.col("j")), F.lit(0).alias("side"), "node", "component")
    meets = met.join(parts(met, "small"), "largest").join(parts(inner, "large"), "largest").withColumn("i", F.explode(upto(F.col("large"))))
    meets = meets.select(tile(F.col("largest"), F.col("i"), own(F.col("small"))), F.lit(1).alias("side"), "node", "component")
    among = outer.where(F.col("others").isNotNull()).withColumn("own", own(F.ceil(F.col("others") / SIDE))).withColumn("j", F.explode(upto(F.ceil(F.col("others") / SIDE))))
    side = F.when(F.col("own") == F.col("j"), 2).when(F.col("own") < F.col("j"), 0).otherwise(1)
    among = among.select(tile(F.encode(F.col("bucket").cast("string"), "UTF-8"), F.least("own", "j"), F.greatest("own", "j")), side.alias("side"), "node", "component")
    dealt = sides.unionByName(meets).unionByName(among)
    return dealt.join(nodes.select("node", "signature"), "node").select("tile", "side", "node", "component", "signature")


def _by_text(signed: DataFrame) -> DataFrame:
    """node, n (rows with the text), best (its smallest id; null if it has none), times (how often an id is repeated, at most).

    Summed first by text and id, so a text with very many copies is spread.
    """
    by_id = signed.where(F.col("signature").isNotNull()).groupBy("node", "doc_id").agg(F.count("*").alias("times"))
    return by_id.groupBy("node").agg(F.sum("times").alias("n"), F.min("doc_id").alias("best"), F.max("times").alias("times"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. -> (signed: doc_id, node, signature), (texts with words: node, component, n, best, times)."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.where(F.col("text").isNotNull()).withColumn("node", _node(F.col("text")))
    signed = stored(keyed.select("doc_id", "node", "text").mapInArrow(_signed, f"doc_id {kind}, node binary, signature binary"), "signatures")
    by_text = stored(_by_text(signed), "texts", few=True)
    width = 4 * dart.ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring(F.col("signature"), i * width + 1, width)) for i in range(dart.BANDS)])
    # Copies have the same keys, which go before the shuffle as far as a task holds several.
    banded = signed.where(F.col("signature").isNotNull()).select("node", keys.alias("keys")).dropDuplicates(["node"]).select("node", F.explode("keys").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    bands = stored(banded.join(shared, "bucket").select("bucket", "node", "first", "n"), "bands")
    # Of copies the row that stands for them is looked for by its id too, so they are spread.
    wanted = bands.select("node").distinct().join(by_text, "node").select(F.col("node").alias("at"), F.col("best").alias("of"))
    mine = (F.col("node") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("of"))
    nodes = stored(signed.join(wanted, mine, "left_semi").select("node", "doc_id", "signature").dropDuplicates(["node"]), "nodes")
    wanted = nodes.select(F.col("node").alias("at"), F.col("doc_id").alias("of"))
    texts = stored(keyed.join(wanted, mine, "left_semi").select("node", "text").dropDuplicates(["node"]), "texts")
    edges = bands.where(F.col("node") != F.col("first")).select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    labels = connected_components(_star_links(edges, nodes, texts))
    hopeful = _by_tile(_rest_tiles(bands.where(F.col("n") > 2).select("bucket", "node"), labels, nodes))
    more = stored(_exact(hopeful.mapInArrow(_hopeful, hopeful.schema), texts), "links", few=True)
    grouped = by_text.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if more.limit(1).count():  # links between components, so only these are joined further
        joined = connected_components(more).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        grouped = grouped.join(joined, "component", "left").withColumn("component", F.coalesce("whole", "component")).drop("whole")
    return signed, grouped.select("node", "component", "n", "best", "times")


def near_duplicate_classes(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, class_id, class_size: one row for each row of docs.

    Documents whose shingles of five words have a weighted Jaccard similarity of 0.8 or more are
    linked; linked documents share a class, named by its smallest doc_id. A text of fewer words is
    one shingle. Equal texts are one class. A null text, or one without words, is similar to
    none and a class of its own, of its own id. Repeated rows count each; a class of null ids alone
    has a null name; an empty table gives no rows. A text of any length is taken whole: its words
    are hashed by pieces, and 8 bytes are held for each.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed, texts = _classes(chosen)
    texts = stored(texts, "by-text", few=True)
    # Stored, so that the join deals out its rows anew and a class with very many texts can be split.
    names = stored(texts.groupBy("component").agg(F.min("best").alias("class_id"), F.sum("n").alias("class_size")), "classes", few=True)
    classes = texts.join(names, "component").select("node", "class_id", "class_size")
    own = signed.where(F.col("signature").isNotNull()).select("doc_id", "node")
    alone = signed.where(F.col("signature").isNull()).select("doc_id").unionByName(chosen.where(F.col("text").isNull()).select("doc_id"))
    return own.join(classes, "node").select("doc_id", "class_id", "class_size").unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def keep_one_of_each(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """docs with its own columns: of each class the row of the smallest doc_id (null last; then by text), once.

    Rows whose text is null or has no words all stay.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    _, texts = _classes(chosen)
    best = F.min(F.struct(F.col("best").isNull().alias("last"), F.col("best").alias("of"), F.col("node").alias("at"), "times")).alias("best")
    best = stored(texts.groupBy("component").agg(best).select("best.of", "best.at", "best.times"), "kept", few=True)
    mine = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(mine, F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _node(F.col(text)).alias("node"))
    has_words = F.coalesce(F.col("text").rlike(r"[^\s\x1c-\x1f\x85\xa0\p{Z}]"), F.lit(False))
    joined = keyed.where(has_words).join(best, (F.col("node") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("of")))
    once = keyed.where(~has_words).select("row").unionByName(joined.where(F.col("times") == 1).select("row"))
    if best.where(F.col("times") > 1).limit(1).count():  # rows that repeat both id and text
        once = once.unionByName(joined.where(F.col("times") > 1).dropDuplicates(["node", "doc_id"]).select("row"))
    return once.select([F.col("row").getField(c).alias(c) for c in docs.columns])
