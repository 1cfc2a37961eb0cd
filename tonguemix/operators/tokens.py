"""Tokenizers, and in how many documents or samples of each language or domain a token occurs.

A tokenizer has two forms. ``rows`` is relational: a row for each occurrence. ``distinct`` gives the
different tokens of one text as arrays, from which ``term_counts`` sums documents by language within
a task, so that what is shuffled is a row for each term and language and task, not for each token.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_latin1, words
from ..plans.shipping import prepare
from .grams import PACKED, WIDEST, Matcher, Tally, as_bytes, distinct_grams, is_space, windows

#: Features up to which a list of them goes to every task; beyond, it is joined with.
MATCHER_LIMIT = 1_000_000
#: Numbers held back in a task before they are summed up, and different ones before they are sent on.
HELD = 1 << 19
#: Tokens as byte strings, or n-grams too wide to be numbered with their class, that are counted before they are sent on.
LOOSE = 1 << 18
#: Classes that are numbered at a time.
CLASSES = 1 << 14


class Tokenizer(Protocol):
    def rows(self, items: DataFrame) -> DataFrame:
        """items: any columns and data (binary). -> the same columns without data, and term: every occurrence."""

    def distinct(self, text: bytes) -> Iterator[tuple[int, np.ndarray] | set[bytes]]:
        """The different tokens: (width, packed n-grams), or a set of byte strings."""


def _positions(items: DataFrame, widths: list[int], least: int) -> DataFrame:
    """A row for each place and width: term is what stands there."""
    long_enough = items.where(F.length("data") >= least)
    placed = long_enough.withColumn("__at", F.explode(F.sequence(F.lit(1), F.length("data")))).withColumn("__width", F.explode(F.array(*[F.lit(w) for w in widths])))
    inside = placed.where(F.col("__at") + F.col("__width") - 1 <= F.length("data"))
    return inside.withColumn("term", F.col("data").substr(F.col("__at"), F.col("__width"))).drop("__at", "__width")


@dataclass(frozen=True)
class NGrams:
    """All n-grams of bytes of orders min_order to max_order; none from texts shorter than max_order - 1."""

    min_order: int = 1
    max_order: int = 3

    def __post_init__(self):
        if not 1 <= self.min_order <= self.max_order:
            raise ValueError("orders must be 1 or more, and the least no larger than the most")

    def rows(self, items: DataFrame) -> DataFrame:
        return _positions(items, list(range(self.min_order, self.max_order + 1)), max(1, self.max_order - 1)).drop("data")

    def distinct(self, text: bytes):
        if len(text) < self.max_order - 1:
            return
        data = np.frombuffer(text, np.uint8)
        for width in range(self.min_order, self.max_order + 1):
            if width <= WIDEST:
                yield width, np.unique(windows(data, width))
            else:
                yield {text[i : i + width] for i in range(len(text) - width + 1)}


@dataclass(frozen=True)
class Prager:
    """N-grams of one order without white space but at their end; with words, also words of another length than the order."""

    order: int = 4
    use_words: bool = False
    word_maxlen: int = 30

    def rows(self, items: DataFrame) -> DataFrame:
        grams = _positions(items, [self.order], self.order)
        grams = grams.where(~as_latin1(F.col("term").substr(1, self.order - 1)).rlike(r"[ \t\n\x0b\f\r]")) if self.order > 1 else grams
        if not self.use_words:
            return grams.drop("data")
        found = items.withColumn("term", F.explode(words(F.col("data")))).where((F.length("term") != self.order) & (F.length("term") <= self.word_maxlen))
        return grams.unionByName(found).drop("data")

    def distinct(self, text: bytes):
        if self.use_words:
            yield {w for w in text.split() if len(w) != self.order and len(w) <= self.word_maxlen}
        data = np.frombuffer(text, np.uint8)
        n = len(data) - self.order + 1
        if n <= 0:
            return
        before = np.concatenate([[0], np.cumsum(is_space(data))])
        kept = before[self.order - 1 : self.order - 1 + n] == before[:n]
        if self.order <= WIDEST:
            yield self.order, np.unique(windows(data, self.order)[kept])
        else:
            yield {text[i : i + self.order] for i in np.flatnonzero(kept).tolist()}


class Scanner:
    """Every known feature at every place where it ends, overlapping and nested ones too."""

    def __init__(self, features: list[bytes]):
        self.features = list(dict.fromkeys(features))
        self.matcher = Matcher(self.features)

    def rows(self, items: DataFrame) -> DataFrame:
        found = _positions(items, sorted({len(f) for f in self.features if f}) or [1], 1)
        known = items.sparkSession.createDataFrame([(f,) for f in self.features], "term binary")
        return found.join(F.broadcast(known) if len(self.features) <= MATCHER_LIMIT else known, "term", "left_semi").drop("data")

    def distinct(self, text: bytes):
        yield {self.features[i] for i in self.matcher.count(text)[0].tolist()}


def sampled(items: DataFrame, size: int = 140, count: int | None = None, seed: int = 0) -> DataFrame:
    """items with data cut into samples: up to count distinct places of each text, size bytes from each.

    Places run from 0 to just below length - size, or are 0 alone. Every set of count places is as
    likely (Floyd's way of drawing, a step for each sample and none for the other places); which it is
    follows from doc_id and seed. Without a count, whole texts. Adds the column sample (the place).
    """
    if not count:
        return items.withColumn("sample", F.lit(None).cast("int"))
    places = F.greatest(F.lit(1), F.length("data") - size).cast("long")

    def draw(taken: Column, last: Column) -> Column:
        digits = F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), last.cast("string"), F.lit(str(seed)))), 1, 15)
        place = F.conv(digits, 16, 10).cast("long") % (last + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, place), last).otherwise(place)))

    steps = F.sequence(places - F.least(places, F.lit(count)), places - 1)
    drawn = F.aggregate(steps, F.array().cast("array<bigint>"), draw)
    return items.withColumn("sample", F.explode(drawn.cast("array<int>"))).withColumn("data", F.col("data").substr(F.col("sample") + 1, F.lit(size)))


def token_rows(items: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    return tokenizer.rows(items)


def term_counts(items: DataFrame, tokenizer: Tokenizer, by: str = "lang") -> DataFrame:
    """items: by, data, one row for each document or sample. -> term, by, n: in how many rows the term occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict = {}
        tallies: dict[int, Tally] = {}
        wide: dict[tuple, list[np.ndarray]] = {}
        loose: Counter = Counter()
        waiting = 0

        def batch(terms: pa.Array, keys: pa.Array | list, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([terms, pa.array(keys, kind) if isinstance(keys, list) else keys, pa.array(n, pa.int64())], ["term", by, "n"])

        def sent(width: int) -> Iterator[pa.RecordBatch]:
            """The class is above the n-gram in each number."""
            keys, bits = pa.array(list(codes), kind), np.uint64(8 * width)
            for numbers, n in tallies[width].take():
                yield batch(as_bytes(numbers & np.uint64((1 << 8 * width) - 1), width), keys.take(pa.array((numbers >> bits).astype(np.int64))), n)

        def added(width: int, classes, found: np.ndarray) -> Iterator[pa.RecordBatch]:
            if tallies.setdefault(width, Tally(HELD)).add(classes << np.uint64(8 * width) | found):
                yield from sent(width)

        def sent_loose() -> Iterator[pa.RecordBatch]:
            for (key, width), parts in wide.items():
                found, n = np.unique(np.concatenate(parts), return_counts=True)
                yield batch(as_bytes(found, width), [key] * len(found), n)
            if loose:
                yield batch(pa.array([t for _, t in loose], pa.binary()), [k for k, _ in loose], list(loose.values()))
            wide.clear()
            loose.clear()

        for rows in batches:
            kind = rows.schema.field(by).type
            for at in range(0, len(rows), CLASSES):
                texts, names = rows.column("data")[at : at + CLASSES], rows.column(by)[at : at + CLASSES].to_pylist()
                if len(codes) + len(names) > CLASSES and len(codes.keys() | set(names)) > CLASSES:
                    for width in tallies:
                        yield from sent(width)
                    codes.clear()
                classes = np.array([codes.setdefault(k, len(codes)) for k in names], np.uint64)
                if isinstance(tokenizer, NGrams) and tokenizer.max_order <= PACKED:
                    for width, places, found in distinct_grams(texts, tokenizer.min_order, tokenizer.max_order, tokenizer.max_order - 1):
                        yield from added(width, classes[places], found)
                    continue
                for key, code, text in zip(names, classes, texts, strict=True):
                    for found in tokenizer.distinct(text.as_py()):
                        if isinstance(found, set):
                            loose.update((key, t) for t in found)
                            waiting += len(found)
                        elif found[0] <= PACKED:
                            yield from added(found[0], code, found[1])
                        elif len(found[1]):
                            wide.setdefault((key, found[0]), []).append(found[1])
                            waiting += len(found[1])
                    if waiting > LOOSE:
                        yield from sent_loose()
                        waiting = 0
        for width in tallies:
            yield from sent(width)
        yield from sent_loose()

    prepare(items.sparkSession)
    kind_name = items.schema[by].dataType.simpleString()
    partial = items.select(by, "data").mapInArrow(count, f"term binary, {by} {kind_name}, n bigint")
    return partial.groupBy("term", by).agg(F.sum("n").alias("n"))


def byte_count(items: DataFrame) -> DataFrame:
    return items.agg(F.coalesce(F.sum(F.length("data")), F.lit(0)).cast("long").alias("n_bytes"))
