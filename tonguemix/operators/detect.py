"""Detection of one to three languages in a text, and cosine scores.

A text's vector holds, for each feature, its occurrences times the feature's weight. Detection looks
for the language, or the mix of two or three, onto whose span the vector has the longest projection;
a mix counts only if all its coefficients lie strictly between 0 and 1. Two forms give the same
result: Detector works row by row with arrays, and the functions below it are relational.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shipping import prepare
from .grams import Matcher


def check_orders(topn: int, max_order: int) -> None:
    if not 1 <= max_order <= 3:
        raise ValueError("documents of 1 to 3 languages are supported")
    if topn < 1:
        raise ValueError("topn must be 1 or more")


@np.errstate(all="ignore")
def mixes_of_two(g12: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For many texts: whether the share of the first language lies between 0 and 1, the share, and the projection's length."""
    a = (x - y * g12) / ((1 - g12) * (x + y))
    return (0 < a) & (a < 1), a, (a * x + (1 - a) * y) / np.sqrt(a * a + 2 * a * (1 - a) * g12 + (1 - a) * (1 - a))


@np.errstate(all="ignore")
def mixes_of_three(g12: np.ndarray, g23: np.ndarray, g13: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether all shares lie between 0 and 1, those of the first two languages, and the projection's length: the Gram matrix is solved by its adjugate."""
    p = (1 - g23 * g23) * x + (g23 * g13 - g12) * y + (g12 * g23 - g13) * z
    q = (g23 * g13 - g12) * x + (1 - g13 * g13) * y + (g12 * g13 - g23) * z
    r = (g12 * g23 - g13) * x + (g12 * g13 - g23) * y + (1 - g12 * g12) * z
    a, b = p / (p + q + r), q / (p + q + r)
    c = 1 - a - b
    inside = (0 < a) & (a < 1) & (0 < b) & (b < 1) & (0 < c) & (c < 1)
    return inside, a, b, (a * x + b * y + c * z) / np.sqrt(a * a + b * b + c * c + 2 * (a * b * g12 + a * c * g13 + b * c * g23))


def mix_of_two(g12: float, x: float, y: float) -> tuple[float, float] | None:
    """The share of the first language and the projection's length; None if no share lies between 0 and 1."""
    inside, *found = mixes_of_two(*map(np.float64, (g12, x, y)))
    return tuple(found) if inside else None


def mix_of_three(g12: float, g23: float, g13: float, x: float, y: float, z: float) -> tuple[float, float, float] | None:
    """Shares of the first two languages and the projection's length, or None."""
    inside, *found = mixes_of_three(*map(np.float64, (g12, g23, g13, x, y, z)))
    return tuple(found) if inside else None


class Detector:
    def __init__(self, features: list[bytes], ilf: np.ndarray, prototypes: np.ndarray, langs: list[str], topn: int = 5, max_order: int = 1):
        check_orders(topn, max_order)
        self.features, self.ilf, self.prototypes, self.langs, self.topn, self.max_order = features, ilf, prototypes, langs, topn, max_order
        self.gram = prototypes @ prototypes.T
        self.matcher = Matcher(features)

    def __reduce__(self):  # the matcher is built again where it is needed
        return Detector, (self.features, self.ilf, self.prototypes, self.langs, self.topn, self.max_order)

    def vector(self, text: str | bytes) -> tuple[np.ndarray, np.ndarray]:
        """Features that occur and their values; not normalised."""
        own, times = self.matcher.count(text.encode() if isinstance(text, str) else text)
        return own, times * self.ilf[own]

    def dots(self, text: str | bytes) -> tuple[np.ndarray, float]:
        """Inner products with all prototypes, and the vector's length."""
        return next(self.dots_of([text.encode() if isinstance(text, str) else text]))

    def groups_of(self, texts: pa.Array | list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Inner products, texts by prototypes, and lengths, for some texts at a time; each text's sums run in order of its features alone."""
        for first, last, places, ids, times in self.matcher.counts(texts):
            own, values = places - first, times * self.ilf[ids]
            dots = np.empty((last - first, len(self.prototypes)))
            for i, weights in enumerate(self.prototypes):
                dots[:, i] = np.bincount(own, values * weights[ids], last - first)
            yield dots, np.sqrt(np.bincount(own, values * values, last - first))

    def dots_of(self, texts: pa.Array | list[bytes]) -> Iterator[tuple[np.ndarray, float]]:
        """The same as dots() for each of many texts."""
        for dots, norms in self.groups_of(texts):
            yield from zip(dots, norms.tolist(), strict=True)

    def named(self, dots: np.ndarray, norm: float) -> dict[str, float]:
        return dict(zip(self.langs, (dots / norm if norm else np.full(len(dots), np.nan)).tolist(), strict=True))

    def score(self, text: str | bytes) -> dict[str, float]:
        """Cosine with every language; not a number if no feature with a weight occurs."""
        return self.named(*self.dots(text))

    def mixes(self, dots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """dots: texts by languages. -> of each text the languages found (max_order places, -1 where there is no more), their shares, and the length."""
        n, order = len(dots), np.argsort(dots, axis=1, kind="stable")[:, ::-1][:, : self.topn]
        best, shares_ = np.full((n, self.max_order), -1), np.zeros((n, self.max_order))
        if not order.shape[1]:
            return best, shares_, np.zeros(n)
        lengths = np.take_along_axis(dots, order, 1)
        length = lengths[:, 0].copy()
        best[:, 0], shares_[:, 0] = order[:, 0], 1.0

        def better(places: tuple[int, ...], inside: np.ndarray, shares_of: tuple[np.ndarray, ...], found: np.ndarray) -> None:
            at = np.flatnonzero(inside & (found > length))
            length[at] = found[at]
            for k, (place, share) in enumerate(zip(places, shares_of, strict=True)):
                best[at, k], shares_[at, k] = order[at, place], share[at]

        grams = {(i, j): self.gram[order[:, i], order[:, j]] for i, j in combinations(range(order.shape[1]), 2)} if self.max_order >= 2 else {}
        for i, j in grams:
            inside, a, found = mixes_of_two(grams[i, j], lengths[:, i], lengths[:, j])
            better((i, j), inside, (a, 1 - a), found)
        for i, j, k in combinations(range(order.shape[1]), 3) if self.max_order >= 3 else ():
            inside, a, b, found = mixes_of_three(grams[i, j], grams[j, k], grams[i, k], *lengths[:, [i, j, k]].T)
            better((i, j, k), inside, (a, b, 1 - a - b), found)
        return best, shares_, length

    def detect_dots(self, dots: np.ndarray) -> tuple[dict[str, float], float]:
        best, shares_, length = self.mixes(np.asarray(dots)[None])
        return {self.langs[i]: w for i, w in zip(best[0].tolist(), shares_[0].tolist(), strict=True) if i >= 0}, float(length[0])

    def detect(self, text: str | bytes) -> dict[str, float]:
        """Languages and their shares, which sum to 1. A text without features is of the last language by id."""
        return self.detect_dots(self.dots(text)[0])[0]


def _by_text(items: DataFrame, schema: str, columns, keep: tuple[str, ...] = ()) -> DataFrame:
    kept = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = columns(batch.column("data"))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | values)

    prepare(items.sparkSession)
    own = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in kept)
    return items.select(*kept, "data").mapInArrow(run, f"{own}, {schema}")


def detected(detector: Detector, texts: pa.Array | list[bytes]) -> dict[str, pa.Array]:
    """langs, score, has_features of many texts."""
    found = [(*detector.mixes(dots), norms) for dots, norms in detector.groups_of(texts)]
    best, shares_, lengths, norms = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty((0, 1), int), np.empty((0, 1)), np.empty(0), np.empty(0))
    told = best >= 0
    offsets = np.append(0, np.cumsum(told.sum(1)))
    names = pa.array(detector.langs, pa.string()).take(pa.array(best[told]))
    return {"langs": pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), names, pa.array(shares_[told])), "score": pa.array(lengths), "has_features": pa.array(norms > 0)}


def detect(items: DataFrame, detector: Detector, keep: tuple[str, ...] = ()) -> DataFrame:
    """items: doc_id, data. -> doc_id, langs (map of shares), score, has_features, and the columns to keep: one row for each row."""
    return _by_text(items, "langs map<string,double>, score double, has_features boolean", lambda texts: detected(detector, texts), keep)


def score(items: DataFrame, detector: Detector) -> DataFrame:
    """items: doc_id, data. -> doc_id, score: map of cosines with every language."""

    def columns(texts: pa.Array) -> dict:
        return {"score": pa.array([list(detector.named(*d).items()) for d in detector.dots_of(texts)], pa.map_(pa.string(), pa.float64()))}

    return _by_text(items, "score map<string,double>", columns)


def detect_udf(detector: Detector):
    """A function of a string or binary column that gives the map of shares; may be registered for SQL."""

    @F.pandas_udf("map<string,double>")
    def languages(texts: pd.Series) -> pd.Series:
        data = [t.encode() if isinstance(t, str) else t or b"" for t in texts]
        return pd.Series([dict(m) for m in detected(detector, data)["langs"].to_pylist()], dtype=object)

    return languages


def shares(detected: DataFrame) -> DataFrame:
    """doc_id, lang, weight: the long form of detect()."""
    return detected.select("doc_id", F.explode("langs").alias("lang", "weight"))


# The relational form.


def query_vectors(document_features: DataFrame, features: DataFrame) -> DataFrame:
    """doc_id, feature_id, v: occurrences times weight."""
    return document_features.join(features.select("feature_id", "ilf"), "feature_id").select("doc_id", "feature_id", (F.col("tf") * F.col("ilf")).alias("v"))


def dot_products(docs: DataFrame, vectors: DataFrame, prototypes: DataFrame, langs: DataFrame) -> DataFrame:
    """doc_id, lang_id, dot: for every document and every language, 0 where they share no feature."""
    dots = vectors.join(prototypes, "feature_id").groupBy("doc_id", "lang_id").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    every = docs.select("doc_id").distinct().crossJoin(F.broadcast(langs.select("lang_id")))  # a row for each language of the result
    return every.join(dots, ["doc_id", "lang_id"], "left").withColumn("dot", F.coalesce("dot", F.lit(0.0)))


def cosine_scores(dots: DataFrame, vectors: DataFrame) -> DataFrame:
    """doc_id, lang_id, score; not a number for a document without features."""
    norms = vectors.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return dots.join(norms, "doc_id", "left").select("doc_id", "lang_id", F.coalesce(F.try_divide("dot", "norm"), F.lit(float("nan"))).alias("score"))


def candidates(dots: DataFrame, topn: int) -> DataFrame:
    """doc_id, rank (from 1), lang_id, dot: the topn languages of each document; ties to the larger id."""
    best = Window.partitionBy("doc_id").orderBy(F.col("dot").desc(), F.col("lang_id").desc())
    return dots.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= topn).select("doc_id", "rank", "lang_id", "dot")


def _combined(top: DataFrame, gram: DataFrame, order: int, fewer: bool = False) -> DataFrame:
    """Columns l1.., d1.., r1.. of each combination of candidates, and g12, g13, g23; with fewer, smaller ones too, the rest null.

    A document's few candidates meet in an array, dealt as their ranking was, so nothing is shuffled again.
    """
    lists = top.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "lang_id", "dot"))).alias("c"))
    none = F.array(F.lit(None).cast(lists.schema["c"].dataType.elementType)) if fewer else None
    for i in range(1, order + 1):
        last = F.col(f"r{i - 1}") if i > 1 else F.lit(0)
        later = F.filter("c", lambda x: x["rank"] > last)  # noqa: B023  made at once, in this turn
        later = F.concat(none, later) if fewer and i > 1 else later
        lists = lists.select("*", F.explode(later).alias("x")).select(*lists.columns, F.col("x.rank").alias(f"r{i}"), F.col("x.lang_id").alias(f"l{i}"), F.col("x.dot").alias(f"d{i}"))
    out = lists.drop("c")
    for i, j in combinations(range(1, order + 1), 2):
        out = out.join(F.broadcast(gram.select(F.col("l1").alias(f"l{i}"), F.col("l2").alias(f"l{j}"), F.col("dot").alias(f"g{i}{j}"))), [f"l{i}", f"l{j}"], "left" if fewer else "inner")
    return out


def _inside(*shares_: Column) -> Column:
    out = F.lit(True)
    for s in shares_:
        out = out & (s > 0) & (s < 1)
    return F.coalesce(out, F.lit(False))


def _pair_share(mixed: DataFrame) -> tuple[DataFrame, Column]:
    """mixed with the share a2 of the first of two candidates, and the projection's length."""
    g, x, y, a = F.col("g12"), F.col("d1"), F.col("d2"), F.col("a2")
    length = (a * x + (1 - a) * y) / F.sqrt(a * a + 2 * a * (1 - a) * g + (1 - a) * (1 - a))
    return mixed.withColumn("a2", F.try_divide(x - y * g, (1 - g) * (x + y))), length


def _triple_shares(mixed: DataFrame) -> tuple[DataFrame, Column]:
    """mixed with the shares a3 and b3 of the first two of three candidates, and the projection's length."""
    g12, g13, g23, x, y, z = (F.col(c) for c in ("g12", "g13", "g23", "d1", "d2", "d3"))
    a, b = F.col("a3"), F.col("b3")
    solved = (
        mixed.withColumn("p", (1 - g23 * g23) * x + (g23 * g13 - g12) * y + (g12 * g23 - g13) * z)
        .withColumn("q", (g23 * g13 - g12) * x + (1 - g13 * g13) * y + (g12 * g13 - g23) * z)
        .withColumn("r", (g12 * g23 - g13) * x + (g12 * g13 - g23) * y + (1 - g12 * g12) * z)
        .withColumn("sum", F.col("p") + F.col("q") + F.col("r"))
        .withColumn("a3", F.try_divide("p", "sum"))
        .withColumn("b3", F.try_divide("q", "sum"))
    )
    c = 1 - a - b
    return solved, (a * x + b * y + c * z) / F.sqrt(a * a + b * b + c * c + 2 * (a * b * g12 + a * c * g13 + b * c * g23))


def pairs(top: DataFrame, gram: DataFrame) -> DataFrame:
    """doc_id, r1, r2, l1, l2, a, score: mixes of two candidates with shares a and 1 - a."""
    mixed, length = _pair_share(_combined(top, gram, 2))
    return mixed.where(_inside(F.col("a2"))).select("doc_id", "r1", "r2", "l1", "l2", F.col("a2").alias("a"), length.alias("score"))


def triples(top: DataFrame, gram: DataFrame) -> DataFrame:
    """doc_id, r1, r2, r3, l1, l2, l3, a, b, score: mixes of three candidates with shares a, b and the rest."""
    solved, length = _triple_shares(_combined(top, gram, 3))
    a, b = F.col("a3"), F.col("b3")
    return solved.where(_inside(a, b, 1 - a - b)).select("doc_id", "r1", "r2", "r3", "l1", "l2", "l3", a.alias("a"), b.alias("b"), length.alias("score"))


def best_mixes(dots: DataFrame, gram: DataFrame, topn: int = 5, max_order: int = 1) -> DataFrame:
    """doc_id, lang_id, weight, score: the relational form of detection, a row for each language found.

    Single languages, pairs and triples come from one pass over the candidates, so dots is made once.
    """
    check_orders(topn, max_order)
    share = lambda lang, weight: F.struct(F.col(lang).cast("int").alias("lang_id"), weight.cast("double").alias("weight"))
    places = [f"r{i}" for i in range(1, max_order + 1)]
    all_ = _combined(candidates(dots, topn), gram, max_order, fewer=True).withColumn("order", sum((F.col(r).isNotNull().cast("int") for r in places), F.lit(0)))
    order, single = F.col("order"), F.array(share("l1", F.lit(1.0)))
    forms = [((order == 1) & (F.col("r1") == 1), F.col("d1"), single)]
    if max_order >= 2:
        all_, length = _pair_share(all_)
        a = F.col("a2")
        forms.append(((order == 2) & _inside(a), length, F.array(share("l1", a), share("l2", 1 - a))))
    if max_order >= 3:
        all_, length = _triple_shares(all_)
        a, b = F.col("a3"), F.col("b3")
        forms.append(((order == 3) & _inside(a, b, 1 - a - b), length, F.array(share("l1", a), share("l2", b), share("l3", 1 - a - b))))
    form = F.lit(None)
    for valid, length, mix in forms:
        form = F.when(valid, F.struct(length.alias("score"), mix.alias("mix"))).otherwise(form)
    found = all_.select("doc_id", "order", *places, form.alias("form")).where(F.col("form").isNotNull())
    first = Window.partitionBy("doc_id").orderBy(F.col("form.score").desc(), "order", *places)
    best = found.withColumn("place", F.row_number().over(first)).where(F.col("place") == 1)
    return best.select("doc_id", F.col("form.score").alias("score"), F.explode("form.mix").alias("m")).select("doc_id", "m.lang_id", "m.weight", "score")
