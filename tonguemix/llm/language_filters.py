"""Language identification by language-bitmask n-gram filters.

Training gives each language a set of letter n-grams. The sets go into one bit-sliced Bloom filter:
a cell is a mask with a bit for each language, an n-gram sets its languages' bits in HASHES cells,
and the conjunction of those cells names all languages that hold it, in one probe for all of them.
A document's n-grams are looked up, each language's bits are counted, and the counts are corrected
for false positives: of N n-grams about N f are hits of a language by chance, with f its share of
set bits to the power HASHES. The language of the highest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import prepare

#: N-grams are windows of this many characters of the lower-case letters, words parted by one space.
ORDER = 4
HASHES, CELLS = 3, 1 << 20
WORD_BITS = 63
#: Texts are looked up in pieces of this many characters, which overlap, so memory has a bound and no text is cut.
PIECE = 1 << 20
UNDETERMINED = "und"


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def letters(text: str) -> Iterator[np.ndarray]:
    """Code points of the lower-case text, every run of other characters as one space, a space at either end.

    They come by pieces of the text, each after the first with the last ORDER - 1 of those before, so that
    arrays are no longer than a piece. A piece that adds nothing, or whose windows would all be short, is
    held back; of a text shorter than a window all codes come at once.
    """
    held, begun = np.array([32], np.uint64), False
    for start in range(0, max(1, len(text)), PIECE):
        codes = np.frombuffer(text[start : start + PIECE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(_LETTER[np.minimum(codes, len(_LETTER) - 1)], codes, 32).astype(np.uint64)
        ended = start + PIECE >= len(text)
        codes = np.concatenate([held, codes, np.array([32] * ended, np.uint64)])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        if len(codes) >= ORDER or ended and not begun:
            yield codes
            begun, held = True, codes[-(ORDER - 1) :]
        else:
            held = codes


_LETTER = np.array([chr(c).isalpha() for c in range(0x32400)])  # beyond lie no letters


def ngrams(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows of ORDER characters; of a shorter text, of the whole."""
    n = max(1, len(codes) - ORDER + 1)
    width = min(ORDER, len(codes))
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def cells(grams: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(HASHES):
        x = (grams + np.uint64(0xD1B54A32D192ED03 * (i + 1) & 2**64 - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        yield ((x ^ x >> np.uint64(31)) >> np.uint64(7)) & np.uint64(CELLS - 1)


@dataclass
class Filters:
    languages: list[str]
    masks: list[np.ndarray]  # one array of cells for every WORD_BITS languages

    def __post_init__(self):
        set_bits = [(m >> np.uint64(i) & np.uint64(1)).mean() for m, i in (self._where(k) for k in range(len(self.languages)))]
        self.chance = np.array(set_bits) ** HASHES

    def _where(self, language: int) -> tuple[np.ndarray, int]:
        return self.masks[language // WORD_BITS], language % WORD_BITS

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language's filter holds."""
        places = list(cells(grams))
        out = np.zeros(len(self.languages))
        for word, mask in enumerate(self.masks):
            held = mask[places[0]]
            for p in places[1:]:
                held &= mask[p]
            for bit in range(min(WORD_BITS, len(self.languages) - word * WORD_BITS)):
                out[word * WORD_BITS + bit] = np.count_nonzero(held & np.uint64(1 << bit))
        return out

    def decide(self, text: str | None) -> tuple[str, float]:
        """Language and score: the corrected share of the text's n-grams that it holds, from 0 to 1."""
        total, n, found = np.zeros(len(self.languages)), 0, False
        for codes in letters(text or ""):
            grams = ngrams(codes)
            total += self.counts(grams)
            n += len(grams)
            found = found or bool((codes != 32).any())
        if not found or not self.languages:
            return UNDETERMINED, 0.0
        share = np.clip((total - n * self.chance) / (n * np.maximum(1 - self.chance, 1e-9)), 0, 1)
        best = int(np.argmax(share))
        return self.languages[best], float(share[best])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> lang, gram, n: summed over up to 4 million n-grams at a time."""
    held: dict[str, list[np.ndarray]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": grams.view(np.int64), "n": n.astype(np.int64)})
        held.clear()

    waiting = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for codes in letters(text):
                grams = ngrams(codes)
                held.setdefault(lang, []).append(grams)
                waiting += len(grams)
                if waiting > 1 << 22:
                    yield from flush()
                    waiting = 0
    yield from flush()


def train(docs: DataFrame, learn: Column, *, text="text", lang="lang", doc_id="doc_id", per_language: int = 3000, share: float = 0.25, least: int = 2) -> Filters:
    """Filters from the rows of docs where learn holds and text and lang are not null.

    per_language bounds the sample: of a language with more documents, those whose id hashes below
    per_language / count are learned from, whole. An n-gram belongs to a language in which it occurs
    at least ``least`` times, and at least ``share`` times as often by length as in the language where
    it is most frequent, so words of other languages in a few documents do not count. The driver gets
    the distinct n-grams of the sample, which its size bounds.
    """
    prepare(docs.sparkSession)
    known = docs.where(learn & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rates = {r["lang"]: min(1.0, per_language / r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(rates)
    if not languages:
        return Filters([], [])
    kept = F.lit(False)
    for name, rate in rates.items():
        kept = kept | ((F.col("lang") == name) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rate * (1 << 30))))
    counts = known.where(kept).select("lang", "text").mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    table = counts.toArrow()
    of = np.searchsorted(languages, table.column("lang").to_pylist()) if table.num_rows else np.empty(0, np.int64)
    grams, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy().astype(float)
    n /= np.maximum(np.bincount(of, n, len(languages)), 1)[of]
    distinct, which = np.unique(grams, return_inverse=True)
    most = np.zeros(len(distinct))
    np.maximum.at(most, which, n)
    chosen = n >= share * most[which]
    masks = [np.zeros(CELLS, np.uint64) for _ in range(-(-len(languages) // WORD_BITS))]
    for k in range(len(languages)):
        for places in cells(grams[chosen & (of == k)]):
            np.bitwise_or.at(masks[k // WORD_BITS], places, np.uint64(1 << k % WORD_BITS))
    return Filters(languages, masks)


def predictor(docs: DataFrame, filters: Filters, text: str) -> Column:
    """struct(lang_pred, score) of a text column; the filters are broadcast: CELLS longs for every 63 languages."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.masks))
    ready: list[Filters] = []

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not ready:
            ready.append(Filters(*shared.value))
        for texts in batches:
            yield pd.DataFrame([ready[0].decide(x) for x in texts], columns=["lang_pred", "score"])

    return predict(F.col(text))


def identify(docs: DataFrame, filters: Filters, *, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of docs.

    A text that is null or holds no letter is ``und`` with score 0, as all are if nothing was learned;
    null ids and repeated rows pass through; ties go to the first language by name; an empty table
    gives no rows. Texts are looked up whole, however long.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = chosen.withColumn("found", predictor(chosen, filters, "text"))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, filters: Filters, *, text="text", least: float = 0.2) -> DataFrame:
    """docs with its own columns, without the rows that are und or whose score is below least.

    Null and empty texts are und, so they go; ties of languages do not matter; repeated rows share their
    fate; an empty table stays empty. Texts are looked up whole, however long.
    """
    mine = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    chosen = docs.select(mine, F.col(text).alias("text"))
    found = chosen.withColumn("found", predictor(chosen, filters, "text"))
    kept = found.where((F.col("found.lang_pred") != UNDETERMINED) & (F.col("found.score") >= least))
    return kept.select([F.col("row").getField(c).alias(c) for c in docs.columns])
