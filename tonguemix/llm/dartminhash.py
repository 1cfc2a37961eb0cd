"""DartMinHash signatures of weighted sets of word shingles.

Every shingle owns a plane of weight by rank into which darts fall as a Poisson process of unit
density, the same for every text: the weight axis is cut into strips [2**v - 1, 2**(v + 1) - 1), and
in a strip darts come in order of rank, at exponential steps, with a weight and a coordinate of the
signature, all from hashes. A text of shingles with weights gets the darts below each shingle's
weight, and keeps the earliest for each coordinate. Two texts keep the same dart in a coordinate with
a probability that is their weighted Jaccard similarity. Only ranks up to about k ln k over the total
weight are thrown, so a signature costs one step for each shingle and k ln k darts, not k hashes for
each shingle.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

SHINGLE = 5
#: Bands of rows: 24 bands of 4 coordinates miss a pair of similarity 0.8 once in 300,000.
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
#: Words of this many bytes of text are hashed at a time, and shingles of texts together up to this many.
PIECE, TOGETHER = 1 << 20, 1 << 18

_RADIX = 0x5851F42D4C957F2D
_INVERSE = pow(_RADIX, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@lru_cache(2)
def _powers(base: int, count: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(count, base, np.uint64))])


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of the lower-case text, parted by white space."""
    words = " ".join(text.lower().split())
    out, start = [], 0
    while start < len(words):
        end = words.find(" ", start + PIECE)
        end = len(words) if end < 0 else end
        out.append(_word_hashes(words[start:end].encode("utf-8", "surrogatepass")))
        start = end + 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _word_hashes(line: bytes) -> np.ndarray:
    """Of words parted by single spaces: differences of one running sum of bytes times powers."""
    data = np.frombuffer(line, np.uint8)
    room = max(1 << 16, 1 << (len(data)).bit_length())
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * _powers(_RADIX, room)[: len(data)], dtype=np.uint64)])
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]])
    return mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, room)[starts])


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of five words, in order, and how often each occurs; of fewer words, of them all."""
    words = word_hashes(text or "")
    if not len(words):
        return words, np.empty(0, np.int64)
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return np.unique(mixed(out + np.uint64(width)), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two results of shingles()."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - both
    return float(both / whole) if whole else 0.0


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    return ((mixed(key + np.uint64(salt * 0x9E3779B97F4A7C15 & 2**64 - 1)) >> np.uint64(11)) + np.uint64(1)) * 2.0**-53


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = COORDINATES) -> np.ndarray:
    """[text, coordinate]: the rank of the earliest dart; infinite for a text without shingles."""
    out = np.full((len(sets), k), np.inf)
    sizes = np.array([len(s) for s, _ in sets])
    total = np.array([c.sum() for _, c in sets], dtype=float)
    reach = k * (math.log(k) + 3) / np.maximum(total, 1)
    todo = np.flatnonzero(sizes)
    while len(todo):
        of = np.repeat(todo, sizes[todo])
        _throw(out, np.concatenate([sets[i][0] for i in todo]), np.concatenate([sets[i][1] for i in todo]), of, reach)
        todo = todo[np.isinf(out[todo]).any(axis=1)]  # few: a coordinate got no dart, so more are thrown
        reach[todo] *= 2
    return out


def _throw(out: np.ndarray, element: np.ndarray, weight: np.ndarray, of: np.ndarray, reach: np.ndarray) -> None:
    k = out.shape[1]
    flat = out.reshape(-1)
    strip = 0
    while len(element):
        width = float(1 << strip)
        key = mixed(element + np.uint64((strip + 1) * 0xD1B54A32D192ED03 & 2**64 - 1))
        text, top, rank, dart = of, weight, np.zeros(len(key)), 0
        while len(key):
            rank = rank - np.log(_uniform(key, 3 * dart)) / width
            near = rank <= reach[text]
            key, text, top, rank = key[near], text[near], top[near], rank[near]
            under = width - 1 + width * _uniform(key, 3 * dart + 1) < top
            place = text[under] * k + (mixed(key[under] ^ np.uint64(3 * dart + 2)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(flat, place, rank[under])
            dart += 1
        strip += 1
        more = weight > (1 << strip) - 1
        element, weight, of = element[more], weight[more], of[more]


def packed(ranks: np.ndarray) -> np.ndarray:
    """4 bytes for each coordinate, equal where the darts are: what is stored and compared."""
    return (mixed(ranks.view(np.uint64)) >> np.uint64(32)).astype("<u4")
