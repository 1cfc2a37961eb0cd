"""Counting and matching of many texts at once, against the definitions."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tonguemix.operators import grams

TEXTS = st.lists(st.text(alphabet="ab\x00é", max_size=12).map(str.encode), max_size=8)


@settings(max_examples=80, deadline=None)
@given(texts=TEXTS, low=st.integers(1, 3), more=st.integers(0, 3), least=st.integers(0, 4), chunk=st.sampled_from([3, 10, 1 << 18]), cut=st.integers(0, 2))
def test_distinct_grams_by_definition(texts, low, more, least, chunk, cut):
    held, grams.CHUNK = grams.CHUNK, chunk
    try:
        high, rows = low + more, pa.array(texts, pa.binary())[cut:]
        found = Counter()
        for width, places, own in grams.distinct_grams(rows, low, high, least):
            found.update(zip([width] * len(own), places.tolist(), map(bytes, grams.as_bytes(own, width).to_pylist()), strict=True))
        want = {(n, at, t[i : i + n]) for at, t in enumerate(texts[cut:]) if len(t) >= least for n in range(low, high + 1) for i in range(len(t) - n + 1)}
        assert found == Counter(want)
    finally:
        grams.CHUNK = held


@settings(max_examples=80, deadline=None)
@given(texts=TEXTS, features=st.lists(st.text(alphabet="ab\x00é", min_size=1, max_size=11).map(str.encode), unique=True, max_size=9), chunk=st.sampled_from([3, 10, 1 << 18]), nodes=st.sampled_from([0, 1 << 12]), cells=st.sampled_from([1, 1 << 20]))
def test_matches_by_definition(texts, features, chunk, nodes, cells):
    held = grams.CHUNK, grams.NODES, grams.CELLS
    grams.CHUNK, grams.NODES, grams.CELLS = chunk, nodes, cells
    try:
        matcher, found, seen = grams.Matcher(features), {}, []
        for first, last, places, ids, n in matcher.counts(texts):
            seen += range(first, last)
            assert [*zip(places, ids, strict=True)] == sorted(zip(places, ids, strict=True))
            found |= dict(zip(zip(places.tolist(), ids.tolist(), strict=True), n.tolist(), strict=True))
        occurs = lambda t, f: sum(t.startswith(f, i) for i in range(len(t)))
        assert seen == list(range(len(texts)))
        assert found == {(at, i): occurs(t, f) for at, t in enumerate(texts) for i, f in enumerate(features) if occurs(t, f)}
    finally:
        grams.CHUNK, grams.NODES, grams.CELLS = held


def test_a_tally_holds_different_numbers_only():
    tally, r, total, full = grams.Tally(100), np.random.default_rng(1), Counter(), Counter()
    for k in range(400):
        own = r.integers(0, 90 if k < 200 else 10_000, 50).astype(np.uint64)
        total.update(own.tolist() * (1 + k % 2))
        if tally.add(own, np.full(50, 2) if k % 2 else None):
            full.update({k: n for numbers, times in tally.take() for k, n in zip(numbers.tolist(), times.tolist(), strict=True)})
        assert tally.waiting <= 100 and len(tally.numbers) <= 250 and (k >= 200 or not full)
    full.update({k: n for numbers, times in tally.take() for k, n in zip(numbers.tolist(), times.tolist(), strict=True)})
    assert full == total and not len(tally.numbers)


def test_memory_does_not_follow_the_batch():
    """What is held at once beside the texts is the same for 1 and 8 MB of them."""
    words = [b"the cat ", b"der hund ", b"le chat ", b"una casa "]
    r = np.random.default_rng(2)
    texts = pa.array([b"".join(words[k] for k in r.integers(0, 4, 250)) for _ in range(4000)], pa.binary())
    matcher = grams.Matcher([bytes([c]) for c in range(97, 123)] + [b"the", b"hund", b" cha"])

    def peak(rows: pa.Array) -> int:
        tracemalloc.start()
        for _ in grams.distinct_grams(rows, 1, 4, 3):
            pass
        for _ in matcher.counts(rows):
            pass
        try:
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(texts) < 8 << 20 and peak(texts) < 1.3 * peak(texts[:500]) + (1 << 20)
