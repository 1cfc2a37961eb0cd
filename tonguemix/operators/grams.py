"""N-grams of bytes and feature matching with NumPy, for many texts at a time.

N-grams of up to 8 bytes are whole numbers of 64 bits, so finding, counting and matching them are
array operations over the texts, which lie one after the other as Arrow keeps them. They are taken in
groups of some CHUNK bytes, so that no array grows with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDEST = 8
#: What stands between texts that are matched together.
END = 256
#: Bytes of texts that are taken at once; a longer text is taken in pieces.
CHUNK = 1 << 16
#: Cells of a dense table of counts, texts by features.
CELLS = 1 << 20
#: Cells for each number up to which numbers are summed in a table, and not sorted.
DENSE = 8
#: Numbers that a tally gives at a time.
SENT = 1 << 16
#: Nodes of a tree of features up to which they are matched by walking it.
NODES = 1 << 12
#: Widest n-grams that are found for many texts at once, and texts that are so taken: both and a length make 64 bits.
PACKED, TOGETHER = 6, 1 << 12


def windows(data: np.ndarray, width: int) -> np.ndarray:
    """The n-gram at each place of an array of bytes, as a number; widths up to WIDEST."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out << np.uint64(8) | data[i : i + n]
    return out


def as_bytes(grams: np.ndarray, width: int) -> pa.Array:
    raw = np.ascontiguousarray(grams.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :])
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(grams), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | (data >= 9) & (data <= 13)


def laid_out(texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (and the last ends); a null is empty."""
    texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_binary())).cast(pa.large_binary())
    texts = texts.fill_null(b"") if texts.null_count else texts
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]


def groups(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First text and the one after the last of groups of CHUNK bytes and most texts, or of one longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1
        last = min(max(last, first + 1), first + max(1, most), n)
        yield first, last
        first = last


def summed(numbers: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers, ascending, and how often each is there (or the sums of times)."""
    if times is None:
        numbers = np.sort(numbers)
    else:
        order = np.argsort(numbers)
        numbers, times = numbers[order], times[order]
    if not len(numbers):
        return numbers, np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
    n = np.diff(np.append(starts, len(numbers))) if times is None else np.add.reduceat(times, starts)
    return numbers[starts], n.astype(np.int64, copy=False)


class Tally:
    """Counts of numbers. What was added is summed up when it is more than held, so memory follows the different numbers."""

    def __init__(self, held: int):
        self.held, self.waiting, self.parts = held, 0, []
        self.numbers, self.times = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, numbers: np.ndarray, times: np.ndarray | None = None) -> bool:
        """Whether the tally is full now, and is to be taken."""
        self.parts.append((numbers, times))
        self.waiting += len(numbers)
        if self.waiting > self.held:
            self._sum()
        return len(self.numbers) > self.held

    def _sum(self) -> None:
        parts = [(self.numbers, self.times), *[p for p in self.parts if p[1] is not None]]
        if once := [numbers for numbers, times in self.parts if times is None]:
            parts.append(summed(np.concatenate(once)))
        self.numbers, self.times = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        self.parts, self.waiting = [], 0

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The numbers, ascending, and their counts, some at a time; the tally is empty then."""
        self._sum()
        numbers, times = self.numbers, self.times
        self.numbers, self.times = numbers[:0].copy(), times[:0].copy()
        for at in range(0, len(numbers), SENT):
            yield numbers[at : at + SENT], times[at : at + SENT]


def distinct_grams(texts: pa.Array | list[bytes], low: int, high: int, least: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """width, places of texts, n-grams: the different n-grams of each text of least bytes or more, for widths low to high, PACKED at most.

    Text, n-gram and how many of its bytes belong to the text make one number. In the order of these
    numbers the shorter n-grams are in order too, so one sort serves all widths.
    """
    data, offsets = laid_out(texts)
    for first, last in groups(offsets, TOGETHER):
        begin, end, ends = int(offsets[first]), int(offsets[last]), offsets[first + 1 : last + 1]
        several: dict[int, list[np.ndarray]] = {}
        for start in range(begin, end, CHUNK):
            stop = min(start + CHUNK, end)
            piece = np.zeros(stop - start + high - 1, np.uint8)
            ahead = data[start : min(stop + high - 1, end)]
            piece[: len(ahead)] = ahead
            owner = np.repeat(np.arange(last - first, dtype=np.uint64), np.diff(np.clip(offsets[first : last + 1], start, stop)))
            room = np.full(stop - start, high, np.uint64)
            for short in range(high - 1, 0, -1):  # the last places of each text
                places = ends - short
                room[places[(places >= offsets[first:last]) & (places >= start) & (places < stop)] - start] = short
            if least > 1:
                room[(np.diff(offsets[first : last + 1]) < least)[owner.astype(np.int64)]] = 0
            keys = np.sort((owner << np.uint64(8 * high) | windows(piece, high)) << np.uint64(3) | room)
            held = (keys & np.uint64(7)).astype(np.uint8)
            keys >>= np.uint64(3)
            for width in range(high, low - 1, -1):
                own = keys[held >= width] >> np.uint64(8 * (high - width))
                own = own[np.append(True, own[1:] != own[:-1])] if len(own) else own
                if end - begin > CHUNK:
                    several.setdefault(width, []).append(own)
                else:
                    yield width, (own >> np.uint64(8 * width)).astype(np.int64) + first, own & np.uint64((1 << 8 * width) - 1)
        for width, parts in several.items():  # of one long text
            own = np.unique(np.concatenate(parts))
            yield width, np.full(len(own), first), own


class Matcher:
    """Counts occurrences of features, overlapping and nested ones too; feature ids are places in the list.

    Features are a tree of bytes that all places of the texts walk at once. The last node that a place
    reaches tells all features that begin there. A list with too many nodes is looked up by width instead.
    """

    def __init__(self, features: list[bytes]):
        self.size = len(features)
        self.longest = max(map(len, features), default=0)
        self.steps = self._tree(features)
        self.short: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.long: dict[int, dict[bytes, int]] = {}
        for width in sorted({len(f) for f in features if f}) if self.steps is None else ():
            own = [(int.from_bytes(f, "big"), i) for i, f in enumerate(features) if len(f) == width]
            if width <= WIDEST:
                own.sort()
                self.short.append((width, np.array([g for g, _ in own], np.uint64), np.array([i for _, i in own])))
            else:
                self.long[width] = {features[i]: i for _, i in reversed(own)}
        # Long features are compared only where their first bytes stand.
        self.heads = {w: np.unique(np.array([int.from_bytes(f[:WIDEST], "big") for f in table], np.uint64)) for w, table in self.long.items()}

    def _tree(self, features: list[bytes]) -> np.ndarray | None:
        """The next node for each node and byte, or END between texts, 0 if there is none; nodes that go on from two bytes come first."""
        nodes: dict[bytes, int] = {b"": 1}
        for f in features:
            for k in range(1, len(f) + 1):
                nodes.setdefault(f[:k], len(nodes) + 1)
            if len(nodes) > NODES:
                return None
        inner = {f[:k] for f in features for k in range(2, len(f))}
        nodes = {f: i + 1 for i, f in enumerate(sorted(nodes, key=lambda f: (f not in inner, f)))}
        self.inner, root = len(inner), END + 1
        steps, places = np.zeros((len(nodes) + 1) * root, np.int16), {f: i for i, f in reversed(list(enumerate(features))) if f}
        pairs = np.zeros((root, root), np.int16)
        for f, node in sorted(nodes.items()):  # shorter ones before those that begin with them
            if len(f) == 1:
                pairs[f[0]] = node
            elif len(f) == 2:
                pairs[f[0], f[1]] = node
            elif f:
                steps[nodes[f[:-1]] * root + f[-1]] = node
        told = [[], *[[places[f[:k]] for k in range(1, len(f) + 1) if f[:k] in places] for f in nodes]]
        self.pairs, self.told, self.n_told = pairs.reshape(-1), np.array([i for own in told for i in own], np.int64), np.array([len(own) for own in told])
        return steps

    def _walk(self, data: np.ndarray) -> np.ndarray:
        """The last node that each place reaches, 0 if it reaches none. data has END after each text, and at its end."""
        root = END + 1
        last = np.zeros(len(data), np.int16)
        if len(data) > 1:
            self.pairs.take(data[:-1] * np.int32(root) + data[1:], out=last[:-1], mode="clip")
        places = np.flatnonzero((last > 0) & (last <= self.inner))
        nodes = last.take(places)
        for width in range(2, self.longest):
            nodes = self.steps.take(nodes * np.int32(root) + data.take(places + width))
            alive = np.flatnonzero(nodes > 0)
            places, nodes = places.take(alive), nodes.take(alive)
            if not len(places):
                break
            last[places] = nodes
        return last

    def _features(self, reached: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and feature as one number, and counts, from text and node as one number, and counts."""
        texts, nodes = np.divmod(reached, len(self.n_told))
        each = self.n_told[nodes]
        starts = (np.cumsum(self.n_told) - self.n_told)[nodes]
        at = np.arange(each.sum()) + np.repeat(starts - (np.cumsum(each) - each), each)
        found, times = np.repeat(texts, each) * self.size + self.told[at], np.repeat(n, each)
        cells = (int(texts[-1]) + 1) * self.size if len(texts) else 0
        if cells > DENSE * len(found):
            return summed(found, times)
        table = np.bincount(found, times, cells)  # whole numbers below 2 ** 53, so exact
        found = np.flatnonzero(table)
        return found, table[found].astype(np.int64)

    def _lookups(self, data: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        for width, grams, ids in self.short:
            own = windows(data, width)[:n]
            place = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            found = np.flatnonzero(grams[place] == own)
            yield found, width, ids[place[found]]
        heads = windows(data, WIDEST)[:n] if self.long else None
        for width, table in self.long.items():
            known = self.heads[width]
            found = np.flatnonzero(known[np.minimum(np.searchsorted(known, heads), len(known) - 1)] == heads)
            ids = np.array([table.get(data[p : p + width].tobytes(), -1) for p in found.tolist()], np.int64)
            yield found[ids >= 0], width, ids[ids >= 0]

    def counts(self, texts: pa.Array | list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """first, last, places of texts, feature ids, times: for the texts first to before last, in order of text and id."""
        data, offsets = laid_out(texts)
        size, nodes = max(1, self.size), 1 if self.steps is None else len(self.n_told)
        for first, last in groups(offsets, CELLS // max(size, nodes)):
            begin, end, cells = int(offsets[first]), int(offsets[last]), (last - first) * nodes
            parts = []
            for start in range(begin, end, CHUNK):
                stop = min(start + CHUNK, end)
                lengths = np.diff(np.clip(offsets[first : last + 1], start, stop))
                if self.steps is None:
                    owner, keys = np.repeat(np.arange(last - first), lengths), []
                    for places, width, ids in self._lookups(data[start : min(stop + self.longest - 1, end)], stop - start):
                        own = owner[places]
                        inside = places + (start + width) <= offsets[first + 1 : last + 1][own]
                        keys.append((own * size + ids)[inside])
                    parts.append(summed(np.concatenate(keys)))
                    continue
                owner = np.repeat(np.arange(last - first), lengths + (stop == end))
                spread = np.full(stop - start + (last - first if stop == end else self.longest + 1), END, np.int16)
                if stop == end:
                    spread[np.arange(stop - start) + np.repeat(np.arange(last - first), lengths)] = data[start:stop]
                else:  # the text goes on
                    ahead = data[start : min(stop + self.longest - 1, end)]
                    spread[: len(ahead)] = ahead
                n = np.bincount(owner * nodes + self._walk(spread)[: len(owner)], minlength=cells)
                n.reshape(-1, nodes)[:, 0] = 0
                reached = np.flatnonzero(n)
                parts.append(self._features(reached, n[reached]))
            if len(parts) > 1:
                parts = [summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))]
            found, times = parts[0] if parts else (np.empty(0, np.int64), np.empty(0, np.int64))
            yield first, last, found // size + first, found % size, times

    def count(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the features that occur, ascending, and how often."""
        for *_, ids, times in self.counts([text]):
            return ids, times
        return np.empty(0, np.int64), np.empty(0, np.int64)
