"""SentencePiece encoding that keeps offsets, and decoding.

A text is first normalised here, by longest prefixes in the model's compiled character map, and
every normalised byte remembers the source byte that it came from. The normalised text then goes to
the library under a copy of the model whose own normaliser is off, so the pieces found tile exactly
that byte string: running sums of their lengths are offsets in it, and the remembered sources turn
these into byte spans of the original text. Decoding is the library's, under the model as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import prepare

#: Fixed by the model file format: field numbers, piece types, the space symbol.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
WHITESPACE_SUFFIX = 24
UNKNOWN, USER_DEFINED, BYTE = 2, 4, 6
SPACE = "▁".encode()

#: Bytes of text that one call to the library gets, longer texts alone.
CALL_BYTES = 1 << 20


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(number, value, bytes as they were) of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        start, key = at, varint()
        if key & 7 == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            value = message[at : at + size]
            at += size
        yield key >> 3, value, message[start:at]


class CharacterMap:
    """A compiled character map: a double-array trie from byte strings to replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that data has at this place."""
        units, found = self.units, None
        node = self._offset(units[0])
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(units) or units[node] & 0x800000FF != data[end]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = end + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, start = found
        return length, self.replacements[start : self.replacements.index(0, start)]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)


@dataclass
class Normalizer:
    charsmap: CharacterMap | None
    dummy_prefix: bool
    remove_extra: bool
    escape: bool
    suffix: bool
    kept: tuple[bytes, ...]  # user-defined symbols, which are never changed; longest first

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end the source byte it came from."""
        data = text.encode()
        if self.charsmap is None and not (self.remove_extra or self.kept or self.suffix):
            return self._plain(data)
        return self._by_prefix(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        source = np.arange(len(data) + 1)
        if not data:
            return b"", source
        if self.escape:
            source = np.repeat(source, np.append(np.where(np.frombuffer(data, np.uint8) == 32, len(SPACE), 1), 1))
            data = data.replace(b" ", SPACE)
        if self.dummy_prefix:
            mark = SPACE if self.escape else b" "
            source, data = np.concatenate([np.zeros(len(mark), source.dtype), source]), mark + data
        return data, source

    def _chunk(self, data: bytes, at: int) -> tuple[int, bytes]:
        """The next stretch of source: its length, and what takes its place."""
        for symbol in self.kept:
            if data.startswith(symbol, at):
                return len(symbol), symbol
        if self.charsmap and (found := self.charsmap.longest(data, at)):
            return found
        first = data[at]
        length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return length, data[at : at + length]

    def _by_prefix(self, data: bytes) -> tuple[bytes, np.ndarray]:
        mark = SPACE if self.escape else b" "
        out, source = bytearray(), []
        at = 0
        while self.remove_extra and at < len(data):
            length, new = self._chunk(data, at)
            if new != b" ":
                break
            at += length
        if at == len(data):
            return b"", np.zeros(1, np.int64)

        def put(new: bytes, origin: int, unchanged: bool = False) -> None:
            out.extend(new)
            source.extend(range(origin, origin + len(new)) if unchanged else [origin] * len(new))

        if self.dummy_prefix and not self.suffix:
            put(mark, at)
        after_space = self.remove_extra
        while at < len(data):
            length, new = self._chunk(data, at)
            kept = new.lstrip(b" ") if after_space else new
            if kept:
                put(kept.replace(b" ", mark), at, kept == data[at : at + length] and b" " not in kept)
                after_space = self.remove_extra and kept.endswith(b" ")
            at += length
        while self.remove_extra and out.endswith(mark):
            at = source[len(out) - len(mark)]
            del out[-len(mark) :], source[-len(mark) :]
        if self.dummy_prefix and self.suffix:
            put(mark, at)
        return bytes(out), np.array([*source, at])


@dataclass
class Encoded:
    ids: np.ndarray  # with begin and end ids
    begins: np.ndarray  # byte offsets in the original text; begin and end ids have empty spans
    ends: np.ndarray


class Codec:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        parts = list(_fields(model))
        pieces = [dict((n, v) for n, v, _ in _fields(value)) for number, value, _ in parts if number == PIECES]
        trainer = {n: v for number, value, _ in parts if number == TRAINER for n, v, _ in _fields(value)}
        rules = {n: v for number, value, _ in parts if number == NORMALIZER for n, v, _ in _fields(value)}
        kinds = np.array([p.get(3, 1) for p in pieces])
        names = [p.get(1, b"") for p in pieces]
        self.normalize = Normalizer(
            CharacterMap(rules[CHARSMAP]) if rules.get(CHARSMAP) else None, bool(rules.get(DUMMY_PREFIX, 1)), bool(rules.get(REMOVE_EXTRA, 1)), bool(rules.get(ESCAPE, 1)), bool(trainer.get(WHITESPACE_SUFFIX, 0)),
            tuple(sorted((n for n, kind in zip(names, kinds, strict=True) if kind == USER_DEFINED), key=len, reverse=True)),
        )
        self.lengths = np.where(kinds == BYTE, 1, [len(n) for n in names])
        off = b"".join(_varint(n << 3) + b"\0" for n in (DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE))
        bare = b"".join(raw for number, _, raw in parts if number in (PIECES, TRAINER)) + _varint(NORMALIZER << 3 | 2) + _varint(len(off)) + off
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=bare)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unknown = int(np.flatnonzero(kinds == UNKNOWN)[0])
        self.edges = [self.library.bos_id()], [self.library.eos_id()]

    def encode(self, texts: list[str]) -> list[Encoded]:
        normal = [self.normalize(x) for x in texts]
        found = self.pieces.encode([data.decode() for data, _ in normal], num_threads=1)
        return [self._placed(ids, *n) for ids, n in zip(found, normal, strict=True)]

    def _placed(self, ids: list[int], data: bytes, source: np.ndarray) -> Encoded:
        own = np.array(ids, dtype=np.uint32)
        lengths = self.lengths[own]
        if (own == self.unknown).any():  # these have no length of their own
            lengths = np.array([len(x.encode()) for x in self.pieces.encode(data.decode(), out_type=str, num_threads=1)])
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        if offsets[-1] != len(data):
            raise ValueError(f"pieces cover {offsets[-1]} of {len(data)} normalised bytes")
        placed = source[offsets]
        begin, end = self.edges
        return Encoded(np.concatenate([begin, own, end]).astype(np.uint32), np.concatenate([[0], placed[:-1], placed[-1:]]), np.concatenate([[0], placed[1:], placed[-1:]]))

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.library.decode([x.tolist() for x in ids], num_threads=1)


@lru_cache(2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def model_bytes(path: str) -> bytes:
    """The model file, read by the driver and sent along with the task: its size is that of a vocabulary."""
    with open(path, "rb") as f:
        return f.read()


def calls(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about CALL_BYTES of text each; null texts are empty."""
    for batch in batches:
        texts = [x or "" for x in batch.column(text).to_pylist()]
        start = held = 0
        for at, x in enumerate(texts):
            if held and held + len(x) > CALL_BYTES:
                yield batch.slice(start, at - start), texts[start:at]
                start, held = at, 0
            held += len(x) + 1
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode_documents(docs: DataFrame, model: bytes, *, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, ids array<int>, begins and ends array<long>: one row for each row of docs.

    Ids are the library's own, with begin and end ids. begins and ends are byte offsets in the
    original UTF-8 text. A null text counts as empty, whose ids are begin and end alone; null ids
    and repeated rows pass through; an empty table gives no rows; a text of any length is one call.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in calls(batches, "text"):
            found = codec(model).encode(texts)
            lists = [pa.array([x.astype(t) for x in xs], pa.list_(k)) for t, k, xs in (("i4", pa.int32(), [e.ids for e in found]), ("i8", pa.int64(), [e.begins for e in found]), ("i8", pa.int64(), [e.ends for e in found]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "ids", "begins", "ends"])

    prepare(docs.sparkSession)
    return chosen.mapInArrow(encode, f"doc_id {kind}, ids array<int>, begins array<bigint>, ends array<bigint>")


def decode_documents(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id, text: what the library decodes from ids (null: from none)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                texts = codec(model).decode([np.array(x or [], np.uint32) for x in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    prepare(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, text string")


def round_trip_digests(docs: DataFrame, model: bytes, *, doc_id="doc_id", text="text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spanned_bytes (of the source, under its pieces); ids too, if asked for.

    The same calls as encode_documents and decode_documents, in one pass that sends digests alone.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in calls(batches, "text"):
            found = codec(model).encode(texts)
            decoded = codec(model).decode([e.ids for e in found])
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(e.ids) for e in found], pa.int64()),
                "ids_sha256": pa.array([digest(e.ids.astype("<u4").tobytes()) for e in found], pa.string()),
                "decoded_sha256": pa.array([digest(x.encode()) for x in decoded], pa.string()),
                "spanned_bytes": pa.array([int((e.ends - e.begins).sum()) for e in found], pa.int64()),
            }
            if keep_ids:
                columns["ids"] = pa.array([e.ids.astype("i4") for e in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    prepare(docs.sparkSession)
    return chosen.mapInArrow(digests, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spanned_bytes bigint" + ", ids array<int>" * keep_ids)
