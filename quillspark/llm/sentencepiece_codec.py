"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised here, not in the library: at each place the longest prefix that the model's compiled
character map knows is replaced by what the map gives, white space is escaped, and every byte of the
result records the byte of the source it came from. The library then encodes the normalised text with a
copy of the model whose normaliser does nothing, and each piece's bytes are projected through the record
to a span of original bytes.

Defined results: null text counts as empty and has no pieces. The id is carried as it is, null or
repeated; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ESCAPED = "▁"
#: Field numbers of the public model format.
PIECES, NORMALIZER, PIECE_TEXT, PIECE_TYPE, CHARSMAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE, TRAINER, SUFFIX = 1, 3, 1, 3, 2, 3, 4, 5, 2, 24
NORMAL, USER_DEFINED, BYTE = 1, 4, 6


def wire(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of a protocol-buffer message."""
    at, n = 0, len(data)

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < n:
        head = number()
        kind = head & 7
        if kind == 0:
            yield head >> 3, kind, number()
        else:
            size = number() if kind == 2 else 4 if kind == 5 else 8
            yield head >> 3, kind, data[at : at + size]
            at += size


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def without_normalizer(model: bytes) -> bytes:
    """The model with a normaliser that leaves every text as it is."""
    nothing = _message(1, b"identity") + b"".join(_varint(f << 3) + b"\0" for f in (DUMMY_PREFIX, EXTRA_SPACES, ESCAPE))
    out = bytearray()
    for field, kind, value in wire(model):
        if field == NORMALIZER:
            continue
        if kind == 2:
            out += _message(field, value)
        elif kind == 0:
            out += _varint(field << 3) + _varint(value)
        else:
            out += _varint(field << 3 | kind) + value
    return bytes(out) + _message(NORMALIZER, nothing)


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes, whose values point into a block of zero-ended strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) for the longest known prefix of ``data`` from ``at``."""
        units, found = self.units, None
        if not units:
            return None
        node = 0
        unit = units[0]
        node ^= unit >> 10 << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node] if node < len(units) else 0
            if unit & (1 << 31 | 255) != data[i]:
                break
            node ^= unit >> 10 << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]


class Normalizer:
    def __init__(self, model: bytes):
        spec = next((v for f, _, v in wire(model) if f == NORMALIZER), b"")
        options = {f: v for f, _, v in wire(spec)}
        trainer = {f: v for f, _, v in wire(next((v for f, _, v in wire(model) if f == TRAINER), b""))}
        self.map = CharacterMap(options.get(CHARSMAP, b""))
        self.dummy, self.squeeze, self.escape = (bool(options.get(f, 1)) for f in (DUMMY_PREFIX, EXTRA_SPACES, ESCAPE))
        self.suffix = bool(trainer.get(SUFFIX, 0))
        self.kept: dict[int, list[bytes]] = {}
        for f, _, v in wire(model):
            if f == PIECES:
                piece = {a: b for a, _, b in wire(v)}
                if piece.get(PIECE_TYPE, NORMAL) == USER_DEFINED:
                    self.kept.setdefault(piece[PIECE_TEXT][0], []).append(piece[PIECE_TEXT])
        for symbols in self.kept.values():
            symbols.sort(key=len, reverse=True)

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        for symbol in self.kept.get(data[at], ()):
            if data.startswith(symbol, at):
                return len(symbol), symbol
        if found := self.map.longest(data, at):
            return found
        n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        return n, data[at : at + n]

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the source byte it came from."""
        data = text.encode("utf-8")
        space = ESCAPED.encode() if self.escape else b" "
        if not data:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.kept and not self.squeeze:  # the map is empty: only white space is escaped
            raw = np.frombuffer(data, np.uint8)
            align = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(space), 1))
            body, ends = text.replace(" ", space.decode()), np.array([len(raw)])
            if self.dummy:
                extra = np.zeros(len(space), np.int64)
                return (body + space.decode(), np.concatenate([align, extra + len(raw), ends])) if self.suffix else (space.decode() + body, np.concatenate([extra, align, ends]))
            return body, np.concatenate([align, ends])
        at, out, align = 0, bytearray(), []
        steps: list[tuple[int, int, bytes]] = []
        while at < len(data):
            n, new = self._prefix(data, at)
            steps.append((at, at + n, new))
            at += n
        first = 0
        if self.squeeze:
            while first < len(steps) and steps[first][2] == b" ":
                first += 1
            if first == len(steps):
                return "", np.zeros(1, np.int64)
        consumed = steps[first][0]
        if self.dummy and not self.suffix:
            out += space
            align += [consumed] * len(space)
        was_space = self.squeeze
        for start, consumed, new in steps[first:]:
            if was_space:
                new = new.lstrip(b" ")
            if new:
                escaped = new.replace(b" ", space)
                out += escaped
                align += [start] * len(escaped)
                was_space = self.squeeze and new.endswith(b" ")
        if self.squeeze:
            while out.endswith(space):
                consumed = align[len(out) - len(space)]
                del out[-len(space) :]
                del align[-len(space) :]
        if self.dummy and self.suffix:
            out += space
            align += [consumed] * len(space)
        return out.decode("utf-8"), np.array([*align, consumed], np.int64)


class Codec:
    """Encodes and decodes with one model."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = f.read()
        self.normalize = Normalizer(model)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=without_normalizer(model))
        sizes = []
        for f, _, v in wire(model):
            if f == PIECES:
                piece = {a: b for a, _, b in wire(v)}
                sizes.append(1 if piece.get(PIECE_TYPE, NORMAL) == BYTE else len(piece[PIECE_TEXT]))
        self.sizes, self.unknown = np.array(sizes, np.int64), self.model.unk_id()

    def encode(self, text: str | None) -> tuple[list[int], np.ndarray]:
        """The ids, and (begin, end) in bytes of the source for each."""
        norm, align = self.normalize(text or "")
        ids = self.inner.encode(norm, num_threads=1) if norm else []
        ends = self.sizes[ids].cumsum() if ids else np.zeros(0, np.int64)
        if ids and ends[-1] != len(align) - 1:  # an unknown piece has no size of its own: ask the library for the surfaces
            ends = np.array([len(p.surface.encode("utf-8")) for p in self.inner.encode(norm, return_type="proto", num_threads=1).pieces], np.int64).cumsum()
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return ids, np.stack([align[begins], align[ends]], axis=1) if len(ends) else np.zeros((0, 2), np.int64)

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


_codecs: dict[str, Codec] = {}


def load(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, begins, ends): the ids and their spans in bytes of the source."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                done = [codec.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i, _ in done])]).astype(np.int32)
                spans = np.concatenate([s for _, s in done]).astype(np.int32)
                flat = np.array([x for i, _ in done for x in i], np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (flat, spans[:, 0].copy(), spans[:, 1].copy()))], [key, "ids", "begins", "ends"])

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"{key} {rows.schema[0].dataType.simpleString()}, ids array<int>, begins array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of (key, ids)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([codec.decode(i or []) for i in part.column(1).to_pylist()], pa.string())], [key, "text"])

    rows = encoded.select(F.col(key), F.col(ids))
    return rows.mapInArrow(run, f"{key} {rows.schema[0].dataType.simpleString()}, text string")


def _digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass over the texts; spans as pairs (begin, end) of 64-bit little-endian integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = []
                for t in part.column(1).to_pylist():
                    ids, spans = codec.encode(t)
                    rows.append((len(ids), sha(",".join(map(str, ids))), sha(codec.decode(ids)), int((spans[:, 1] - spans[:, 0]).sum()) if len(ids) else 0, hashlib.sha256(spans.astype("<i8").tobytes()).hexdigest()))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes", "spans_sha256"]
                )

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"{key} {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long, spans_sha256 string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(table(spark, sf_dir, "documents"), default_path())
