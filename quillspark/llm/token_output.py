"""Token ids packed into fixed-width rows and written in binary form.

Texts are encoded where they are read and packed there, in windows of a bounded number of ids: the pieces of a
window are taken longest first, and each goes to the open row with the least room that still holds it,
which a segment tree over the room left (one leaf for each amount) finds in logarithmic time. Documents
longer than a row are split without loss. Nothing is shuffled.

A written row holds the padded ids (little-endian, two bytes each where the vocabulary allows it, else four), cumulative
segment lengths (``cu_seqlens``, from 0), position resets (``positions``: a position for each id, little-endian and four bytes, that starts
again at each segment), and the segments' documents, pieces and starts. A row says its width, so files of both kinds can be read.

Defined results: null text counts as empty and gives one segment, its end id. A null or repeated id is carried as it
is; repeated rows get segments of their own. Other columns are ignored. An empty table writes no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import shared_path, table

CAPACITY = 2048
END_ID = 0
WINDOW_IDS = 4_000_000


class RoomTree:
    """Open rows by the room they have left; finds the least room of at least a given size."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.leaves + room
        while i and not self.some[i]:
            self.some[i] = True
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the fullest row with ``need`` left, removed from the tree."""
        i = self.leaves + need
        if not self.some[i]:
            while i > 1 and not (i % 2 == 0 and self.some[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        room = i - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.some[i] = False
            while i > 1 and not self.some[i ^ 1]:
                i >>= 1
                self.some[i] = False
        return room, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers."""
    tree, rows = RoomTree(capacity), []
    for p in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        found = tree.take(lengths[p])
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(p)
        tree.add(room - lengths[p], row)
    return rows


def positions(cu_seqlens: list[int]) -> np.ndarray:
    """Position ids of a row's segments: each starts again at 0."""
    cu = np.asarray(cu_seqlens)
    return np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))


SCHEMA = "sequence_id long, n_ids int, width int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<{key}>, pieces array<int>, starts array<long>"
_NAMES = ["sequence_id", "n_ids", "width", "ids", "positions", "cu_seqlens", "doc_ids", "pieces", "starts"]


def pack(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, window: int = WINDOW_IDS, width: int | None = None) -> DataFrame:
    """Packed rows (``SCHEMA``). ``width``: bytes of an id, 2 or 4; by default what the vocabulary needs."""
    path = path or tokens.default_path()
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    id_type = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.load(path)
        size_of_id = width or (2 if bpe.size <= 1 << 16 else 4)
        kind = np.dtype(f"<u{size_of_id}")
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held: list[tuple[object, int, int, np.ndarray]] = []
        size = 0
        id_arrow = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            packed = best_fit_decreasing([len(h[3]) for h in held], capacity)
            for at in range(0, len(packed), 256):
                some = packed[at : at + 256]
                cus, blobs, places = [], [], []
                for r in some:
                    cu = np.concatenate([[0], np.cumsum([len(held[p][3]) for p in r])])
                    blob = np.zeros(capacity, kind)
                    blob[: cu[-1]] = np.concatenate([held[p][3] for p in r])
                    cus.append(cu.tolist())
                    blobs.append(blob.tobytes())
                    places.append(positions(cu).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(number, number + len(some)), pa.int64()),
                        pa.array([c[-1] for c in cus], pa.int32()),
                        pa.array([size_of_id] * len(some), pa.int32()),
                        pa.array(blobs, pa.binary()),
                        pa.array(places, pa.binary()),
                        pa.array(cus, pa.list_(pa.int32())),
                        pa.array([[held[p][0] for p in r] for r in some], pa.list_(id_arrow)),
                        pa.array([[held[p][1] for p in r] for r in some], pa.list_(pa.int32())),
                        pa.array([[held[p][2] for p in r] for r in some], pa.list_(pa.int64())),
                    ],
                    _NAMES,
                )
                number += len(some)

        for batch in batches:
            id_arrow = batch.column(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(bpe.encode(t), np.uint32(END_ID))
                    if int(ids.max()) >= 1 << 8 * size_of_id:
                        raise ValueError(f"an id of {int(ids.max())} does not fit {size_of_id} bytes")
                    ids = ids.astype(kind)
                    for piece, (start, length) in enumerate(tokens.piece_bounds(len(ids), capacity)):
                        held.append((doc, piece, start, ids[start : start + length]))
                    size += len(ids)
                    if size >= window:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, SCHEMA.format(key=id_type))


def write_packed(docs: DataFrame, out: str, **options) -> None:
    """Writes the packed rows as Parquet; ``ids`` is one row of the matrix."""
    pack(docs, **options).write.option("compression", "zstd").parquet(out)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each segment that was written; the crc is that of 32-bit little-endian ids.

    Lengths and offsets come from the position resets, which must agree with ``cu_seqlens``.
    """
    rows = spark.read.parquet(path)
    id_type = rows.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[] for _ in range(4)]
                for seq, n, width, blob, places, cu in zip(*(part.column(i).to_pylist() for i in range(6))):
                    ids = np.frombuffer(blob, f"<u{width}").astype("<u4")
                    bounds = [*np.flatnonzero(np.frombuffer(places, "<u4") == 0).tolist(), n]
                    if bounds != cu:
                        raise ValueError(f"positions of sequence {seq} do not start again where its segments do")
                    for a, b in zip(bounds, bounds[1:]):
                        for col, v in zip(out, (b - a, zlib.crc32(ids[a:b]), seq, a)):
                            col.append(v)
                flat = [part.column(i).flatten() for i in (6, 7, 8)]
                yield pa.RecordBatch.from_arrays([*flat, *(pa.array(c, pa.int64()) for c in out)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "packed")
    write_packed(table(spark, sf_dir, "documents"), out)
    return read_segments(spark, out)
