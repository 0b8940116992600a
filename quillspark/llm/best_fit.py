"""Packing documents into sequences by the configuration linear program.

A configuration is a multiset of piece lengths that fits one sequence. The program (as few sequences as
cover the length histogram) is solved by multiplicative weights: each round prices the lengths, finds
the configurations of the largest value by knapsack dynamic programming over the capacity, takes a share of each, and
lowers the prices of what they cover too often. The fractional solution is rounded by largest remainder and the
program solved again for what is left; the last rest is packed best fit first, longest lengths first, also on the histogram. All of this sees at most
``capacity`` counts, whatever the number of documents, so it runs on the driver.

Pieces meet their places without the driver: a piece's rank among those of its length comes from counts
of (length, bucket), with about the square root of the largest count as buckets, so that a length which a
third of all documents share is ranked by many tasks; the rank then selects a slot of the plan, whose
size is bounded by the number of configurations.

Defined results: null text counts as empty and is one piece (its end id); documents of over ``capacity``
ids are cut, the first piece being the shorter; a null or repeated id is a row like any other, and
repeated rows get pieces of their own. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import materialise, table

CAPACITY = 2048
END_ID = 0
ROUNDS = 40
#: How often the program is solved for what is left over, and the rounds of each solution after the first.
SOLUTIONS, AGAIN = 24, 8
STEP = 0.1
#: A configuration of the rounded solution leaves at most so many places free; others go to the best fit.
SPARE = 1


def cut_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32) for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                source, rows = [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    ids = np.append(bpe.encode(t), np.uint32(END_ID)).astype("<u4")
                    for piece, (start, length) in enumerate(tokens.piece_bounds(len(ids), capacity)):
                        source.append(i)
                        rows.append((piece, start, length, zlib.crc32(ids[start : start + length])))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(source)), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], [key, "piece", "start", "length", "ids_crc32"]
                )

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"{key} {rows.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_configurations(lengths: np.ndarray, values: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """For each length the configuration of the largest value that holds it, from one table of the unbounded knapsack. ``lengths`` ascend."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    usable = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := usable[c]:
            offers = best[c - lengths[:n]] + values[:n]
            i = int(offers.argmax())
            if offers[i] > best[c] + 1e-12:
                best[c], pick[c] = offers[i], i
    sizes, picks, out = lengths.tolist(), pick.tolist(), []
    for length in sizes:
        config, c = {length: 1}, capacity - length
        while c > 0:
            if picks[c] < 0:
                c -= 1
            else:
                size = sizes[picks[c]]
                config[size] = config.get(size, 0) + 1
                c -= size
        out.append(config)
    return out


def fractional(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, step: float = STEP) -> list[tuple[dict[int, int], float]]:
    """Multiplicative weights on the configuration program: (configuration, times), covering no length more often than it occurs.

    Each round takes, for every length, a ``rounds``-th of its pieces in the best configuration that holds it; a length
    that the round covers more often than that becomes cheaper, one that it covers less often dearer.
    """
    if not histogram:
        return []
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[int(k)] for k in lengths], float)
    place_of = {int(k): i for i, k in enumerate(lengths)}
    price = lengths / capacity
    found: dict[tuple, float] = {}
    total = np.zeros(len(lengths))
    for _ in range(rounds):
        covered = np.zeros(len(lengths))
        for i, config in enumerate(best_configurations(lengths, price, capacity)):
            times = counts[i] / (rounds * config[int(lengths[i])])
            key = tuple(sorted(config.items(), reverse=True))
            found[key] = found.get(key, 0.0) + times
            for k, n in config.items():
                covered[place_of[k]] += n * times
        total += covered
        price = price * np.exp(-step * np.minimum(covered / counts * rounds - 1, 4))
        price *= (counts * lengths).sum() / capacity / (counts * price).sum()
    # scaled so that no length is covered more often than it occurs
    over = total / counts
    return [(dict(k), v / max(over[place_of[x]] for x, _ in k)) for k, v in found.items()]


def best_fit_rest(left: dict[int, int], capacity: int) -> Counter:
    """Best fit decreasing over counts: configuration (lengths in the order placed) -> number of sequences."""
    bins: dict[int, Counter] = {}
    for length in sorted((k for k, v in left.items() if v), reverse=True):
        todo = left[length]
        while todo:
            room = min((r for r, c in bins.items() if r >= length and c), default=None)
            if room is None:
                each = capacity // length
                full, rest = divmod(todo, each)
                for n, times in ((each, full), (rest, 1 if rest else 0)):
                    if times:
                        bins.setdefault(capacity - n * length, Counter())[(length,) * n] += times
                break
            config = next(iter(bins[room]))
            times = min(todo, bins[room][config])
            bins[room][config] -= times
            if not bins[room][config]:
                del bins[room][config]
            bins.setdefault(room - length, Counter())[(*config, length)] += times
            todo -= times
    out: Counter = Counter()
    for c in bins.values():
        out.update(c)
    return out


def by_program(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(configuration, number of sequences) that the program decides, and the counts that are left over.

    A fractional solution covers part of the histogram only, so the program is solved again for what is left. Each solution is
    rounded down, and then up, the largest remainders first, as far as pieces are left.
    """
    left = {k: v for k, v in histogram.items() if v}
    out = []
    for solved in range(SOLUTIONS):
        found = [(c, t) for c, t in fractional(left, capacity, rounds if not solved else AGAIN) if sum(k * n for k, n in c.items()) >= capacity - SPARE]
        before = len(out)
        for up in (0, 1):
            for config, times in sorted(found, key=lambda x: (-(x[1] % 1 if up else x[1]), sorted(x[0].items()))):
                n = min([up or int(times + 1e-9), *(left[k] // c for k, c in config.items())])
                if n > 0:
                    out.append((tuple(k for k, c in config.items() for _ in range(c)), n))
                    for k, c in config.items():
                        left[k] -= c * n
        left = {k: v for k, v in left.items() if v}
        if len(out) == before:
            break
    return out, left


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int, str]]:
    """(configuration, number of sequences, how it was found) for every piece of the histogram: a piece that is ``full``, the ``program`` or the best ``fit`` of what that leaves."""
    whole = {k: v for k, v in histogram.items() if k < capacity}
    out = [((capacity,), histogram[capacity], "full")] if histogram.get(capacity) else []
    decided, rest = by_program(whole, capacity, rounds)
    return out + [(*d, "program") for d in decided] + [(*f, "fit") for f in best_fit_rest(rest, capacity).items()]


FOUND = ("full", "program", "fit")


def slots(planned: list[tuple[tuple[int, ...], int, str]]) -> dict[str, np.ndarray]:
    """The plan as arrays sorted by (length, first rank): how many pieces a sequence takes there, its first sequence and offset, and how it was found."""
    rows, sequence, rank = [], 0, Counter()
    for config, times, how in planned:
        offset = 0
        for length, n in Counter(config).items():
            rows.append((length, rank[length], n, sequence, offset, FOUND.index(how)))
            rank[length] += n * times
            offset += n * length
        sequence += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return dict(zip(("length", "rank", "each", "sequence", "offset", "found"), a.T.copy()))


def place(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (written before) with sequence_id, offset and found: how the sequence was planned (``plan``)."""
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    where = slots(plan(histogram, capacity, rounds))
    buckets = int(np.ceil(np.sqrt(max(histogram.values(), default=1))))
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("length", "_bucket").orderBy(key, "piece", "ids_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(own) - 1).join(firsts, ["length", "_bucket"])
    ranked = ranked.select(key, "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_first")).alias("_rank"))
    names = [key, "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = 1 << 42
        order = where["length"] * big + where["rank"]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            i = np.searchsorted(order, length * big + rank, side="right") - 1
            copy, nth = np.divmod(rank - where["rank"][i], where["each"][i])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(where["sequence"][i] + copy), pa.array(where["offset"][i] + nth * length), pa.array(np.array(FOUND)[where["found"][i]], pa.string())], [*names, "sequence_id", "offset", "found"])

    kind = pieces.schema[key].dataType.simpleString()
    return ranked.mapInArrow(run, f"{key} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, found string")


def best_fit_packing(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    return place(materialise(cut_pieces(docs, path or tokens.default_path(), key, text, capacity), "pieces"), key, capacity, rounds)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
