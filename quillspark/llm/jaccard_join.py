"""Similarity join on word shingles by Jaccard similarity.

A document's set holds 64-bit hashes of its distinct word shingles; of these sets the result is exact. Documents with
equal sets form a class and go on as one. Two sets whose similarity reaches the threshold share one of the first
``n - ceil(threshold * n) + 1`` members of either, in any order that is the same for all sets; here members
that very many documents have come last, the most frequent at the very end, and the others go by hash, so that common
passages make no tiles.

The classes that share such a member form a tile; tiles with the same least class are one. A tile of many classes is
cut by bands of set size, each twice the one below (a set is in its own band and in every one that a set it can link
to may be of). In a tile a hashed bitmap of each set bounds the overlap from above: a bit that one set has and the
other lacks stands for a member that is not shared. Pairs that the bound lets pass join their classes to candidate
components; within these the sets themselves are fetched, and pairs are decided by intersecting the sorted arrays.
Every link lies within a candidate component, so none is lost; a pair that is already connected needs no decision.
Components of the links come from joins (``components``).

No group of classes, tile or component, is gathered in one place. One of up to ``LARGE`` classes is cut into a few blocks,
and each pair of blocks is a task's work. A larger group does not meet itself block by block: it
is dealt into smaller blocks (``_dealt``). First each block compares its own classes, and each with a few pivots that
visit every block (``_at_home``). What this connects is contracted, and while much is left outside the group's
largest component, the classes with the most links so far visit every block, and those left outside as many blocks as
``MOVES`` allows (``_hubs``). At last all classes still outside visit all blocks (``_visits``): a pair within the
largest component needs no decision, and any other pair has a class outside it. So the rows moved grow with the
square only of what is not connected.

Defined results: null or empty text has an empty set, size 0, and is its own component; fewer words than a
shingle has make one shingle of the whole; repeated rows are of one class. A null id is a member like
any other, and every id is allowed, numbers or strings: classes go by numbers of their own, and texts are fetched by a
digest of id and text. A component of null ids alone has a null id. Other columns are ignored. An empty table gives an
empty result. The threshold is above 0 and at most 1, or an error is raised.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .components import connected_components

#: Bitmaps have one to two times as many bits as the sets of their size class have members, and at least these.
LEAST_BITS = 256
#: A member that over one document in ``COMMON`` has is taken last in the order.
COMMON = 2048
#: So many of the most frequent members are ordered by their frequency; the list only orders, any list gives the same result.
LISTED = 200_000
SMALL_TILE = 64
#: Groups of up to ``LARGE`` classes are cut into blocks of about ``WHOLE`` that meet in pairs, larger ones into blocks of about
#: ``BLOCK``; the sets of a block have about ``BLOCK_MEMBERS`` members in all at most.
LARGE, WHOLE, BLOCK, BLOCK_MEMBERS = 1024, 256, 64, 2_000_000
PIVOTS = 8
#: A task of visits has a block and so many guests.
GUESTS = 192
#: Rounds of hubs at most, and only while the visits of all that is left would move over so many times a group's rows.
ROUNDS, MOVES = 3, 3


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) | 1
        return h


_word_hashes = _WordHashes()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes (unsigned 64-bit) of the shingles of ``words`` words; A-Z are lower-cased, white space is ASCII's."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter((_word_hashes[w] for w in parts), np.uint64, n)
    if n < words:  # the whole sequence; its length keeps it apart from full shingles
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), n)], np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n - words + 1, np.uint64)
        for i in range(words):
            out = (out ^ h[i : n - words + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def size_class(n: int) -> int:
    """Sets of one class have bitmaps of ``2 ** class`` bits."""
    return max(LEAST_BITS.bit_length() - 1, int(n).bit_length())


def bands(n: int, threshold: Fraction) -> range:
    """The size classes of the sets of size n or more that a set of size n can link to."""
    return range(size_class(n), size_class(int(n / threshold)) + 1)


def bitmap(members: np.ndarray, cls: int) -> np.ndarray:
    bits = np.zeros(1 << cls, np.uint8)
    bits[(members >> np.uint64(17)) % np.uint64(1 << cls)] = 1
    return np.packbits(bits).view(np.uint64)


def prefix_size(n: int, threshold: Fraction) -> int:
    return n - ceil(threshold * n) + 1 if n else 0


def least_overlap(a, b, threshold: Fraction):
    """The least intersection of sets of sizes a and b that link: ceil(t / (1 + t) * (a + b))."""
    p, q = threshold.numerator, threshold.numerator + threshold.denominator
    return -((-(a + b) * p) // q)


def _common_members(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that more than one document in ``COMMON`` has, nearly, and their frequencies: counted over all texts, in runs of documents of which a run reports what is common in it.

    At most ``LISTED`` of them, the most frequent, whatever the number of documents. The list only orders the members; every
    list gives the same result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs_held, size = [], 0, 0

        def report():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= max(4, docs_held // (2 * COMMON))
            keep &= counts * COMMON >= docs_held
            return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64)), pa.array([docs_held] + [0] * (int(keep.sum()) - 1) if keep.any() else [], pa.int64())], ["h", "n", "docs"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shingle_set(text, words)
                held.append(s)
                docs_held += 1
                size += len(s)
                if size >= 3_000_000:
                    yield report()
                    held, docs_held, size = [], 0, 0
        if held:
            yield report()

    parts = docs.select(F.col("_text")).mapInArrow(run, "h long, n long, docs long")
    totals = materialise(parts.groupBy("h").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "common")
    rows = totals.agg(F.sum("docs").alias("docs")).collect()[0]["docs"] or 0
    listed = totals.filter(F.col("n") * COMMON >= rows).orderBy(F.desc("n"), "h").limit(LISTED).select("h", "n").collect()
    h, n = np.array([r["h"] for r in listed], np.int64).view(np.uint64), np.array([r["n"] for r in listed], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def in_order(members: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The members with the common ones last, the most frequent at the end."""
    if not len(common) or not len(members):
        return members
    at = np.minimum(np.searchsorted(common, members), len(common) - 1)
    late = common[at] == members
    return np.concatenate([members[~late], members[late][np.argsort(often[at[late]], kind="stable")]])


def _describe(docs: DataFrame, words: int, threshold: Fraction, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, row, n, print, prefix, bits) for each row; ``bits`` are bitmaps by size class, one for each of the set's bands."""
    id_type = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, prints, prefixes, bits = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text, words)
                    sizes.append(len(s))
                    prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    prefixes.append(in_order(s, *common)[: prefix_size(len(s), threshold)].view(np.int64))
                    bits.append([{"cls": k, "map": bitmap(s, k).tobytes()} for k in bands(len(s), threshold)])
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(prefixes), pa.int64())), pa.array(bits, pa.list_(pa.struct([("cls", pa.int32()), ("map", pa.binary())])))],
                    ["id", "row", "n", "print", "prefix", "bits"],
                )

    return docs.select("_id", "_text", "_row").mapInArrow(run, f"id {id_type}, row binary, n long, print binary, prefix array<long>, bits array<struct<cls:int,map:binary>>")


def _groups(keys: list[np.ndarray]) -> np.ndarray:
    """Bounds of the runs of equal keys in sorted columns."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    change = np.zeros(n - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]])


def _passes(bits: np.ndarray, n: np.ndarray, i, j, threshold: Fraction) -> np.ndarray:
    """Whether the bitmaps let pairs (i, j) reach the overlap that links them."""
    a, b = bits[i], bits[j]
    ni, nj = n[i], n[j]
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(ni - only_a, nj - only_b) >= least_overlap(ni, nj, threshold)


def _whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str], most_rows: int = 4096, most_bytes: int = 1 << 25) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """A stream sorted by ``keys`` in tables of whole runs of equal keys, with the bounds of the runs; memory holds about ``most_bytes`` and one run."""
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def cut(last: bool):
        table = pa.Table.from_batches(held).combine_chunks()
        bounds = _groups([table.column(k).to_numpy() for k in keys])
        return table, bounds if last else bounds[:-1]

    for batch in batches:
        for at in range(0, batch.num_rows, most_rows):
            part = batch.slice(at, most_rows)
            held.append(part)
            rows, size = rows + part.num_rows, size + part.nbytes
            if rows >= most_rows or size >= most_bytes:
                table, bounds = cut(False)
                done = int(bounds[-1])
                if done:
                    yield table.slice(0, done), bounds
                held = table.slice(done).to_batches()
                rows = size = 0  # the run left over grows by as much again before it is looked at
    if held:
        table, bounds = cut(True)
        if table.num_rows:
            yield table, bounds


def _pairs(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs (a, b) as batches."""
    if found:
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _allowed(x, y, label: np.ndarray, guest: np.ndarray, visits: bool) -> np.ndarray:
    """Whether pairs are to be compared: never two guests, nor what is connected; of a visit only guests with those at home."""
    apart = label[x] != label[y]
    return apart & (guest[x] ^ guest[y]) if visits else apart & ~(guest[x] & guest[y])


def _forest(n: np.ndarray, label: np.ndarray, guest: np.ndarray, visits: bool, threshold: Fraction, near, sure=None) -> list[tuple[int, int]]:
    """Pairs (x, y) of a spanning forest of those that ``near`` (of many) and ``sure`` (of one) accept; rows ascend by n."""
    label = np.unique(label, return_inverse=True)[1]
    out = []
    for x in range(len(n) - 1):
        js = np.arange(x + 1, np.searchsorted(n, n[x] * threshold.denominator // threshold.numerator, side="right"))
        js = js[_allowed(x, js, label, guest, visits)]
        for y in near(x, js) if len(js) else ():
            if label[y] != label[x] and (sure is None or sure(x, y)):
                label[label == label[y]] = label[x]
                out.append((x, y))
    return out


def _tile_candidates(threshold: Fraction, visits: bool):
    """Candidate pairs of tiles: rows sorted by (band, tile, i, j, n). Large tiles give a spanning forest of their candidates."""

    def tile_pairs(rows: pa.Table, bounds: np.ndarray) -> list[np.ndarray]:
        col = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
        rep, n, label, guest = col("id"), col("n"), col("label"), col("guest").astype(bool)
        bits = np.frombuffer(b"".join(rows.column("map").to_pylist()), np.uint64).reshape(len(rep), -1)
        sizes = np.diff(bounds)
        out = []
        group = np.repeat(np.arange(len(sizes)), sizes)
        few = np.repeat(sizes <= SMALL_TILE, sizes)
        for d in range(1, min(SMALL_TILE, int(sizes.max()))):
            i = np.flatnonzero((group[d:] == group[:-d]) & few[d:])
            if not len(i):
                break
            step = max(1, (1 << 22) // bits.shape[1])
            for s in range(0, len(i), step):
                x = i[s : s + step]
                x = x[(n[x] * threshold.denominator >= n[x + d] * threshold.numerator) & _allowed(x, x + d, label, guest, visits)]
                x = x[_passes(bits, n, x, x + d, threshold)]
                out.append(np.stack([rep[x], rep[x + d]], axis=1))
        for g in np.flatnonzero(sizes > SMALL_TILE):
            lo, hi = bounds[g], bounds[g + 1]
            own, of = bits[lo:hi], n[lo:hi]
            near = lambda x, js: js[_passes(own, of, np.full(len(js), x), js, threshold)]
            if found := _forest(of, label[lo:hi], guest[lo:hi], visits, threshold, near):
                out.append(rep[lo:hi][np.array(found)])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_keys(batches, ["band", "tile", "i", "j"]):
            band = rows.column("band").to_numpy()
            wide = _groups([band])
            found = []
            for lo, hi in zip(wide, wide[1:]):  # bitmaps of a band are of one width
                inside = bounds[(bounds >= lo) & (bounds <= hi)] - lo
                found += tile_pairs(rows.slice(lo, hi - lo).combine_chunks(), inside)
            yield from _pairs(found)

    return run


def _decide(threshold: Fraction, visits: bool):
    """Links of blocks of candidate components, a spanning forest of each: rows sorted by (comp, i, j, n)."""

    def links(rows: pa.Table) -> np.ndarray | None:
        col = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
        rep, n, label, guest = col("id"), col("n"), col("label"), col("guest").astype(bool)
        sets = [np.frombuffer(m, np.uint64) for m in rows.column("members").to_pylist()]
        width = size_class(int(np.median(n)))  # any width gives a right bound
        bits = np.stack([bitmap(s, width) for s in sets])
        near = lambda x, js: js[_passes(bits, n, np.full(len(js), x), js, threshold)]

        def sure(x, y) -> bool:
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            return both * threshold.denominator >= threshold.numerator * (int(n[x]) + int(n[y]) - both)

        found = _forest(n, label, guest, visits, threshold, near, sure)
        return rep[np.array(found)] if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_keys(batches, ["comp", "i", "j"]):
            found = [links(rows.slice(lo, hi - lo).combine_chunks()) for lo, hi in zip(bounds, bounds[1:]) if hi - lo > 1]
            yield from _pairs([f for f in found if f is not None])

    return run


def _dealt(members: DataFrame, group: list[str]) -> DataFrame:
    """``members`` (group, id, n) of groups of two or more, with their size, whether the group is large, the number of blocks and their own block."""
    sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("_all")).filter("size > 1")
    large = F.col("size") > LARGE
    blocks = F.greatest(F.ceil(F.col("size") / F.when(large, F.lit(BLOCK)).otherwise(F.lit(WHOLE))), F.ceil(F.col("_all") / BLOCK_MEMBERS)).cast("int")
    sizes = materialise(sizes.select(*group, "size", large.alias("large"), blocks.alias("blocks")), "sizes")
    return materialise(members.join(sizes, group).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "dealt")


def _at_home(dealt: DataFrame, group: list[str]) -> DataFrame:
    """Each class of a large group in its own block (i, 0), with about ``PIVOTS`` classes, the same for all blocks, as guests; of another group in every pair (i, j) of blocks that its own is part of."""
    pivot = F.col("large") & (F.pmod(F.xxhash64("id", F.lit(3)), F.col("size")) < PIVOTS)
    placed = dealt.withColumn("_at", F.explode(F.when(pivot | ~F.col("large"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))))
    pair = lambda large, other: F.when(F.col("large"), large).otherwise(other)
    return placed.select(
        *group, pair(F.col("_at"), F.least("own", "_at")).alias("i"), pair(F.lit(0), F.greatest("own", "_at")).alias("j"),
        "id", "n", F.col("id").alias("label"), (F.col("large") & (F.col("_at") != F.col("own"))).alias("guest"),
    )


def _left_over(dealt: DataFrame, group: list[str], found: DataFrame) -> tuple[DataFrame, float] | None:
    """Large groups that ``found`` does not connect wholly, with each class's label, the label of the largest component and the number left outside; and the rows that visits of these would move, in rows of the groups."""
    names = found.select(F.col("id").alias("_f"), F.col("comp").alias("_c"))
    large = dealt.filter("large").join(names, F.col("id") == F.col("_f"), "left").withColumn("label", F.coalesce("_c", "id")).drop("_f", "_c")
    tally = large.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("c"))
    most = tally.groupBy(*group).agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("all"))
    most = most.select(*group, F.col("most.label").alias("main"), (F.col("all") - F.col("most.c")).alias("rest")).filter("rest > 0")
    large = materialise(large.join(most, group), "left-over")
    moved = F.ceil(F.col("rest") / GUESTS) + F.when(F.col("label") != F.col("main"), F.col("blocks")).otherwise(F.lit(0))
    cost = large.agg(F.avg(moved)).first()[0]
    return (large, float(cost)) if cost is not None else None


def _visited(home: DataFrame, guests: DataFrame, group: list[str]) -> DataFrame:
    """Classes in their own blocks, and guests in every block."""
    home = home.withColumn("i", F.col("own")).withColumn("guest", F.lit(False))
    guests = guests.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("guest", F.lit(True))
    columns = [*group, "i", "j", "id", "n", "label", "guest"]
    return home.select(*columns).unionByName(guests.select(*columns))


def _hubs(left: DataFrame, group: list[str], links: DataFrame, seed: int) -> DataFrame:
    """As guests of every block the ``PIVOTS`` classes of each group with the most links, and as guests of some blocks those outside its largest component."""
    degree = links.select(F.explode(F.array("a", "b")).alias("_l")).groupBy("_l").agg(F.count(F.lit(1)).alias("_d"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_d"), "id"))
    known = materialise(left.join(degree, F.col("id") == F.col("_l")).withColumn("_p", place).filter(F.col("_p") <= PIVOTS).drop("_l", "_d", "_p"), "hubs")
    left = left.withColumn("j", F.lit(0))
    placed = _visited(left, known.withColumn("j", F.lit(0)), group)
    # blocks in a row from one of its own, so that the guests are spread evenly
    some = F.least(F.col("blocks") - 1, F.greatest(F.lit(1), F.floor(F.col("size") * (MOVES - 1) / F.col("rest")).cast("int")))
    first = F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int")
    at = F.transform(F.sequence(F.lit(0), some - 1), lambda k: F.pmod(first + k, F.col("blocks")).cast("int"))
    outside = left.filter("label <> main").withColumn("i", F.explode(F.filter(at, lambda i: i != F.col("own")))).withColumn("guest", F.lit(True))
    return placed.unionByName(outside.select(*placed.columns))  # a class that is in a block twice has one label, so it isn't compared with itself


def _visits(left: DataFrame, group: list[str]) -> DataFrame:
    """The classes outside their group's largest component as guests of every block."""
    parts = F.ceil(F.col("rest") / GUESTS).cast("int")
    home = left.withColumn("j", F.explode(F.sequence(F.lit(0), parts - 1)))
    guests = left.filter("label <> main").withColumn("j", F.pmod(F.xxhash64("id", F.lit(5)), parts).cast("int"))
    return _visited(home, guests, group)


def _components_of(members: DataFrame, group: list[str], payload, decide) -> DataFrame:
    """Components (id, comp) of the pairs within groups that ``decide(visits)`` accepts, of rows that ``payload`` adds to."""
    dealt = _dealt(members, group)

    def links_of(placed: DataFrame, visits: bool) -> DataFrame:
        keys = [*group, "i", "j"]
        rows = payload(placed).repartition(*keys).sortWithinPartitions(*keys, "n", "id")
        return materialise(rows.mapInArrow(decide(visits), "a long, b long"), "links")

    links = links_of(_at_home(dealt, group), False)
    found = connected_components(links)
    if not dealt.filter("large").limit(1).count():
        return found
    for turn in range(ROUNDS + 1):
        left = _left_over(dealt, group, found)
        if left is None:
            break
        last = turn == ROUNDS or left[1] <= MOVES
        more = links_of(_visits(left[0], group) if last else _hubs(left[0], group, links, 11 + turn), True)
        found = connected_components(more.unionByName(found.select(F.col("id").alias("a"), F.col("comp").alias("b"))))
        if last:
            break
        links = links.unionByName(more)
    return found


def row_key(key: str = "doc_id", text: str = "text") -> Column:
    """A digest of id and text, nulls told apart: rows that share it agree in both."""
    t = F.col(text).cast("string")
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.when(t.isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce(t, F.lit(""))), 256))


def _linked(docs: DataFrame, key: str, text: str, words: int, threshold: Fraction | float) -> DataFrame:
    """(id, row, n, class_id, component_id, comp) of each row: the least ids of class and component, and the component's own number; all three are null where the set is empty."""
    t = threshold if isinstance(threshold, Fraction) else Fraction(threshold).limit_denominator(1000)
    if not 0 < t <= 1:
        raise ValueError(f"a threshold of {threshold} is not above 0 and at most 1")
    base = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text"), row_key(key, text).alias("_row"))
    rows = materialise(_describe(base, words, t, _common_members(base, words)), "sets")
    filled = rows.filter("n > 0")
    classes = materialise(
        filled.groupBy("print", "n")
        .agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("least"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
        .select("print", "n", F.monotonically_increasing_id().alias("id"), F.col("least.id").alias("class_id"), "least.row", "prefix", "bits"),
        "classes",
    )

    posts = classes.select(F.explode("prefix").alias("token"), "id", "n")
    # a tile is named by its least class, so the tiles that one family of texts makes fall together and each class goes into them once
    live = materialise(posts.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("tile")).filter("df > 1").select("token", "tile"), "tokens")
    placed = materialise(posts.join(live, "token").select("tile", "id", "n").distinct(), "posts")
    # the size classes of the bitmaps are the bands
    cls_of = lambda n: F.greatest(F.lit(size_class(0)), F.length(F.bin(n)))
    banded = placed.withColumn("band", F.explode(F.sequence(cls_of(F.col("n")), cls_of(F.expr(f"n * {t.denominator} div {t.numerator}")))))
    maps = classes.select("id", F.explode("bits").alias("b")).select("id", F.col("b.cls").alias("band"), "b.map")
    candidates = _components_of(banded, ["band", "tile"], lambda rows: rows.join(maps, ["id", "band"]), lambda visits: _tile_candidates(t, visits))

    # a class is represented by one text: rows of its key agree in it, and repeated ones go
    members = materialise(candidates.join(classes.select("id", "n", "row"), "id"), "members")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(x, words).tobytes() for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sets, pa.binary())], [*part.schema.names[:-1], "members"])

    def with_sets(placed: DataFrame) -> DataFrame:
        """A text is fetched and cut once, whatever the number of its places. The join has one plan at every size."""
        places = placed.groupBy("id").agg(F.collect_list(F.struct(*(c for c in placed.columns if c != "id"))).alias("at"))
        wanted = members.select("id", "row").join(places, "id")
        texts = base.join(wanted.hint("merge"), base["_row"] == wanted["row"]).select("id", "row", "at", "_text").dropDuplicates(["id", "row"]).select("id", "at", "_text")
        sets = texts.mapInArrow(fetch, f"id long, at {places.schema['at'].dataType.simpleString()}, members binary")
        return sets.select("id", "members", F.explode("at").alias("at")).select("id", "members", "at.*")

    found = _components_of(members.select("comp", "id", "n"), ["comp"], with_sets, lambda visits: _decide(t, visits))

    # a component's id is the least that its classes have
    of_comp = found.join(classes.select("id", "class_id"), "id").groupBy("comp").agg(F.min("class_id").alias("component_id"))
    linked = found.join(of_comp, "comp").select(F.col("id").alias("_id"), "comp", "component_id")
    named = classes.select("print", "n", "id", "class_id").join(linked, F.col("id") == F.col("_id"), "left").select(
        F.col("print").alias("p"), F.col("n").alias("m"), "class_id", F.when(F.col("_id").isNull(), F.col("class_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("comp", "id").alias("comp")
    )
    named = materialise(named, "named")
    joined = rows.join(named, (F.col("print") == F.col("p")) & (F.col("n") == F.col("m")), "left")
    return joined.select("id", "row", "n", "class_id", "component_id", "comp")


def similar_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: Fraction | float = 0.8) -> DataFrame:
    """One row per input row: ``key``, n_shingles, class_id (least id with the same set), component_id (least id reachable by links)."""
    return _linked(docs, key, text, words, threshold).select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: Fraction | float = 0.8) -> DataFrame:
    """(row, alone): the ``row_key`` of the row of the least id (null last) of each component, and that of every empty text, which is ``alone``."""
    linked = _linked(docs, key, text, words, threshold).withColumn("alone", F.col("n") == 0)
    groups = linked.groupBy("comp", "alone", F.when(F.col("alone"), F.col("row")).alias("own"))
    return groups.agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("least")).select("least.row", "alone")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"), words=3, threshold=Fraction(9, 10)).select("doc_id", "n_shingles", "component_id", "class_id")
