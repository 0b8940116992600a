"""Exact duplicate removal by deterministic block naming.

A text without ASCII white space is cut into blocks of fixed size. The distinct blocks are sorted and
named by their places in the order; then adjacent names are paired and the distinct pairs are named again,
level by level, until one name is left for each document. A name stands for one value only, so two documents
get the same (level, name) exactly when their texts are equal: nothing rests on a hash being free of
collisions. Blocks are ordered by their fingerprints, which spread evenly over ranges of the order whatever the
texts begin with; should two different blocks ever share one, level 0 orders and joins by the blocks themselves.
Names are ranks, so they don't depend on how the tables are partitioned (``named``).

Only DataFrame functions are used. Texts are read, normalised and cut once, into a written table that numbers the
rows; all else derives from that table. A block that a third of all documents share is collapsed before the
shuffle that names it (partial aggregation), and names reach the rows through joins of written tables,
whose skewed partitions adaptive execution splits.

Defined results: null text counts as empty; all empty texts form one group; a null id is a row like any
other (sorted last among ties); repeated ids and repeated rows each keep a row of output, and exactly
one row of a group is kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialise, table, text_or_empty

BLOCK_BYTES = 4096


def _fingerprint(block: Column) -> tuple[Column, Column]:
    return F.xxhash64(block), F.xxhash64(F.lit(7), block)


def _blocks(raw: Column, block_bytes: int) -> Column:
    """Fixed-size slices of a binary value; one empty block for an empty value."""
    last = F.greatest(F.ceil(F.octet_length(raw) / block_bytes).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)))


def named(values: DataFrame, order: list[str]) -> DataFrame:
    """Distinct rows with ``name``, their rank (from 0) in the order of the columns ``order``.

    The rows are dealt by ranges and sorted there; a range's ranks begin behind the rows of the ranges before it.
    """
    dealt = values.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialise(dealt, "dedup-names").withColumn("_range", F.shiftright("_at", 33))
    # a row for each partition: few, whatever the rows
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    firsts = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(firsts, "_range").withColumn("name", F.col("_first") + within).drop("_range", "_at", "_first")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, fingerprint=_fingerprint) -> DataFrame:
    """One row per input row: ``key``, keep_id, group_size, kept, text_sha256."""
    norm = F.regexp_replace(text_or_empty(text), SPACE_CLASS + "+", "")
    source = docs.select(F.col(key).alias("_id"), F.length(text_or_empty(text)).cast("long").alias("n_chars"), norm.alias("norm"))
    cut = materialise(
        source.withColumn("blocks", _blocks(F.col("norm").cast("binary"), block_bytes)).select(
            F.monotonically_increasing_id().alias("rid"),
            "_id",
            "n_chars",
            F.sha2(F.col("norm"), 256).alias("sha"),
            F.transform("blocks", lambda b: F.struct(*(h.alias(n) for h, n in zip(fingerprint(b), ("h1", "h2"))))).alias("prints"),
            "blocks",
        ),
        "dedup-rows",
    )

    pairs = cut.select(F.explode(F.arrays_zip("prints", "blocks")).alias("z")).select("z.prints.h1", "z.prints.h2", F.col("z.blocks").alias("block"))
    distinct = materialise(pairs.groupBy("h1", "h2", "block").agg(F.lit(0).alias("_")).select("h1", "h2"), "dedup-blocks")
    clash = distinct.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    number = [F.col("rid"), F.size("prints").cast("long").alias("n")]
    if clash.limit(1).count() == 0:
        names = named(distinct, ["h1", "h2"])
        rows = cut.select(*number, F.posexplode("prints").alias("pos", "p")).select("rid", "n", F.col("pos").cast("long").alias("pos"), "p.h1", "p.h2")
        on = ["h1", "h2"]
    else:
        # the fingerprints are not injective here: rows carry their blocks
        names = named(pairs.distinct(), ["h1", "h2", "block"]).select("block", "name")
        rows = cut.select(*number, F.posexplode("blocks").alias("pos", "block")).select("rid", "n", F.col("pos").cast("long").alias("pos"), "block")
        on = ["block"]
    current = materialise(rows.join(names, on).select("rid", "n", "pos", "name"), "dedup-level")

    done, level = [], 0
    while True:
        done.append(current.filter("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        open_rows = current.filter("n > 1")
        if open_rows.limit(1).count() == 0:
            break
        halves = (
            open_rows.groupBy("rid", F.expr("(n + 1) div 2").alias("n"), F.expr("pos div 2").alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"))
        )
        halves = materialise(halves, "dedup-pairs")
        names = named(halves.select("left", "right").distinct(), ["left", "right"])
        current = materialise(halves.join(names, ["left", "right"]).select("rid", "n", "pos", "name"), "dedup-level")
        level += 1

    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    ids = materialise(cut.drop("prints", "blocks").join(identity, "rid"), "dedup-ids")
    best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("rid").alias("r")))
    groups = materialise(ids.groupBy("level", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")
    return ids.join(groups, ["level", "name"]).select(
        F.col("_id").alias(key),
        F.col("best.i").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.r")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
     g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS r, count(*) OVER (PARTITION BY t) AS c
           FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, c AS group_size, r = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""
