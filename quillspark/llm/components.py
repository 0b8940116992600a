"""Connected components of links, by contraction with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for every id that a link names; comp is the least id reachable.

    Each round points every node at its least neighbour, follows pointers twice, and replaces the links'
    ends by what they point at; links inside a component vanish, so a star is done in a round or two and a
    chain in a number of rounds that grows as the logarithm of its length. Tables are written between
    rounds, so that a hub's rows meet its pointer in joins that adaptive execution can split. ``links`` is read
    twice and may repeat: pass a written table. The pointers of the first round name every id, so they are the first labels.
    """

    def follow(t: DataFrame, c: str, point: DataFrame) -> DataFrame:
        return t.join(point.withColumnsRenamed({"u": "_u", "p": "_p"}), F.col(c) == F.col("_u"), "left").withColumn(c, F.coalesce("_p", c)).drop("_u", "_p")

    def pointers(current: DataFrame) -> DataFrame:
        both = current.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"))
        point = materialise(both.groupBy(F.col("e.u").alias("u")).agg(F.min("e.v").alias("v")).select("u", F.least("u", "v").alias("p")), "pointers")
        return materialise(follow(follow(point, "p", point), "p", point), "pointers")

    def contracted(current: DataFrame, point: DataFrame) -> DataFrame:
        moved = follow(follow(current, "a", point), "b", point).filter("a <> b")
        return materialise(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")

    current = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    point = pointers(current)
    ids, current = point.select(F.col("u").alias("id"), F.col("p").alias("comp")), contracted(current, point)
    while current.limit(1).count():
        point = pointers(current)
        ids, current = materialise(follow(ids, "comp", point), "labels"), contracted(current, point)
    return ids
