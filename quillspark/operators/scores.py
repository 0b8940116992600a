"""Scores of readings: the orientation of a page and the languages that its largest boxes speak for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_orientation(readings: DataFrame) -> DataFrame:
    """(page, degrees, score) from (page, degrees, text, conf): confidence times length, summed over texts that are not blank.

    Scores are compared to six places; of equal ones the least angle wins. A page of blank texts has no row.
    """
    said = readings.filter(F.trim("text") != "").groupBy("page", "degrees").agg(F.round(F.sum(F.col("conf") * F.length("text")), 6).alias("score"))
    best = said.groupBy("page").agg(F.max(F.struct("score", (-F.col("degrees")).alias("turn"))).alias("best"))
    return best.select("page", (-F.col("best.turn")).alias("degrees"), F.col("best.score").alias("score"))


def dominant_packs(readings: DataFrame, boxes: int = 5, floor: float = 0.35, share: float = 0.85) -> DataFrame:
    """(page, pack, score) from (page, box_id, w, h, pack, conf, text): packs whose mean confidence on the page's largest boxes is near the best.

    The largest boxes are taken by area, then by id; a score is at least ``floor`` and at least ``share`` of the best one.
    """
    largest = Window.partitionBy("page").orderBy((F.col("w") * F.col("h")).desc(), "box_id")
    seen = readings.withColumn("place", F.dense_rank().over(largest)).filter((F.col("place") <= boxes) & (F.trim("text") != ""))
    scored = seen.groupBy("page", "pack").agg(F.round(F.avg("conf"), 6).alias("score"))
    best = F.max("score").over(Window.partitionBy("page"))
    return scored.withColumn("best", best).filter((F.col("best") > 0) & (F.col("score") >= F.greatest(F.lit(floor), F.lit(share) * F.col("best")))).drop("best")


def confident(readings: DataFrame, confidence: str, least: float) -> DataFrame:
    """Readings of at least that confidence."""
    return readings.filter(F.col(confidence) >= least)
