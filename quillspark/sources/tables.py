"""Readers: the tables of a directory, and the synthetic page layout that the queries derive from line items."""

from __future__ import annotations

import fnmatch
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores: a small file of one row group is one task, however much work its rows are. Their number is fixed, so they are not merged by size."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism * 2)


def layout(spark: SparkSession, directory: str) -> DataFrame:
    """A box for each line item: page, box_id, x0, y0, w, h (whole numbers), conf, pack."""
    return table(spark, directory, "lineitem").select(
        F.col("l_orderkey").alias("page"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("box_id"),
        ((F.col("l_partkey") % 40) * 25).alias("x0"),
        (F.col("l_linenumber") * 30 + F.col("l_suppkey") % 7).alias("y0"),
        (F.col("l_partkey") % 60 + 40).alias("w"),
        (F.col("l_suppkey") % 5 + 18).alias("h"),
        F.round(1 - F.col("l_discount") * 5, 4).alias("conf"),
        (F.col("l_suppkey") % 3).alias("pack"),
    )


LAYOUT_SQL = """lay AS (SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS box_id, (l_partkey % 40) * 25 AS x0,
  l_linenumber * 30 + l_suppkey % 7 AS y0, l_partkey % 60 + 40 AS w, l_suppkey % 5 + 18 AS h, round(1 - l_discount * 5, 4) AS conf, l_suppkey % 3 AS pack FROM lineitem)"""


def recognise(files: DataFrame, recogniser, schema: str) -> DataFrame:
    """(path, content) through an injected recogniser: ``recogniser()`` is called once for a task and gives ``content -> list of rows``.

    Returns (path, <schema>, error); a file that fails gives one row with its error.
    """
    names = [f.name for f in files.sparkSession.createDataFrame([], schema).schema]

    def run(batches):
        read = recogniser()
        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"]):
                try:
                    out += [(name, *row, None) for row in read(bytes(content))]
                except Exception as e:  # one bad file must not end the scan: its error is its row
                    out.append((name, *[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", *names, "error"])

    return files.mapInPandas(run, f"path string, {schema}, error string")


def recognised_files(spark: SparkSession, path: str, recogniser, schema: str) -> DataFrame:
    """The files of a directory through ``recognise``."""
    return recognise(spark.read.format("binaryFile").load(path).select("path", "content"), recogniser, schema)


#: The image files that a folder is searched for.
IMAGES = (".bmp", ".gif", ".jpeg", ".jpg", ".pbm", ".png", ".tga", ".tif", ".tiff", ".webp")


def resolve_paths(tokens: list[str], recursive: bool = False, kinds: tuple[str, ...] = IMAGES) -> list[str]:
    """Files, folders and patterns (in the last part of a path) as files: each folder's in the order of their names, each once; an error for what matches nothing."""
    out: dict[str, None] = {}
    for token in tokens:
        folder, name = os.path.split(token.rstrip("/"))
        if os.path.isfile(token):
            found = [token]
        else:
            top, pattern = (token, "*") if os.path.isdir(token) else (folder or ".", name)
            tree = os.walk(top) if recursive else [next(os.walk(top), (top, [], []))]
            found = sorted(os.path.join(d, f) for d, _, files in tree for f in files if fnmatch.fnmatchcase(f, pattern) and f.lower().endswith(kinds))
        if not found:
            raise FileNotFoundError(f"nothing matches {token}")
        out.update(dict.fromkeys(found))
    return list(out)


def image_size(head: bytes) -> tuple[int, int] | None:
    """(width, height) from the first bytes of a PNG, GIF, BMP or JPEG file, without decoding it; None where they don't tell."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return int.from_bytes(head[16:20], "big"), int.from_bytes(head[20:24], "big")
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return int.from_bytes(head[6:8], "little"), int.from_bytes(head[8:10], "little")
    if head[:2] == b"BM" and len(head) >= 26:
        return int.from_bytes(head[18:22], "little", signed=True), abs(int.from_bytes(head[22:26], "little", signed=True))
    at = 2
    while head[:2] == b"\xff\xd8" and at + 9 <= len(head) and head[at] == 0xFF:
        kind, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(head[at + 7 : at + 9], "big"), int.from_bytes(head[at + 5 : at + 7], "big")
        at += 2 + size
    return None


def guarded(files: DataFrame, most_pixels: int = 100_000_000) -> DataFrame:
    """(path, content, error): empty files and images of over ``most_pixels`` have an error and no content, before anything decodes them."""

    @F.pandas_udf("string")
    def error(content: pd.Series) -> pd.Series:
        def of(c: bytes) -> str | None:
            size = image_size(c[:65536]) if c else None
            return "the file is empty" if not c else f"{size[0]} x {size[1]} pixels are too many" if size and size[0] * size[1] > most_pixels else None

        return content.map(of)

    told = files.select("path", "content", error("content").alias("error"))
    return told.withColumn("content", F.when(F.col("error").isNull(), F.col("content")))
