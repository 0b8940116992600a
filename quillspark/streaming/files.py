"""Files of a directory as a stream of recognised lines, and results handed out in the order of their key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession

from ..sources.tables import recognise


def recognised_stream(spark: SparkSession, path: str, recogniser, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """New files of ``path`` through an injected recogniser, with the rows that ``sources.tables.recognised_files`` gives for them."""
    source = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(source).option("maxFilesPerTrigger", files_per_batch).load(path)
    return recognise(files.select("path", "content"), recogniser, schema)


def in_order(df: DataFrame, *keys: str) -> Iterator[Row]:
    """Rows in key order, one partition at the driver and the next on its way; later partitions are not held."""
    return df.orderBy(*keys).toLocalIterator(prefetchPartitions=True)
