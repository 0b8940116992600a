"""Shared plumbing: table access, shared-folder tables and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where the session may name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillspark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quillspark/{kind}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialise(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage (a lost executor costs a re-read, never a recomputation with other ids) and
    tells the planner the real size, so that a later join broadcasts only what measures small and splits
    skewed partitions otherwise.
    """
    spark = df.sparkSession
    path = shared_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


#: Elements folded by one accumulator (an array that grows by copying), so that folding stays near linear.
RUN = 256


def bind(value: Column, body) -> Column:
    """``body`` of the value, which is evaluated once even where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_runs(values: Column) -> Column:
    """The array cut into arrays of ``RUN`` elements, the last one shorter; of an empty array none."""
    return bind(values, lambda v: F.transform(F.filter(F.sequence(F.lit(0), F.floor(F.size(v) / RUN).cast("int")), lambda r: r * RUN < F.size(v)), lambda r: F.slice(v, r * RUN + 1, F.lit(RUN))))


def running(values: Column, join) -> Column:
    """Running results of an associative ``join`` over an array of integers of zero or more (0 is neutral)."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = join(acc["at"], x)
        return F.struct(at.alias("at"), F.array_append(acc["out"], at).alias("out"))

    within = F.transform(in_runs(values), lambda run: F.aggregate(run, zero, step, lambda acc: acc["out"]))
    before = lambda runs: F.concat(F.array(F.lit(0)), F.aggregate(F.transform(runs, lambda run: F.element_at(run, -1)), zero, step, lambda acc: acc["out"]))
    return bind(within, lambda runs: F.flatten(F.zip_with(runs, F.slice(before(runs), F.lit(1), F.size(runs)), lambda run, at: F.transform(run, lambda x: join(x, at)))))


def held_out(doc_id: str | Column) -> Column:
    """Rows that no label may be learned from: crc32 of the id as text, modulo 4, is 2."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 4 == 2, F.lit(False))
