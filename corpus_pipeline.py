"""A corpus pipeline: toxic documents go, copies go, near copies go, secrets are masked, the rest is packed.

Each stage takes the documents that the one before kept (with all their columns, as a written table) and
decides on all of them. Nulls, repeated rows and empty texts are treated as the operators say; a stage
returns the columns of its input, in their order, but for the last, which returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.best_fit import best_fit_packing
from quillspark.llm.common import SPACE_CLASS, materialise, table, text_or_empty
from quillspark.llm.exact_dedup import exact_dedup
from quillspark.llm.jaccard_join import row_key, survivors
from quillspark.llm.secrets import mask_secrets, scan_secrets
from quillspark.llm.toxicity import filter_toxic, fit


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring below the threshold; the model learns from labelled rows that aren't held out."""
    return filter_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the smallest id; of repeated rows of one id, one."""
    kept = materialise(exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("__qs_id"), F.col("text_sha256").alias("__qs_sha")), "kept")
    marked = docs.withColumn("__qs_text", F.sha2(F.regexp_replace(text_or_empty("text"), SPACE_CLASS + "+", ""), 256))
    stay = marked.join(kept, F.col("doc_id").eqNullSafe(F.col("__qs_id")) & (F.col("__qs_text") == F.col("__qs_sha")), "left_semi")
    one = Window.partitionBy("doc_id", "__qs_text").orderBy(F.length(text_or_empty("text")).desc())
    return stay.withColumn("__qs_row", F.row_number().over(one)).filter("__qs_row = 1").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over shingles of five words, the smallest id stays; of null or repeated ids, one row."""
    kept = materialise(survivors(docs).select(F.col("row").alias("__qs_key"), F.col("alone").alias("__qs_alone")), "kept")
    stay = docs.withColumn("__qs_key", row_key()).join(kept, "__qs_key")
    one = Window.partitionBy("__qs_key").orderBy("__qs_key")
    return stay.withColumn("__qs_row", F.row_number().over(one)).filter("__qs_row = 1 or __qs_alone").select(*docs.columns)


def mask_found_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; what the rules find in their texts is masked, and n_chars follows."""
    found = scan_secrets(docs, out="__qs_found")
    masked = found.withColumn("text", mask_secrets(found, "__qs_found"))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.size("__qs_found") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, placed in as few sequences as the plan finds."""
    return best_fit_packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("secret_scans", mask_found_secrets),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Toxicity, similarity links and packing are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None
