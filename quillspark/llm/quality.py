"""Quality rules with adaptive thresholds.

Signals are computed once for each document: the mean word length, and shares of symbols, repeated lines, repeated words, capitals
and oddly ending words, each share by the rule of succession (one more than the count over two more than the whole), so that a short text
without a symbol doesn't look like a long one without. The distribution of each signal over the documents that pass the base rules is
gathered in quantile sketches, one for each language and source: logarithmic buckets with counts (relative error below
``ACCURACY``), so that two sketches merge by adding counts, in any order, with the same result. The
sketch of a (language, source) merges into that of its language and of the corpus; a group of under
``LEAST_ROWS`` documents takes its thresholds from the next wider one that has enough.

A threshold is a fence on the scale of logarithms: the quartile times the ratio of the quartiles to the power of ``FENCE``, Tukey's bound for values
that are far out. Nothing else decides it: there is no fixed cut-off and no least distance, and no label is looked at. The quartiles
are the outer edges of their buckets, so that a spread below the sketch's accuracy counts as that accuracy. Documents meet
their thresholds by a join on (language, source); the table of
thresholds is written first, so Spark broadcasts it only where its measured size allows it, and splits
skewed partitions otherwise.

Defined results: null text has no words and fails the base rules; null language or source is a group of
its own; a mean word length of no words is 0. Repeated rows are counted and returned each. Where no document of the corpus passes
the base rules there is no threshold. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
NOT_STARTS = bytes(range(0x80, 0xC0))

ACCURACY = 0.005
LEAST_ROWS = 200
FENCE = 3.0

#: signal: whether small values fail too
SIGNALS = {"word_length": True, "symbol_share": False, "dup_line_share": False, "repeat_share": False, "upper_share": False, "odd_word_share": False}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_odd_words"]
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of ``COUNTS`` for a text; see the module's contract for their meaning."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    repeated = 0
    if n >= 4:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        v = len(number)
        _, pairs = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)
        _, back, counts = np.unique(pairs[:-1].astype(np.int64) * v + ids[2:], return_inverse=True, return_counts=True)
        at = np.flatnonzero(counts[back] >= 2)
        if len(at):
            covered = np.zeros(n, bool)
            covered[at] = covered[at + 1] = covered[at + 2] = True
            repeated = int(covered.sum())
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    letters = len(raw.translate(None, SPACES + NOT_STARTS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    odd = sum(not w[-1:].isalpha() and w[-1] < 0x80 and w[-1] not in b".,;:'\")" for w in words)
    return n, letters, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), upper, odd


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            rows = [text_counts(t) for t in part.column("_text").to_pylist()]
            counts = np.array(rows, np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *(pa.array(counts[:, i]) for i in range(len(COUNTS)))], ["_key", "_lang", "_source", *COUNTS])


def document_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    rows = docs.select(F.col(key).alias("_key"), F.col(lang).cast("string").alias("_lang"), F.col(source).cast("string").alias("_source"), F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(_count, f"_key {rows.schema['_key'].dataType.simpleString()}, _lang string, _source string, {kinds}")


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _signal(name: str) -> Column:
    if name == "word_length":
        return F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    count, whole = {
        "symbol_share": ("n_symbols", "n_words"),
        "dup_line_share": ("n_dup_lines", "n_words"),
        "repeat_share": ("n_repeat_words", "n_words"),
        "upper_share": ("n_upper", "word_chars"),
        "odd_word_share": ("n_odd_words", "n_words"),
    }[name]
    return (F.col(count) + 1) / (F.col(whole) + 2)


_GAMMA, _LEAST = (1 + ACCURACY) / (1 - ACCURACY), 1e-9


def bucket(value: Column) -> Column:
    """The sketch's bucket of a value that is not negative: 0 below the least one told apart, else by its logarithm."""
    return F.when(value < _LEAST, F.lit(0)).otherwise(F.ceil(F.log(value / _LEAST) / math.log(_GAMMA)).cast("int") + 1)


def bucket_value(number: Column) -> Column:
    return F.when(number == 0, F.lit(0.0)).otherwise(F.pow(F.lit(_GAMMA), number - 1) * (2 * _LEAST / (1 + _GAMMA)))


def lower_edge(number: Column) -> Column:
    return F.when(number == 0, F.lit(_LEAST / _GAMMA)).otherwise(F.pow(F.lit(_GAMMA), number - 2) * _LEAST)


def upper_edge(number: Column) -> Column:
    return F.when(number == 0, F.lit(_LEAST)).otherwise(F.pow(F.lit(_GAMMA), number - 1) * _LEAST)


def sketch(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., signal, bucket, n): merging sketches is adding n over fewer columns."""
    long = counts.select(*by, F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), bucket(_signal(s)).alias("bucket")) for s in SIGNALS))).alias("s"))
    return long.groupBy(*by, "s.signal", "s.bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "signal", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by..., signal, n, q1, q3). A sketch has some thousand buckets at most, whatever the rows, so a list of them is small."""
    listed = sketches.groupBy(*by, "signal").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("n"))

    def at(q: float) -> Column:
        need = F.ceil(F.col("n") * q)
        zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("hit"))
        step = lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.coalesce(acc["hit"], F.when(acc["seen"] + x["n"] >= need, x["bucket"])).alias("hit"))
        return F.aggregate("b", zero, step, lambda acc: acc["hit"])

    return listed.select(*by, "signal", "n", lower_edge(at(0.25)).alias("q1"), upper_edge(at(0.75)).alias("q3"))


def thresholds(counts: DataFrame, least_rows: int = LEAST_ROWS, fence: float = FENCE) -> DataFrame:
    """A row for each (_lang, _source) of which a document passes the base rules: low_<signal> and high_<signal>."""
    groups = materialise(sketch(counts.filter(~_base_failed()), ["_lang", "_source"]), "sketches")
    langs, every = merge(groups, ["_lang"]), merge(groups, [])
    g, a, e = (quartiles(s, by) for s, by in ((groups, ["_lang", "_source"]), (langs, ["_lang"]), (every, [])))
    a = a.select(F.col("_lang").alias("l2"), F.col("signal").alias("s2"), F.col("n").alias("n2"), F.col("q1").alias("a1"), F.col("q3").alias("a3"))
    e = e.select(F.col("signal").alias("s3"), F.col("q1").alias("e1"), F.col("q3").alias("e3"))
    chosen = g.join(a, F.col("_lang").eqNullSafe(F.col("l2")) & (F.col("signal") == F.col("s2"))).join(e, F.col("signal") == F.col("s3"))
    pick = lambda own, wide, all_: F.when(F.col("n") >= least_rows, F.col(own)).when(F.col("n2") >= least_rows, F.col(wide)).otherwise(F.col(all_))
    chosen = chosen.select("_lang", "_source", "signal", pick("q1", "a1", "e1").alias("q1"), pick("q3", "a3", "e3").alias("q3"))
    out = []
    for s in SIGNALS:
        reach = F.pow(F.col("q3") / F.col("q1"), F.lit(float(fence)))
        out += [F.max(F.when(F.col("signal") == s, F.col("q1") / reach)).alias(f"low_{s}"), F.max(F.when(F.col("signal") == s, F.col("q3") * reach)).alias(f"high_{s}")]
    return chosen.groupBy("_lang", "_source").agg(*out)


def quality_filter(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per input row: ``key``, the counts, base_failed, the signals outside their fences, kept."""
    counts = materialise(document_counts(docs, key), "counts")
    limits = materialise(thresholds(counts, **options), "thresholds").withColumnsRenamed({"_lang": "l2", "_source": "s2"})
    joined = counts.join(limits, F.col("_lang").eqNullSafe(F.col("l2")) & F.col("_source").eqNullSafe(F.col("s2")), "left")
    failed = []
    for s, low in SIGNALS.items():
        bad = F.coalesce(_signal(s) > F.col(f"high_{s}"), F.lit(False))
        if low:
            bad = bad | F.coalesce(_signal(s) < F.col(f"low_{s}"), F.lit(False))
        failed.append(F.when(bad, F.lit(s)))
    outside = F.array_compact(F.array(*failed))
    return joined.select(F.col("_key").alias(key), *COUNTS, _base_failed().alias("base_failed"), outside.alias("outside")).withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_filter(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *COUNTS[:5], "base_failed", F.array_join("outside", ",").alias("outside"), "kept")
