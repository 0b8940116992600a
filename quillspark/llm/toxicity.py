"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is read in windows;
each window is compressed with either dictionary, and the difference of the two lengths says which kind
of text it is closer to. The windows' differences are reduced to a few numbers for a document, and a
logistic curve fitted on other labelled rows turns those into a score whose threshold is calibrated.

Learning takes a bounded sample of labelled rows (``SAMPLE`` rows of each class at most, the first by a hash of the id),
never rows that are held out (crc32 of the id modulo 4 is 2). Scoring reads every whole text.

A word stands in its window as codes of ``CODE_BYTES`` bytes: digests of its lower-case form and of its first
``PREFIX`` characters. Real words of five or six bytes are too short for zstandard to gain from a reference;
as codes, each feature that a dictionary has saves the same, and what neither has costs the same under both.

Both dictionaries begin with one that zstandard's trainer makes of both classes' windows, so that common prose costs the
same under either. Each ends with one that the trainer makes of its own class's windows, which keep the features whose
document rates differ between the classes beyond chance: what a trainer finds frequent in whole windows is what all
prose has, and differences of that are noise. Copies are left out of the training. Where the trainer refuses (too few samples), the
features themselves make the dictionary.

Defined results: null text counts as empty; an empty text scores what the curve gives for no evidence,
below the threshold. Without labelled rows of both classes every score is 0. Repeated rows score alike.
Labels, language, source and id are no inputs of a score; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

SAMPLE = 1500
WINDOW = 32
DICT_BYTES = 16384
CODE_BYTES = 16
PREFIX = 4
PUNCTUATION = b".,!?;:\"'()[]{}*#"
TELLING = 3.0
NOISE = 0.3
CUT = 0.3


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]

    def scorer(self) -> "Scorer":
        return Scorer(self)


class _Codes(dict):
    """Word -> the codes of its features; kept for words met, and emptied when it holds many."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 100_000:
            self.clear()
        codes = self[word] = b"".join(map(code, features(word)))
        return codes


_codes = _Codes()


def code(feature: bytes) -> bytes:
    return hashlib.blake2b(feature, digest_size=CODE_BYTES).digest()


def words(text: str | None) -> list[bytes]:
    """Lower-case words without the punctuation around them."""
    return [w for x in (text or "").lower().encode("utf-8", "surrogatepass").split() if (w := x.strip(PUNCTUATION))]


def features(word: bytes) -> tuple[bytes, ...]:
    """The word, and its first characters where it is longer (so an inflected or compound form counts with its stem)."""
    start = word.decode("utf-8", "surrogatepass")[:PREFIX].encode("utf-8", "surrogatepass")
    return (word, start + b"*") if len(start) < len(word) else (word,)


def windows(text: str | None) -> list[bytes]:
    """The codes of each run of ``WINDOW`` words (the last may be shorter)."""
    codes = [_codes[w] for w in words(text)]
    return [b"".join(codes[i : i + WINDOW]) for i in range(0, len(codes), WINDOW)]


class Scorer:
    def __init__(self, model: ToxicityModel):
        how = zstandard.ZstdCompressionParameters.from_level(1, strategy=zstandard.STRATEGY_FAST, min_match=6, window_log=16, hash_log=15, write_content_size=False, write_dict_id=False)
        pack = lambda d: zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        self.toxic, self.ordinary, self.weights = pack(model.toxic), pack(model.ordinary), np.array(model.weights)

    def signals(self, text: str | None) -> np.ndarray:
        """1; and of the windows' gains with the toxic dictionary, in codes: the largest, the sum's logarithm, the mean, and whether there is one at all."""
        gains = [len(self.ordinary.compress(w)) - len(self.toxic.compress(w)) for w in windows(text)]
        if not gains:
            return np.array([1.0, 0, 0, 0, 0])
        g = np.array(gains, float) / CODE_BYTES
        g[np.abs(g) < NOISE] = 0
        return np.array([1.0, max(-4.0, min(4.0, g.max())), math.log1p(max(0.0, g.sum())), max(-2.0, min(2.0, g.mean())), float(g.max() > 0)])

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            return 0.0
        z = float(self.signals(text) @ self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _unlike(texts: list[str]) -> list[list[bytes]]:
    """The words of the texts, without those that share the least hash of their word triples with an earlier one: copies would make their words look telling."""
    seen: set[tuple[int, int]] = set()
    out = []
    for t in texts:
        ws = words(t)
        triples = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
        keys = {(seed, min(zlib.crc32(x, seed) for x in triples)) for seed in (1, 2, 3)}
        if not keys & seen:
            out.append(ws)
        seen |= keys
    return out


def _telling(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[list[bytes], list[bytes]]:
    """Features whose document rates differ between the classes by ``TELLING`` standard errors: those of toxic and those of ordinary text, the surest last."""
    a, b = (Counter(f for ws in docs for f in {f for w in set(ws) for f in features(w)}) for docs in (toxic, ordinary))
    sure = []
    for w in a.keys() | b.keys():
        p, q = (a[w] + 0.5) / (len(toxic) + 1), (b[w] + 0.5) / (len(ordinary) + 1)
        rate = (a[w] + b[w] + 1) / (len(toxic) + len(ordinary) + 2)
        z = (p - q) / math.sqrt(rate * (1 - rate) * (1 / (len(toxic) + 1) + 1 / (len(ordinary) + 1)))
        if abs(z) >= TELLING and max(p, q) >= 5 * min(p, q):
            sure.append((z, w))
    return [w for z, w in sorted(sure) if z > 0], [w for z, w in sorted(sure, reverse=True) if z < 0]


def _sample_windows(docs: list[list[bytes]], keep) -> list[bytes]:
    """The windows of the documents' codes, with the features that are to be kept."""
    out = []
    for ws in docs:
        codes = [code(f) for w in ws for f in features(w) if keep(f)]
        out += [b"".join(codes[i : i + WINDOW]) for i in range(0, len(codes), WINDOW)]
    return out


def _trained(windows_: list[bytes], size: int) -> bytes:
    """What zstandard's trainer makes of windows: segments of one code, the most frequent ones."""
    try:
        return zstandard.train_dictionary(size, windows_, k=CODE_BYTES, d=8).as_bytes()
    except zstandard.ZstdError:
        codes = Counter(w[i : i + CODE_BYTES] for w in windows_ for i in range(0, len(w), CODE_BYTES))
        return b"".join(c for c, _ in reversed(codes.most_common(size // CODE_BYTES)))


def train(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """Dictionaries from the first two thirds of each class, the curve from the rest."""
    if len(toxic) < 2 or len(ordinary) < 2:
        return ToxicityModel(b"", b"", ())
    a, b = 2 * len(toxic) // 3, 2 * len(ordinary) // 3
    first = _unlike(toxic[:a]), _unlike(ordinary[:b])
    strong, weak = map(set, _telling(*first))
    common = _trained(_sample_windows(first[0] + first[1], lambda f: f not in strong and f not in weak), DICT_BYTES // 2)
    own = [_trained(_sample_windows(docs, telling.__contains__), DICT_BYTES // 2) for docs, telling in zip(first, (strong, weak))]
    model = ToxicityModel(common + own[0], common + own[1], (0.0,) * 5)
    s = model.scorer()
    x = np.array([s.signals(t) for t in toxic[a:] + ordinary[b:]])
    y = np.array([1.0] * (len(toxic) - a) + [0.0] * (len(ordinary) - b))
    balance = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        r = p * (1 - p) * balance
        w += np.linalg.solve(x.T @ (x * r[:, None]) + 0.05 * np.eye(len(w)), x.T @ ((y - p) * balance) - 0.05 * w)
    # calibrate: shift the curve so that CUT falls where most training rows are told apart rightly
    z, best = x @ w, (-1.0, 0.0)
    for t in np.unique(np.concatenate([z - 1e-6, z + 1e-6])):
        hit = z >= t
        tp = float((hit & (y == 1)).sum())
        f1 = 2 * tp / max(1.0, hit.sum() + y.sum())
        if f1 > best[0] + 1e-12:
            best = (f1, t)
    rest = z[z < best[1]]
    middle = (best[1] + rest.max()) / 2 if len(rest) else best[1]
    w[0] += math.log(CUT / (1 - CUT)) - middle
    return ToxicityModel(model.toxic, model.ordinary, tuple(float(v) for v in w))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learns from at most ``sample`` rows of each class that aren't held out, the first by a hash of the id.

    An id with labels of both classes counts as toxic; of an id with several texts the least is learned from, so what is collected is bounded in rows.
    """
    marks = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id is not null and _y is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    marks = marks.filter(~held_out("_id"))
    # the ids first (bounded), then their texts: the scan of texts meets a broadcast of at most 2 * sample ids
    ranked = [marks.filter(F.col("_y") == y).orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(sample) for y in (1, 0)]
    chosen = ranked[0].unionByName(ranked[1])
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_id").filter("_t is not null").groupBy("_id", "_y").agg(F.min("_t").alias("_t"))
    rows = rows.orderBy(F.xxhash64("_id", F.lit(11)), "_id").collect()
    return train([r._t for r in rows if r._y == 1], [r._t for r in rows if r._y == 0])


def score_texts(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([scorer.score(t) for t in part.column(1).to_pylist()], pa.float64())], [key, "score"])

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"{key} {rows.schema[0].dataType.simpleString()}, score double")


def filter_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, all columns as they were."""
    names = docs.columns
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield part.filter(pa.array([scorer.score(t) < cut for t in part.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
