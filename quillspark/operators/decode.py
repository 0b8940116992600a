"""Decoding of recogniser output: greedy and beam CTC, choices between readings."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once


def best_classes(logits: Column, classes: int) -> Column:
    """The class (from 0) with the largest value of each step of a flat array, the first of equals."""
    steps = F.transform(F.sequence(F.lit(0), (F.size(logits) / classes).cast("int") - 1), lambda t: F.slice(logits, t * classes + 1, classes))
    return F.transform(steps, lambda s: F.array_position(s, F.array_max(s)).cast("int") - 1)


def ctc_text(picks: Column, characters: str) -> Column:
    """Collapsed text: a class counts where it differs from the step before and is not the blank (0)."""
    kept = F.filter(F.transform(picks, lambda c, t: F.when((c > 0) & ((t == 0) | (c != F.get(picks, t - 1))), c).otherwise(F.lit(0))), lambda c: c > 0)
    return F.array_join(F.transform(kept, lambda c: F.substring(F.lit(characters), c, F.lit(1))), "")


def log_softmax(logits: Column) -> Column:
    """Logarithms of the softmax of an array, computed from the differences to the largest."""
    total = lambda x, top: F.log(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - top)))
    shares = lambda x, top: once(total(x, top), lambda t: F.transform(x, lambda v: (v - top) - t))
    return once(logits, lambda x: once(F.array_max(x), lambda top: shares(x, top)))


def ctc_confidence(logits: Column, classes: int) -> Column:
    """exp(2 / sqrt(n) * sum of ln p) over the n steps of a flat array whose best class is not the blank; 0 for none."""
    steps = F.transform(F.sequence(F.lit(0), (F.size(logits) / classes).cast("int") - 1), lambda t: F.slice(logits, t * classes + 1, classes))
    share = lambda s: once(F.array_max(s).cast("double"), lambda top: -F.log(F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top))))
    shares = F.transform(F.filter(steps, lambda s: F.array_position(s, F.array_max(s)) > 1), share)
    mean = lambda x: F.when(F.size(x) > 0, F.exp(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v) * 2 / F.sqrt(F.size(x).cast("double")))).otherwise(F.lit(0.0))
    return once(shares, mean)


def greedy(logits: np.ndarray, characters: str, allowed: list[bool] | None = None) -> tuple[str, float, list[tuple[str, float, int, int]]]:
    """(text, confidence, alignment) of (steps, classes): the alignment has each character with the mean probability over its steps, and its first and last step.

    Class 0 is the blank; a NUL in the vocabulary is a separator. Characters that are not allowed are no classes.
    """
    x = np.asarray(logits, float)
    if allowed is not None:
        x = np.where([True, *allowed], x, -np.inf)
    best = x.argmax(axis=1)
    p = 1 / np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1)
    known = np.array([c > 0 and (c > len(characters) or characters[c - 1] != "\0") for c in best])
    runs = np.flatnonzero(np.diff(best, prepend=-1, append=-1))
    alignment = [(characters[best[a] - 1], float(p[a:b].mean()), int(a), int(b) - 1) for a, b in zip(runs, runs[1:]) if known[a] and best[a] <= len(characters)]
    n = int(known.sum())
    confidence = float(np.exp(2 / np.sqrt(n) * np.log(p[known]).sum())) if n else 0.0
    return "".join(a[0] for a in alignment), confidence, alignment


def uniform_alignment(text: str, confidence: float, steps: int) -> list[tuple[str, float, int, int]]:
    """The steps divided evenly between the characters: what stands for an alignment where there is none."""
    bounds = [i * steps // len(text) for i in range(len(text) + 1)] if text and steps > 0 else []
    return [(c, confidence, a, min(max(a, b - 1), steps - 1)) for c, a, b in zip(text, bounds, bounds[1:])]


def prefixes(words: list[str] | None) -> set[str] | None:
    """The beginnings of a lexicon's words in lower case; None for no lexicon."""
    found = {w.lower()[:i] for w in words or () for i in range(1, len(w) + 1)}
    return found or None


def may_follow(known: set[str] | None, text: str, ch: str) -> bool:
    """Whether a word of the lexicon may go on with the character; white space ends a word, and a word that is in no lexicon is free."""
    word = "" if not text or text[-1].isspace() else text.split()[-1]
    return known is None or ch.isspace() or (bool(word) and word.lower() not in known) or (word + ch).lower() in known


def beam_ctc(log_probs: np.ndarray, characters: str, width: int = 5, known: set[str] | None = None) -> tuple[str, float]:
    """Prefix beam search over (probability of ending in a blank, in a character); the best text and its probability.

    ``known``: the ``prefixes`` of a lexicon whose words alone may be begun.
    """
    beams = {"": (1.0, 0.0)}
    for step in np.exp(log_probs):
        grown: dict[str, list[float]] = {}
        for text, (blank, last) in beams.items():
            g = grown.setdefault(text, [0.0, 0.0])
            g[0] += (blank + last) * step[0]
            for c in np.argsort(-step[1:], kind="stable")[: max(2 * width, 8)]:
                ch, p = characters[c], step[c + 1]
                if not may_follow(known, text, ch):
                    continue
                if text and text[-1] == ch:
                    g[1] += last * p
                    grown.setdefault(text + ch, [0.0, 0.0])[1] += blank * p
                else:
                    grown.setdefault(text + ch, [0.0, 0.0])[1] += (blank + last) * p
        beams = dict(sorted(((t, tuple(p)) for t, p in grown.items()), key=lambda x: (-sum(x[1]), x[0]))[:width])
    text, p = max(beams.items(), key=lambda x: sum(x[1]))
    return text, float(sum(p))


def beam_decode(rows: DataFrame, key: str, logits: str, classes: int, characters: str, width: int = 5) -> DataFrame:
    """(key, text, confidence): confidence is the best prefix's probability to the power of one over its length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, flat in zip(pdf[key], pdf[logits]):
                x = np.asarray(flat, float).reshape(-1, classes)
                x = x - x.max(axis=1, keepdims=True)
                text, p = beam_ctc(x - np.log(np.exp(x).sum(axis=1, keepdims=True)), characters, width)
                out.append((k, text, min(1.0, max(0.0, p ** (1 / max(1, len(text)))))))
            yield pd.DataFrame(out, columns=[key, "text", "confidence"])

    return rows.select(key, logits).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, text string, confidence double")


def sequence(next_logits, start: int, end: int, most: int = 64, width: int = 1, penalty: float = 1.0, unscored: frozenset[int] = frozenset()) -> tuple[list[int], float, bool]:
    """(ids, confidence, whether the limit cut it short) of a decoder: ``next_logits(ids so far)`` gives an array, an empty one ends the text.

    Of ``width`` hypotheses those live on whose log-probability over the length to the power ``penalty`` is largest; finished ones
    compete with them. Confidence is the mean probability of the ids that count.
    """
    beams = [((), 0.0, 0.0, 0, 0, False)]  # ids, log-probability, that of scored ids, their number, length, finished
    rank = lambda total, n: total / n**penalty if n else total
    for _ in range(most):
        if all(b[5] for b in beams):
            break
        grown = []
        for ids, total, kept, n, length, finished in beams:
            logits = np.zeros(0) if finished else np.asarray(next_logits([start, *ids]), float)
            if not len(logits):
                grown.append((rank(total, length), (ids, total, kept, n, length, True)))
                continue
            share = logits - logits.max()
            share = share - np.log(np.exp(share).sum())
            for c in np.argsort(-logits, kind="stable")[: max(1, width)].tolist():
                p, ends = float(share[c]), c == end
                counts = not ends and c not in unscored
                # a greedy search does not count the end, a search by beams does
                grown.append((rank(total + p, length + 1), (ids if ends else (*ids, c), total + p, kept + p * counts, n + counts, length + 1, ends)))
        grown.sort(key=lambda g: -g[0])
        beams = [b for _, b in grown[: max(1, width)]]
    best = max([b for b in beams if b[5]] or beams, key=lambda b: rank(b[1], b[4]))
    return list(best[0]), min(1.0, float(np.exp(best[2] / best[3]))) if best[3] else 0.0, not best[5]


def vocabulary(text: str) -> list[str | None]:
    """The tokens by id of a JSON vocabulary: a list, a map from token to id, or such a map under ``vocab`` or ``model.vocab``."""
    root = json.loads(text)
    if isinstance(root, list):
        tokens = [x if isinstance(x, str) else None for x in root]
    else:
        named = root.get("model", {}).get("vocab") if isinstance(root.get("model"), dict) else None
        named = named or (root["vocab"] if isinstance(root.get("vocab"), dict) else root)
        ids = {i: t for t, i in named.items() if isinstance(i, int) and i >= 0}
        tokens = [ids.get(i) for i in range(max(ids, default=-1) + 1)]
    if not tokens:
        raise ValueError("the vocabulary has no tokens")
    return tokens


def characters(text: str) -> str:
    """A recogniser's vocabulary: a JSON string, or the text itself without the line end behind it."""
    out = json.loads(text) if text.lstrip().startswith('"') else text.rstrip("\r\n")
    if not out:
        raise ValueError("the vocabulary is empty")
    return out


def byte_symbols() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as itself, and the n-th of the others as code point 256 + n."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


def decode_ids(ids: list[int], tokens: list[str | None], special: frozenset[str] = frozenset({"<s>", "</s>", "<pad>", "<unk>", "<mask>"})) -> str:
    """The text of byte-level token ids; unknown and special ones are left out."""
    table = byte_symbols()
    known = (tokens[i] for i in ids if 0 <= i < len(tokens) and tokens[i] is not None and tokens[i] not in special)
    return b"".join(bytes([table[c]]) if c in table else c.encode() for t in known for c in t).decode("utf-8", "replace")


def best_reading(readings: DataFrame, box: list[str], score: Column, order: str, dominant: Column | None = None, margin: float = 0.1) -> DataFrame:
    """The reading of the largest score for each box, the first pack of equals; readings of the page's ``dominant`` pack gain ``margin``."""
    if dominant is not None:
        score = score + F.when(dominant, F.lit(Decimal(str(margin)))).otherwise(F.lit(0))
    return readings.withColumn("_n", F.row_number().over(Window.partitionBy(*box).orderBy(score.desc(), order))).filter("_n = 1").drop("_n")
