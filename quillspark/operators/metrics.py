"""Alignment of two texts with counts of operations, and the weighted distance of recognition errors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import CONFUSABLE

#: Two characters that look like one.
MERGED = {("rn", "m"), ("cl", "d"), ("vv", "w"), ("ri", "n")}


def align(reference: list, hypothesis: list, budget: int = 25_000_000) -> tuple[int, int, int, int]:
    """(hits, substitutions, insertions, deletions) of a least-cost alignment; equal ends are trimmed, and an error is raised over ``budget`` cells."""
    start = 0
    while start < min(len(reference), len(hypothesis)) and reference[start] == hypothesis[start]:
        start += 1
    tail = 0
    while tail < min(len(reference), len(hypothesis)) - start and reference[-1 - tail] == hypothesis[-1 - tail]:
        tail += 1
    a, b = reference[start : len(reference) - tail], hypothesis[start : len(hypothesis) - tail]
    if (len(a) + 1) * (len(b) + 1) > budget:
        raise ValueError("the texts are too long to align")
    row = [(j, 0, 0, j, 0) for j in range(len(b) + 1)]  # cost, hits, substitutions, insertions, deletions
    for i, x in enumerate(a, 1):
        new = [(i, 0, 0, 0, i)]
        for j, y in enumerate(b, 1):
            d = row[j - 1]
            if x == y:
                new.append((d[0], d[1] + 1, *d[2:]))
                continue
            up, left = row[j], new[j - 1]
            least = min(d[0], up[0], left[0])
            if d[0] == least:
                new.append((d[0] + 1, d[1], d[2] + 1, d[3], d[4]))
            elif up[0] == least:
                new.append((up[0] + 1, *up[1:4], up[4] + 1))
            else:
                new.append((left[0] + 1, *left[1:3], left[3] + 1, left[4]))
        row = new
    _, h, s, i, d = row[-1]
    return h + start + tail, s, i, d


_COUNTS = "struct<hits:int,substitutions:int,insertions:int,deletions:int>"


def _aligned(split, reference: Column, hypothesis: Column) -> Column:
    @F.pandas_udf(_COUNTS)
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align(split(p or ""), split(q or "")) for p, q in zip(x, y)], columns=["hits", "substitutions", "insertions", "deletions"])

    return run(reference, hypothesis)


def align_characters(reference: Column, hypothesis: Column) -> Column:
    return _aligned(list, reference, hypothesis)


def align_words(reference: Column, hypothesis: Column) -> Column:
    return _aligned(str.split, reference, hypothesis)


def weighted_distance(a: str, b: str) -> float:
    """Edit distance in which look-alikes cost 0.3 and a merge or split of look-alike pairs 0.4."""
    cost = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == 0 or j == 0:
                cost[i][j] = float(i + j)
                continue
            x, y = a[i - 1].lower(), b[j - 1].lower()
            same = 0.0 if a[i - 1] == b[j - 1] else 0.3 if min(x, y) + max(x, y) in CONFUSABLE else 1.0
            best = min(cost[i - 1][j - 1] + same, cost[i - 1][j] + 1, cost[i][j - 1] + 1)
            if i > 1:
                best = min(best, cost[i - 2][j - 1] + (0.4 if (a[i - 2 : i].lower(), y) in MERGED else 2.0))
            if j > 1:
                best = min(best, cost[i - 1][j - 2] + (0.4 if (b[j - 2 : j].lower(), x) in MERGED else 2.0))
            cost[i][j] = best
    return cost[-1][-1]


#: Cells of the tables that are filled at one time.
_CELLS = 4_000_000


def _lower_codes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The characters' numbers, and those of their lower-case forms (0 where that is not one character), a text in each row."""
    codes = np.zeros((len(texts), width), np.int64)
    for r, t in enumerate(texts):
        codes[r, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    known, at = np.unique(codes, return_inverse=True)
    lower = np.array([ord(c) if len(c) == 1 else 0 for c in (chr(k).lower() for k in known)], np.int64)
    return codes, lower[at].reshape(codes.shape)


def _is_pair(x: np.ndarray, y: np.ndarray, pairs) -> np.ndarray:
    hit = np.zeros(np.broadcast(x, y).shape, bool)
    for p in pairs:
        hit |= (x == ord(p[0])) & (y == ord(p[1]))
    return hit


def _merge_cost(first: np.ndarray, second: np.ndarray, other: np.ndarray) -> np.ndarray:
    """What it costs that two characters stand for another one."""
    cost = np.full(np.broadcast(first, second, other).shape, 2.0)
    for two, one in MERGED:
        cost[(first == ord(two[0])) & (second == ord(two[1])) & (other == ord(one))] = 0.4
    return cost


def weighted_distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``weighted_distance`` of many pairs, those of like lengths in one table: the same sums in the same order."""
    out = np.zeros(len(pairs))
    by_size: dict[tuple[int, int], list[int]] = {}
    for k, (a, b) in enumerate(pairs):
        by_size.setdefault((len(a), len(b)), []).append(k)
    for (n, m), members in by_size.items():
        step = max(1, _CELLS // (max(n, 1) * max(m, 1)))
        for first in range(0, len(members), step):
            own = members[first : first + step]
            out[own] = _table([pairs[k][0] for k in own], [pairs[k][1] for k in own], n, m)
    return out


def _table(left: list[str], right: list[str], n: int, m: int) -> np.ndarray:
    (a, la), (b, lb) = _lower_codes(left, n), _lower_codes(right, m)
    either = [p for c in CONFUSABLE for p in (c, c[::-1])]
    before, above = None, np.tile(np.arange(m + 1.0), (len(left), 1))
    for i in range(1, n + 1):
        x, low = a[:, i - 1 : i], la[:, i - 1 : i]
        same = np.where(x == b, 0.0, np.where(_is_pair(low, lb, either), 0.3, 1.0))
        best = np.minimum(above[:, :-1] + same, above[:, 1:] + 1)
        if i > 1:
            best = np.minimum(best, before[:, :-1] + _merge_cost(la[:, i - 2 : i - 1], low, lb))
        if m > 1:
            best[:, 1:] = np.minimum(best[:, 1:], above[:, :-2] + _merge_cost(lb[:, :-1], lb[:, 1:], low))
        row = np.empty_like(above)
        row[:, 0] = i
        for j in range(1, m + 1):
            row[:, j] = np.minimum(best[:, j - 1], row[:, j - 1] + 1)
        before, above = above, row
    return above[:, -1]


def weighted_distance_of(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(weighted_distances([(p or "", q or "") for p, q in zip(x, y)]))

    return run(a, b)
