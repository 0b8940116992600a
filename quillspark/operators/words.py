"""Words and characters of a recognised line: their places from an alignment, and characters grouped by words."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def content_width(width: int, height: int, target_height: int, most: int) -> int:
    """The columns of a recogniser's input that hold the crop, scaled to a height; what follows is padding."""
    return 0 if width <= 0 or height <= 0 else min(most, max(1, math.ceil(target_height * (width / height))))


def corners(polygon: list[tuple[float, float]]) -> np.ndarray:
    """Top left, top right, bottom right and bottom left of a polygon, by the extremes of x + y and y - x; of fewer than four points the box's."""
    p = np.asarray(polygon, float)
    if len(p) < 4:
        (x0, y0), (x1, y1) = p.min(axis=0), p.max(axis=0)
        return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])
    total, turn = p.sum(axis=1), p[:, 1] - p[:, 0]
    return p[[total.argmin(), turn.argmin(), total.argmax(), turn.argmax()]]


def on_quad(quad: np.ndarray, u: float, v: float) -> np.ndarray:
    top, bottom = quad[0] + (quad[1] - quad[0]) * u, quad[3] + (quad[2] - quad[3]) * u
    return top + (bottom - top) * v


def to_crop(u: float, v: float, crop: tuple[float, float], patch: tuple[float, float], degrees: float) -> tuple[float, float]:
    """A place on a patch that was turned clockwise onto a larger canvas, as a place on the crop: both in fractions."""
    if degrees % 360 == 0 or min(crop) <= 0:
        return u, v
    a = math.radians(degrees)
    dx, dy = (u - 0.5) * patch[0], (v - 0.5) * patch[1]
    inside = lambda x: min(1.0, max(0.0, x))
    return inside((dx * math.cos(a) + dy * math.sin(a)) / crop[0] + 0.5), inside((dy * math.cos(a) - dx * math.sin(a)) / crop[1] + 0.5)


def geometry(polygon, alignment: list[tuple[str, float, int, int]], steps: int, content: int, padded: int, turn=None) -> tuple[list[tuple], list[tuple]]:
    """(words, characters) of a line, each (text, confidence, quad): characters stand where their steps lie in the part of the input that is no padding.

    ``turn``: (crop, patch, degrees) where the winning reading was of a turned crop. A word's confidence is the mean of its characters'.
    """
    if not alignment or steps <= 0 or content <= 0 or len(polygon) < 3:
        return [], []
    quad = corners(polygon)
    scale = max(1.0, padded / content) / steps
    place = lambda u, v: on_quad(quad, *(to_crop(u, v, *turn) if turn else (u, v)))
    span = lambda a, b: [tuple(place(u, v)) for u, v in ((a, 0), (b, 0), (b, 1), (a, 1))]
    marks = [(c, p, min(1.0, a * scale), min(1.0, (b + 1) * scale)) for c, p, a, b in alignment]
    characters = [(c, p, span(a, b)) for c, p, a, b in marks]
    words, held = [], []
    for mark in [*marks, (" ", 0.0, 0.0, 0.0)]:
        if not mark[0].isspace():
            held.append(mark)
        elif held:
            words.append(("".join(m[0] for m in held), sum(m[1] for m in held) / len(held), span(held[0][2], held[-1][3])))
            held = []
    return words, characters


def by_word(characters: Column, words: Column) -> Column:
    """The characters (value, ...) of each word in arrays; null unless they give the words' texts exactly, white space between them."""
    blank = lambda c: c["value"].rlike(r"(?U)^\s$")
    at = lambda i: F.get(characters, i)
    last = F.size(characters) - 1
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: ~blank(at(i)) & ((i == 0) | blank(at(i - 1))))
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: ~blank(at(i)) & ((i == last) | blank(at(i + 1))))
    groups = F.zip_with(starts, ends, lambda a, b: F.slice(characters, a + 1, b - a + 1))
    texts = F.transform(groups, lambda g: F.array_join(F.transform(g, lambda c: c["value"]), ""))
    return F.when((F.size(characters) > 0) & (texts == F.transform(words, lambda w: w["text"])), groups)
