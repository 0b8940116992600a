"""Numeric work on pixel arrays and points, as numpy functions and as columns over flat arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels (1, 2, ... in the order of their first pixels by rows; 0 outside) of the 4-connected parts of a mask, and their number.

    Runs of each row are joined with those they touch in the row above, by union-find.
    """
    mask = np.asarray(mask, bool)
    parent: list[int] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    rows, above = [], []
    for line in mask:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(np.int8), [0]])))
        own = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            number = len(parent)
            parent.append(number)
            for c, d, other in above:
                if a < d and c < b:
                    x, y = sorted((find(number), find(other)))
                    parent[y] = x
            own.append((a, b, number))
        rows.append(own)
        above = own
    names: dict[int, int] = {}
    labels = np.zeros(mask.shape, np.int64)
    for y, own in enumerate(rows):
        for a, b, number in own:
            labels[y, a:b] = names.setdefault(find(number), len(names) + 1)
    return labels, len(names)


def component_boxes(labels: np.ndarray, n: int) -> list[tuple[int, int, int, int, int]]:
    """(min_x, min_y, max_x, max_y, area) of each label."""
    out = []
    for k in range(1, n + 1):
        y, x = np.nonzero(labels == k)
        out.append((int(x.min()), int(y.min()), int(x.max()), int(y.max()), len(x)))
    return out


def dilate(mask: np.ndarray, side: int) -> np.ndarray:
    """Binary dilation with a square of ``side`` pixels around its middle one."""
    out = np.asarray(mask, bool)
    for axis in (0, 1):
        moved = np.zeros_like(out)
        for shift in range(-(side // 2), side - side // 2):
            part = np.roll(out, -shift, axis)
            edge = [slice(None)] * 2
            edge[axis] = slice(out.shape[axis] - shift, None) if shift > 0 else slice(0, -shift)
            if shift:
                part[tuple(edge)] = False
            moved |= part
        out = moved
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull's corners, counter-clockwise."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    halves = []
    for way in (p, p[::-1]):
        half: list = []
        for q in way:
            while len(half) > 1 and turn(half[-2], half[-1], q) <= 0:
                half.pop()
            half.append(q)
        halves.append(half[:-1])
    return np.array(halves[0] + halves[1])


def min_area_rectangle(points: np.ndarray) -> np.ndarray:
    """Corners of the rectangle of the least area around points, the one nearest the origin's corner (least x + y) first, then clockwise on a page."""
    points = np.asarray(points, float)
    h = hull(points)
    low, high = points.min(axis=0), points.max(axis=0)
    if len(h) < 3:
        return np.array([low, [high[0], low[1]], high, [low[0], high[1]]])
    edges = np.roll(h, -1, axis=0) - h
    u = edges / np.linalg.norm(edges, axis=1, keepdims=True)
    v = np.stack([-u[:, 1], u[:, 0]], axis=1)
    along, across = u @ h.T, v @ h.T
    best = int(np.argmin((along.max(1) - along.min(1)) * (across.max(1) - across.min(1))))
    ends = [(along[best].min(), across[best].min()), (along[best].max(), across[best].min()), (along[best].max(), across[best].max()), (along[best].min(), across[best].max())]
    corners = np.array([a * u[best] + b * v[best] for a, b in ends])
    return np.roll(corners, -int(np.argmin(corners.sum(axis=1))), axis=0)


def polygon_spans(polygon: list[tuple[float, float]], width: int, height: int) -> list[tuple[int, int, int]]:
    """(y, first x, last x) of the pixels of an image whose centres lie in the polygon (even-odd; an edge holds its upper end and not its lower)."""
    if len(polygon) < 3 or width <= 0 or height <= 0:
        return []
    p = np.asarray(polygon, float)
    q = np.roll(p, -1, axis=0)
    out = []
    for y in range(max(0, int(np.floor(p[:, 1].min()))), min(height - 1, int(np.ceil(p[:, 1].max()))) + 1):
        line = y + 0.5
        cut = (p[:, 1] <= line) != (q[:, 1] <= line)
        x = np.sort(p[cut, 0] + (line - p[cut, 1]) / (q[cut, 1] - p[cut, 1]) * (q[cut, 0] - p[cut, 0]))
        for a, b in zip(x[::2], x[1::2]):
            first, last = max(0, int(np.ceil(a - 0.5))), min(width - 1, int(np.floor(b - 0.5)))
            if first <= last:
                out.append((y, first, last))
    return out


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(np.asarray(source, float), np.asarray(target, float)):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows), np.array(right)), 1.0).reshape(3, 3)


def warp(image: np.ndarray, corners: np.ndarray, width: int, height: int) -> np.ndarray:
    """The content of a quad (top left, top right, bottom right, bottom left), upright and sampled bilinearly; places outside the image repeat its edge."""
    h = homography([(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)], corners)
    y, x = np.mgrid[0:height, 0:width]
    u, v, w = h @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    u, v = np.clip(u / w, 0, image.shape[1] - 1), np.clip(v / w, 0, image.shape[0] - 1)
    i, j = np.minimum(v.astype(int), image.shape[0] - 2).clip(0), np.minimum(u.astype(int), image.shape[1] - 2).clip(0)
    a, b = v - i, u - j
    i1, j1 = np.minimum(i + 1, image.shape[0] - 1), np.minimum(j + 1, image.shape[1] - 1)
    out = image[i, j] * (1 - a) * (1 - b) + image[i, j1] * (1 - a) * b + image[i1, j] * a * (1 - b) + image[i1, j1] * a * b
    return out.reshape(height, width)


def heat_boxes(text: np.ndarray, link: np.ndarray, scale: tuple[float, float], size: tuple[int, int], text_limit: float = 0.7, link_limit: float = 0.4, low: float = 0.4, min_size: int = 10) -> list[np.ndarray]:
    """Quads on the image of a detector's text and link maps: parts of at least ``min_size`` pixels with a pixel of ``text_limit``, grown by what thresholding took."""
    inked, linked = np.asarray(text) > low, np.asarray(link) > link_limit
    labels, n = components(inked | linked)
    out = []
    for k, (x0, y0, x1, y1, area) in enumerate(component_boxes(labels, n), 1):
        own = labels == k
        if area < min_size or text[own].max() < text_limit:
            continue
        wide, tall = x1 - x0 + 1, y1 - y0 + 1
        grow = int(np.sqrt(area * min(wide, tall) / (wide * tall)) * 2)
        left, top = max(0, x0 - grow), max(0, y0 - grow)
        right, bottom = min(labels.shape[1] - 1, x1 + grow + 1), min(labels.shape[0] - 1, y1 + grow + 1)
        part = (own & ~(linked & ~inked))[top : bottom + 1, left : right + 1]
        y, x = np.nonzero(dilate(part, 1 + grow) if grow else part)
        if len(x) >= 3:
            out.append(np.clip(min_area_rectangle(np.stack([x + left, y + top], axis=1)) * scale, 0, size))
    return out


def box_blur(grey: np.ndarray, radius: int) -> np.ndarray:
    """Means over a square of whole numbers, cut off: first along rows, then along columns; at the edges over what is there."""
    out = np.asarray(grey, np.int64)
    for axis in (1, 0):
        n = out.shape[axis]
        sums = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis)], axis)
        first, last = np.maximum(np.arange(n) - radius, 0), np.minimum(np.arange(n) + radius, n - 1) + 1
        counts = (last - first).reshape((1, -1) if axis else (-1, 1))
        out = (np.take(sums, last, axis) - np.take(sums, first, axis)) // counts
    return out


def stretched(grey: np.ndarray, target: float = 0.5) -> np.ndarray:
    """Grey levels spread around their middle where the 10th and 90th percentiles lie nearer together than ``target``."""
    level = np.asarray(grey, float)
    s = np.sort(level.ravel())
    high, low = (s[int(np.floor(q * (len(s) - 1)))] for q in (0.9, 0.1))
    if (high - low) / max(10.0, high + low) >= target:
        return level
    ratio = 200.0 / max(10.0, high - low)
    return np.clip((level - low + 25) * ratio, 0, 255)


def luminance(rgb: np.ndarray) -> np.ndarray:
    """Whole-number grey levels of red, green and blue."""
    r, g, b = (np.asarray(rgb, np.int64)[..., i] for i in range(3))
    return (r * 306 + g * 601 + b * 117 + 512) >> 10


def outline(image: np.ndarray, polygon: list[tuple[int, int]], colour, thickness: int = 1) -> np.ndarray:
    """A copy of the image with the polygon's edges drawn."""
    out = image.copy()
    for (x0, y0), (x1, y1) in zip(polygon, [*polygon[1:], polygon[0]]):
        n = max(abs(x1 - x0), abs(y1 - y0), 1)
        for x, y in zip(np.rint(np.linspace(x0, x1, n + 1)).astype(int), np.rint(np.linspace(y0, y1, n + 1)).astype(int)):
            at = [slice(max(0, c - thickness // 2), max(0, c - thickness // 2 + thickness)) for c in (y, x)]
            out[tuple(at)] = colour
    return out


def redacted(image: np.ndarray, polygon: list[tuple[float, float]], how: str = "fill", amount: int = 8) -> np.ndarray:
    """A copy of a grey image whose pixels in the polygon are filled with black, blurred or replaced by means of blocks."""
    out = image.copy()
    if how == "blur":
        new = box_blur(image, amount)
    elif how == "pixelate":
        new = np.zeros_like(image)
        for y in range(0, image.shape[0], amount):
            for x in range(0, image.shape[1], amount):
                part = np.s_[y : y + amount, x : x + amount]
                new[part] = int(image[part].sum()) // image[part].size
    elif how == "fill":
        new = np.zeros_like(image)
    else:
        raise ValueError(f"no way of redaction is named {how}")
    for y, a, b in polygon_spans(polygon, image.shape[1], image.shape[0]):
        out[y, a : b + 1] = new[y, a : b + 1]
    return out


def component_stats(flat: Column, width: int, limit: float, min_size: int = 1) -> Column:
    """(label, min_x, min_y, max_x, max_y, area) of the parts of a flat array of rows that lie above a limit and have ``min_size`` pixels."""
    kind = "array<struct<label:int,min_x:int,min_y:int,max_x:int,max_y:int,area:int>>"

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        out = []
        for v in x:
            labels, n = components(np.asarray(v, float).reshape(-1, width) > limit)
            out.append([dict(zip(("label", "min_x", "min_y", "max_x", "max_y", "area"), (k, *b))) for k, b in enumerate(component_boxes(labels, n), 1) if b[4] >= min_size])
        return pd.Series(out)

    return run(flat)
