"""Geometry of boxes (x0, y0, w, h) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = overlap(a["x0"], a["x0"] + a["w"], b["x0"], b["x0"] + b["w"]) * overlap(a["y0"], a["y0"] + a["h"], b["y0"], b["y0"] + b["h"])
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union <= 0, 0.0).otherwise(both / union)


def rotate_back(x: Column, y: Column, degrees: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A point of a page that was turned by 90, 180 or 270 degrees, in the original frame; other angles leave it."""
    return (
        F.when(degrees == 90, y).when(degrees == 180, width - x).when(degrees == 270, width - y).otherwise(x),
        F.when(degrees == 90, height - x).when(degrees == 180, height - y).when(degrees == 270, x).otherwise(y),
    )


def resolve_region(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, fractions: bool = True) -> tuple[Column, Column, Column, Column]:
    """(left, top, right, bottom) in whole pixels of a region given in fractions of the page or in pixels: place and size are clamped to the page and rounded half to even."""
    clamp = lambda v, most: F.rint(F.greatest(F.lit(0.0), F.least(v.cast("double"), most.cast("double")))).cast("int")
    scaled = lambda v, by: v * by if fractions else v
    left, top = clamp(scaled(x, width), width), clamp(scaled(y, height), height)
    return left, top, left + clamp(scaled(w, width), width - left), top + clamp(scaled(h, height), height - top)


def is_region(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """A region that can be read has two pixels at least in each direction."""
    return (right - left >= 2) & (bottom - top >= 2)


def box_of(points: Column) -> Column:
    """(min_x, min_y, max_x, max_y) of an array of points (x, y); zeros for none."""
    of = lambda f, c: F.coalesce(f(F.transform(points, lambda p: p[c])), F.lit(0.0)).alias
    return F.struct(of(F.array_min, "x")("min_x"), of(F.array_min, "y")("min_y"), of(F.array_max, "x")("max_x"), of(F.array_max, "y")("max_y"))


def is_empty(box: Column) -> Column:
    return (box["max_x"] - box["min_x"] <= 0) & (box["max_y"] - box["min_y"] <= 0)


def centre(box: Column) -> Column:
    return F.struct(((box["min_x"] + box["max_x"]) / 2).alias("x"), ((box["min_y"] + box["max_y"]) / 2).alias("y"))


def contains(outer: Column, inner: Column, slack: float = 0.5) -> Column:
    return (inner["min_x"] >= outer["min_x"] - slack) & (inner["min_y"] >= outer["min_y"] - slack) & (inner["max_x"] <= outer["max_x"] + slack) & (inner["max_y"] <= outer["max_y"] + slack)


def translate(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def rectangle(box: Column) -> Column:
    """The corners of a box from the top left on, clockwise."""
    corner = lambda x, y: F.struct(box[x].alias("x"), box[y].alias("y"))
    return F.array(corner("min_x", "min_y"), corner("max_x", "min_y"), corner("max_x", "max_y"), corner("min_x", "max_y"))


def shape(polygon: Column, box: Column) -> Column:
    """What to paint for a word or line: its polygon, else its box, else nothing (null)."""
    whole = (box["max_x"] > box["min_x"]) & (box["max_y"] > box["min_y"])
    return F.when(F.size(polygon) >= 3, polygon).when(whole, rectangle(box))


def quad(polygon: Column) -> Column:
    """(tl, tr, br, bl) of a polygon by the extremes of x + y and y - x, the first of equals; of fewer than four points the box's corners."""
    corners = F.when(F.size(polygon) >= 4, polygon).otherwise(rectangle(box_of(polygon)))
    first = lambda key: F.array_min(F.transform(corners, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
    point = lambda key: F.struct(first(key)["x"].alias("x"), first(key)["y"].alias("y"))
    return F.struct(point(lambda p: p["x"] + p["y"]).alias("tl"), point(lambda p: p["y"] - p["x"]).alias("tr"), point(lambda p: -(p["x"] + p["y"])).alias("br"), point(lambda p: p["x"] - p["y"]).alias("bl"))


def on_quad(q: Column, u: Column, v: Column) -> Column:
    """The point of a quad at ``u`` along the text and ``v`` across it, both from 0 to 1."""

    def at(c: str) -> Column:
        top, bottom = q["tl"][c] + (q["tr"][c] - q["tl"][c]) * u, q["bl"][c] + (q["br"][c] - q["bl"][c]) * u
        return (top + (bottom - top) * v).alias(c)

    return F.struct(at("x"), at("y"))


def to_crop(u: Column, v: Column, crop: tuple[Column, Column], patch: tuple[Column, Column], degrees: Column) -> tuple[Column, Column]:
    """A place on a patch that was turned clockwise onto a larger canvas, as a place on the crop: both in fractions."""
    a = F.radians(degrees)
    dx, dy = (u - 0.5) * patch[0], (v - 0.5) * patch[1]
    inside = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    turned = inside((dx * F.cos(a) + dy * F.sin(a)) / crop[0] + 0.5), inside((dy * F.cos(a) - dx * F.sin(a)) / crop[1] + 0.5)
    still = (degrees % 360 == 0) | (crop[0] <= 0) | (crop[1] <= 0)
    return F.when(still, u).otherwise(turned[0]), F.when(still, v).otherwise(turned[1])


def padded(polygon: Column, share: float) -> Column:
    """A polygon grown by a share of its height: a quad along its own axes, another from its centroid."""
    p = [F.get(polygon, F.lit(i)) for i in range(4)]
    side = lambda c, a, b, d, e: (p[a][c] - p[b][c]) + (p[d][c] - p[e][c])
    ux, uy, vx, vy = (side(c, *k) for k in ((1, 0, 2, 3), (3, 0, 2, 1)) for c in ("x", "y"))
    lu, lv = F.sqrt(ux * ux + uy * uy), F.sqrt(vx * vx + vy * vy)
    pad = lv / 2 * share
    corner = lambda i, su, sv: F.struct((p[i]["x"] + pad * (su * ux / lu + sv * vx / lv)).alias("x"), (p[i]["y"] + pad * (su * uy / lu + sv * vy / lv)).alias("y"))
    own = F.array(corner(0, -1, -1), corner(1, 1, -1), corner(2, 1, 1), corner(3, -1, 1))
    mean = lambda c: F.aggregate(polygon, F.lit(0.0), lambda acc, q: acc + q[c]) / F.size(polygon)
    cx, cy = mean("x"), mean("y")
    reach = (box_of(polygon)["max_y"] - box_of(polygon)["min_y"]) * share
    away = lambda q: F.sqrt((q["x"] - cx) * (q["x"] - cx) + (q["y"] - cy) * (q["y"] - cy))
    out = lambda q, c, m: F.when(away(q) > 0, q[c] + reach * (q[c] - m) / away(q)).otherwise(q[c]).alias(c)
    central = F.transform(polygon, lambda q: F.struct(out(q, "x", cx), out(q, "y", cy)))
    if share <= 0:
        return polygon
    return F.when(F.size(polygon) < 3, polygon).when((F.size(polygon) == 4) & (lu > 0) & (lv > 0), own).otherwise(central)


def horizontal_gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), a["min_x"] - b["max_x"], b["min_x"] - a["max_x"])


def union(a: Column, b: Column) -> Column:
    """The box around two boxes; an empty one does not count."""
    both = F.struct(F.least(a["min_x"], b["min_x"]).alias("min_x"), F.least(a["min_y"], b["min_y"]).alias("min_y"), F.greatest(a["max_x"], b["max_x"]).alias("max_x"), F.greatest(a["max_y"], b["max_y"]).alias("max_y"))
    return F.when(is_empty(a), b).when(is_empty(b), a).otherwise(both)
