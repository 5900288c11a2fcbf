"""Geometry of diagrams: midpoints of polylines, sizes of labels, offsets of labels, sizes of vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pixels of a character, padding and greatest width of a label, height of a line.
LABEL_CHAR, LABEL_PADDING, LABEL_MOST, LABEL_LINE = 7, 8, 240, 18
# What a hub's edge takes of the base width, and from how many edges on a vertex is one.
HUB_SHARE, HUB_LEAST = 0.55, 2
_POINT = "struct<x:double,y:double>"


def _round(c: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c + 0.5)


def midpoint(points: Column) -> Column:
    """points (an array of x, y) -> the point half way along them. One point is its own midpoint; null without any.

    The fold carries what is left of half the length, and the point once it is found."""
    points = points.cast(f"array<{_POINT}>")
    last = F.size(points) - 1
    steps = F.when(last >= 1, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get(points, i)
    length = lambda i: F.hypot(at(i + 1)["x"] - at(i)["x"], at(i + 1)["y"] - at(i)["y"])
    segments = F.transform(steps, lambda i: F.struct(i.alias("i"), length(i).alias("d")))
    total = F.aggregate(segments, F.lit(0.0), lambda a, s: a + s["d"])
    none = F.lit(None).cast(_POINT)

    def walk(a: Column, s: Column) -> Column:
        here, there = at(s["i"]), at(s["i"] + 1)
        t = F.when(s["d"] == 0, 0.0).otherwise(a["left"] / s["d"])
        found = F.struct((here["x"] + t * (there["x"] - here["x"])).alias("x"), (here["y"] + t * (there["y"] - here["y"])).alias("y"))
        now = F.coalesce(a["at"], F.when(a["left"] <= s["d"], found))
        return F.struct((a["left"] - s["d"]).alias("left"), now.alias("at"))

    state = F.struct((total / 2).alias("left"), none.alias("at"))
    return F.aggregate(segments, state, walk, lambda a: F.when(F.size(points) > 0, F.coalesce(a["at"], F.get(points, last))))


def label_bounds(text: Column) -> Column:
    """width, height of a label by its lines, which line ends and <br> part; a null label has one empty line."""
    lines = F.split(F.coalesce(text, F.lit("")), r"(?i)<br\s*/?>|\n")
    longest = F.array_max(F.transform(lines, lambda s: F.length(s)))
    return F.struct(F.least(longest * LABEL_CHAR + LABEL_PADDING, F.lit(LABEL_MOST)).alias("width"), (F.size(lines) * LABEL_LINE).alias("height"))


def label_offset(points: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """dx, dy of a label's centre from the midpoint; null where it is within a pixel, or anything isn't finite."""
    mid = midpoint(points)
    dx, dy = _round(x + width / 2 - mid["x"]), _round(y + height / 2 - mid["y"])
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    good = finite(x + y + width + height) & finite(mid["x"] + mid["y"])
    return F.when(good & ((F.abs(dx) > 1) | (F.abs(dy) > 1)), F.struct(dx.alias("dx"), dy.alias("dy")))


def vertex_sizes(vertices: DataFrame, edges: DataFrame, default: tuple[int, int] = (200, 80)) -> DataFrame:
    """id, width, height of vertices (id, parent, width, height; no width: a boundary, sized by what it holds).

    One with children is three times as high and wide enough for them side by side, twice its width at least; one with
    two edges and more, of either direction, is wide enough to spread them."""
    kids = vertices.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    rows = vertices.select("id", "width", "height").join(kids, "id", "left").join(ends, "id", "left").na.fill(0, ["kids", "degree"])
    sized = F.coalesce(F.col("width") > 0, F.lit(False))
    w, h = F.when(sized, F.col("width")).otherwise(default[0]), F.when(sized, F.col("height")).otherwise(default[1])
    inner = F.when(F.col("kids") > 0, F.greatest(2 * w, F.col("kids") * w)).otherwise(w)
    hub = F.when(F.col("degree") >= HUB_LEAST, _round(F.col("degree") * (w * F.lit(HUB_SHARE)))).otherwise(0)
    return rows.select("id", F.greatest(inner, hub).cast("long").alias("width"), F.when(F.col("kids") > 0, 3 * h).otherwise(h).cast("long").alias("height"))
