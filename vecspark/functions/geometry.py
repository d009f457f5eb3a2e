"""Geometry of boxes as column expressions; boxes are structs of single-precision x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iou(a: Column, b: Column) -> Column:
    """Intersection over union in single precision; 0 if the union is empty."""
    zero = F.lit(0.0).cast("float")
    side = lambda hi, lo: F.greatest(zero, (hi - lo).cast("float"))
    inter = (side(F.least(a["x2"], b["x2"]), F.greatest(a["x1"], b["x1"])) * side(F.least(a["y2"], b["y2"]), F.greatest(a["y1"], b["y1"]))).cast("float")
    area = lambda r: (side(r["x2"], r["x1"]) * side(r["y2"], r["y1"])).cast("float")
    union = ((area(a) + area(b)).cast("float") - inter).cast("float")
    return F.when(union <= 0, zero).otherwise((inter / union).cast("float"))


def scaled_dimensions(w: Column, h: Column, most: int = 1024) -> Column:
    """struct<w, h>: the longer side at most `most`, the other scaled in single precision and truncated."""
    fit = lambda side, longest: (side.cast("float") * (F.lit(float(most)).cast("float") / longest.cast("float")).cast("float")).cast("float").cast("int")
    pair = lambda x, y: F.struct(x.cast("int").alias("w"), y.cast("int").alias("h"))
    return F.when((w <= most) & (h <= most), pair(w, h)).when(w >= h, pair(F.lit(most), fit(h, w))).otherwise(pair(fit(w, h), F.lit(most)))


def half_even(x: Column) -> Column:
    return F.bround(x.cast("double")).cast("int")


def multiple_of_32(w: Column, h: Column, limit: int, kind: str, most: int) -> Column:
    """struct<w, h>: sizes of a resize to multiples of 32; kind is max, min or resize_long."""
    w, h = w.cast("int"), h.cast("int")
    long, short = F.greatest(w, h), F.least(w, h)
    ratios = {
        "max": F.when(long > limit, F.lit(float(limit)) / long).otherwise(1.0),
        "min": F.when(short < limit, F.lit(float(limit)) / short).otherwise(1.0),
        "resize_long": F.lit(float(limit)) / long,
    }
    if kind.lower() not in ratios:
        raise ValueError(f"unknown limit type: {kind}")
    r = ratios[kind.lower()]
    nw, nh = (w * r).cast("int"), (h * r).cast("int")
    over = F.greatest(nw, nh)
    cap = lambda x: F.when(over > most, (x * (F.lit(float(most)) / over)).cast("int")).otherwise(x)
    side = lambda x: F.greatest(half_even(cap(x) / F.lit(32.0)) * 32, F.lit(32))
    return F.struct(side(nw).alias("w"), side(nh).alias("h"))


def crop_box(box: Column, width: Column, height: Column) -> Column:
    """struct<x, y, w, h> of a box cut to an image, or null if nothing is left."""
    x, y = F.greatest(F.lit(0), box["x1"].cast("int")), F.greatest(F.lit(0), box["y1"].cast("int"))
    w, h = F.least(width, box["x2"].cast("int")) - x, F.least(height, box["y2"].cast("int")) - y
    return F.when((w > 0) & (h > 0), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def expanded(w: Column, h: Column, ratio: float) -> Column:
    """struct<w, h> of a rectangle grown on all sides by area * ratio / perimeter."""
    area, edge = w * h, (w + h) * 2
    d = F.when((area > 0) & (edge > 0), area * float(ratio) / edge).otherwise(F.lit(0.0))
    return F.struct((w + d * 2).alias("w"), (h + d * 2).alias("h"))


def rotated_rects(points: DataFrame, key: str = "component") -> DataFrame:
    """(key, n, cx, cy, w, h, angle): the rectangle along the main axes of points (key, x, y), by two aggregations."""
    mean = points.groupBy(key).agg(F.count("*").alias("n"), (F.sum(F.col("x").cast("double")) / F.count("*")).alias("cx"), (F.sum(F.col("y").cast("double")) / F.count("*")).alias("cy"))
    d = points.join(mean, key).withColumn("dx", F.col("x") - F.col("cx")).withColumn("dy", F.col("y") - F.col("cy"))
    axes = d.groupBy(key).agg(F.sum(F.col("dx") * F.col("dx")).alias("xx"), F.sum(F.col("dx") * F.col("dy")).alias("xy"), F.sum(F.col("dy") * F.col("dy")).alias("yy"))
    angle = F.lit(0.5) * F.atan2(F.lit(2.0) * F.col("xy"), F.col("xx") - F.col("yy"))
    turned = d.join(axes.select(key, angle.alias("angle")), key)
    u = F.col("dx") * F.cos("angle") + F.col("dy") * F.sin("angle")
    v = -F.col("dx") * F.sin("angle") + F.col("dy") * F.cos("angle")
    return turned.groupBy(key, "n", "cx", "cy", "angle").agg((F.max(u) - F.min(u)).alias("w"), (F.max(v) - F.min(v)).alias("h")).select(key, "n", "cx", "cy", "w", "h", "angle")


def corner_order(points: Column) -> Column:
    """Of an array of four structs (x, y): the least and greatest x + y first and third, the least and greatest x - y second and fourth."""

    def pick(score, least: bool) -> Column:
        keyed = F.transform(points, lambda p, i: F.struct(score(p).alias("s"), (i if least else -i).alias("i"), p.alias("p")))
        return (F.array_min(keyed) if least else F.array_max(keyed))["p"]

    plus, minus = (lambda p: p["x"] + p["y"]), (lambda p: p["x"] - p["y"])
    return F.array(pick(plus, True), pick(minus, True), pick(plus, False), pick(minus, False))


def quad_order(points: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left: the two leftmost and the two others, each by y."""
    by_x = F.array_sort(F.transform(points, lambda p, i: F.struct(p["x"].alias("x"), i.alias("i"), p["y"].alias("y"))))
    at = lambda i: F.struct(F.get(by_x, F.lit(i))["x"].alias("x"), F.get(by_x, F.lit(i))["y"].alias("y"))
    a, b, c, d = (at(i) for i in range(4))
    left, right = b["y"] > a["y"], d["y"] > c["y"]
    pick = lambda t, x, y: F.when(t, x).otherwise(y)
    return F.array(pick(left, a, b), pick(right, c, d), pick(right, d, c), pick(left, b, a))
