"""Pixel features as Column expressions over ``px``, an array of struct<r:int,g:int,b:int>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hsv(p: Column) -> Column:
    """8-bit HSV of one pixel (hue 0 to 179), in fixed point with 12 fractional bits."""
    r, g, b = p["r"], p["g"], p["b"]
    v = F.greatest(r, g, b)
    d = v - F.least(r, g, b)
    s_scale = F.rint(F.try_divide(F.lit(255.0 * 4096), v.cast("double"))).cast("int")
    h_scale = F.rint(F.try_divide(F.lit(180.0 * 4096), 6.0 * d.cast("double"))).cast("int")
    turn = F.when(v == r, g - b).when(v == g, b - r + 2 * d).otherwise(r - g + 4 * d)
    s = F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(d * s_scale + 2048, 12)))
    h = F.shiftright(turn * h_scale + 2048, 12)
    h = F.when(h < 0, h + 180).when(h >= 180, h - 180).otherwise(h)
    flat = d == 0
    return F.struct(F.when(flat, 0).otherwise(h).cast("int").alias("h"), F.when(flat, 0).otherwise(s).cast("int").alias("s"), v.cast("int").alias("v"))


def luma(p: Column) -> Column:
    return 0.299 * p["r"].cast("double") + 0.587 * p["g"].cast("double") + 0.114 * p["b"].cast("double")


def mean_luma(px: Column) -> Column:
    """Mean luma of a frame; 0 without pixels."""
    return F.coalesce(F.try_divide(F.aggregate(px, F.lit(0.0), lambda a, p: a + luma(p)), F.size(px).cast("double")), F.lit(0.0))


def luma_counts(px: Column, bins: int) -> Column:
    """Numbers of pixels by luma bin."""
    bins = max(1, bins)
    which = F.transform(px, lambda p: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(luma(p) * bins / 256.0))).cast("int"))
    return F.transform(F.array(which), lambda w: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(w, lambda x: x == k)).cast("long")))[0]


def luma_histogram(px: Column, bins: int) -> Column:
    """Counts of pixels by luma bin, divided by their Euclidean norm if that is above 0."""
    counts = F.transform(luma_counts(px, bins), lambda x: x.cast("double"))

    def normed(c):
        norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(c, lambda x: F.when(norm > 0, x / norm).otherwise(x))

    return F.transform(F.array(counts), normed)[0]


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; 1 where it is undefined."""
    n = F.size(a).cast("double")
    mean = lambda x: F.coalesce(F.try_divide(F.aggregate(x, F.lit(0.0), lambda t, y: t + y), n), F.lit(0.0))

    def pearson(m):
        each = F.zip_with(a, b, lambda x, y: F.struct((x - m["a"]).alias("x"), (y - m["b"]).alias("y")))
        zero = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"))
        total = F.aggregate(each, zero, lambda t, e: F.struct((t["xy"] + e["x"] * e["y"]).alias("xy"), (t["xx"] + e["x"] * e["x"]).alias("xx"), (t["yy"] + e["y"] * e["y"]).alias("yy")))
        return F.transform(F.array(total), lambda t: F.coalesce(F.try_divide(t["xy"], F.sqrt(t["xx"] * t["yy"])), F.lit(1.0)))[0]

    return F.transform(F.array(F.struct(mean(a).alias("a"), mean(b).alias("b"))), pearson)[0]


def count_correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays of counts, out of whole sums: what ties with a threshold isn't moved by rounding."""
    zero = F.struct(*(F.lit(0).cast("long").alias(k) for k in ("x", "y", "xy", "xx", "yy")))
    each = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    sums = F.aggregate(each, zero, lambda t, e: F.struct((t["x"] + e["x"]).alias("x"), (t["y"] + e["y"]).alias("y"), (t["xy"] + e["x"] * e["y"]).alias("xy"), (t["xx"] + e["x"] * e["x"]).alias("xx"), (t["yy"] + e["y"] * e["y"]).alias("yy")))
    n = F.size(a).cast("long")
    spread = lambda t, p, x, y: (n * t[p] - t[x] * t[y]).cast("double")
    return F.transform(F.array(sums), lambda t: F.coalesce(F.try_divide(spread(t, "xy", "x", "y"), F.sqrt(spread(t, "xx", "x", "x") * spread(t, "yy", "y", "y"))), F.lit(1.0)))[0]


def compact_luma(px: Column, width: Column, height: Column, side: int = 32) -> Column:
    """side x side integer luma samples at the centres of the cells."""
    at = lambda k, n: F.least(F.floor((2 * k + 1) * n / (2 * side)), n - 1).cast("int")
    cells = F.sequence(F.lit(0), F.lit(side * side - 1))
    pick = lambda k: F.get(px, at(F.floor(k / side), height) * width + at(k % side, width))
    return F.transform(F.transform(cells, pick), lambda p: F.shiftright(77 * p["r"] + 150 * p["g"] + 29 * p["b"] + 128, 8))


def analysis_size(width: Column, height: Column, limit: int) -> Column:
    """Width and height scaled down so that the longer side is at most limit."""
    scale = F.least(F.lit(1.0), F.lit(float(limit)) / F.greatest(width, height))
    side = lambda x: F.greatest(F.lit(1), F.floor(x * scale + 0.5)).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))
