"""Scores of neighbouring frames.

``with_previous`` gives each row its predecessor's features without holding a video in one task:
rows are dealt by (video, chunk of frames), and the features of each chunk's last row go to the
next one.  Only one row a chunk meets its video in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Content, Histogram
from ..functions.image import differing_bytes
from ..functions.pixel import count_correlation, hsv, luma_counts, mean_luma
from .features import frame_features

CHUNK = 512
EPSILON = 1e-6


def with_previous(rows: DataFrame, columns: list[str], chunk: int = CHUNK) -> DataFrame:
    """rows with prev_<column> of the row before in frame order; null for a video's first row.

    Rows meet their chunk in one shuffle, which both branches below read; a chunk's last features join its successor's first row.
    """
    dealt = rows.withColumn("__chunk", F.floor(F.col("frame") / chunk)).repartition("video_id", "__chunk")
    ends = dealt.groupBy("video_id", "__chunk").agg(F.max_by(F.struct(*columns), "frame").alias("__end"))
    carried = ends.select("video_id", "__chunk", F.lag("__end").over(Window.partitionBy("video_id").orderBy("__chunk")).alias("__end"))
    w = Window.partitionBy("video_id", "__chunk").orderBy("frame")
    inside = dealt.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns} | {"__n": F.row_number().over(w)})
    carried = carried.select(F.col("video_id").alias("__video"), F.col("__chunk").alias("__of"), "__end")
    # Null-safe, so that no filter goes below only one side and both keep sharing the shuffle.
    joined = inside.join(carried, F.col("video_id").eqNullSafe(F.col("__video")) & F.col("__chunk").eqNullSafe(F.col("__of")), "left")
    out = joined.withColumns({f"prev_{c}": F.when(F.col("__n") == 1, F.col(f"__end.{c}")).otherwise(F.col(f"prev_{c}")) for c in columns})
    return out.drop("__chunk", "__end", "__n", "__video", "__of")


def content_scores(frames: DataFrame, config: Content = Content(), chunk: int = CHUNK) -> DataFrame:
    """video_id, frame, content_val and the delta_* components of frames with px (and edge, if its weight isn't 0).

    Sums of hue, saturation and value deltas are integers, so they are exact in any order.
    """
    hue, sat, val, edge = config.used_weights
    carried = ["hsv"] + (["edge"] if edge else [])
    features = frames.select("video_id", "frame", F.transform("px", hsv).alias("hsv"), *(["edge"] if edge else []))
    rows = with_previous(features, carried, chunk)
    n = F.least(F.size("hsv"), F.size("prev_hsv"))
    both = F.zip_with(F.slice("hsv", 1, n), F.slice("prev_hsv", 1, n), lambda a, b: F.struct(*(F.abs(a[k] - b[k]).cast("long").alias(k) for k in "hsv")))
    zero = F.struct(*(F.lit(0).cast("long").alias(k) for k in "hsv"))
    sums = F.aggregate(both, zero, lambda t, d: F.struct(*((t[k] + d[k]).alias(k) for k in "hsv")))
    rows = rows.select("video_id", "frame", F.when(F.col("prev_hsv").isNotNull(), sums).alias("d"), F.coalesce(n, F.lit(0)).cast("double").alias("n"), *([edge_distance(F.col("edge"), F.col("prev_edge")).alias("de")] if edge else [F.lit(0.0).alias("de")]))
    total = sum(map(abs, (hue, sat, val, edge)))
    weighted = hue * F.col("d.h") + sat * F.col("d.s") + val * F.col("d.v")
    if edge:
        weighted = weighted + edge * F.col("de") * F.col("n")
    score = F.when(F.col("d").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(weighted.cast("double"), F.col("n") * total), F.lit(0.0)))
    part = lambda k: F.coalesce(F.col(f"d.{k}") / F.greatest(F.col("n"), F.lit(1.0)), F.lit(0.0))
    return rows.select("video_id", "frame", score.alias("content_val"), part("h").alias("delta_hue"), part("s").alias("delta_saturation"), part("v").alias("delta_luminance"), F.coalesce("de", F.lit(0.0)).alias("delta_edges"))


def edge_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two binary edge maps of 0 and 255; 0 if their sizes differ."""
    differ = differing_bytes(a, b)
    return F.when(F.length(a) > 0, F.coalesce(255.0 * differ / F.length(a), F.lit(0.0))).otherwise(F.lit(0.0))


def luma_scores(frames: DataFrame) -> DataFrame:
    """video_id, frame, average_rgb (mean luma)."""
    return frames.select("video_id", "frame", mean_luma(F.col("px")).alias("average_rgb"))


def histogram_scores(frames: DataFrame, config: Histogram = Histogram(), chunk: int = CHUNK) -> DataFrame:
    """video_id, frame, hist_diff (correlation with the frame before; 0 for the first), first; of px or binary frames."""
    counts = frames.select("video_id", "frame", luma_counts(F.col("px"), config.bins).alias("counts")) if "px" in frames.columns else frame_features(frames, counts=config.bins)
    rows = with_previous(counts, ["counts"], chunk)
    first = F.col("prev_counts").isNull()
    return rows.select("video_id", "frame", F.when(first, 0.0).otherwise(count_correlation(F.col("prev_counts"), F.col("counts"))).alias("hist_diff"), first.alias("first"))


def hash_scores(hashes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """video_id, frame, hash_dist (share of differing bits; 0 for the first), first, for (video_id, frame, bits)."""
    rows = with_previous(hashes.select("video_id", "frame", "bits"), ["bits"], chunk)
    n = F.least(F.size("bits"), F.size("prev_bits"))
    differ = F.size(F.filter(F.zip_with(F.slice("bits", 1, n), F.slice("prev_bits", 1, n), lambda a, b: a != b), lambda d: d))
    first = F.col("prev_bits").isNull()
    return rows.select("video_id", "frame", F.when(first, 0.0).otherwise(F.coalesce(F.try_divide(differ.cast("double"), n.cast("double")), F.lit(0.0))).alias("hash_dist"), first.alias("first"))


def adaptive_scores(scores: DataFrame, window: int = 2) -> DataFrame:
    """scores with adaptive_ratio: content_val over the mean of its window neighbours on each side.

    0 for the first and last window rows of a video, and everywhere if window is 0.
    """
    if window == 0:
        return scores.withColumn("adaptive_ratio", F.lit(0.0))
    w = Window.partitionBy("video_id").orderBy("frame")
    before, after = w.rowsBetween(-window, -1), w.rowsBetween(1, window)
    full = (F.count("content_val").over(before) == window) & (F.count("content_val").over(after) == window)
    mean = (F.sum("content_val").over(before) + F.sum("content_val").over(after)) / (2.0 * window)
    return scores.withColumn("adaptive_ratio", F.when(full, F.col("content_val") / (mean + EPSILON)).otherwise(0.0))


def detector_row(rows: DataFrame, detector: str, threshold: float) -> DataFrame:
    """rows (…, metrics map) with score, threshold, candidate as each detector reads its metrics."""
    prefixed = lambda p: F.get(F.map_values(F.map_filter("metrics", lambda k, v: F.startswith(k, F.lit(p)))), F.lit(0))
    score = {
        "content": F.element_at("metrics", "content_val"),
        "adaptive": F.element_at("metrics", "adaptive_ratio"),
        "threshold": F.element_at("metrics", "average_rgb"),
        "histogram": 1.0 - prefixed("hist_diff"),
        "hash": prefixed("hash_dist"),
    }[detector]
    rows = rows.withColumn("score", F.coalesce(score, F.lit(0.0))).withColumn("threshold", F.lit(float(threshold)))
    return rows.withColumn("candidate", F.lit(False) if detector == "threshold" else reaches(F.col("score"), threshold))


def insight_score(rows: DataFrame, detector: str, threshold: float) -> DataFrame:
    """detector_row with a histogram's first frame at score 0."""
    out = detector_row(rows, detector, threshold)
    return out.withColumn("score", F.when(F.col("frame") == 0, 0.0).otherwise(F.col("score"))) if detector == "histogram" else out


def reaches(score: Column, threshold) -> Column:
    """score >= threshold; not a number never does."""
    return ~F.isnan(score) & (score >= threshold)
