"""Scene spans: half-open intervals that tile a video."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MERGE_LAST, SUPPRESS


def totals(frames: DataFrame) -> DataFrame:
    """video_id, total: number of rows, which is the end of the last scene."""
    return frames.groupBy("video_id").agg(F.count("*").alias("total"))


def scene_spans(boundaries: DataFrame, total: DataFrame, m: int = 15, policy: str = SUPPRESS) -> DataFrame:
    """video_id, scene_number, start, end from boundaries (video_id, frame) and totals; no frames, no scenes.

    merge_last joins a last scene below m frames with the one before.
    """
    total = total.where("total > 0")
    starts = boundaries.select("video_id", F.col("frame").cast("long").alias("start")).join(total.select("video_id"), "video_id", "left_semi")
    starts = starts.union(total.select("video_id", F.lit(0).cast("long"))).distinct().join(total, "video_id")
    w = Window.partitionBy("video_id").orderBy("start")
    if policy == MERGE_LAST:
        short = F.lead("start").over(w).isNull() & (F.col("total") - F.col("start") < m) & F.lag("start").over(w).isNotNull()
        starts = starts.withColumn("__short", short).where("not __short").drop("__short")
    return starts.select("video_id", F.row_number().over(w).alias("scene_number"), "start", F.lead("start", 1).over(w).alias("__end"), "total").select("video_id", "scene_number", "start", F.coalesce("__end", "total").alias("end"))


def stored_spans(rows: DataFrame, total: DataFrame) -> DataFrame:
    """Spans of accepted rows, those strictly inside the video; a short last scene stays."""
    accepted = rows.where("decision = 'accepted'").select("video_id", "frame").join(total, "video_id").where("frame > 0 and frame < total")
    return scene_spans(accepted.select("video_id", "frame"), total)


def boundary_count(spans: DataFrame) -> DataFrame:
    return spans.groupBy("video_id").agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("boundaries"))


def containing(points: DataFrame, spans: DataFrame, point: str, chunk: int = 4096) -> DataFrame:
    """points with scene_number, start, end of the span that holds them: an as-of join, as spans tile the axis.

    Both sides meet in ordered windows by video and chunk of frames, so no pair of a point and a span is
    tried and no video is sorted whole; a span stands in every chunk that it reaches.
    """
    cols = points.columns
    chunk_of = lambda x: F.floor(x / chunk).cast("long")
    reached = F.explode(F.sequence(chunk_of(F.col("start")), chunk_of(F.greatest(F.col("end") - 1, F.col("start")))))
    marks = spans.select("video_id", F.col("start").alias("__at"), F.struct("scene_number", "start", "end").alias("__span"), F.lit(None).cast(points.select(F.struct(*cols)).schema[0].dataType).alias("__row"), reached.alias("__chunk"))
    rows = points.select("video_id", F.col(point).alias("__at"), F.lit(None).cast(marks.schema["__span"].dataType).alias("__span"), F.struct(*cols).alias("__row"), chunk_of(F.col(point)).alias("__chunk"))
    w = Window.partitionBy("video_id", "__chunk").orderBy("__at", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(rows).withColumn("__span", F.last("__span", ignorenulls=True).over(w)).where("__row is not null")
    inside = F.when(F.col("__at") < F.col("__span.end"), F.col("__span"))
    return found.select("__row.*", inside.alias("__span")).select(*cols, "__span.scene_number", "__span.start", "__span.end")
