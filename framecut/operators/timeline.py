"""Exact times of scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rational import exact_end


def scene_timeline(spans: DataFrame, timing: DataFrame) -> DataFrame:
    """spans with start_time and end_time; a missing start, end or final frame in timing is an error.

    A scene ends when the next one starts; the last ends with its final frame's duration, or null if
    that isn't known exactly.
    """
    w = Window.partitionBy("video_id").orderBy("start")
    rows = spans.withColumn("__last", F.lead("start").over(w).isNull())
    times = timing.select("video_id", "frame", F.struct("presentation_time", "duration").alias("t"))
    at = lambda name, frame: times.select("video_id", F.col("frame").alias(frame), F.col("t").alias(name))
    rows = rows.withColumn("__until", F.when(F.col("__last"), F.col("end") - 1).otherwise(F.col("end")))
    rows = rows.join(at("__s", "start"), ["video_id", "start"], "left").join(at("__e", "__until"), ["video_id", "__until"], "left")
    missing = lambda seen, frame, what: F.when(F.col(seen).isNull(), F.raise_error(F.concat(F.lit(f"no timing for the {what} frame "), F.col(frame).cast("string"))).cast("boolean")).otherwise(True)
    rows = rows.where(missing("__s", "start", "start")).where(missing("__e", "__until", "end"))
    end = F.when(F.col("__last"), exact_end(F.col("__e.presentation_time"), F.col("__e.duration"))).otherwise(F.col("__e.presentation_time"))
    return rows.select("video_id", "scene_number", "start", "end", F.col("__s.presentation_time").alias("start_time"), end.alias("end_time"))
