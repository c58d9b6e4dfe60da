"""What a human review leaves: reviewed scenes as CSV, and all of a review as JSON, one document a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import media_times

HEADER = "Scene,Start Sample,Start Time,End Sample,End Time"


def time_text(seconds: Column) -> Column:
    """HH:MM:SS.mmm; unknown, infinite and negative times give 0, and seconds aren't carried when they round up to 60."""
    known = F.coalesce(seconds.cast("double"), F.lit(0.0))
    safe = F.when(F.isnan(known) | (F.abs(known) == float("inf")) | (known < 0), 0.0).otherwise(known)
    return F.format_string("%02d:%02d:%06.3f", F.floor(safe / 3600).cast("long"), F.floor(safe % 3600 / 60).cast("long"), safe % 60)


def timed_scenes(scenes: DataFrame, samples: DataFrame, videos: DataFrame) -> DataFrame:
    """video_id, scene_number, start, start_time, end, end_time of scenes in samples.

    samples: video_id, sample, media_time_seconds; videos: video_id, duration, fps, count of samples.
    A sample that wasn't presented has the duration from count on, else its number divided by fps.
    """
    rows = scenes.join(videos.select("video_id", "duration", "fps", "count"), "video_id")
    for side in ("start", "end"):
        rows = media_times(rows.withColumnRenamed(side, "sample"), samples, F.col("duration"), F.col("fps"), F.col("count"))
        rows = rows.withColumnsRenamed({"sample": side, "media_time_seconds": f"{side}_time"})
    return rows.select("video_id", "scene_number", "start", "start_time", "end", "end_time")


def _listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """video_id, name: a video's rows as an array in the order of the columns."""
    return rows.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def reviewed_csv(timed: DataFrame) -> DataFrame:
    """video_id, text of timed scenes; numbers count the scenes of a video from 1."""
    line = lambda s, k: F.concat_ws(",", k + 1, s["start"], time_text(s["start_time"]), s["end"], time_text(s["end_time"]))
    scenes = _listed(timed, "scenes", "start", "end", "start_time", "end_time")
    return scenes.select("video_id", F.concat(F.lit(f"{HEADER}\n"), F.array_join(F.transform("scenes", line), "\n"), F.lit("\n")).alias("text"))


def review_artifact(videos: DataFrame, samples: DataFrame, actions: DataFrame, detected: DataFrame, reviewed: DataFrame) -> DataFrame:
    """video_id, text: decisions with their times, the detector's scenes, the reviewed ones, and the presented samples.

    videos as in timed_scenes; actions: video_id, frame, action.  Each of a video's lists is as long as its session.
    """
    points = actions.select("video_id", F.col("frame").alias("sample"), "action").join(videos.select("video_id", "duration", "fps", "count"), "video_id")
    decisions = media_times(points, samples, F.col("duration"), F.col("fps"), F.col("count"))
    rows = videos.select("video_id")
    lists = (_listed(decisions, "decisions", "sample", "media_time_seconds", "action"), _listed(detected, "detected", "start", "end"), _listed(reviewed, "reviewed", "start", "end"), _listed(samples, "presented", "sample", "media_time_seconds"))
    for part in lists:
        rows = rows.join(part, "video_id", "left")
    listed = {c: F.coalesce(F.col(c), F.array()) for c in ("decisions", "reviewed", "presented")}
    body = F.struct(
        F.lit(1).alias("schema_version"),
        F.struct(F.lit("spark").alias("detector"), F.lit("human").alias("review")).alias("authority"),
        listed["decisions"].alias("decisions"),
        F.when(F.col("detected").isNotNull(), F.struct(F.col("detected").alias("scenes"))).alias("detector_scene_list"),
        F.struct(listed["reviewed"].alias("scenes")).alias("reviewed_scene_list"),
        listed["presented"].alias("presented_samples"),
    )
    return rows.select("video_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("text"))
