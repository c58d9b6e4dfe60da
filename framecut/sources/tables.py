"""Frame streams out of the plain tables: embeddings as images, events as scores and timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _byte(x):
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.6) * 200))).cast("int")


def gray_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame, width, height, px: 8 x 8 gray pixels of each embedding."""
    px = F.transform(F.col("embedding"), lambda x: F.struct(_byte(x).alias("r"), _byte(x).alias("g"), _byte(x).alias("b")))
    return read(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("video_id"), F.col("vec_id").alias("frame"), F.lit(8).alias("width"), F.lit(8).alias("height"), px.alias("px"))


def rgb_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame, width, height, px: 7 x 3 colour pixels of each embedding's first 63 values."""
    at = lambda k: _byte(F.get(F.col("embedding"), k))
    px = F.transform(F.sequence(F.lit(0), F.lit(60), F.lit(3)), lambda k: F.struct(at(k).alias("r"), at(k + 1).alias("g"), at(k + 2).alias("b")))
    return read(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("video_id"), F.col("vec_id").alias("frame"), F.lit(7).alias("width"), F.lit(3).alias("height"), px.alias("px"))


def wide_frames(spark: SparkSession, sf_dir: str, width: int = 320, height: int = 180, grain: int = 0) -> DataFrame:
    """video_id, frame, width, height, rgb: each embedding's 64 values as 8 x 8 areas of colour.

    grain: each image's bytes are then changed by a fixed pattern of up to so much, as real ones don't compress.
    """
    import numpy as np
    import pyarrow as pa

    cell = (np.arange(height) * 8 // height)[:, None] * 8 + (np.arange(width) * 8 // width)[None, :]
    pattern = np.random.default_rng(7).integers(0, grain + 1, (height, width, 3), np.uint8)

    def run(batches):
        for b in batches:
            for frame, values in zip(b.column("frame").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                v = np.array(values, np.uint8)
                image = np.stack([v[cell], v[(cell + 1) % 64], v[(cell + 2) % 64]], axis=-1) ^ pattern
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([frame], pa.int64()), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([image.tobytes()], pa.binary())], ["video_id", "frame", "width", "height", "rgb"])

    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.transform("embedding", _byte).alias("bytes"))
    return rows.mapInArrow(run, "video_id long, frame long, width int, height int, rgb binary")


def score_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame, content_val, average_rgb: the values of each user's events in order."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), (F.row_number().over(order) - 1).cast("long").alias("frame"), F.col("value").alias("content_val"), F.col("value").alias("average_rgb"))


def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame, presentation_time, duration: microsecond ticks of each user's events; the last duration is null."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    ticks = F.unix_micros(F.col("ts").cast("timestamp"))
    base = F.struct(F.lit(1).cast("long").alias("numerator"), F.lit(1_000_000).cast("long").alias("denominator"))
    time = lambda t: F.when(t.isNotNull(), F.struct(t.alias("ticks"), base.alias("time_base")))
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"),
        (F.row_number().over(order) - 1).cast("long").alias("frame"),
        time(ticks).alias("presentation_time"),
        time(F.lead(ticks).over(order) - ticks).alias("duration"),
    )
