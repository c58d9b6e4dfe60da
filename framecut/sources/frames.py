"""Frame sources: solid frames, raw rgb24 files, facts of video files, timing records, fixed-rate samples."""

from __future__ import annotations

import json
import shutil
import subprocess

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timecode import ratio

MAX_SAMPLES = 200_000
TIME_BASE = T.StructType([T.StructField("numerator", T.LongType()), T.StructField("denominator", T.LongType())])
MEDIA_TIME = T.StructType([T.StructField("ticks", T.LongType()), T.StructField("time_base", TIME_BASE)])
FRAMES = "video_id long, frame long, width int, height int, rgb binary"
VIDEOS = "path string, width int, height int, rate string, time_base string, error string"


def solid_frames(spark: SparkSession, colors: list[tuple[int, int, int]], width: int = 2, height: int = 2, video_id: int = 0) -> DataFrame:
    """One binary frame for each colour; a small in-memory source for tests and examples."""
    rows = [(video_id, k, width, height, bytes(c) * (width * height)) for k, c in enumerate(colors)]
    return spark.createDataFrame(rows, FRAMES)


def to_pixels(frames: DataFrame) -> DataFrame:
    """Binary frames with px, an array of r, g, b structs."""
    text = F.hex("rgb")
    at = lambda k: F.conv(F.substr(text, 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    px = F.when(F.length("rgb") == 0, F.array().cast("array<struct<r:int,g:int,b:int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.length("rgb") - 3, F.lit(0)), F.lit(3)), lambda k: F.struct(at(k).alias("r"), at(k + 1).alias("g"), at(k + 2).alias("b"))))
    return frames.withColumn("px", px)


def raw_frames(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Frames of raw rgb24 files; a file that ends within a frame is an error.  Columns path, frame, width, height, rgb.

    Executors read the files through Spark, each whole file in one task at a time.
    """
    size = width * height * 3
    content = F.col("content")
    n = F.length(content)
    whole = F.when(n % size != 0, F.raise_error(F.concat(F.lit("truncated frame in "), F.col("path")))).otherwise((n / size).cast("int"))
    files = spark.read.format("binaryFile").load(path).select("path", "content", whole.alias("n"))
    numbered = files.where("n > 0").select("path", "content", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    return numbered.select("path", F.col("k").cast("long").alias("frame"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.substr(content, F.col("k") * size + 1, F.lit(size)).alias("rgb"))


def require(tool: str) -> str:
    found = shutil.which(tool)
    if not found:
        raise FileNotFoundError(f"{tool} is not installed on this machine")
    return found


def probe_one(path: str) -> tuple:
    """Facts of a file's first video stream by ffprobe."""
    done = subprocess.run([require("ffprobe"), "-v", "error", "-select_streams", "v:0", "-show_entries", "stream=width,height,r_frame_rate,time_base", "-of", "json", path], capture_output=True, text=True)
    if done.returncode:
        return (path, None, None, None, None, done.stderr.strip())
    streams = json.loads(done.stdout).get("streams") or []
    if not streams:
        return (path, None, None, None, None, "no video stream")
    s = streams[0]
    return (path, s["width"], s["height"], s["r_frame_rate"], s["time_base"], None)


def probe(paths: DataFrame, override: Column | None = None) -> DataFrame:
    """width, height, frame_rate, time base and error of the files in column path; needs ffprobe on the executors."""

    def run(batches):
        for b in batches:
            rows = [probe_one(p) for p in b.column("path").to_pylist()]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "width", "height", "rate", "time_base", "error"])

    found = paths.select("path").mapInArrow(run, VIDEOS)
    return found.withColumn("frame_rate", F.coalesce(override if override is not None else F.lit(None).cast("double"), ratio(F.col("rate")))).withColumn("base", time_base(F.col("time_base")))


def time_base(text: Column) -> Column:
    """``1/90000`` as struct; a zero or missing part is an error."""
    parts = F.split(text, "/")
    n, d = F.get(parts, F.lit(0)).try_cast("long"), F.get(parts, F.lit(1)).try_cast("long")
    good = F.struct(n.alias("numerator"), d.alias("denominator"))
    return F.when(text.isNull(), F.lit(None)).when(F.coalesce(n, F.lit(0)) * F.coalesce(d, F.lit(0)) == 0, F.raise_error(F.concat(F.lit("invalid time base "), text))).otherwise(good)


def parse_timing(records: DataFrame, base: Column) -> DataFrame:
    """records (video_id, frame, record) with presentation_time and duration.

    A record holds key=value fields split by |; what is no integer is null, duration precedes pkt_duration.
    """
    fields = F.str_to_map(F.col("record"), F.lit("\\|"), F.lit("="))
    number = lambda k: F.element_at(fields, k).try_cast("long")
    time = lambda t: F.when(t.isNotNull(), F.struct(t.alias("ticks"), base.alias("time_base")))
    return records.withColumn("presentation_time", time(number("best_effort_timestamp"))).withColumn("duration", time(F.coalesce(number("duration"), number("pkt_duration"))))


def with_timing(frames: DataFrame, timing: DataFrame) -> DataFrame:
    """frames with the times of the same video and frame; a frame without a timing row is an error."""
    joined = frames.join(timing.withColumn("__seen", F.lit(True)), ["video_id", "frame"], "left")
    check = F.when(F.col("__seen").isNull(), F.raise_error(F.concat(F.lit("no timing for frame "), F.col("frame").cast("string"))).cast("boolean")).otherwise(True)
    return joined.where(check).drop("__seen")


def sample_times(videos: DataFrame) -> DataFrame:
    """video_id, sample, target: times of fixed-rate samples for videos (video_id, duration, fps); too many are an error."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration") * F.col("fps"))).cast("long")
    checked = F.when(n > MAX_SAMPLES, F.raise_error(F.lit(f"more than {MAX_SAMPLES} samples")).cast("long")).otherwise(n)
    return videos.select("video_id", "duration", "fps", F.explode(F.sequence(F.lit(0).cast("long"), checked - 1)).alias("sample")).select("video_id", "sample", F.least(F.col("sample") / F.col("fps"), F.col("duration") - 0.001).alias("target"))


def check_order(rows: DataFrame, time: str | None = None, order: str = "frame") -> DataFrame:
    """rows, after a check that order strictly rises and time never falls within a video."""
    w = Window.partitionBy("video_id").orderBy(order)
    falls = F.lag(order).over(w) >= F.col(order)
    if time:
        falls = falls | (F.lag(time).over(w) > F.col(time))
    return rows.withColumn("__falls", falls).where(F.when(F.col("__falls"), F.raise_error(F.lit("frames out of order")).cast("boolean")).otherwise(True)).drop("__falls")


def parity_scenes(spark: SparkSession, path: str, oracle: bool) -> DataFrame:
    """scene, start, end of a scene list CSV; the header is found by content, bad rows are skipped.

    oracle: its start frames count from 1 and are lowered; others are taken as they stand.
    """
    lines = spark.read.text(path).select(F.split(F.lower("value"), ",").alias("f"), F.monotonically_increasing_id().alias("n"))
    head = lines.where(F.array_contains("f", "scene number") & F.array_contains("f", "start frame")).orderBy("n").limit(1).select(F.col("f").alias("h"), F.col("n").alias("hn"))
    body = lines.join(F.broadcast(head), F.col("n") > F.col("hn"))
    field = lambda name: F.trim(F.get(F.col("f"), (F.array_position("h", name) - 1).cast("int"))).try_cast("long")
    rows = body.select(field("scene number").alias("scene"), (field("start frame") - int(oracle)).alias("start"), field("end frame").alias("end"))
    return rows.where("scene is not null and start is not null and end is not null")
