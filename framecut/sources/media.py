"""Video files by ffmpeg and ffprobe on the executors: decoded frames, and beside them their timing records.

Images and records are two ordered streams of one file, read in step by one task a file: neither is held whole.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import parse_timing, probe, require

FRAMES = "path string, frame long, width int, height int, rgb binary, record string, numerator long, denominator long"


class ToolError(Exception):
    """A tool that ended badly, or said less than it should."""


def images(path: str, width: int, height: int) -> Iterator[bytes]:
    """rgb24 frames of a file; one that ends within a frame, or a decoder that fails, is an error."""
    size, k = width * height * 3, 0
    with subprocess.Popen([require("ffmpeg"), "-v", "error", "-i", path, "-fps_mode", "passthrough", "-f", "rawvideo", "-pix_fmt", "rgb24", "-"], stdout=subprocess.PIPE) as p:
        while data := p.stdout.read(size):
            if len(data) < size:
                raise ToolError(f"truncated frame {k} of {path}")
            yield data
            k += 1
    if p.returncode:
        raise ToolError(f"ffmpeg ended with {p.returncode} on {path}")


def records(path: str) -> Iterator[str]:
    """Timing records of a file's frames in order, as ffprobe prints them."""
    entries = "frame=best_effort_timestamp,duration,pkt_duration"
    with subprocess.Popen([require("ffprobe"), "-v", "error", "-select_streams", "v:0", "-show_frames", "-show_entries", entries, "-of", "compact=p=0:nk=0", path], stdout=subprocess.PIPE, text=True) as p:
        try:
            yield from (line.strip() for line in p.stdout if line.strip())
        finally:
            p.kill()  # frames may end first


def in_step(frames: Iterable, timing: Callable[[], Iterator[str]], first: int = 0) -> Iterator[tuple]:
    """(number, frame, record): records are opened at the first frame that wants one, and those of earlier frames passed over.

    A record missing for a wanted frame is an error; records beyond the last frame aren't read.
    """
    opened = None
    try:
        for k, frame in enumerate(frames):
            if k < first:
                yield k, frame, None
                continue
            if opened is None:
                opened = timing()
                for at in range(k):
                    if next(opened, None) is None:
                        raise ToolError(f"no timing record for frame {at}")
            record = next(opened, None)
            if record is None:
                raise ToolError(f"no timing record for frame {k}")
            yield k, frame, record
    finally:
        if opened is not None:
            opened.close()


def decode_timed(videos: DataFrame, first: int = 0) -> DataFrame:
    """path, frame, width, height, rgb, record, numerator, denominator of the files in videos (path, width, height, base).

    record is null before frame number first; the time base goes along, so that nothing is joined to the images.
    """

    def run(batches):
        for b in batches:
            for v in b.to_pylist():
                fixed = [v[c] for c in ("width", "height")], [v[c] for c in ("numerator", "denominator")]
                for k, data, record in in_step(images(v["path"], *fixed[0]), lambda path=v["path"]: records(path), first):
                    row = [v["path"], k, *fixed[0], data, record, *fixed[1]]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in FRAMES.split(", ")]
    return videos.select("path", "width", "height", "base.numerator", "base.denominator").mapInArrow(run, FRAMES)


def decode(videos: DataFrame) -> DataFrame:
    """path, frame, width, height, rgb of the files in videos (path, width, height), without their times."""

    def run(batches):
        for b in batches:
            for path, w, h in zip(*(b.column(c).to_pylist() for c in ("path", "width", "height")), strict=True):
                for k, data in enumerate(images(path, w, h)):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int64()), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([data], pa.binary())], ["path", "frame", "width", "height", "rgb"])

    return videos.select("path", "width", "height").mapInArrow(run, "path string, frame long, width int, height int, rgb binary")


def open_videos(paths: DataFrame, override: Column | None = None) -> DataFrame:
    """video_id (hash of the path), path, width, height, frame_rate, base of the files in column path; a file that can't be probed is an error."""
    found = probe(paths, override)
    bad = F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("error"))).cast("boolean")
    return found.where(F.when(F.col("error").isNotNull(), bad).otherwise(True)).select(F.xxhash64("path").alias("video_id"), "path", "width", "height", "frame_rate", "base")


def video_frames(videos: DataFrame, first: int = 0) -> DataFrame:
    """video_id, frame, width, height, rgb, presentation_time, duration of the files that open_videos found."""
    timed = decode_timed(videos, first).withColumn("video_id", F.xxhash64("path"))
    rows = parse_timing(timed, F.struct("numerator", "denominator"))
    return rows.select("video_id", "frame", "width", "height", "rgb", "presentation_time", "duration")
