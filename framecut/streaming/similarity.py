"""A similarity session as Structured Streaming: frames are checked as they are pushed, and a few of them fingerprinted.

Rows carry video_id, arrival (the order of pushes within a video), frame, width, height and rgb.  Buffers of the wrong
length, frame numbers that do not rise in order of arrival, and more pushes than a session takes are errors.  Images are
fingerprinted where they are read; the state of a video is its last frame and its number of pushes.  A session ends by
``finish`` on the fingerprints written so far.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.image import as_image, similarity_hash
from ..operators.similarity import MAX_PAIRS, MAX_SAMPLES, MAX_SCENES, even_scenes, scene_hashes, similar_pairs, stride

OUTPUT = "video_id long, frame long, hash long"


@F.pandas_udf(T.LongType())
def _print_of(rgb: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([None if image is None else similarity_hash(as_image(image, w, h)) for image, w, h in zip(rgb, width, height, strict=True)], dtype="Int64")


def checked_sizes(frames: DataFrame) -> DataFrame:
    """frames, after a check that each has pixels and as many bytes as its sides ask for."""
    width, height = F.col("width").cast("long"), F.col("height").cast("long")
    good = (width > 0) & (height > 0) & (F.length("rgb") == width * height * 3)
    said = F.concat(F.lit("frame "), F.col("frame").cast("string"), F.lit(" has a buffer of the wrong length"))
    return frames.where(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(said).cast("boolean")))


def push(last: int | None, pushed: int, frame: int, most: int = MAX_SAMPLES) -> tuple[int, int]:
    """The state after a frame is pushed."""
    if last is not None and frame <= last:
        raise ValueError(f"frame {frame} after {last}: frames must rise")
    if pushed >= most:
        raise ValueError(f"a session takes at most {most} frames")
    return frame, pushed + 1


def fingerprint_stream(stream: DataFrame, fps: float, most: int = MAX_SAMPLES) -> DataFrame:
    """video_id, frame, hash of every frame whose number the stride of fps divides, once the push is found in order."""
    sampled = F.col("frame") % stride(fps) == 0
    printed = _print_of(F.when(sampled, F.col("rgb")), "width", "height")
    # No null hashes: pandas would hold the column as doubles then, which lose bits.
    small = checked_sizes(stream).select("video_id", "arrival", "frame", F.coalesce(printed, F.lit(0).cast("long")).alias("hash"), sampled.alias("sampled"))

    def step(key, batches, state: GroupState):
        last, pushed = state.get if state.exists else (None, 0)
        rows = pd.concat(batches).sort_values("arrival", kind="stable")
        for frame in rows["frame"]:
            last, pushed = push(last, pushed, int(frame), most)
        if last is not None:
            state.update((last, pushed))
        yield rows.loc[rows["sampled"], ["video_id", "frame", "hash"]]

    return small.groupBy("video_id").applyInPandasWithState(step, OUTPUT, "last long, pushed long", "append", GroupStateTimeout.NoTimeout)


def finish(signatures: DataFrame, spans: DataFrame, limit: int = MAX_SCENES, most: int = MAX_PAIRS) -> DataFrame:
    """The most similar pairs of scenes, from the fingerprints that a session wrote and the scenes found since."""
    return similar_pairs(scene_hashes(signatures, even_scenes(spans, limit)), most)
