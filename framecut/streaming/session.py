"""Push sessions as Structured Streaming: one small state for each video.

Rows carry video_id, frame, value (a score or mean luma) or feature (histogram or hash as doubles),
last (true on the marker row that ends a video), and time (when it is presented) where that is known.  Frames must rise,
but may be sparse, and times must not fall; others are errors, as nothing is reordered across batches.  Results equal those of the batch operators.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scores import EPSILON

#: The state of a video: frames seen, the last one and its time, the last cut; the feature before (histogram, hash),
#: whether it is dark and since when (threshold), and the samples that a window still needs (adaptive).
STATE = "total long, last long, time double, cut long, feature array<double>, dark boolean, fade long, samples array<struct<frame: long, value: double>>, emitted long"
NAMES = ("total", "last", "time", "cut", "feature", "dark", "fade", "samples", "emitted")
OUTPUT = "video_id long, frame long, score double, boundary long, value double, total long"


class Session:
    """The state of one video; push gives (frame, score, boundary or None, value) rows as soon as they are known."""

    def __init__(self, config, m: int, state: dict | None = None) -> None:
        self.config, self.m = config, m
        self.s = state or {"total": 0, "last": None, "time": None, "cut": 0, "feature": None, "dark": None, "fade": None, "samples": [], "emitted": 0}

    def push(self, frame: int, value: float | None, feature: list | None, time: float | None = None) -> list[tuple]:
        s = self.s
        if s["last"] is not None and frame <= s["last"]:
            raise ValueError(f"frame {frame} after {s['last']}: frames must rise")
        if time is not None:
            if s["time"] is not None and time < s["time"]:
                raise ValueError(f"time {time} of frame {frame} after {s['time']}: times must not fall")
            s["time"] = time
        if not s["total"] and self.config.name == "threshold":
            s["cut"] = frame
        s["last"], s["total"] = frame, s["total"] + 1
        return getattr(self, f"_{self.config.name}")(frame, value, feature)

    def _accept(self, frame: int) -> int | None:
        if frame - self.s["cut"] < self.m:
            return None
        self.s["cut"] = frame
        return frame

    def _content(self, frame, value, _):
        boundary = None
        if value >= self.config.threshold:
            boundary = frame if frame - self.s["cut"] >= self.m else None
            self.s["cut"] = frame  # a suppressed candidate delays the next one too
        return [(frame, value, boundary, value)]

    def _adaptive(self, frame, value, _):
        self.s["samples"].append((frame, value))
        return self._settle(False)

    def _settle(self, end: bool) -> list[tuple]:
        """Rows whose window is complete, or at the end all that are left."""
        s, w, out = self.s, self.config.frame_window, []
        while s["emitted"] < s["total"]:
            at = s["emitted"]
            first = s["total"] - len(s["samples"])  # position of the oldest sample kept
            whole = at >= w and at + w < s["total"]
            if not (whole or at < w or end):
                break
            frame, value = s["samples"][at - first]
            score = 0.0
            if whole and w:
                around = [v for _, v in s["samples"][at - first - w : at - first + w + 1]]
                score = value / ((sum(around[:w]) + sum(around[w + 1 :])) / (2 * w) + EPSILON)
            hit = w and value >= self.config.min_content_val and score >= self.config.threshold
            out.append((frame, score, self._accept(frame) if hit else None, value))
            s["emitted"] += 1
            s["samples"] = s["samples"][max(0, s["emitted"] - w - first) :]
        return out

    def _threshold(self, frame, value, _):
        s, dark, boundary = self.s, self.s["dark"], None
        if dark is None:
            s["dark"], s["fade"] = value < self.config.threshold, frame
        elif not dark and value < self.config.threshold:
            s["dark"], s["fade"] = True, frame
        elif dark and value >= self.config.threshold:
            if frame - s["cut"] >= self.m:
                boundary = s["fade"] + round((frame - s["fade"]) * (1 + self.config.fade_bias) / 2)
                s["cut"] = frame
            s["dark"], s["fade"] = False, frame
        return [(frame, value, boundary, value)]

    def _histogram(self, frame, _, feature):
        before, self.s["feature"] = self.s["feature"], feature
        if before is None:
            return [(frame, 0.0, None, None)]
        a, b = np.array(before) - np.mean(before), np.array(feature) - np.mean(feature)
        scale = float(np.sqrt((a @ a) * (b @ b)))
        score = float(a @ b) / scale if scale else 1.0
        return [(frame, score, self._accept(frame) if score <= 1 - self.config.threshold else None, None)]

    def _hash(self, frame, _, feature):
        before, self.s["feature"] = self.s["feature"], feature
        if before is None:
            return [(frame, 0.0, None, None)]
        n = min(len(before), len(feature))
        score = sum(x != y for x, y in zip(before, feature, strict=False)) / n if n else 0.0
        return [(frame, score, self._accept(frame) if score >= self.config.threshold else None, None)]

    def finish(self) -> list[tuple]:
        """What the end of the video settles: the adaptive tail, a final fade-out."""
        s = self.s
        if self.config.name == "adaptive":
            return self._settle(True)
        if self.config.name == "threshold" and s["dark"] and self.config.add_last_scene and s["total"] - s["cut"] >= self.m:
            return [(s["last"], 0.0, s["fade"], None)]
        return []


def detect_stream(stream: DataFrame, config, m: int = 15) -> DataFrame:
    """video_id, frame, score, boundary (frame of a cut, else null), total (on a video's last row) as a stream.

    A final fade-out gives one more row at the last frame.
    """

    def step(key, frames, state: GroupState):
        session = Session(config, m, dict(zip(NAMES, state.get, strict=True)) if state.exists else None)
        rows = pd.concat(frames).sort_values("frame", kind="stable")
        out, ended = [], False
        for frame, value, feature, last, time in zip(*(rows[c] for c in ("frame", "value", "feature", "last", "time")), strict=True):
            if ended:
                raise ValueError(f"video {key[0]} goes on after its end")
            if last:
                out += [(*r, session.s["total"]) for r in session.finish()] or [(session.s["last"], 0.0, None, None, session.s["total"])]
                ended = True
            else:
                out += [(*r, None) for r in session.push(int(frame), value, None if feature is None else list(map(float, feature)), None if pd.isna(time) else float(time))]
        if ended:
            state.remove()
        else:
            state.update(tuple(session.s[name] for name in NAMES))
        yield pd.DataFrame({"video_id": [key[0]] * len(out), "frame": pd.array([r[0] for r in out], "Int64"), "score": [r[1] for r in out], "boundary": pd.array([r[2] for r in out], "Int64"), "value": pd.array([r[3] for r in out], "Float64"), "total": pd.array([r[4] for r in out], "Int64")})

    time = (F.col("time") if "time" in stream.columns else F.lit(None)).cast("double").alias("time")
    return stream.select("video_id", "frame", "value", "feature", "last", time).groupBy("video_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_spans(rows: DataFrame) -> DataFrame:
    """Scenes of ended videos from the rows that detect_stream wrote."""
    from ..operators.spans import scene_spans

    total = rows.groupBy("video_id").agg(F.max("total").alias("total")).where("total is not null")
    return scene_spans(rows.where("boundary is not null").select("video_id", F.col("boundary").alias("frame")), total)


def stream_review(rows: DataFrame, config, options, threshold: float | None = None) -> DataFrame:
    """Boundary review of ended videos from the rows that detect_stream wrote for a content or adaptive detector."""
    from ..config import review_threshold
    from ..operators.decisions import content_decisions
    from ..operators.review import adaptive_review, content_review

    if config.name not in ("content", "adaptive"):
        raise ValueError("only content and adaptive detectors have a review")
    review_threshold(config, threshold)
    total = rows.groupBy("video_id").agg(F.max("total").alias("total")).where("total is not null")
    ended = rows.where("value is not null").join(total.select("video_id"), "video_id", "left_semi")
    if config.name == "adaptive":
        return adaptive_review(ended.select("video_id", "frame", F.col("value").alias("content_val"), F.col("score").alias("adaptive_ratio")), total, config, options, threshold)
    frames = ended.select("video_id", "frame", F.col("score").alias("content_val"))
    judged = content_decisions(frames, config, options.min_scene_len).withColumn("metrics", F.create_map(F.lit("content_val"), "score"))
    return content_review(judged, total, config, options, threshold)
