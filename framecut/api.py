"""Batch entry points: frames in, scores, boundaries, scenes and reviews out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Adaptive, Content, Fade, Hash, Histogram, Options
from .operators import decisions, features, review, scores, spans


class Detection(NamedTuple):
    """scores: one row a frame; boundaries: first frames of new scenes; scenes: spans that tile the videos."""

    scores: DataFrame
    boundaries: DataFrame
    scenes: DataFrame


def frame_scores(frames: DataFrame, config) -> DataFrame:
    """Scores of a detector over frames with px, or binary frames with width, height, rgb."""
    binary = "px" not in frames.columns
    if isinstance(config, (Content, Adaptive)):
        content = config if isinstance(config, Content) else Content()
        rows = features.image_content_scores(frames, content) if binary else scores.content_scores(frames, content)
        return scores.adaptive_scores(rows, config.frame_window) if isinstance(config, Adaptive) else rows
    if isinstance(config, Fade):
        return features.frame_features(frames, luma=True) if binary else scores.luma_scores(frames)
    if isinstance(config, Hash):
        return scores.hash_scores(features.frame_features(frames, phash=(config.size, config.lowpass)))
    return scores.histogram_scores(frames, config)


def boundaries_of(rows: DataFrame, config, m: int) -> DataFrame:
    """Boundaries of scored rows."""
    rule = {
        Content: lambda: decisions.content_boundaries(rows, config, m),
        Adaptive: lambda: decisions.adaptive_boundaries(rows, config, m),
        Fade: lambda: decisions.fade_boundaries(rows, config, m),
        Histogram: lambda: decisions.histogram_boundaries(rows, config.threshold, m),
        Hash: lambda: decisions.hash_boundaries(rows, config.threshold, m),
    }
    return rule[type(config)]()


def detect(frames: DataFrame, config=Content(), options: Options = Options()) -> Detection:
    """Scores, boundaries and scenes of frames; the hash detector takes binary frames."""
    rows = frame_scores(frames, config)
    cuts = boundaries_of(rows, config, options.min_scene_len)
    return Detection(rows, cuts, spans.scene_spans(cuts, spans.totals(frames), options.min_scene_len, options.policy))


def boundary_review(frames: DataFrame, config=Content(), options: Options = Options(), threshold: float | None = None) -> DataFrame:
    """Ranked candidates near the threshold; only content and adaptive detectors have a review."""
    review.review_threshold(config, threshold)
    rows, total = frame_scores(frames, config), spans.totals(frames)
    if isinstance(config, Adaptive):
        return review.adaptive_review(rows, total, config, options, threshold)
    judged = decisions.content_decisions(rows, config, options.min_scene_len).withColumn("metrics", F.create_map(F.lit("content_val"), "score"))
    return review.content_review(judged, total, config, options, threshold)


def stats(frames: DataFrame, config=Content(), options: Options = Options()) -> DataFrame:
    """video_id, frame, score, threshold, decision, metrics of every frame."""
    found = detect(frames, config, options)
    if isinstance(config, Content):
        return decisions.content_decisions(found.scores, config, options.min_scene_len).withColumn("metrics", F.create_map(F.lit("content_val"), "score")).select("video_id", "frame", "score", "threshold", "decision", "metrics")
    name = {Adaptive: "adaptive_ratio", Fade: "average_rgb", Histogram: "hist_diff", Hash: "hash_dist"}[type(config)]
    key = config.metric if isinstance(config, (Histogram, Hash)) else name
    rows = scores.detector_row(found.scores.withColumn("metrics", F.create_map(F.lit(key), F.col(name))), config.name, config.threshold)
    if isinstance(config, Adaptive):
        rows = rows.withColumn("candidate", F.col("candidate") & (F.col("content_val") >= config.min_content_val))
    return decisions.reconstructed(rows, found.scenes).select("video_id", "frame", "score", "threshold", "decision", "metrics")
