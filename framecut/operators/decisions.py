"""From scores to boundaries.

Candidates and turns, few beside the scores, are written once before rows meet their neighbours: what finds them runs once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Adaptive, Content, Fade
from ..sources.shared import cut
from .scans import spaced, with_last_known, with_next
from .scores import reaches, with_previous


def rolling(candidates: DataFrame, m: int) -> DataFrame:
    """candidates with accepted: at least m frames after the previous candidate, accepted or not (0 before the first)."""
    rows = with_previous(cut(candidates), ["frame"])
    return rows.withColumn("accepted", F.col("frame") - F.coalesce("prev_frame", F.lit(0)) >= m).drop("prev_frame")


def greedy_frames(candidates: DataFrame, m: int, start: str | None = None) -> DataFrame:
    """video_id, frame of the candidates at least m frames after the last accepted one (start or 0 before the first)."""
    return spaced(cut(candidates), m, F.col(start) if start else F.lit(0))


def greedy(candidates: DataFrame, m: int, start: str | None = None) -> DataFrame:
    """candidates with accepted: whether greedy_frames holds them."""
    candidates = cut(candidates)
    kept = spaced(candidates, m, F.col(start) if start else F.lit(0)).withColumn("accepted", F.lit(True))
    return candidates.join(kept, ["video_id", "frame"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def content_decisions(scores: DataFrame, config: Content = Content(), m: int = 15) -> DataFrame:
    """scores with score, threshold, decision; a video's first row is not evaluated and no candidate."""
    first = scores.groupBy("video_id").agg(F.min("frame").alias("__first"))
    rows = scores.join(first, "video_id").withColumn("__over", reaches(F.col("content_val"), config.threshold) & (F.col("frame") > F.col("__first")))
    judged = rolling(rows.where("__over").select("video_id", "frame"), m)
    decision = F.when(F.col("frame") == F.col("__first"), "not_evaluated").when(F.col("accepted"), "accepted").when(~F.col("accepted"), "suppressed_min_scene_len").otherwise("below_threshold")
    return rows.join(judged, ["video_id", "frame"], "left").withColumns({"score": F.col("content_val"), "threshold": F.lit(config.threshold), "decision": decision}).drop("__first", "__over", "accepted")


def content_boundaries(scores: DataFrame, config: Content = Content(), m: int = 15) -> DataFrame:
    """video_id, frame of content boundaries, by the plain rule: a first row over a threshold of 0 counts too."""
    return rolling(scores.where(reaches(F.col("content_val"), config.threshold)).select("video_id", "frame"), m).where("accepted").select("video_id", "frame")


def adaptive_candidates(ratios: DataFrame, config: Adaptive = Adaptive(), threshold: float | None = None) -> DataFrame:
    least = config.threshold if threshold is None else threshold
    rows = ratios.where(reaches(F.col("content_val"), config.min_content_val) & reaches(F.col("adaptive_ratio"), least))
    return rows.limit(0) if config.frame_window == 0 else rows


def adaptive_boundaries(ratios: DataFrame, config: Adaptive = Adaptive(), m: int = 15) -> DataFrame:
    return greedy_frames(adaptive_candidates(ratios, config).select("video_id", "frame"), m)


def histogram_boundaries(scores: DataFrame, threshold: float = 0.05, m: int = 15) -> DataFrame:
    over = ~F.col("first") & ~F.isnan("hist_diff") & (F.col("hist_diff") <= 1.0 - threshold)
    return greedy_frames(scores.where(over).select("video_id", "frame"), m)


def hash_boundaries(scores: DataFrame, threshold: float = 0.395, m: int = 15) -> DataFrame:
    return greedy_frames(scores.where(~F.col("first") & reaches(F.col("hash_dist"), threshold)).select("video_id", "frame"), m)


def fades(luma: DataFrame, threshold: float) -> DataFrame:
    """video_id, out, in (null if the video ends dark), first, total: each dark stretch of average_rgb.

    A video that begins dark begins with a stretch; not a number changes nothing and is light at the start.
    """
    known = F.when(~F.isnan("average_rgb"), F.col("average_rgb") < threshold)
    marked = with_last_known(luma.select("video_id", "frame", known.alias("known")), "known", False)
    turns = cut(marked.where("before is null or state <> before").select("video_id", "frame", "state"))
    ends = luma.groupBy("video_id").agg(F.min("frame").alias("first"), F.count("*").alias("total"))
    return with_next(turns, "frame").where("state").select("video_id", F.col("frame").alias("out"), F.col("next_frame").alias("in")).join(ends, "video_id")


def fade_boundaries(luma: DataFrame, config: Fade = Fade(), m: int = 15) -> DataFrame:
    """video_id, frame of cuts between the first dark and the next light frame of a fade, and of a final fade-out."""
    found = fades(luma, config.threshold)
    judged = greedy(found.where("`in` is not null").select("video_id", F.col("in").alias("frame"), "out", "first"), m, "first")
    split = (F.col("out") + F.rint((F.col("frame") - F.col("out")) * (1.0 + config.fade_bias) / 2.0)).cast("long")
    cuts = judged.where("accepted").select("video_id", split.alias("frame"))
    if not config.add_last_scene:
        return cuts
    last = judged.where("accepted").groupBy("video_id").agg(F.max("frame").alias("last"))
    final = found.where("`in` is null").join(last, "video_id", "left").where(F.col("total") - F.coalesce("last", "first") >= m)
    return cuts.union(final.select("video_id", F.col("out").alias("frame")))


def reconstructed(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """rows (…, candidate) with decision from the final scenes' starts (video_id, start)."""
    found = starts.select("video_id", F.col("start").alias("frame"), F.lit(True).alias("__starts")).distinct()
    decision = F.when(F.col("frame") == 0, "not_evaluated").when(F.col("__starts"), "accepted").when(F.col("candidate"), "suppressed_min_scene_len").otherwise("below_threshold")
    return rows.join(found, ["video_id", "frame"], "left").withColumn("decision", decision).drop("__starts")


def preview(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows after frame 0 whose score reaches threshold, without any cooldown."""
    return rows.where((F.col("frame") > 0) & F.coalesce("eligible", F.lit(True)) & reaches(F.col("score"), threshold) & (F.abs("score") != float("inf")))
