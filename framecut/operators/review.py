"""Boundary reviews: candidates near the threshold, ranked, with the scenes around them; review decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Adaptive, Content, Options, review_threshold
from ..sources.shared import cut
from .decisions import adaptive_candidates, greedy, rolling
from .scans import numbered, ranked_by
from .scores import reaches
from .spans import containing, scene_spans

STATUS = {"accepted": "accepted", "suppressed": "suppressed_min_scene_len", "near": "near_miss"}


def content_review(rows: DataFrame, total: DataFrame, config: Content = Content(), options: Options = Options(), threshold: float | None = None, gated: bool = False) -> DataFrame:
    """Review of decided content rows (video_id, frame, score, decision, metrics).

    Boundaries are the accepted decisions, so they don't depend on the review threshold.  gated
    judges again, but only rows that reach the review threshold: a higher one then drops boundaries.
    """
    least = review_threshold(config, threshold)
    shown = rows.where(reaches(F.col("score"), least))
    if gated:
        over = rolling(shown.where(reaches(F.col("score"), config.threshold)).select("video_id", "frame"), options.min_scene_len)
        shown = shown.join(over, ["video_id", "frame"], "left")
        status = F.when(F.col("accepted"), STATUS["accepted"]).when(~F.col("accepted"), STATUS["suppressed"]).otherwise(STATUS["near"])
        cuts = over.where("accepted").select("video_id", "frame")
    else:
        status = F.when(F.col("decision") == "accepted", STATUS["accepted"]).when(F.col("decision") == "suppressed_min_scene_len", STATUS["suppressed"]).otherwise(STATUS["near"])
        cuts = rows.where("decision = 'accepted'").select("video_id", "frame")
    seeds = shown.select("video_id", "frame", status.alias("status"), F.lit("content_val").alias("score_metric"), "score", "metrics")
    return ranked(seeds, scene_spans(cuts, total, options.min_scene_len, options.policy), config.threshold, least)


def adaptive_review(ratios: DataFrame, total: DataFrame, config: Adaptive = Adaptive(), options: Options = Options(), threshold: float | None = None) -> DataFrame:
    """Review of adaptive rows (video_id, frame, content_val, adaptive_ratio); the cooldown counts within the gate."""
    least = review_threshold(config, threshold)
    shown = adaptive_candidates(ratios, config, least)
    judged = greedy(shown.where(reaches(F.col("adaptive_ratio"), config.threshold)).select("video_id", "frame"), options.min_scene_len)
    rows = shown.join(judged, ["video_id", "frame"], "left")
    status = F.when(F.col("accepted"), STATUS["accepted"]).when(~F.col("accepted"), STATUS["suppressed"]).otherwise(STATUS["near"])
    metrics = F.create_map(F.lit("adaptive_ratio"), F.col("adaptive_ratio"), F.lit("content_val"), F.col("content_val"))
    seeds = rows.select("video_id", "frame", status.alias("status"), F.lit("adaptive_ratio").alias("score_metric"), F.col("adaptive_ratio").alias("score"), metrics.alias("metrics"))
    return ranked(seeds, scene_spans(judged.where("accepted").select("video_id", "frame"), total, options.min_scene_len, options.policy), config.threshold, least)


def ranked(seeds: DataFrame, spans: DataFrame, threshold: float, least: float) -> DataFrame:
    """Candidates with number (by time), rank (by distance from the threshold, then frame) and context."""
    rows = seeds.withColumns({"detector_threshold": F.lit(float(threshold)), "review_threshold": F.lit(float(least)), "threshold_distance": F.abs(F.col("score") - threshold)})
    return context(ranked_by(numbered(cut(rows), "candidate_number"), "threshold_distance", "rank"), spans)


def context(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """candidates with before and after: the scenes a starting frame divides, else its scene split at it.

    A frame beyond the last scene splits that; without scenes all is 0.
    """
    w = Window.partitionBy("video_id").orderBy("start")
    with_before = spans.withColumns({"p_start": F.lag("start").over(w), "p_end": F.lag("end").over(w)})
    last = spans.groupBy("video_id").agg(F.max(F.struct("start", "end")).alias("__last"))
    starts = with_before.where("start > 0").select("video_id", F.col("start").alias("frame"), F.struct("p_start", "p_end", "start", "end").alias("__cut"))
    rows = containing(candidates, spans, "frame").withColumnsRenamed({"start": "__start", "end": "__end"}).drop("scene_number")
    rows = rows.join(starts, ["video_id", "frame"], "left").join(last, "video_id", "left")
    lo, hi = F.coalesce("__start", "__last.start"), F.coalesce("__end", "__last.end")
    pair = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    cut, none = F.col("__cut").isNotNull(), F.col("__last").isNull()
    zero = F.lit(0)
    before = pair(F.when(none, zero).when(cut, F.col("__cut.p_start")).otherwise(lo), F.when(none, zero).when(cut, F.col("__cut.p_end")).otherwise(F.col("frame")))
    after = pair(F.when(none, zero).when(cut, F.col("__cut.start")).otherwise(F.col("frame")), F.when(none, zero).when(cut, F.col("__cut.end")).otherwise(hi))
    return rows.withColumns({"before": before, "after": after}).drop("__start", "__end", "__cut", "__last")


SORTS = {
    "distance": ("threshold_distance", "frame"),
    "time": ("frame",),
    "time-desc": ("-frame",),
    "score": ("-score", "frame"),
    "score-asc": ("score", "frame"),
    "status": ("status", "frame"),
    "number": ("candidate_number",),
}


def filtered(review: DataFrame, status: str = "all", sort: str = "distance") -> DataFrame:
    """Candidates of a status (edge_case: within the review margin of the threshold) in one of SORTS."""
    margin = F.greatest(F.lit(0.0), F.col("detector_threshold") - F.col("review_threshold")) + 1e-9
    rows = review if status == "all" else review.where(F.col("threshold_distance") <= margin) if status == "edge_case" else review.where(F.col("status") == status)
    return rows.orderBy("video_id", *(F.col(c[1:]).desc() if c[0] == "-" else F.col(c) for c in SORTS[sort]))


def search_scenes(scenes: DataFrame, text: str = "", sort: str = "start") -> DataFrame:
    """Scenes whose number, frames or seconds contain text, in one of four orders."""
    length = F.col("end") - F.col("start")
    found = scenes.where(F.contains(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in scenes.columns if c != "video_id"))), F.lit(text.strip().lower())))
    keys = {"start": ["start"], "start-desc": [F.col("start").desc()], "longest": [length.desc(), "start"], "shortest": [length, "start"]}[sort]
    return found.orderBy("video_id", *keys)


def effective_boundaries(raw: DataFrame, actions: DataFrame, total: DataFrame) -> DataFrame:
    """(raw - rejected) with the accepted and manual ones, strictly inside the video; actions: video_id, frame, action."""
    keep = raw.select("video_id", "frame").join(actions.where("action = 'reject'"), ["video_id", "frame"], "left_anti")
    added = actions.where("action in ('accept', 'manual')").select("video_id", "frame")
    return keep.unionByName(added).distinct().join(total, "video_id").where("frame > 0 and frame < total").select("video_id", "frame")


def merged(raw: DataFrame, actions: DataFrame, cut: DataFrame) -> DataFrame:
    """actions after the boundaries in cut are merged away: a manual one is dropped, any other rejected."""
    hit = cut.select("video_id", "frame").distinct()
    manual = actions.where("action = 'manual'").join(hit, ["video_id", "frame"], "left_semi").select("video_id", "frame")
    rejected = hit.join(manual, ["video_id", "frame"], "left_anti").withColumn("action", F.lit("reject"))
    return actions.join(hit, ["video_id", "frame"], "left_anti").select("video_id", "frame", "action").unionByName(rejected)


def last_actions(log: DataFrame) -> DataFrame:
    """The latest action of each frame in a log (video_id, frame, seq, action)."""
    return log.groupBy("video_id", "frame").agg(F.max_by("action", "seq").alias("action"))


def threshold_diff(baseline: DataFrame, preview: DataFrame) -> DataFrame:
    """video_id, frame, change (added or removed) between two boundary sets."""
    key = ["video_id", "frame"]
    base, new = baseline.select(*key).distinct(), preview.select(*key).distinct()
    return new.join(base, key, "left_anti").withColumn("change", F.lit("added")).unionByName(base.join(new, key, "left_anti").withColumn("change", F.lit("removed")))


def seek(points: DataFrame, at: Column, time: str, forward: bool = True, wrap: bool = False, dead_zone: float = 0.001) -> DataFrame:
    """video_id, time of the next (or previous) point beyond the dead zone around at; wrap goes on at the other end."""
    beyond = F.col(time) > at + dead_zone if forward else F.col(time) < at - dead_zone
    pick, other = (F.min, F.min) if forward else (F.max, F.max)
    found = pick(F.when(beyond, F.col(time)))
    return points.groupBy("video_id").agg((F.coalesce(found, other(time)) if wrap else found).alias(time))
