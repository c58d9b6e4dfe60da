"""One query for each group of operators, over the plain tables.  Each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import MERGE_LAST, Adaptive, Content, Fade, Histogram, Options
from ..functions import image, pixel, timecode
from ..operators import decisions, features, joins, quality, review, scores, similarity, spans, timeline
from ..sources import frames as sources
from ..sources import tables

CONTENT, CONTENT_M = Content(threshold=10.0), 3
HIST, HIST_M = Histogram(threshold=0.15, bins=16), 3
ADAPTIVE, ADAPTIVE_M = Adaptive(), 5
FADE, FADE_M = Fade(threshold=12.0), 5
HASH_SIZE, HASH_LOWPASS, HASH_THRESHOLD, HASH_M = 4, 2, 0.625, 3


def _binary(frames):
    """Frames with px as binary rgb."""
    return frames.select("video_id", "frame", "width", "height", F.unhex(F.array_join(F.transform("px", lambda p: F.concat(*(F.lpad(F.hex(p[c].cast("long")), 2, "0") for c in "rgb"))), "")).alias("rgb"))


def hsv_pixels(spark, d):
    rows = tables.rgb_frames(spark, d).select("frame", F.posexplode(F.transform("px", pixel.hsv)).alias("pixel", "c"))
    return rows.select("frame", "pixel", "c.h", "c.s", "c.v")


def luma_mean(spark, d):
    return scores.luma_scores(tables.rgb_frames(spark, d)).select("frame", F.round("average_rgb", 6).alias("average_rgb"))


def luma_histogram(spark, d):
    rows = tables.gray_frames(spark, d).select("frame", F.posexplode(pixel.luma_histogram(F.col("px"), 16)).alias("bin", "x"))
    return rows.select("frame", "bin", F.round("x", 6).alias("x"))


def compact_luma(spark, d):
    rows = tables.rgb_frames(spark, d).select("frame", pixel.compact_luma(F.col("px"), F.col("width"), F.col("height"), 4).alias("y"))
    return rows.select("frame", F.posexplode("y").alias("cell", "luma"))


def content_scores(spark, d):
    return scores.content_scores(tables.rgb_frames(spark, d)).select("frame", F.round("content_val", 6).alias("content_val"))


def content_components(spark, d):
    rows = scores.content_scores(tables.rgb_frames(spark, d), Content(weights=(0.5, 1.0, 2.0, 0.0)))
    return rows.select("frame", *(F.round(c, 6).alias(c) for c in ("content_val", "delta_hue", "delta_saturation", "delta_luminance", "delta_edges")))


def content_luma_only(spark, d):
    return scores.content_scores(tables.rgb_frames(spark, d), Content(luma_only=True)).select("frame", F.round("content_val", 6).alias("content_val"))


def _content(spark, d):
    gray = tables.gray_frames(spark, d)
    return scores.content_scores(gray), spans.totals(gray)


def content_decisions(spark, d):
    return decisions.content_decisions(_content(spark, d)[0], CONTENT, CONTENT_M).select("frame", F.round("score", 6).alias("score"), "threshold", "decision")


def content_scenes(spark, d):
    found, total = _content(spark, d)
    return spans.scene_spans(decisions.content_boundaries(found, CONTENT, CONTENT_M), total, CONTENT_M)


def content_merge_last(spark, d):
    found, total = _content(spark, d)
    return spans.scene_spans(decisions.content_boundaries(found, CONTENT, CONTENT_M), total, 400, MERGE_LAST)


def edge_distance(spark, d):
    rows = _binary(tables.gray_frames(spark, d)).withColumn("edge", image.edges("rgb", "width", "height"))
    found = scores.with_previous(rows.select("video_id", "frame", "edge"), ["edge"])
    return found.select("frame", F.coalesce(scores.edge_distance(F.col("edge"), F.col("prev_edge")), F.lit(0.0)).alias("delta_edges"))


def binary_content_scores(spark, d):
    return features.image_content_scores(_binary(tables.rgb_frames(spark, d))).select("frame", F.round("content_val", 6).alias("content_val"))


def wide_content_scores(spark, d):
    return features.image_content_scores(tables.wide_frames(spark, d)).select("frame", *(F.round(c, 6).alias(c) for c in ("content_val", "delta_hue", "delta_saturation", "delta_luminance")))


def wide_features(spark, d):
    """Mean luma and histogram of frames of 320 x 180, and hashes of frames whose sides the hash doesn't divide."""
    found = features.frame_features(tables.wide_frames(spark, d), luma=True, bins=16)
    bits = features.frame_features(tables.wide_frames(spark, d, 20, 12), phash=(HASH_SIZE, HASH_LOWPASS))
    text = F.array_join(F.transform("bits", lambda b: b.cast("int").cast("string")), "").alias("bits")
    return found.join(bits, ["video_id", "frame"]).select("frame", F.round(F.col("average_rgb") * 57_600_000).cast("long").alias("luma_total"), F.round(F.get("hist", F.lit(7)), 6).alias("bin_7"), F.round(F.aggregate("hist", F.lit(0.0), lambda a, x: a + x), 6).alias("hist_sum"), text)


def hist_scores(spark, d):
    return scores.histogram_scores(tables.gray_frames(spark, d), HIST).select("frame", F.round("hist_diff", 6).alias("hist_diff"), "first")


def hist_scenes(spark, d):
    gray = tables.gray_frames(spark, d)
    return spans.scene_spans(decisions.histogram_boundaries(scores.histogram_scores(gray, HIST), HIST.threshold, HIST_M), spans.totals(gray))


def _hashes(spark, d):
    return features.frame_features(_binary(tables.gray_frames(spark, d)), phash=(HASH_SIZE, HASH_LOWPASS))


def hash_bits(spark, d):
    return _hashes(spark, d).select("frame", F.array_join(F.transform("bits", lambda b: b.cast("int").cast("string")), "").alias("bits"))


def hash_scenes(spark, d):
    found = scores.hash_scores(_hashes(spark, d))
    return spans.scene_spans(decisions.hash_boundaries(found, HASH_THRESHOLD, HASH_M), spans.totals(tables.gray_frames(spark, d)))


def frame_fingerprints(spark, d):
    prints = features.frame_features(_binary(tables.gray_frames(spark, d)), fingerprint=True)
    return prints.select("frame", F.lpad(F.bin("hash"), 64, "0").alias("print"))


def _ratios(spark, d):
    return scores.adaptive_scores(tables.score_stream(spark, d), ADAPTIVE.frame_window)


def adaptive_scores(spark, d):
    return _ratios(spark, d).select("video_id", "frame", F.round("adaptive_ratio", 6).alias("adaptive_ratio"))


def adaptive_scenes(spark, d):
    rows = _ratios(spark, d)
    return spans.scene_spans(decisions.adaptive_boundaries(rows, ADAPTIVE, ADAPTIVE_M), spans.totals(rows))


def fade_events(spark, d):
    return decisions.fades(tables.score_stream(spark, d), FADE.threshold).select("video_id", "out", F.col("in").alias("back"))


def _fade_spans(spark, d):
    rows = tables.score_stream(spark, d)
    return spans.scene_spans(decisions.fade_boundaries(rows, FADE, FADE_M), spans.totals(rows))


def fade_scenes(spark, d):
    return _fade_spans(spark, d)


def stats_long_to_wide(spark, d):
    rows = tables.score_stream(spark, d).select("video_id", "frame", F.create_map(F.lit("content_val"), "content_val", F.lit("half"), F.col("content_val") / 2).alias("metrics"))
    return rows.select("video_id", "frame", *(F.coalesce(F.element_at("metrics", n), F.lit(0.0)).alias(n) for n in ("content_val", "half", "missing")))


def stats_rows_decisions(spark, d):
    rows = _ratios(spark, d).withColumn("metrics", F.create_map(F.lit("adaptive_ratio"), "adaptive_ratio"))
    rows = scores.detector_row(rows, "adaptive", ADAPTIVE.threshold).withColumn("candidate", F.col("candidate") & (F.col("content_val") >= ADAPTIVE.min_content_val))
    return decisions.reconstructed(rows, adaptive_scenes(spark, d)).select("video_id", "frame", "decision")


def stored_scenes(spark, d):
    rows = stats_rows_decisions(spark, d)
    return spans.stored_spans(rows, spans.totals(rows))


def threshold_preview(spark, d):
    rows = tables.score_stream(spark, d).select("video_id", "frame", F.col("content_val").alias("score"), (F.col("frame") % 2 == 0).alias("eligible"))
    return decisions.preview(rows, 60.0).select("video_id", "frame", "score")


def scene_counts(spark, d):
    return spans.boundary_count(_fade_spans(spark, d))


def _reviewed(spark, d):
    found, total = _content(spark, d)
    rows = decisions.content_decisions(found, CONTENT, CONTENT_M).withColumn("metrics", F.create_map(F.lit("content_val"), "score"))
    return review.content_review(rows, total, CONTENT, Options(CONTENT_M), 9.5)


def boundary_review(spark, d):
    return _reviewed(spark, d).select("frame", "status", "candidate_number", "rank", F.round("threshold_distance", 6).alias("threshold_distance"))


def review_context(spark, d):
    return _reviewed(spark, d).select("frame", F.col("before.start").alias("before_start"), F.col("before.end").alias("before_end"), F.col("after.start").alias("after_start"), F.col("after.end").alias("after_end"))


def adaptive_review(spark, d):
    rows = _ratios(spark, d)
    found = review.adaptive_review(rows, spans.totals(rows), ADAPTIVE, Options(ADAPTIVE_M))
    return found.select("video_id", "frame", "status", "candidate_number", F.round("score", 6).alias("score"))


def _actions(spark, d):
    action = F.element_at(F.array(F.lit("reject"), F.lit("accept"), F.lit("manual")), (F.col("frame") % 3 + 1).cast("int"))
    return tables.score_stream(spark, d).where("frame % 7 = 0").select("video_id", "frame", action.alias("action"))


def _raw(spark, d):
    return adaptive_scenes(spark, d).where("start > 0").select("video_id", F.col("start").alias("frame"))


def effective_boundaries(spark, d):
    return review.effective_boundaries(_raw(spark, d), _actions(spark, d), spans.totals(tables.score_stream(spark, d)))


def reviewed_scenes(spark, d):
    return spans.scene_spans(effective_boundaries(spark, d), spans.totals(tables.score_stream(spark, d)))


def threshold_diff(spark, d):
    new = decisions.adaptive_boundaries(_ratios(spark, d), Adaptive(threshold=4.0), ADAPTIVE_M)
    return review.threshold_diff(_raw(spark, d), new)


def scene_timeline(spark, d):
    rows = timeline.scene_timeline(_fade_spans(spark, d), tables.timing(spark, d))
    return rows.select("video_id", "scene_number", F.col("start_time.ticks").alias("start_ticks"), F.col("end_time.ticks").alias("end_ticks"))


def _signatures(spark, d):
    value = F.aggregate(F.sequence(F.lit(0), F.lit(61)), F.lit(0).cast("long"), lambda a, k: a + F.when(F.get(F.col("px"), k)["r"] > 112, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return tables.gray_frames(spark, d).select("video_id", "frame", value.alias("hash"))


def _blocks(spark, d):
    """Scenes of five frames each."""
    gray = tables.gray_frames(spark, d)
    return spans.scene_spans(gray.where("frame % 5 = 0").select("video_id", "frame"), spans.totals(gray))


def stride_samples(spark, d):
    return similarity.sampled(_signatures(spark, d), 2.5).select("frame", "hash")


def scene_selection(spark, d):
    return similarity.even_scenes(_blocks(spark, d), 64).select("scene_number", "start", "end")


def scene_majority_hash(spark, d):
    return similarity.scene_hashes(_signatures(spark, d), _blocks(spark, d)).select("scene_number", "hash", "samples")


def scene_similarity_pairs(spark, d):
    chosen = similarity.even_scenes(_blocks(spark, d))
    return similarity.similar_pairs(similarity.scene_hashes(_signatures(spark, d), chosen)).select("rank", "first_scene", "second_scene", "distance", "similarity")


def similarity_report(spark, d):
    return similarity.similarity_report(similarity.sampled(_signatures(spark, d), 7.0), _blocks(spark, d), 64).drop("video_id")


def _media(spark, d):
    seconds = timecode.seconds(F.col("presentation_time"))
    w = Window.partitionBy("video_id")
    rows = tables.timing(spark, d).select("video_id", F.col("frame").alias("sample"), F.round(seconds - F.min(seconds).over(w), 3).alias("media_time_seconds"))
    return rows


def nearest_sample(spark, d):
    media = _media(spark, d)
    ends = media.groupBy("video_id").agg(F.max("media_time_seconds").alias("end"))
    times = ends.select("video_id", "end", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k")).select("video_id", "k", F.floor(F.col("end") * F.col("k") / 20).cast("double").alias("time"))
    return joins.nearest_sample(times, media).select("video_id", "k", "time", "sample")


def previous_sample(spark, d):
    samples = _media(spark, d)
    points = samples.select("video_id", (F.col("sample") - 1).alias("sample_at")).union(samples.select("video_id", F.col("sample") + 1))
    return joins.previous_sample(points, samples)


def compare_runs(spark, d):
    at = lambda b: b.select("video_id", (F.col("frame") / 10.0).alias("time"))
    return joins.compare_runs(at(_raw(spark, d)), at(decisions.adaptive_boundaries(_ratios(spark, d), Adaptive(threshold=4.0), ADAPTIVE_M)), 2.0)


def score_downsample(spark, d):
    return joins.downsample(tables.score_stream(spark, d), 16, "content_val")


def _matched(spark, d, tolerance):
    of = lambda t: decisions.adaptive_boundaries(_ratios(spark, d), Adaptive(threshold=t), ADAPTIVE_M).select(F.col("video_id").cast("string").alias("case_id"), "frame")
    return quality.matches(of(3.0), of(4.0), tolerance)


def boundary_match(spark, d):
    return _matched(spark, d, 0).select("case_id", "kind", F.coalesce("reference_frame", "candidate_frame").alias("frame"))


def boundary_match_totals(spark, d):
    return quality.quality_totals(quality.case_metrics(_matched(spark, d, 0)))


def boundary_match_tolerant(spark, d):
    return quality.case_metrics(_matched(spark, d, 3))


def boundary_match_pairs(spark, d):
    """The pairs of dense boundaries, where many matchings are equally good."""
    rows = tables.score_stream(spark, d)
    of = lambda where: rows.where(where).select(F.col("video_id").cast("string").alias("case_id"), "frame")
    return quality.matches(of("average_rgb < 20"), of("average_rgb >= 20 and average_rgb < 45"), 3)


def worst_divergences(spark, d):
    return quality.worst_divergences(_matched(spark, d, 0), 25)


def parity_compare(spark, d):
    rename = lambda s: s.withColumnRenamed("scene_number", "scene")
    return quality.parity(rename(adaptive_scenes(spark, d)), rename(reviewed_scenes(spark, d)), 1, ("video_id",))


def bench_pairs(spark, d):
    label = F.concat("o_orderpriority", F.when(F.col("o_orderstatus") == "F", " reference").otherwise(" candidate"))
    rows = tables.read(spark, d, "orders").groupBy(label.alias("label")).agg(F.round(F.avg("o_totalprice"), 2).alias("mean"))
    return quality.bench_pairs(rows).select("id", "reference", "candidate", F.round("ratio", 6).alias("ratio"), "winner")


def timecodes(spark, d):
    part = timecode.millisecond_clock(F.col("frame"), F.lit(23.976))
    core = timecode.clock_parts(F.col("frame"), F.lit(23.976))
    rows = tables.read(spark, d, "events").select((F.col("event_id") * 37).alias("frame"))
    text = F.concat(F.col("frame").cast("string"), F.lit("s"))
    return rows.select("frame", part["hours"].alias("hours"), part["minutes"].alias("minutes"), part["seconds"].alias("seconds"), part["millis"].alias("millis"), core["minutes"].alias("core_minutes"), timecode.frames_of(text, F.lit(30.0)).alias("parsed"))


def sample_times(spark, d):
    videos = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("video_id"), (F.col("c_custkey") % 7 + 0.5).alias("duration"), F.lit(4.0).alias("fps"))
    return sources.sample_times(videos).select("video_id", "sample", F.round("target", 6).alias("target"))


QUERIES = {
    f.__name__: f
    for f in (
        content_scenes, hsv_pixels, luma_mean, luma_histogram, compact_luma, content_scores, content_components, content_luma_only, content_decisions,
        content_merge_last, edge_distance, binary_content_scores, wide_content_scores, wide_features, hist_scores, hist_scenes, hash_bits, hash_scenes, frame_fingerprints, adaptive_scores, adaptive_scenes,
        fade_events, fade_scenes, stats_long_to_wide, stats_rows_decisions, stored_scenes, threshold_preview, scene_counts, boundary_review, review_context,
        adaptive_review, effective_boundaries, reviewed_scenes, threshold_diff, scene_timeline, stride_samples, scene_selection, scene_majority_hash,
        scene_similarity_pairs, similarity_report, nearest_sample, previous_sample, compare_runs, score_downsample, boundary_match, boundary_match_totals,
        boundary_match_tolerant, boundary_match_pairs, worst_divergences, parity_compare, bench_pairs, timecodes, sample_times,
    )
}
