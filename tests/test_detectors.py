import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framecut import api
from framecut.config import MERGE_LAST, Adaptive, Content, Fade, Hash, Histogram, Options, load, review_threshold
from framecut.functions import image
from framecut.operators import decisions, features, scores, spans
from framecut.sources.frames import solid_frames, to_pixels


def gray(spark, *values, size=2):
    return to_pixels(solid_frames(spark, [(v, v, v) for v in values], size, size))


def scenes(df):
    return [(r.start, r.end) for r in df.orderBy("video_id", "start").collect()]


def spans_of(spark, config, values, m=1, policy="suppress"):
    frames = gray(spark, *values)
    if isinstance(config, Hash):
        frames = frames.drop("px")
    return scenes(api.detect(frames, config, Options(m, policy)).scenes)


def series(spark, values, name="content_val"):
    return spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(values)], f"video_id long, frame long, {name} double")


def test_no_frames_no_scenes(spark):
    assert scenes(api.detect(gray(spark, 0).limit(0)).scenes) == []


def test_single_scene(spark):
    assert spans_of(spark, Content(), [0, 0, 0]) == [(0, 3)]


def test_content_rows(spark):
    rows = api.stats(gray(spark, 0, 0, 255, 255), Content(20.0), Options(1)).orderBy("frame").collect()
    assert [r.decision for r in rows] == ["not_evaluated", "below_threshold", "accepted", "below_threshold"]
    assert spans_of(spark, Content(20.0), [0, 0, 255, 255]) == [(0, 2), (2, 4)]


def test_components(spark):
    rows = scores.content_scores(to_pixels(solid_frames(spark, [(255, 0, 0), (255, 255, 0), (255, 255, 255)]))).orderBy("frame").collect()
    assert [(r.delta_hue, r.delta_saturation, r.delta_luminance) for r in rows[1:]] == [(30.0, 0.0, 0.0), (30.0, 255.0, 0.0)]
    only = scores.content_scores(to_pixels(solid_frames(spark, [(255, 0, 0), (255, 255, 0)])), Content(luma_only=True)).orderBy("frame").collect()
    assert only[1].content_val == 0.0


def test_binary_scores_equal_pixel_scores(spark):
    rng = np.random.default_rng(1)
    frames = spark.createDataFrame([(v, k, 4, 3, rng.integers(0, 256, 36, np.uint8).tobytes()) for v in range(2) for k in range(0, 40, 1 + v)], "video_id long, frame long, width int, height int, rgb binary")
    for config in (Content(), Content(weights=(1.0, 0.0, 2.0, 0.5))):
        pixels = to_pixels(frames).withColumn("edge", image.edges("rgb", "width", "height"))
        a = scores.content_scores(pixels, config, chunk=7).orderBy("video_id", "frame").collect()
        for dealt, step in ((frames, 1), (frames.repartition(5), 1), (frames.repartition(7, "frame"), 2), (frames.orderBy(F.desc("frame")), 1)):
            b = features.image_content_scores(dealt.where("video_id = 1") if step == 2 else dealt, config, step).orderBy("video_id", "frame").collect()
            for x, y in zip([r for r in a if step == 1 or r.video_id == 1], b, strict=True):
                assert tuple(x)[:2] == tuple(y)[:2] and np.allclose(list(x)[2:], list(y)[2:])


def test_few_images_leave_their_task(spark, monkeypatch):
    """Of frames stored in order, two images a run go on; a step that skips frames is found out."""
    kept = []
    plain = features.cut
    monkeypatch.setattr(features, "cut", lambda df: kept.append(plain(df)) or kept[-1])
    frames = solid_frames(spark, [(k, 7 * k % 256, 3) for k in range(60)]).coalesce(1)
    assert features.image_content_scores(frames.union(frames.withColumn("video_id", F.lit(9)))).count() == 120
    assert kept[0].where("rgb is not null").count() == 4
    assert features.image_content_scores(frames.where("frame < 0")).count() == 0
    mixed = frames.where("frame % 2 = 0").union(frames.where("frame % 2 = 1"))
    with pytest.raises(Exception, match="distance of these frames"):
        features.image_content_scores(mixed, step=2).collect()


def test_features_of_images(spark):
    rng = np.random.default_rng(2)
    rows = [(0, k, w, h, rng.integers(0, 256, 3 * w * h, np.uint8).tobytes()) for k, (w, h) in enumerate([(13, 7), (5, 5), (0, 0), (32, 18)])]
    frames = spark.createDataFrame(rows, "video_id long, frame long, width int, height int, rgb binary")
    found = features.frame_features(frames, luma=True, bins=8).orderBy("frame").collect()
    for r, (_, _, w, h, rgb) in zip(found, rows, strict=True):
        p = np.frombuffer(rgb, np.uint8).reshape(-1, 3).astype(float) @ [0.299, 0.587, 0.114]
        counts = np.bincount(np.minimum(p * 8 // 256, 7).astype(int), minlength=8)
        assert abs(r.average_rgb - (p.mean() if w else 0.0)) < 1e-9 and np.allclose(r.hist, counts / (np.linalg.norm(counts) or 1))
    bits = features.frame_features(frames.where("frame <> 2"), phash=(4, 2), fingerprint=True).orderBy("frame").collect()
    assert [len(r.bits) for r in bits] == [16] * 3 and len({r["hash"] for r in bits}) == 3


def test_edges_golden(spark):
    a, b = np.zeros((64, 64, 3), np.uint8), np.zeros((64, 64, 3), np.uint8)
    a[:, :32] = 255
    b[:32] = 255
    frames = spark.createDataFrame([(0, k, 64, 64, x.tobytes()) for k, x in enumerate((a, b))], "video_id long, frame long, width int, height int, rgb binary")
    got = features.image_content_scores(frames, Content(weights=(0.0, 0.0, 0.0, 1.0))).orderBy("frame").collect()
    assert got[1].delta_edges == got[1].content_val == 36.73095703125


def test_box_resize_overlaps_cells():
    assert image.box_resize(np.arange(5.0)[None, :].repeat(5, 0), 2)[0].tolist() == [1.0, 3.0]


def test_content_cooldown_is_rolling_and_others_greedy(spark):
    frames = [10, 20, 26, 34, 50]
    c = spark.createDataFrame([(0, f) for f in frames], "video_id long, frame long")
    kept = lambda df: sorted(r.frame for r in df.where("accepted").collect())
    assert kept(decisions.rolling(c, 10)) == [10, 20, 50]
    assert kept(decisions.greedy(c, 10)) == [10, 20, 34, 50]


def test_greedy_equals_a_loop(spark):
    rng = random.Random(4)
    rows = sorted({(v, rng.randrange(400)) for v in range(6) for _ in range(20 + 30 * v)})
    for m in (0, 1, 7, 40):
        want, last = set(), {}
        for v, f in rows:
            if f - last.get(v, 0) >= m:
                want.add((v, f))
                last[v] = f
        got = decisions.greedy(spark.createDataFrame(rows, "video_id long, frame long"), m).where("accepted")
        assert {(r.video_id, r.frame) for r in got.collect()} == want


@pytest.mark.parametrize(
    ("config", "want"),
    [
        (Adaptive(3.0, 30.0, 1), [(0, 3), (3, 7)]),
        (Adaptive(6.0, 30.0, 1), [(0, 7)]),
        (Adaptive(3.0, 34.0, 1), [(0, 7)]),
        (Adaptive(3.0, 30.0, 2), [(0, 7)]),
        (Adaptive(3.0, 30.0, 0), [(0, 7)]),
    ],
)
def test_adaptive(spark, config, want):
    assert spans_of(spark, config, [0, 80, 100, 200, 220, 140, 140]) == want


def test_fade_return(spark):
    assert spans_of(spark, Fade(12.0), [0] * 4 + [128] * 2 + [255] * 4) == [(0, 2), (2, 10)]


@pytest.mark.parametrize(("bias", "end"), [(0.0, 3), (-1.0, 2), (1.0, 4)])
def test_fade_bias(spark, bias, end):
    assert spans_of(spark, Fade(12.0, bias), [20, 20, 0, 0, 80, 80])[0] == (0, end)


def test_final_fade(spark):
    assert spans_of(spark, Fade(12.0), [80, 80, 0, 0, 0])[0] == (0, 2)
    assert spans_of(spark, Fade(12.0, add_last_scene=False), [80, 80, 0, 0, 0]) == [(0, 5)]
    assert spans_of(spark, Fade(0.0), [20, 20, 0, 0, 80, 80]) == [(0, 6)]


def test_hash_ignores_brightness(spark):
    assert spans_of(spark, Hash(size=4), [0, 0, 255, 255]) == [(0, 4)]


def test_histogram(spark):
    assert spans_of(spark, Histogram(), [0, 0, 255, 255]) == [(0, 2), (2, 4)]
    flat = scores.histogram_scores(gray(spark, 5, 5), Histogram(bins=1)).orderBy("frame").collect()
    assert [r.hist_diff for r in flat] == [0.0, 1.0]


def test_not_a_number_is_no_candidate(spark):
    rows = series(spark, [0, float("nan"), 50])
    assert [r.frame for r in decisions.content_boundaries(rows, Content(), 1).collect()] == [2]


def test_merge_last(spark):
    cuts = spark.createDataFrame([(0, 5), (0, 8), (0, 0)], "video_id long, frame long")
    total = spark.createDataFrame([(0, 10), (1, 4), (2, 0)], "video_id long, total long")
    assert scenes(spans.scene_spans(cuts, total, 3)) == [(0, 5), (5, 8), (8, 10), (0, 4)]
    assert scenes(spans.scene_spans(cuts, total, 3, MERGE_LAST)) == [(0, 5), (5, 10), (0, 4)]


def test_sparse_frames_take_the_row_before(spark):
    rows = spark.createDataFrame([(0, f, f) for f in (0, 3, 700, 5000, 5001)], "video_id long, frame long, x long")
    got = scores.with_previous(rows, ["x"], chunk=100).orderBy("frame").collect()
    assert [r.prev_x for r in got] == [None, 0, 3, 700, 5000]


def test_review_golden(spark):
    found = api.boundary_review(gray(spark, 0, 50, 200, 50), Content(33.0), Options(2), 16.0)
    assert [r.status for r in found.orderBy("candidate_number").collect()] == ["near_miss", "accepted", "suppressed_min_scene_len"]
    one = api.boundary_review(gray(spark, 0, 70, 200), Content(40.0), Options(1)).collect()
    assert [(r.frame, r.review_threshold) for r in one] == [(2, 32.0)]
    order = api.boundary_review(gray(spark, 0, 80, 190, 90), Content(33.0), Options(1), 0.0).orderBy("rank").collect()
    assert [r.frame for r in order] == [3, 2, 1, 0]


def test_adaptive_review_noise_floor(spark):
    values = gray(spark, 0, 1, 100, 101, 102)
    assert api.boundary_review(values, Adaptive(100.0, 34.0, 1), Options(1), 50.0).count() == 0
    assert [r.status for r in api.boundary_review(values, Adaptive(100.0, 30.0, 1), Options(1), 50.0).collect()] == ["near_miss"]


def test_settings():
    assert load("content") == Content() and load("hash", {"size": 8}).metric == "hash_dist [size=8 lowpass=2]"
    for bad in (lambda: load("x"), lambda: load("hash", {"size": 0}), lambda: load("content", {"y": 1}), lambda: Fade(fade_bias=2.0), lambda: Options(-1), lambda: review_threshold(Fade()), lambda: Histogram(bins=257)):
        with pytest.raises(ValueError):
            bad()


def test_reconstructed_decisions(spark):
    rows = api.stats(gray(spark, 0, 0, 255, 255), Histogram(), Options(1)).orderBy("frame").collect()
    assert [r.decision for r in rows] == ["not_evaluated", "below_threshold", "accepted", "below_threshold"]
    assert rows[0].score == 1.0 and scores.insight_score(api.stats(gray(spark, 0, 0), Histogram(), Options(1)).select("video_id", "frame", "metrics"), "histogram", 0.05).where("frame = 0").first().score == 0.0
    assert F is not None


def test_binary_histograms_equal_those_of_pixels(spark):
    frames = solid_frames(spark, [(0, 0, 0), (10, 200, 30), (10, 200, 30), (255, 255, 255)], 3)
    plain = scores.histogram_scores(to_pixels(frames)).orderBy("frame").collect()
    binary = scores.histogram_scores(frames).orderBy("frame").collect()
    assert [(r["frame"], round(r["hist_diff"], 9), r["first"]) for r in binary] == [(r["frame"], round(r["hist_diff"], 9), r["first"]) for r in plain]
