import math
import random
from fractions import Fraction

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framecut.functions import image, order, rational, timecode
from framecut.operators import joins, quality, review, similarity, spans, timeline
from framecut.sources import frames as sources


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def media(ticks, num, den):
    return {"ticks": ticks, "time_base": {"numerator": num, "denominator": den}}


def plain_end(time, duration):
    """The exact sum in Python's integers."""
    if time is None or duration is None or duration["ticks"] < 0:
        return None
    parts = []
    for x in (time, duration):
        n, d = x["time_base"]["numerator"], x["time_base"]["denominator"]
        if n * d <= 0 or max((f := Fraction(n, d)).numerator, f.denominator) >= 2**31:
            return None
        parts.append(f)
    total = time["ticks"] * parts[0] + duration["ticks"] * parts[1]
    whole = total / parts[0]
    if whole.denominator == 1 and abs(whole) < 2**63:
        return {"ticks": int(whole), "time_base": time["time_base"]}
    (a, b), (c, d) = (f.as_integer_ratio() for f in parts)
    base = Fraction(math.gcd(a * d, c * b), b * d)
    ticks, n, d = int(total / base), base.numerator, base.denominator
    if abs(ticks) >= 2**63:
        g = math.gcd(ticks, d)
        ticks, d = ticks // g, d // g
    return None if abs(ticks) >= 2**63 or max(n, d) >= 2**31 else media(ticks, n, d)


def test_rational_sums(spark):
    cases = [
        (media(9, 1, 10), media(100, 1, 1000), media(10, 1, 10)),
        (media(1, 1, 6), media(1, 1, 4), media(5, 1, 12)),
        (media(2**63 - 1, 1, 1000), media(1, 1, 1000), media(2**60, 1, 125)),
        (media(1, -1, -10), media(2, 1, 10), media(3, -1, -10)),
        (media(1, 2**34, 2**34), media(1, 1, 1), media(2, 2**34, 2**34)),
        (media(1, 1, 10), media(-1, 1, 10), None),
        (None, media(1, 1, 10), None),
        (media(1, 1, 10), None, None),
        (media(1, 0, 10), media(1, 1, 10), None),
        (media(1, 1, -10), media(1, 1, 10), None),
        (media(1, 1, 2**31), media(1, 1, 10), None),
        (media(-(2**63), 1, 2**31 - 1), media(2**63 - 1, 2**31 - 1, 2**31 - 2), None),
        (media(-(2**63), -(2**63), -(2**63)), media(1, 1, 1), media(1 - 2**63, -(2**63), -(2**63))),
    ]
    rng = random.Random(3)
    number = lambda: rng.choice([rng.randrange(1, 40), rng.randrange(1, 2**31), rng.randrange(2**62, 2**63)])
    for _ in range(400):
        base = [rng.choice([1, 2, 3, 1001, rng.randrange(1, 2**31)]) for _ in range(4)]
        t, d = media(rng.choice([1, -1]) * number(), *base[:2]), media(number(), *base[2:])
        cases.append((t, d, plain_end(t, d)))
    assert [plain_end(t, d) for t, d, _ in cases] == [want for *_, want in cases]
    kind = sources.MEDIA_TIME.simpleString()
    table = spark.createDataFrame([(k, t, d) for k, (t, d, _) in enumerate(cases)], f"k int, t {kind}, d {kind}")
    got = table.select("k", rational.exact_end(F.col("t"), F.col("d")).alias("end")).orderBy("k").collect()
    assert [r.end and r.end.asDict(True) for r in got] == [want for *_, want in cases]
    assert sum(want is not None for *_, want in cases) > 50


def test_total_order(spark):
    nan, inf = float("nan"), float("inf")
    given = [[0.0, nan, -0.0, inf, -1.0, None, -inf, 0.0, -0.0], [2.0, 1.0], [], None, [nan, 1.0, -0.0], [-0.0, 0.0, -0.0]]
    table = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, x array<double>")
    got = table.select("k", order.total_sort(F.col("x")).alias("s"), order.total_median(F.col("x")).alias("m")).orderBy("k").collect()
    assert [repr(r.s) for r in got] == [repr(x) for x in ([-inf, -1.0, -0.0, -0.0, 0.0, 0.0, inf, nan, None], [1.0, 2.0], [], None, [-0.0, 1.0, nan], [-0.0, -0.0, 0.0])]
    assert [repr(r.m) for r in got] == ["0.0", "1.5", "None", "None", "1.0", "-0.0"]


def test_timeline_with_varying_rate(spark):
    times = spark.createDataFrame([(0, k, (p, (1, 1000)), (d, (1, 1000))) for k, (p, d) in enumerate(zip((0, 100, 400, 900), (100, 300, 500, 100), strict=True))], f"video_id long, frame long, presentation_time {sources.MEDIA_TIME.simpleString()}, duration {sources.MEDIA_TIME.simpleString()}")
    scenes = spark.createDataFrame([(0, 1, 0, 2), (0, 2, 2, 4)], "video_id long, scene_number int, start long, end long")
    got = timeline.scene_timeline(scenes, times).orderBy("scene_number").collect()
    assert [(r.start_time.ticks, r.end_time.ticks) for r in got] == [(0, 400), (400, 1000)]
    with pytest.raises(PySparkException):
        timeline.scene_timeline(scenes, times.where("frame <> 3")).collect()


def test_timecodes(spark):
    assert timecode.clock(599_996, 10_000) == "00:00:60.000" and timecode.clock(36_005, 10) == "01:00:00.500"
    texts = ["00:01:00.5", "2.5s", "17", "-1", "1:2", "x", "-3s", "nans"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(timecode.frames_of(F.col("t"), F.lit(10.0)).alias("n"))
    assert [r.n for r in got.collect()] == [605, 25, 17, None, None, None, 0, 0]
    assert one(spark, timecode.ratio(F.lit("30000/1001"))) == pytest.approx(29.97003)
    with pytest.raises(PySparkException):
        one(spark, timecode.ratio(F.lit("1/0")))


def test_containing_spans(spark):
    s = spark.createDataFrame([(0, 1, 0, 5), (0, 2, 5, 9), (1, 1, 0, 3)], "video_id long, scene_number int, start long, end long")
    p = spark.createDataFrame([(0, 0), (0, 4), (0, 5), (0, 9), (1, 2), (2, 0)], "video_id long, at long")
    assert rows(spans.containing(p, s, "at").select("video_id", "at", "scene_number"), "video_id", "at") == [(0, 0, 1), (0, 4, 1), (0, 5, 2), (0, 9, None), (1, 2, 1), (2, 0, None)]


def test_review_context_beyond_scenes(spark):
    s = spark.createDataFrame([(0, 1, 0, 5), (0, 2, 5, 9)], "video_id long, scene_number int, start long, end long")
    c = spark.createDataFrame([(0, f) for f in (0, 3, 5, 12)] + [(7, 1)], "video_id long, frame long")
    got = {(r.video_id, r.frame): (tuple(r.before), tuple(r.after)) for r in review.context(c, s).collect()}
    assert got == {(0, 0): ((0, 0), (0, 5)), (0, 3): ((0, 3), (3, 5)), (0, 5): ((0, 5), (5, 9)), (0, 12): ((5, 12), (12, 9)), (7, 1): ((0, 0), (0, 0))}


def test_review_decisions(spark):
    raw = spark.createDataFrame([(0, 3), (0, 6), (0, 9)], "video_id long, frame long")
    log = spark.createDataFrame([(0, 3, 1, "reject"), (0, 6, 1, "reject"), (0, 6, 2, "accept"), (0, 7, 1, "manual"), (0, 20, 1, "manual")], "video_id long, frame long, seq long, action string")
    total = spark.createDataFrame([(0, 12)], "video_id long, total long")
    actions = review.last_actions(log)
    assert rows(review.effective_boundaries(raw, actions, total), "frame") == [(0, 6), (0, 7), (0, 9)]
    after = review.merged(raw, actions, spark.createDataFrame([(0, 7), (0, 9)], "video_id long, frame long"))
    assert rows(review.effective_boundaries(raw, after, total), "frame") == [(0, 6)]
    assert rows(review.threshold_diff(raw, raw.where("frame <> 6").union(spark.createDataFrame([(0, 8)], raw.schema))), "frame") == [(0, 6, "removed"), (0, 8, "added")]


def test_seek(spark):
    p = spark.createDataFrame([(0, t) for t in (1.0, 2.0, 5.0)], "video_id long, t double")
    at = lambda x, **o: review.seek(p, F.lit(x), "t", **o).first().t
    assert (at(2.0), at(2.0, forward=False), at(5.0), at(5.0, wrap=True), at(1.0, forward=False, wrap=True)) == (5.0, 1.0, None, 1.0, 5.0)


def test_nearest_and_previous_samples(spark):
    s = spark.createDataFrame([(0, k, t) for k, t in enumerate((0.0, 1.0, 3.0))], "video_id long, sample long, media_time_seconds double")
    t = spark.createDataFrame([(0, x) for x in (-1.0, 0.5, 2.0, 2.5, 9.0)], "video_id long, time double")
    assert [r[1] for r in rows(joins.nearest_sample(t, s).select("time", "sample"), "time")] == [0, 0, 1, 2, 2]
    p = spark.createDataFrame([(0, 0), (0, 2), (0, 9), (1, 5)], "video_id long, sample_at long")
    assert rows(joins.previous_sample(p, s), "video_id", "sample_at") == [(0, 0, 0), (0, 2, 1), (0, 9, 2), (1, 5, 4)]


def test_compare_runs_is_greedy_in_order(spark):
    of = lambda ts: spark.createDataFrame([(0, t) for t in ts], "video_id long, time double")
    got = joins.compare_runs(of([1.0, 1.03, 5.0]), of([1.04, 1.06, 9.0]), 30.0)
    assert {(r.kind, r.current, r.saved) for r in got.collect()} == {("shared", 1.0, 1.04), ("shared", 1.03, 1.06), ("current_only", 5.0, None), ("saved_only", None, 9.0)}


def brute_score(reference, candidate, tolerance):
    best = {}

    def go(i, j):
        if i == len(reference) or j == len(candidate):
            return (0, 0)
        if (i, j) not in best:
            options = [go(i + 1, j), go(i, j + 1)]
            if (d := abs(reference[i] - candidate[j])) <= tolerance:
                n, t = go(i + 1, j + 1)
                options.append((n + 1, t - d))
            best[i, j] = max(options)
        return best[i, j]

    return go(0, 0)


def test_matching(spark):
    of = lambda c: spark.createDataFrame([(i, f) for i, fs in c.items() for f in fs], "case_id string, frame long")
    got = quality.matches(of({"a": [10, 20, 30], "b": [10, 11]}), of({"a": [9, 21, 40], "b": [9, 10]}), 1)
    found = {(r.case_id, r.kind, r.reference_frame, r.candidate_frame) for r in got.collect()}
    assert found == {("a", "match", 10, 9), ("a", "match", 20, 21), ("a", "false_negative", 30, None), ("a", "false_positive", None, 40), ("b", "match", 10, 9), ("b", "match", 11, 10)}
    metrics = {r.case_id: r for r in quality.case_metrics(got).collect()}
    assert (metrics["a"].matched_boundaries, metrics["a"].max_absolute_delta, metrics["b"].mean_absolute_delta) == (2, 1, 1.0)
    rng = random.Random(3)
    cases = {str(k): (sorted(rng.sample(range(60), rng.randrange(12))), sorted(rng.sample(range(60), rng.randrange(12)))) for k in range(40)}
    got = quality.matches(of({k: a for k, (a, _) in cases.items()}), of({k: b for k, (_, b) in cases.items()}), 3).where("kind = 'match'").groupBy("case_id").agg(F.count("*").alias("n"), F.sum(F.abs("delta")).alias("d")).collect()
    want = {k: (n, -d) for k, (a, b) in cases.items() for n, d in [brute_score(a, b, 3)] if n}
    assert {r.case_id: (r.n, r.d) for r in got} == want


def test_benchmark_pairs(spark):
    runs = spark.createDataFrame([("a b reference", 2.0), ("a b candidate", 0.5), ("c reference", 1.0), ("c candidate", 0.0)], "label string, mean double")
    assert rows(quality.bench_pairs(runs), "id") == [("a b", 2.0, 0.5, 4.0, "candidate"), ("c", 1.0, 0.0, float("inf"), "candidate")]
    with pytest.raises(PySparkException):
        quality.bench_pairs(runs.limit(1)).collect()


def test_parity(spark):
    s = lambda x: spark.createDataFrame(x, "scene int, start long, end long")
    assert rows(quality.parity(s([(1, 0, 5), (2, 5, 9)]), s([(1, 0, 6), (2, 6, 9), (3, 9, 12)]), 1), "scene") == [(3, None, None)]


def test_parity_of_many_videos(spark):
    s = lambda r: spark.createDataFrame(r, "video_id long, scene int, start long, end long")
    got = quality.parity(s([(1, 1, 0, 5), (2, 1, 0, 9)]), s([(1, 1, 0, 5), (2, 1, 0, 12), (3, 1, 0, 4)]), 1, ("video_id",))
    assert rows(got, "video_id", "scene") == [(2, 1, 0, 3), (3, 1, None, None)]


def test_scene_hashes(spark):
    s = spark.createDataFrame([(0, 1, 0, 4), (0, 2, 4, 6)], "video_id long, scene_number int, start long, end long")
    h = [0b1100, 0b1010, -1, 0b1000, -8, 7]
    got = rows(similarity.scene_hashes(spark.createDataFrame([(0, k, x) for k, x in enumerate(h)], "video_id long, frame long, hash long"), s), "scene_number")
    assert [r[2] for r in got] == [0b1100 | 0b1000, -8]
    pairs = similarity.similar_pairs(spark.createDataFrame([(0, 1, 0), (0, 2, -1), (0, 3, 1)], "video_id long, scene_number int, hash long"), 2)
    assert [(r.first_scene, r.second_scene, r.distance) for r in pairs.orderBy("rank").collect()] == [(1, 3, 1), (2, 3, 63)]


def test_selection_and_stride(spark):
    assert [similarity.stride(f) for f in (0.5, 1, 6, 30)] == [1, 1, 6, 30]
    with pytest.raises(ValueError):
        similarity.stride(0)
    s = spark.range(1041).selectExpr("0L as video_id", "cast(id + 1 as int) as scene_number", "id * 2 as start", "id * 2 + 2 as end")
    got = similarity.similarity_report(spark.createDataFrame([], "video_id long, frame long, hash long"), s).first()
    assert (got.selected_scenes, got.considered_scenes, got.truncated) == (1024, 0, True)
    chosen = {r.scene_number for r in similarity.even_scenes(s).collect()}
    assert [r.scene_number for r in similarity.even_scenes(s, 1).where('video_id = 0').collect()] == [1]
    assert len(chosen) == 1024 and {1, 1041} <= chosen


def test_similar_images_have_near_hashes():
    import numpy as np

    blocks = np.random.default_rng(2).integers(0, 200, (8, 8))
    a = np.kron(blocks, np.ones((8, 8)))[:, :, None].repeat(3, 2).astype(np.uint8)
    b = np.ascontiguousarray(a[::-1])
    d = lambda p, q: bin((image.similarity_hash(p) ^ image.similarity_hash(q)) % 2**64).count("1")
    assert d(a, a + 25) <= 4 and d(a, b) > 10


def test_samples_and_sizes(spark):
    v = spark.createDataFrame([(0, 9.3, 6.0), (1, 0.0, 6.0)], "video_id long, duration double, fps double")
    got = sources.sample_times(v)
    assert [r.n for r in got.groupBy("video_id").agg(F.count("*").alias("n")).orderBy("video_id").collect()] == [56, 1]
    with pytest.raises(PySparkException):
        sources.sample_times(v.withColumn("fps", F.lit(1e6))).collect()
    assert [one(spark, joins.even_frames(F.lit(a), F.lit(b), 3)) for a, b in ((10, 20), (4, 5), (8, 8))] == [[10, 15, 19], [4], [8]]
    x = one(spark, joins.threshold_to_slider(joins.slider_to_threshold(F.lit(0.3), 255.0), 255.0))
    assert x == pytest.approx(0.3)


def test_raw_and_timing_sources(spark, tmp_path):
    (tmp_path / "a.rgb").write_bytes(bytes(range(24)))
    got = sources.raw_frames(spark, str(tmp_path / "a.rgb"), 2, 2).orderBy("frame").collect()
    assert [bytes(r.rgb) for r in got] == [bytes(range(12)), bytes(range(12, 24))]
    (tmp_path / "b.rgb").write_bytes(bytes(13))
    with pytest.raises(PySparkException):
        sources.raw_frames(spark, str(tmp_path / "b.rgb"), 2, 2).collect()
    base = sources.time_base(F.lit("1/90000"))
    records = spark.createDataFrame([(0, 0, "best_effort_timestamp=5|pkt_duration=7|duration=N/A")], "video_id long, frame long, record string")
    r = sources.parse_timing(records, base).first()
    assert (r.presentation_time.ticks, r.duration.ticks, r.duration.time_base.denominator) == (5, 7, 90000)
    with pytest.raises(PySparkException):
        one(spark, sources.time_base(F.lit("1/0")))
    (tmp_path / "s.csv").write_text("Timecode List:,x\nScene Number,Start Frame,End Frame\n1,1,5\nbad,2,3\n2,6,9\n")
    assert rows(sources.parity_scenes(spark, str(tmp_path / "s.csv"), True), "scene") == [(1, 0, 5), (2, 5, 9)]


def test_order_check(spark):
    good = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.0)], "video_id long, frame long, t double")
    assert sources.check_order(good, "t").count() == 2
    with pytest.raises(PySparkException):
        sources.check_order(good.union(good), "t").collect()


def test_joins_cross_chunks_of_the_axis(spark):
    s = spark.createDataFrame([(0, 1, 0, 9000), (0, 2, 9000, 9001), (0, 3, 9001, 30000)], "video_id long, scene_number int, start long, end long")
    p = spark.createDataFrame([(0, x) for x in (0, 4096, 8999, 9000, 9001, 20000, 29999, 30000, 50000)], "video_id long, at long")
    found = spans.containing(p, s, "at").orderBy("at").collect()
    assert [r["scene_number"] for r in found] == [1, 1, 1, 2, 3, 3, 3, None, None]
    marks = spark.createDataFrame([(0, 0, 0.0), (0, 1, 5000.0), (0, 2, 40000.0)], "video_id long, sample long, media_time_seconds double")
    times = spark.createDataFrame([(0, 1.0), (0, 4095.0), (0, 22500.0), (0, 22501.0), (0, 90000.0), (1, 3.0)], "video_id long, time double")
    near = joins.nearest_sample(times, marks).orderBy("video_id", "time").collect()
    assert [r["sample"] for r in near] == [0, 1, 1, 2, 2, None]
    at = spark.createDataFrame([(0, x) for x in (0, 1, 9000, 9001)], "video_id long, sample_at long")
    some = spark.createDataFrame([(0, 0), (0, 9000)], "video_id long, sample long")
    assert [r["previous"] for r in joins.previous_sample(at, some).orderBy("sample_at").collect()] == [0, 0, 0, 9000]


def plain_matching(reference, candidate, tolerance):
    """The whole table by prefixes, and the walk back from its end: match, else leave out the reference, else the candidate."""
    best = [[(0, 0)] * (len(candidate) + 1) for _ in range(len(reference) + 1)]
    for i, a in enumerate(reference, 1):
        for j, c in enumerate(candidate, 1):
            options = [best[i - 1][j], best[i][j - 1]]
            if abs(a - c) <= tolerance:
                options.append((best[i - 1][j - 1][0] + 1, best[i - 1][j - 1][1] - abs(a - c)))
            best[i][j] = max(options)
    i, j, out = len(reference), len(candidate), set()
    while i or j:
        d = abs(reference[i - 1] - candidate[j - 1]) if i and j else tolerance + 1
        if d <= tolerance and best[i][j] == (best[i - 1][j - 1][0] + 1, best[i - 1][j - 1][1] - d):
            i, j = i - 1, j - 1
            out.add((reference[i], candidate[j]))
        elif i and (not j or best[i - 1][j] == best[i][j]):
            i -= 1
            out.add((reference[i], None))
        else:
            j -= 1
            out.add((None, candidate[j]))
    return out


def test_matching_breaks_ties_from_the_end(spark):
    import random

    rng = random.Random(11)
    cases = {"a": ([10], [9, 11]), "b": ([10, 12], [11]), "c": ([10, 12], [11, 100]), "d": ([10, 12, 100], [11]), "e": ([1, 3, 50, 52, 90], [2, 51, 91, 300])}
    for k in range(60):
        cases[f"r{k}"] = tuple(sorted(rng.sample(range(rng.choice([12, 40, 90])), rng.randrange(12))) for _ in range(2))
    of = lambda side: spark.createDataFrame([(k, f) for k, v in cases.items() for f in v[side]], "case_id string, frame int")
    for tolerance in (0, 1, 3):
        found = {}
        for r in quality.matches(of(0), of(1), tolerance).collect():
            found.setdefault(r.case_id, set()).add((r.reference_frame, r.candidate_frame))
        for k, (a, c) in cases.items():
            assert found.get(k, set()) == plain_matching(a, c, tolerance), (k, a, c, tolerance)


def test_dense_matching_and_runs_take_seconds(spark):
    import time

    frames = spark.range(100_000).select(F.lit("x").alias("case_id"), (2 * F.col("id")).alias("frame"))
    began = time.perf_counter()
    found = quality.matches(frames, frames.withColumn("frame", F.col("frame") + 1), 3)
    assert found.where("kind = 'match'").count() == 100_000
    times = lambda d: spark.range(100_000).select(F.lit(1).cast("long").alias("video_id"), (F.col("id") / 100 + d).alias("time"))
    assert joins.compare_runs(times(0.0), times(0.004), 30.0).where("kind = 'shared'").count() == 100_000
    assert time.perf_counter() - began < 120


def test_nearest_unused_equals_plain(spark):
    import random

    rng = random.Random(4)
    mine, theirs = ([round(rng.random() * 3, 2) for _ in range(150)] for _ in range(2))
    left, want = sorted(theirs), []
    for t in sorted(mine):
        best = min(left, key=lambda x: abs(x - t), default=None)
        if best is not None and abs(best - t) <= 0.05:
            left.remove(best)
            want.append((t, best))
        else:
            want.append((t, None))
    of = lambda v: spark.createDataFrame([(1, x) for x in v], "video_id long, time double")
    got = [(r.current, r.saved) for r in joins.compare_runs(of(mine), of(theirs), 30.0).collect()]
    assert sorted(got, key=repr) == sorted(want + [(None, x) for x in left], key=repr)
