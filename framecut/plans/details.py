"""Queries of single operators that the grouped ones don't reach, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Content, Options
from ..functions import order, rational, timecode
from ..operators import decisions, features, joins, quality, review, scores, similarity, spans, timeline
from ..sinks import render, reviewed
from ..sources import frames as sources
from ..sources import tables
from . import oracle, queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def checked_by(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_SPANS = oracle._ADAPTIVE_SPANS
#: Detector, its metric, and the value divided by this; the threshold judged.
_METRICS = (("content", "content_val", 1, 50), ("adaptive", "adaptive_ratio", 20, 3), ("threshold", "average_rgb", 1, 12), ("histogram", "hist_diff [bins=16]", 100, 0.5), ("hash", "hash_dist [size=4]", 100, 0.4))
_SCORED = " UNION ALL ".join(f"SELECT '{d}' AS detector, video_id, frame, {'CASE WHEN frame = 0 THEN 0 ELSE 1 - x / 100.0::DOUBLE END' if d == 'histogram' else f'x / {n}.0::DOUBLE'} AS score, {'false' if d == 'threshold' else f'{chr(49) + " - " if d == "histogram" else ""}x / {n}.0::DOUBLE >= {t}::DOUBLE'} AS candidate FROM stream" for d, _, n, t in _METRICS)


@checked_by(f"WITH {oracle._STREAM} SELECT detector, video_id, frame, round(score, 6) AS score, candidate FROM ({_SCORED})")
def detector_statuses(spark, d):
    """Each detector reads its metric of the same rows; a histogram's first frame counts as unchanged."""
    value = F.col("content_val")
    metrics = F.create_map(*(x for _, name, n, _ in _METRICS for x in (F.lit(name), value / n)))
    rows = tables.score_stream(spark, d).withColumn("metrics", metrics)
    out = None
    for detector, _, _, threshold in _METRICS:
        one = scores.insight_score(rows, detector, threshold).select(F.lit(detector).alias("detector"), "video_id", "frame", F.round("score", 6).alias("score"), "candidate")
        out = one if out is None else out.unionByName(one)
    return out


@checked_by(f"WITH RECURSIVE {oracle._FADE_SPANS}, t AS (SELECT video_id, frame, epoch_us(ts) AS ticks FROM stream) SELECT s.video_id, scene_number, a.ticks AS start_ticks, coalesce(b.ticks, l.ticks + 40000) AS end_ticks FROM spans s JOIN t a ON a.video_id = s.video_id AND a.frame = s.start JOIN t l ON l.video_id = s.video_id AND l.frame = s.\"end\" - 1 LEFT JOIN t b ON b.video_id = s.video_id AND b.frame = s.\"end\"")
def exact_timeline(spark, d):
    """Scenes timed exactly where a video's last frame lasts one tick of 1/25 second."""
    tick = F.struct(F.lit(1).cast("long").alias("ticks"), F.struct(F.lit(1).cast("long").alias("numerator"), F.lit(25).cast("long").alias("denominator")).alias("time_base"))
    timing = tables.timing(spark, d).withColumn("duration", F.coalesce("duration", tick))
    rows = timeline.scene_timeline(queries.fade_scenes(spark, d), timing)
    return rows.select("video_id", "scene_number", F.col("start_time.ticks").alias("start_ticks"), F.col("end_time.ticks").alias("end_ticks"))


_GATED = f"{oracle._CONTENT}, over_ AS (SELECT frame, score, frame - lag(frame, 1, 0) OVER (ORDER BY frame) >= 3 AS ok FROM score WHERE score >= 10.5)"


@checked_by(f"WITH {_GATED} SELECT frame, CASE WHEN ok THEN 'accepted' ELSE 'suppressed_min_scene_len' END AS status, row_number() OVER (ORDER BY frame)::INT AS candidate_number, row_number() OVER (ORDER BY abs(score - 10), frame)::INT AS rank FROM over_")
def gated_review(spark, d):
    """A review threshold above the detector's drops boundaries when rows are judged again."""
    found, total = queries._content(spark, d)
    rows = decisions.content_decisions(found, Content(threshold=10.0), 3).withColumn("metrics", F.create_map(F.lit("content_val"), "score"))
    return review.content_review(rows, total, Content(threshold=10.0), Options(3), 10.5, gated=True).select("frame", "status", "candidate_number", "rank")


@checked_by(f"WITH {oracle._REVIEW} SELECT frame, status FROM seeds WHERE abs(score - 10) <= 0.5 + 1e-9")
def edge_cases(spark, d):
    """Candidates near the threshold, best score first."""
    return review.filtered(queries._reviewed(spark, d), "edge_case", "score").select("frame", "status")


@checked_by(f"WITH RECURSIVE {_SPANS} SELECT * FROM spans WHERE contains(concat_ws(' ', scene_number, start, \"end\"), '12')")
def scene_search(spark, d):
    """Scenes with 12 among their numbers, longest first."""
    return review.search_scenes(queries.adaptive_scenes(spark, d), " 12", "longest")


_ACTION = "['accept', 'reject', 'manual'][event_id % 3 + 1]"


@checked_by(f"SELECT user_id AS video_id, event_id % 50 AS frame, arg_max({_ACTION}, event_id) AS action FROM events GROUP BY ALL")
def last_actions(spark, d):
    """The latest of many review actions on a frame."""
    action = F.element_at(F.array(F.lit("accept"), F.lit("reject"), F.lit("manual")), (F.col("event_id") % 3 + 1).cast("int"))
    return review.last_actions(tables.read(spark, d, "events").select(F.col("user_id").alias("video_id"), (F.col("event_id") % 50).alias("frame"), F.col("event_id").alias("seq"), action.alias("action")))


@checked_by(
    f"WITH RECURSIVE {oracle._EFFECTIVE} SELECT video_id, frame, action FROM act ANTI JOIN raw USING (video_id, frame) UNION ALL SELECT video_id, frame, 'reject' FROM raw r WHERE NOT EXISTS (SELECT 1 FROM act a WHERE a.video_id = r.video_id AND a.frame = r.frame AND action = 'manual')"
)
def merged_actions(spark, d):
    """Actions after all detected boundaries are merged away."""
    raw = queries._raw(spark, d)
    return review.merged(raw, queries._actions(spark, d), raw)


@checked_by(f"WITH {oracle._MEDIA} SELECT video_id, 'next' AS kind, coalesce(min(t) FILTER (t > 1000 + 0.001::DOUBLE), min(t)) AS time FROM media GROUP BY video_id UNION ALL SELECT video_id, 'previous', max(t) FILTER (t < 1000 - 0.001::DOUBLE) FROM media GROUP BY video_id")
def seek_points(spark, d):
    """The sample after second 1000, around the end if there is none, and the one before."""
    points = queries._media(spark, d)
    after = review.seek(points, F.lit(1000.0), "media_time_seconds", wrap=True).select("video_id", F.lit("next").alias("kind"), F.col("media_time_seconds").alias("time"))
    return after.union(review.seek(points, F.lit(1000.0), "media_time_seconds", forward=False).select("video_id", F.lit("previous"), "media_time_seconds"))


@checked_by("SELECT c_custkey::VARCHAR AS id, c_mktsegment AS detector, c_acctbal > 0 AS enabled FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0")
def case_selection(spark, d):
    """Enabled cases of two detectors."""
    cases = tables.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("detector"), (F.col("c_acctbal") > 0).alias("enabled"))
    return quality.select_cases(cases, detectors=["BUILDING", "MACHINERY"])


@checked_by(f"WITH {oracle._MEDIA}, n AS (SELECT video_id, count(*) AS n FROM media GROUP BY video_id) SELECT p.video_id, 2 * p.sample AS sample, coalesce(m.t, CASE WHEN 2 * p.sample >= n THEN 9 END, 2 * p.sample / 4.0::DOUBLE) AS media_time_seconds FROM media p JOIN n USING (video_id) LEFT JOIN media m ON m.video_id = p.video_id AND m.sample = 2 * p.sample")
def sample_media_times(spark, d):
    """Times of every other sample and of as many beyond the end."""
    media = queries._media(spark, d)
    count = media.groupBy("video_id").agg(F.count("*").alias("n"))
    points = media.select("video_id", (F.col("sample") * 2).alias("sample")).join(count, "video_id")
    return joins.media_times(points, media, F.lit(9.0), F.lit(4.0), F.col("n")).select("video_id", "sample", "media_time_seconds")


@checked_by(f"WITH RECURSIVE {_SPANS}, p AS (SELECT video_id, scene_number + scene_number % 2 AS number, start FROM spans) SELECT p.video_id, p.number::INT AS number, p.start, CASE WHEN n.start = p.start THEN n.scene_number ELSE a.scene_number END AS scene_number FROM p LEFT JOIN spans n ON n.video_id = p.video_id AND n.scene_number = p.number LEFT JOIN spans a ON a.video_id = p.video_id AND a.start = p.start")
def scenes_of_pairs(spark, d):
    """Scenes found by number where that agrees with the start, else by start."""
    scenes = queries.adaptive_scenes(spark, d)
    pairs = scenes.select("video_id", (F.col("scene_number") + F.col("scene_number") % 2).alias("number"), "start")
    return similarity.pair_scenes(pairs, scenes).select("video_id", "number", "start", F.col("scene.scene_number").alias("scene_number"))


@checked_by("SELECT user_id AS id, max(event_id) AS saved_at FROM events GROUP BY user_id ORDER BY saved_at DESC LIMIT 8")
def recent_snapshots(spark, d):
    """The eight latest snapshots, one an id (a top-k report)."""
    return joins.recent(tables.read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("saved_at")))


@checked_by(f"WITH RECURSIVE {_SPANS}, l AS (SELECT video_id, scene_number, start, greatest(\"end\" - 1, start) AS l FROM spans) SELECT DISTINCT video_id, scene_number, CASE WHEN l = start THEN start ELSE start + floor(k * (l - start) / 4.0::DOUBLE + 0.5::DOUBLE)::BIGINT END AS frame FROM l, (SELECT unnest(generate_series(0, 4)) AS k)")
def preview_frames(spark, d):
    """Five even frames of each scene, fewer where it is shorter."""
    return queries.adaptive_scenes(spark, d).select("video_id", "scene_number", F.explode(joins.even_frames(F.col("start"), F.col("end"), 5)).alias("frame"))


@checked_by("SELECT event_id, round(100 * (exp(value / 500 * 4) - 1) / (exp(4.0::DOUBLE) - 1), 6) AS threshold, round(ln(1 + value / 500 * (exp(4.0::DOUBLE) - 1)) / 4, 6) AS position FROM events")
def slider_positions(spark, d):
    """Thresholds of slider positions, and positions of thresholds."""
    share = F.col("value") / 500
    return tables.read(spark, d, "events").select("event_id", F.round(joins.slider_to_threshold(share, 100.0), 6).alias("threshold"), F.round(joins.threshold_to_slider(share * 100, 100.0), 6).alias("position"))


_PAIRS = oracle.ORACLES["scene_similarity_pairs"]


@checked_by(f"SELECT rank, first_scene, second_scene FROM ({_PAIRS}) WHERE similarity >= 0.6 AND rank <= 16")
def reported_pairs(spark, d):
    """The most similar pairs of each video's report."""
    chosen = similarity.even_scenes(queries._blocks(spark, d))
    pairs = similarity.similar_pairs(similarity.scene_hashes(queries._signatures(spark, d), chosen))
    return similarity.report_pairs(pairs, 0.6).select("rank", "first_scene", "second_scene")


@checked_by("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id * 1800 + event_id % 60 * 30 WHEN 1 THEN event_id WHEN 2 THEN NULL WHEN 3 THEN event_id * 30 + 15 ELSE 0 END::BIGINT AS frames FROM events""")
def timecode_forms(spark, d):
    """Frames of clocks, frame numbers, words, seconds and negative seconds at 30 frames a second."""
    n = F.col("event_id")
    forms = [F.concat(F.lit("0:"), n.cast("string"), F.lit(":"), (n % 60).cast("string")), n.cast("string"), F.lit("soon"), F.concat(n.cast("string"), F.lit(".5s")), F.concat(F.lit("-"), n.cast("string"), F.lit("s"))]
    text = F.element_at(F.array(*forms), (n % 5 + 1).cast("int"))
    return tables.read(spark, d, "events").select("event_id", timecode.frames_of(text, F.lit(30.0)).alias("frames"))


def _clock(frames: str) -> str:
    seconds = f"(({frames})::DOUBLE / 25)"
    return f"printf('%02d:%02d:%06.3f', floor({seconds} / 3600)::INT, floor(fmod({seconds}, 3600) / 60)::INT, fmod({seconds}, 60))"


_CSV_LINE = f"""concat_ws(',', scene_number, start + 1, {_clock('start')}, printf('%.6f', start / 25.0::DOUBLE), "end", {_clock('"end"')}, printf('%.6f', "end" / 25.0::DOUBLE), "end" - start, {_clock('"end" - start')}, printf('%.6f', ("end" - start) / 25.0::DOUBLE))"""


@checked_by(
    f"""WITH RECURSIVE {_SPANS} SELECT video_id, sha256('Timecode List:' || coalesce(string_agg(',' || {_clock('start')}, '' ORDER BY start) FILTER (start > 0), '') || chr(10) || '{",".join(render.SCENE_HEADER)}' || chr(10) || string_agg({_CSV_LINE} || chr(10), '' ORDER BY start)) AS csv_sha256 FROM spans GROUP BY video_id"""
)
def scene_csv(spark, d):
    """Digest of each video's scene list as CSV."""
    scenes = queries.adaptive_scenes(spark, d)
    videos = scenes.select("video_id").distinct().withColumn("frame_rate", F.lit(25.0))
    return render.documents(scenes, videos, "csv").select("video_id", F.sha2("text", 256).alias("csv_sha256"))


_FIELDS = {"scene_number": "scene_number", "start_frame": "start + 1", "start_timecode": f"'\"' || {_clock('start')} || '\"'", "start_seconds": "start / 25.0::DOUBLE"}
_FIELDS |= {"end_frame": '"end"', "end_timecode": f"""'"' || {_clock('"end"')} || '"'""", "end_seconds": '"end" / 25.0::DOUBLE'}
_FIELDS |= {"length_frames": '"end" - start', "length_timecode": f"""'"' || {_clock('"end" - start')} || '"'""", "length_seconds": '("end" - start) / 25.0::DOUBLE'}


def _object(colon: str, comma: str) -> str:
    return f" || '{comma}' || ".join(f"""'"{name}"{colon}' || ({value})::VARCHAR""" for name, value in _FIELDS.items())


_JSON_SCENE = f"""'    {{' || chr(10) || '      ' || {_object(': ', ',' + chr(10) + '      ')} || chr(10) || '    }}'"""
_JSON = f"""'{{' || chr(10) || '  "frame_rate": 25.0,' || chr(10) || '  "scene_count": ' || count(*) || ',' || chr(10) || '  "scenes": [' || chr(10) || string_agg({_JSON_SCENE}, ',' || chr(10) ORDER BY start) || chr(10) || '  ]' || chr(10) || '}}'"""
_NDJSON = f"""string_agg('{{"event":"scene",' || {_object(':', ',')} || '}}' || chr(10), '' ORDER BY start)"""


@checked_by(f"WITH RECURSIVE {_SPANS} SELECT video_id, sha256({_JSON}) AS json_sha256, sha256({_NDJSON}) AS ndjson_sha256 FROM spans GROUP BY video_id")
def scene_exports(spark, d):
    """Digests of each video's scene list as JSON and as JSON lines."""
    scenes = queries.adaptive_scenes(spark, d)
    videos = scenes.select("video_id").distinct().withColumn("frame_rate", F.lit(25.0))
    text = lambda form: render.documents(scenes, videos, form).select("video_id", F.sha2("text", 256).alias(f"{form}_sha256"))
    return text("json").join(text("ndjson"), "video_id")


@checked_by("""WITH m AS (SELECT o_orderpriority AS id, o_orderstatus = 'F' AS first, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1, 2), p AS (SELECT id, max(mean) FILTER (first) AS reference, max(mean) FILTER (NOT first) AS candidate FROM m GROUP BY id), r AS (SELECT id, reference / candidate AS ratio, 'corpus ' || left(id, 1) AS corpus FROM p)
  SELECT id, corpus, CASE WHEN ratio > 1 THEN round(ratio, 2)::VARCHAR || '× faster' WHEN ratio = 1 THEN 'tie' ELSE round(1 / ratio, 2)::VARCHAR || '× slower' END AS label FROM r""")
def bench_labels(spark, d):
    """Benchmark pairs with their cases, labelled for a page."""
    label = F.concat("o_orderpriority", F.when(F.col("o_orderstatus") == "F", " reference").otherwise(" candidate"))
    rows = tables.read(spark, d, "orders").groupBy(label.alias("label")).agg(F.round(F.avg("o_totalprice"), 2).alias("mean"))
    cases = tables.read(spark, d, "orders").select(F.col("o_orderpriority").alias("id")).distinct().withColumn("corpus", F.concat(F.lit("corpus "), F.left("id", F.lit(1))))
    return quality.bench_view(quality.bench_pairs(rows, cases), ["corpus 5", "corpus 1"]).select("id", "corpus", "label")


@checked_by("SELECT p_partkey::VARCHAR AS path FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0")
def stale_goldens(spark, d):
    """Goldens whose file changed or is gone."""
    part = tables.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_partkey", F.encode("p_name", "UTF-8").alias("content"))
    goldens = part.select("path", F.when(F.col("p_partkey") % 5 == 0, F.lit("old")).otherwise(F.sha2("content", 256)).alias("sha256"))
    return quality.stale_fixtures(goldens, part.where("p_partkey % 7 <> 0").select("path", "content")).select("path")


@checked_by("SELECT event_id AS frame, CASE WHEN event_id % 4 > 0 THEN event_id * 3003 END AS ticks, CASE event_id % 3 WHEN 0 THEN 3003 WHEN 1 THEN 1500 END::BIGINT AS duration, 90000::BIGINT AS denominator, round(30000 / 1001.0::DOUBLE, 6) AS rate FROM events")
def timing_records(spark, d):
    """Timing records as a probe prints them, with missing values."""
    n = F.col("event_id")
    stamp = F.when(n % 4 > 0, (n * 3003).cast("string")).otherwise("N/A")
    length = F.when(n % 3 == 0, "duration=3003|pkt_duration=7").when(n % 3 == 1, "duration=N/A|pkt_duration=1500").otherwise("duration=N/A")
    records = tables.read(spark, d, "events").select(F.col("user_id").alias("video_id"), n.alias("frame"), F.concat(F.lit("best_effort_timestamp="), stamp, F.lit("|"), length).alias("record"))
    rows = sources.parse_timing(records, sources.time_base(F.lit("1/90000")))
    return rows.select("frame", F.col("presentation_time.ticks").alias("ticks"), F.col("duration.ticks").alias("duration"), sources.time_base(F.lit("1/90000"))["denominator"].alias("denominator"), F.round(timecode.ratio(F.lit("30000/1001")), 6).alias("rate"))


@checked_by(f"WITH {oracle._STREAM} SELECT video_id, frame, epoch_us(ts) AS ticks, x AS content_val FROM stream")
def timed_frames(spark, d):
    """Frames with their presentation times, checked to be in order."""
    joined = sources.with_timing(tables.score_stream(spark, d), tables.timing(spark, d))
    rows = joined.select("video_id", "frame", F.col("presentation_time.ticks").alias("ticks"), "content_val")
    return sources.check_order(rows, "ticks")


@checked_by(f"WITH {oracle._STREAM}, s AS (SELECT video_id, frame, x, CASE WHEN frame = 0 THEN 'not_evaluated' WHEN x >= 60 THEN 'over' ELSE 'under' END AS side FROM stream) SELECT video_id, max(frame) + 1 AS total, count(*) FILTER (side = 'over') AS over FROM s GROUP BY video_id")
def preview_counts(spark, d):
    """Rows over a previewed threshold, and the frames of each video."""
    rows = tables.score_stream(spark, d)
    shown = decisions.preview(rows.select("video_id", "frame", F.col("content_val").alias("score"), F.lit(True).alias("eligible")), 60.0)
    counted = shown.groupBy("video_id").agg(F.count("*").alias("n"))
    return spans.totals(rows).join(counted, "video_id", "left").select("video_id", "total", F.coalesce("n", F.lit(0)).alias("over"))


#: Time bases of the sums below, of presentation times and durations, by event_id % 6.
_BASES = (("1", "10", "1", "1000"), ("1", "6", "1 + event_id % 3", "4"), ("1", "1000", "1", "1000"), ("-1", "-10", "1", "10"), ("17179869184", "17179869184", "1", "1"), ("1001", "30000 + user_id % 7", "1", "90000 - event_id % 11"))
_TICKS = ("CASE WHEN event_id % 6 = 2 THEN 9223372036854775807 - event_id % 3 ELSE event_id * 7919 - 300000 END", "event_id % 203 - 3")


def _chosen(part: int) -> str:
    return "CASE event_id % 6 " + " ".join(f"WHEN {k} THEN {base[part]}" for k, base in enumerate(_BASES)) + " END"


@checked_by(
    f"""WITH r AS (SELECT event_id, ({_TICKS[0]})::HUGEINT AS t, ({_TICKS[1]})::HUGEINT AS u, {", ".join(f"({_chosen(k)})::HUGEINT AS {name}" for k, name in enumerate(("n", "d", "m", "e")))} FROM events),
    low AS (SELECT *, abs(n) // gcd(n, d) AS a, abs(d) // gcd(n, d) AS b, abs(m) // gcd(m, e) AS x, abs(e) // gcd(m, e) AS y FROM r),
    own AS (SELECT *, u * x * b AS scaled, y * a AS unit, gcd(a * y, x * b) AS g FROM low),
    sums AS (SELECT *, t + scaled // unit AS kept, scaled % unit = 0 AND abs(t + scaled // unit) < 9223372036854775808::HUGEINT AS whole, t * (a * y // g) + u * (x * b // g) AS fine, g // gcd(g, b * y) AS fn, b * y // gcd(g, b * y) AS fd FROM own),
    held AS (SELECT *, CASE WHEN abs(fine) < 9223372036854775808::HUGEINT THEN 1 ELSE gcd(fine, fd) END AS c FROM sums)
    SELECT event_id, CASE WHEN u < 0 THEN NULL WHEN whole THEN kept WHEN abs(fine // c) < 9223372036854775808::HUGEINT AND greatest(fn, fd // c) < 2147483648 THEN fine // c END::BIGINT AS ticks,
      CASE WHEN u < 0 THEN NULL WHEN whole THEN n WHEN abs(fine // c) < 9223372036854775808::HUGEINT AND greatest(fn, fd // c) < 2147483648 THEN fn END::BIGINT AS numerator,
      CASE WHEN u < 0 THEN NULL WHEN whole THEN d WHEN abs(fine // c) < 9223372036854775808::HUGEINT AND greatest(fn, fd // c) < 2147483648 THEN fd // c END::BIGINT AS denominator FROM held"""
)
def rational_ends(spark, d):
    """Exact sums of times: whole in the first base or in a common one, overflowing, negative bases and durations."""
    time = lambda ticks, n, d: F.struct(F.expr(ticks).cast("long").alias("ticks"), F.struct(F.expr(_chosen(n)).cast("long").alias("numerator"), F.expr(_chosen(d)).cast("long").alias("denominator")).alias("time_base"))
    rows = tables.read(spark, d, "events").select("event_id", time(_TICKS[0], 0, 1).alias("t"), time(_TICKS[1], 2, 3).alias("u"))
    return rows.select("event_id", rational.exact_end(F.col("t"), F.col("u")).alias("end")).select("event_id", "end.ticks", "end.time_base.numerator", "end.time_base.denominator")


@checked_by(
    """WITH v AS (SELECT vec_id, k, CASE WHEN (vec_id + k) % 11 = 0 THEN 'NaN'::DOUBLE WHEN (vec_id + k) % 7 = 0 THEN '-0.0'::DOUBLE WHEN (vec_id + k) % 5 = 0 THEN 0.0::DOUBLE WHEN (vec_id + k) % 13 = 1 THEN 'Infinity'::DOUBLE ELSE x::DOUBLE END AS x
      FROM (SELECT vec_id, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS k FROM embeddings) WHERE x IS NOT NULL),
    s AS (SELECT vec_id, list(x ORDER BY isnan(x), x, NOT starts_with(x::VARCHAR, '-')) AS xs FROM v GROUP BY vec_id)
    SELECT vec_id, ordered, CASE WHEN middle = 0 THEN 0.0::DOUBLE ELSE round(middle, 9) END AS middle FROM (SELECT e.vec_id, array_to_string(list_transform(xs, lambda x: CASE WHEN isnan(x) THEN 'n' WHEN isinf(x) THEN 'i' WHEN x = 0 THEN CASE WHEN starts_with(x::VARCHAR, '-') THEN '-0' ELSE '0' END ELSE floor(x * 1000000)::BIGINT::VARCHAR END), ' ') AS ordered,
      CASE WHEN len(xs) % 2 = 1 THEN xs[len(xs) // 2 + 1] ELSE (xs[len(xs) // 2] + xs[len(xs) // 2 + 1]) / 2 END AS middle FROM embeddings e LEFT JOIN s USING (vec_id))"""
)
def total_order(spark, d):
    """Values in total order, with both zeros, infinities and what is no number among them, and their median."""
    place = lambda k, n: (F.col("vec_id") + k) % n
    planted = lambda x, k: F.when(x.isNull(), x.cast("double")).when(place(k, 11) == 0, F.lit(float("nan"))).when(place(k, 7) == 0, F.lit(-0.0)).when(place(k, 5) == 0, F.lit(0.0)).when(place(k, 13) == 1, F.lit(float("inf"))).otherwise(x.cast("double"))
    rows = tables.read(spark, d, "embeddings").select("vec_id", F.transform("embedding", planted).alias("xs"))
    zero = lambda x: F.when(F.startswith(x.cast("string"), F.lit("-")), "-0").otherwise("0")
    shown = lambda x: F.when(F.isnan(x), "n").when(x == float("inf"), "i").when(x == 0, zero(x)).otherwise(F.floor(x * 1_000_000).cast("string"))
    middle = order.total_median(F.col("xs"))
    return rows.select("vec_id", F.array_join(F.transform(order.total_sort(F.col("xs")), shown), " ").alias("ordered"), F.when(middle == 0, 0.0).otherwise(F.round(middle, 9)).alias("middle"))


_UNEVEN = f"""{oracle._GRAY}, cell AS (SELECT unnest(generate_series(0, 5)) AS c), edge AS (SELECT c, c * 8 // 6 AS low, (c * 8 + 8 + 5) // 6 AS high FROM cell),
    small AS (SELECT frame, r.c AS y, q.c AS x, avg({oracle._LUMA}) AS l FROM gray JOIN edge r ON k // 8 >= r.low AND k // 8 < r.high JOIN edge q ON k % 8 >= q.low AND k % 8 < q.high GROUP BY ALL),
    plane AS (SELECT frame, y, x, l / greatest(1, max(l) OVER (PARTITION BY frame)) AS s FROM small),
    coef AS (SELECT u, x, cos(pi() * (2 * x + 1) * u / 12) * CASE WHEN u = 0 THEN sqrt(1 / 6.0::DOUBLE) ELSE sqrt(2 / 6.0::DOUBLE) END AS c FROM (SELECT unnest(generate_series(0, 2)) AS u), (SELECT c AS x FROM cell)),
    low AS (SELECT frame, a.u * 3 + b.u AS k, sum(a.c * s * b.c) AS x FROM plane JOIN coef a ON a.x = plane.y JOIN coef b ON b.x = plane.x GROUP BY ALL)"""


@checked_by(f"WITH {_UNEVEN} SELECT frame, string_agg(CASE WHEN x > m THEN '1' ELSE '0' END, '' ORDER BY k) AS bits FROM (SELECT frame, k, x, median(x) OVER (PARTITION BY frame) AS m FROM (SELECT frame, k, CASE WHEN abs(x) < 1e-12 THEN 0 ELSE x END AS x FROM low)) GROUP BY frame")
def hash_bits_uneven(spark, d):
    """Hashes of 3 x 3 bits from 6 x 6 cells of 8 x 8 pixels, which overlap."""
    rows = features.frame_features(queries._binary(tables.gray_frames(spark, d)), phash=(3, 2))
    return rows.select("frame", F.array_join(F.transform("bits", lambda b: b.cast("int").cast("string")), "").alias("bits"))


_SHOWN = "printf('%02d:%02d:%06.3f', floor({0} / 3600)::INT, floor(fmod({0}, 3600) / 60)::INT, fmod({0}, 60))"


@checked_by(
    f"""WITH RECURSIVE {oracle._EFFECTIVE}, {oracle._video_spans('eff', 'reviewed')}, {oracle._MEDIA}, e AS (SELECT video_id, max(t) AS duration, count(*) AS n FROM media GROUP BY video_id),
    timed AS (SELECT r.video_id, r.scene_number, r.start, r."end", coalesce(a.t, CASE WHEN r.start >= e.n THEN e.duration END, r.start / 4.0::DOUBLE) AS s, coalesce(b.t, CASE WHEN r."end" >= e.n THEN e.duration END, r."end" / 4.0::DOUBLE) AS u
      FROM reviewed r JOIN e USING (video_id) LEFT JOIN media a ON a.video_id = r.video_id AND a.sample = r.start LEFT JOIN media b ON b.video_id = r.video_id AND b.sample = r."end")
    SELECT video_id, sha256('{reviewed.HEADER}' || chr(10) || string_agg(concat_ws(',', scene_number, start, {_SHOWN.format('s')}, "end", {_SHOWN.format('u')}), chr(10) ORDER BY start) || chr(10)) AS csv_sha256 FROM timed GROUP BY video_id"""
)
def reviewed_csv(spark, d):
    """Digest of each video's reviewed scenes as CSV, by presented times."""
    media = queries._media(spark, d)
    videos = media.groupBy("video_id").agg(F.max("media_time_seconds").alias("duration"), F.count("*").alias("count")).withColumn("fps", F.lit(4.0))
    text = reviewed.reviewed_csv(reviewed.timed_scenes(queries.reviewed_scenes(spark, d), media, videos))
    return text.select("video_id", F.sha2("text", 256).alias("csv_sha256"))


@checked_by(
    """SELECT o_orderkey::VARCHAR AS case_id, key, expected, observed FROM (
      SELECT o_orderkey, 'detector' AS key, o_orderpriority AS expected, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'other' ELSE o_orderpriority END AS observed FROM orders UNION ALL
      SELECT o_orderkey, 'args', o_orderstatus, CASE WHEN o_orderkey % 11 > 0 THEN o_orderstatus END FROM orders UNION ALL
      SELECT o_orderkey, 'runtime', NULL, CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 5 > 0 THEN '3' END FROM orders)
    WHERE CASE WHEN expected IS NULL THEN observed IS NULL ELSE expected IS DISTINCT FROM observed END"""
)
def stale_metadata(spark, d):
    """Goldens that are gone, of another detector, or without the runtime that made them."""
    rows, key = tables.read(spark, d, "orders"), F.col("o_orderkey")
    case = key.cast("string").alias("case_id")
    expected = rows.select(case, F.create_map(F.lit("detector"), F.col("o_orderpriority"), F.lit("args"), F.col("o_orderstatus")).alias("metadata"))
    detector = F.when(key % 7 == 0, F.lit("other")).otherwise(F.col("o_orderpriority"))
    runtime = F.when(key % 5 > 0, F.create_map(F.lit("runtime"), F.lit("3"))).otherwise(F.create_map().cast("map<string,string>"))
    goldens = rows.where(key % 11 > 0).select(case, F.map_concat(F.create_map(F.lit("detector"), detector, F.lit("args"), F.col("o_orderstatus"), F.lit("more"), F.lit("x")), runtime).alias("metadata"))
    return quality.stale_metadata(goldens, expected, ("runtime",))
