import json
import os

import pytest
from pyspark.sql import functions as F

from framecut import __main__ as cli
from framecut.config import Adaptive, Content, Fade, Hash, Histogram, Options
from framecut.operators import decisions, review, scores, similarity, spans
from framecut.sinks import documents, render
from framecut.streaming import session


def test_scene_csv_golden():
    lines = render.scenes_csv([{"start": 0, "end": 3}, {"start": 3, "end": 5}], 10.0).splitlines()
    assert lines[0] == "Timecode List:,00:00:00.300"
    assert lines[3] == "2,4,00:00:00.300,0.300000,5,00:00:00.500,0.500000,2,00:00:00.200,0.200000"


def test_review_csv_golden():
    row = {"rank": 1, "status": "near_miss", "candidate_number": 2, "frame": 3, "score_metric": "content_val", "score": 18.5, "detector_threshold": 20.0, "review_threshold": 16.0, "threshold_distance": 1.5, "before": {"start": 0, "end": 3}, "after": {"start": 3, "end": 5}, "metrics": {"content_val": 18.5}}
    assert render.review_csv([row], 10.0).splitlines()[1] == "1,near_miss,2,4,3,00:00:00.300,0.300000,content_val,18.500000,20.000000,16.000000,1.500000,1,3,4,5,18.500000"
    review = json.loads(render.review_json([row], 10.0))
    assert list(review) == ["frame_rate", "detector", "sort", "score_metric", "detector_threshold", "review_threshold", "candidate_count", "boundary_candidates"]
    only = review["boundary_candidates"][0]
    assert list(only)[:7] == ["rank", "status", "boundary_candidate_number", "boundary_frame", "boundary_frame_index", "boundary_timecode", "boundary_seconds"]
    assert only["boundary_frame"] == row["frame"] + 1 and only["boundary_frame_index"] == row["frame"]
    assert (only["before"], only["after"]) == ({"start_frame": row["before"]["start"] + 1, "end_frame": row["before"]["end"]}, {"start_frame": row["after"]["start"] + 1, "end_frame": row["after"]["end"]})
    spans = [{"start": 0, "end": 3}, {"start": 3, "end": 7}]
    assert [s["start_frame"] for s in json.loads(render.scenes_json(spans, 10.0))["scenes"]] == [1, 4]
    assert [json.loads(x)["start_frame"] for x in render.scenes_ndjson(spans, 10.0).splitlines()] == [1, 4]
    assert "<tr><td>2</td><td>4</td>" in render.scenes_html(spans, 10.0)


def test_documents_by_video(spark):
    s = spark.createDataFrame([(v, k + 1, k * 3, k * 3 + 3) for v in range(2) for k in range(2 + v)], "video_id long, scene_number int, start long, end long")
    videos = spark.createDataFrame([(0, 10.0), (1, 5.0)], "video_id long, frame_rate double")
    got = {r.video_id: json.loads(r.text) for r in render.documents(s, videos, "json").collect()}
    assert got[1]["scene_count"] == 3 and got[1]["scenes"][2]["start_seconds"] == 1.2
    assert all(r.text.count("\n") == 2 + r.video_id for r in render.documents(s, videos, "ndjson").collect())
    assert "<td>00:00:00.300</td>" in render.documents(s, videos, "html").where("video_id = 0").first().text


def test_stats_csv(spark):
    rows = [{"frame": 0, "metrics": {"b": 1.0}}, {"frame": 1, "metrics": {"a": 2.5, "b": 0.0}}]
    assert render.stats_csv(rows, ["b", "a"]) == "Frame Number,b,a\n0,1.000000,0.000000\n1,0.000000,2.500000\n"
    df = spark.createDataFrame([(r["frame"], r["metrics"]) for r in rows], "frame long, metrics map<string,double>")
    assert render.metric_names(df) == ["b", "a"]
    assert [tuple(r) for r in render.metric_columns(df, ["b", "a"]).orderBy("frame").collect()] == [(0, 1.0, 0.0), (1, 0.0, 2.5)]


def test_stats_document(tmp_path):
    source = tmp_path / "v.rgb"
    source.write_bytes(b"x")
    path = documents.write_stats(str(tmp_path / "d.json"), Content(20.0), Options(1), [{"frame": 1, "decision": "accepted"}], 3, 10.0, str(source))
    assert documents.read_stats(path)["settings"] == Content(20.0)
    assert documents.summary(path)["boundaries"] == 1
    source.write_bytes(b"xy")
    with pytest.raises(ValueError):
        documents.read_stats(path)
    os.remove(source)
    assert documents.read_stats(path)["total_frames"] == 3
    (tmp_path / "e.json").write_text('{"version": 9, "kind": "detection-stats"}')
    with pytest.raises(ValueError):
        documents.read_stats(str(tmp_path / "e.json"))


def test_artifacts_and_manifests(tmp_path):
    a, request = str(tmp_path / "a.json"), {"detector": "content", "threshold": 27.0}
    assert documents.read_artifact(a, request) is None
    documents.write_artifact(a, request, "t.parquet")
    assert documents.read_artifact(a, request) == "t.parquet" and documents.read_artifact(a, request | {"threshold": 1.0}) is None
    out = tmp_path / "o.csv"
    out.write_text("x")
    m = documents.write_manifest(str(tmp_path / "m.json"), "csv", str(out), request)
    assert documents.reusable(m, "csv", str(out), request) and not documents.reusable(m, "html", str(out), request)
    out.write_text("changed")
    assert not documents.reusable(m, "csv", str(out), request)
    assert documents.fnv64(b"") == "cbf29ce484222325" and documents.fnv64(b"a") == "af63dc4c8601ec8c"
    assert documents.default_path("x/clip.mp4", "stats") == "x/clip.framecut.json" and documents.same_review({"bytes": 1}, {"bytes": 1})


def test_command_line(spark, tmp_path, capsys):
    frames = spark.createDataFrame([(0, k, 1, 1, bytes([v] * 3)) for k, v in enumerate([0, 0, 255, 255])], "video_id long, frame long, width int, height int, rgb binary")
    frames.write.parquet(str(tmp_path / "f"))
    cli.main(["detect", "content", str(tmp_path / "f"), str(tmp_path / "out"), "--threshold", "20", "--min-scene-len", "1", "--stats"])
    cli.main(["render", "csv", str(tmp_path / "out/scenes"), "--rate", "10"])
    assert "2,3,00:00:00.200" in capsys.readouterr().out
    cli.main(["list-scenes", str(tmp_path / "out/scenes"), "--rate", "10"])
    assert "2,3,00:00:00.200" in capsys.readouterr().out
    cli.main(["export-html", str(tmp_path / "out/scenes"), "--rate", "10"])
    assert "<td>00:00:00.200</td>" in capsys.readouterr().out
    cli.main(["render", "stats", str(tmp_path / "out/stats"), "--out", str(tmp_path / "stats")])
    cli.main(["list-boundaries", str(tmp_path / "out/review"), "--out", str(tmp_path / "review")])
    read = lambda name: spark.read.option("header", True).csv(str(tmp_path / name))
    assert [(r.frame, r.decision) for r in read("stats").orderBy("frame").collect()] == [("0", "not_evaluated"), ("1", "below_threshold"), ("2", "accepted"), ("3", "below_threshold")]
    assert [(r.frame, r.rank, r.after_end) for r in read("review").collect()] == [("2", "1", "4")]
    base = "struct<ticks:long,time_base:struct<numerator:long,denominator:long>>"
    times = spark.createDataFrame([(0, k, (k * 40, (1, 1000)), (40, (1, 1000))) for k in range(4)], f"video_id long, frame long, presentation_time {base}, duration {base}")
    times.write.parquet(str(tmp_path / "timing"))
    cli.main(["render", "timeline", str(tmp_path / "out/scenes"), "--timing", str(tmp_path / "timing"), "--out", str(tmp_path / "timeline")])
    assert [(r.start_time.ticks, r.end_time.ticks) for r in spark.read.json(str(tmp_path / "timeline")).orderBy("start").collect()] == [(0, 80), (80, 160)]
    with pytest.raises(SystemExit):
        cli.main(["detect", "hash", str(tmp_path / "f"), str(tmp_path / "o"), "--size", "2", "--lowpass", "4"])


CASES = [(Content(30.0), "score"), (Adaptive(2.0, 15.0, 2), "score"), (Fade(40.0, 0.25), "score"), (Histogram(0.2, 4), "feature"), (Hash(0.3, 4), "feature")]


@pytest.mark.parametrize(("config", "kind"), CASES, ids=[c.name for c, _ in CASES])
def test_stream_equals_batch(spark, tmp_path, config, kind):
    import random

    rng = random.Random(7)
    videos = {v: [float(rng.randrange(100)) for _ in range(40 + 7 * v)] for v in range(3)}
    feature = lambda x: [float(int(x) >> b & 1) for b in range(6)]
    schema = "video_id long, frame long, value double, feature array<double>, last boolean"
    folder = tmp_path / "in"
    for part in range(4):
        batch = [(v, f, x, feature(x), False) for v, xs in videos.items() for f, x in enumerate(xs) if f // 15 == part]
        batch += [(v, None, None, None, True) for v, xs in videos.items() if (len(xs) - 1) // 15 == part]
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = session.detect_stream(stream, config, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = [tuple(r)[:1] + tuple(r)[2:] for r in session.stream_spans(spark.read.parquet(str(tmp_path / 'out'))).orderBy("video_id", "start").collect()]
    rows = spark.createDataFrame([(v, f, x, x, feature(x)) for v, xs in videos.items() for f, x in enumerate(xs)], "video_id long, frame long, content_val double, average_rgb double, f array<double>")
    if config.name == "content":
        cuts = decisions.content_boundaries(rows, config, 3)
    elif config.name == "adaptive":
        cuts = decisions.adaptive_boundaries(scores.adaptive_scores(rows, 2), config, 3)
    elif config.name == "threshold":
        cuts = decisions.fade_boundaries(rows, config, 3)
    elif config.name == "hash":
        cuts = decisions.hash_boundaries(scores.hash_scores(rows.withColumn("bits", F.transform("f", lambda x: x > 0))), 0.3, 3)
    else:
        before = scores.with_previous(rows.withColumnRenamed("f", "hist"), ["hist"])
        from framecut.functions.pixel import correlation

        first = F.col("prev_hist").isNull()
        cuts = decisions.histogram_boundaries(before.select("video_id", "frame", F.when(first, 0.0).otherwise(correlation(F.col("prev_hist"), F.col("hist"))).alias("hist_diff"), first.alias("first")), config.threshold, 3)
    want = [tuple(r)[:1] + tuple(r)[2:] for r in spans.scene_spans(cuts, spans.totals(rows)).orderBy("video_id", "start").collect()]
    assert got == want and len(want) > 5
    if config.name == "adaptive":
        shown = lambda df: [tuple(r) for r in df.orderBy("video_id", "rank").collect()]
        found = shown(session.stream_review(spark.read.parquet(str(tmp_path / "out")), config, Options(3)))
        assert found == shown(review.adaptive_review(scores.adaptive_scores(rows, 2), spans.totals(rows), config, Options(3))) and found


def test_stream_checks_times(spark, tmp_path):
    """A restarted stream of sparse frames keeps its state; a presented time that falls stops it."""
    schema = "video_id long, frame long, value double, feature array<double>, last boolean, time double"
    folder = str(tmp_path / "in")

    def push(*rows):
        spark.createDataFrame([(0, f, v, None, False, t) for f, v, t in rows], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        session.detect_stream(stream, Content(), 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    push((0, 1.0, 0.0), (10, 2.0, 0.4))
    push((20, 99.0, 0.4), (30, 3.0, None))
    assert [(r.frame, r.boundary) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("frame").collect()] == [(0, None), (10, None), (20, 20), (30, None)]
    with pytest.raises(Exception, match="must not fall"):
        push((40, 1.0, 0.3))


def test_stream_review(spark):
    values = [0.0, 50.0, 200.0, 50.0]
    rows = spark.createDataFrame([(0, k, v, None, v, None) for k, v in enumerate(values)] + [(0, 3, 0.0, None, None, 4)], session.OUTPUT)
    found = session.stream_review(rows, Content(60.0), Options(1), 50.0).orderBy("frame").collect()
    assert [(r.frame, r.status) for r in found] == [(1, "near_miss"), (2, "accepted"), (3, "near_miss")]
    with pytest.raises(ValueError):
        session.stream_review(rows, Fade(), Options(1))


def test_sql_functions(spark):
    from framecut.functions import sql

    sql.register(spark)
    got = spark.sql("SELECT * FROM scene_spans(array(5L, 2L), 9L)").collect()
    assert [tuple(r) for r in got] == [(1, 0, 2), (2, 2, 5), (3, 5, 9)]
    assert spark.sql("SELECT size(phash(unhex('000000ffffff000000ffffff'), 2, 2, 2, 1)) AS n").first().n == 4
    saved = documents.review_session(__file__, {"threshold": 3}, [], [])
    assert documents.same_review(saved, documents.review_session(__file__, {"threshold": 3}, [{"video_id": 0, "frame": 1}], []))


def test_stream_rejects_falling_frames():
    s = session.Session(Content(), 1)
    s.push(0, 1.0, None)
    with pytest.raises(ValueError):
        s.push(0, 1.0, None)
    assert s.push(2, 1.0, None, 0.5) == [(2, 1.0, None, 1.0)]  # sparse frames are fine
    with pytest.raises(ValueError):
        s.push(1, 1.0, None)
    assert s.push(5, 1.0, None, 0.5) and s.push(6, 1.0, None)  # equal and unknown times are fine
    with pytest.raises(ValueError, match="must not fall"):
        s.push(7, 1.0, None, 0.4)


def test_queries_match_their_sql(spark, sf_dir):
    import duckdb

    from framecut.plans.oracle import ORACLES
    from framecut.plans.queries import QUERIES

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("embeddings", "events", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    near = lambda t: tuple(round(v, 9) if isinstance(v, float) else v for v in t)
    for name in ("content_scenes", "content_components", "hist_scenes", "adaptive_scenes", "fade_scenes", "boundary_review", "review_context", "scene_timeline", "scene_similarity_pairs", "nearest_sample", "worst_divergences"):
        found, want = QUERIES[name](spark, sf_dir), con.sql(ORACLES[name])
        assert sorted(found.columns) == sorted(want.columns), name
        assert sorted((near(r) for r in found.select(*want.columns).collect()), key=repr) == sorted(map(near, want.fetchall()), key=repr), name


def test_detail_queries_match_their_sql(spark, sf_dir):
    import duckdb

    from framecut.plans.details import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("embeddings", "events", "orders", "customer", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name, query in QUERIES.items():
        found, want = query(spark, sf_dir), con.sql(ORACLES[name])
        assert sorted(found.columns) == sorted(want.columns), name
        assert sorted((tuple(r) for r in found.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr), name


def test_reports_are_limited_by_video(spark):
    pairs = spark.createDataFrame([(v, k, 1.0 - k / 64) for v in (1, 2) for k in range(1, 30)], "video_id long, rank int, similarity double")
    assert similarity.report_pairs(pairs, 0.0).groupBy("video_id").count().orderBy("video_id").collect() == [(1, 16), (2, 16)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
