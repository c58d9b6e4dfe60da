"""Exports of a human review, and goldens held against their cases."""

import json

from pyspark.sql import functions as F

from framecut.operators import quality
from framecut.sinks import reviewed


def test_times_as_text(spark):
    given = [0.0, 3725.5, 59.9996, -1.0, float("nan"), float("inf"), None, 360000.001]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, x double").orderBy("k").select(reviewed.time_text(F.col("x")).alias("t"))
    assert [r.t for r in got.collect()] == ["00:00:00.000", "01:02:05.500", "00:00:60.000", *["00:00:00.000"] * 4, "100:00:00.001"]


def test_review_documents(spark):
    videos = spark.createDataFrame([(0, 2.5, 10.0, 5), (1, 1.0, 10.0, 2)], "video_id long, duration double, fps double, count long")
    samples = spark.createDataFrame([(0, 0, 0.0), (0, 3, 0.7), (1, 0, 0.0)], "video_id long, sample long, media_time_seconds double")
    scenes = spark.createDataFrame([(0, 1, 0, 3), (0, 2, 3, 4), (0, 3, 4, 5)], "video_id long, scene_number int, start long, end long")
    texts = {r.video_id: r.text for r in reviewed.reviewed_csv(reviewed.timed_scenes(scenes, samples, videos)).collect()}
    assert texts == {0: "Scene,Start Sample,Start Time,End Sample,End Time\n1,0,00:00:00.000,3,00:00:00.700\n2,3,00:00:00.700,4,00:00:00.400\n3,4,00:00:00.400,5,00:00:02.500\n"}
    actions = spark.createDataFrame([(0, 4, "manual"), (0, 3, "accept")], "video_id long, frame long, action string")
    got = {r.video_id: json.loads(r.text) for r in reviewed.review_artifact(videos, samples, actions, scenes.where("start = 0"), scenes).collect()}
    assert got[0] == {
        "schema_version": 1,
        "authority": {"detector": "spark", "review": "human"},
        "decisions": [{"sample": 3, "media_time_seconds": 0.7, "action": "accept"}, {"sample": 4, "media_time_seconds": 0.4, "action": "manual"}],
        "detector_scene_list": {"scenes": [{"start": 0, "end": 3}]},
        "reviewed_scene_list": {"scenes": [{"start": 0, "end": 3}, {"start": 3, "end": 4}, {"start": 4, "end": 5}]},
        "presented_samples": [{"sample": 0, "media_time_seconds": 0.0}, {"sample": 3, "media_time_seconds": 0.7}],
    }
    assert (got[1]["decisions"], got[1]["detector_scene_list"], got[1]["reviewed_scene_list"]) == ([], None, {"scenes": []})


def test_stale_metadata(spark):
    side = lambda *rows: spark.createDataFrame(list(rows), "case_id string, metadata map<string,string>")
    cases = side(("same", {"a": "1"}), ("other", {"a": "1", "b": "2"}), ("gone", {"a": "1"}), ("null", {"a": None}))
    goldens = side(("same", {"a": "1", "c": "9", "python": "3"}), ("other", {"a": "2", "python": "3"}), ("null", {"a": None}), ("extra", {"a": "7"}))
    found = quality.stale_metadata(goldens, cases, ("python",)).collect()
    assert sorted((r.case_id, r.key, r.expected, r.observed) for r in found) == [("gone", "a", "1", None), ("gone", "python", None, None), ("null", "python", None, None), ("other", "a", "1", "2"), ("other", "b", "2", None)]
