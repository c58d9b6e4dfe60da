"""Statistics as tables with a header that commits them."""

import json
import os

import pytest
from pyspark.sql import functions as F

from framecut import api
from framecut.config import Content, Hash, Options
from framecut.operators import spans
from framecut.sinks import store
from framecut.sources import frames as sources


def many_rows(spark, n, videos=4):
    """n frames of each video; every 1000th is an accepted cut."""
    metrics = "map('content_val', cast(id % 97 as double))"
    decision = "case when id % 1000 = 999 then 'accepted' else 'below_threshold' end"
    rows = spark.range(n * videos).selectExpr(f"id div {n} as video_id", f"id % {n} as frame", "cast(id % 97 as double) as score", "27d as threshold", f"{decision} as decision", f"{metrics} as metrics")
    return rows, spark.range(videos).selectExpr("id as video_id", f"{n}L as total")


def test_rows_come_back(spark, tmp_path):
    path = str(tmp_path / "stats")
    rows, totals = many_rows(spark, 250_000)
    store.write(path, rows, totals, Content(20.0), Options(1), 25.0)
    stored = store.read(spark, path)
    assert stored.settings == Content(20.0) and stored.rows.dtypes == rows.dtypes
    assert (stored.header["rows"], stored.header["metric_names"], stored.header["version"]) == (1_000_000, ["content_val"], 1)
    flat = lambda df: df.withColumn("metrics", F.to_json("metrics"))
    assert flat(stored.rows).exceptAll(flat(rows)).isEmpty() and stored.rows.count() == 1_000_000
    assert store.scenes(stored).count() == 4 * 251 and store.plain(stored.rows).columns == ["video_id", "frame", "metrics"]
    assert store.content_rows(stored) is stored.rows
    assert store.summary(spark, path) == {"detector": "content", "config": stored.header["config"], "source": None, "metric_names": ["content_val"], "rows": 1_000_000, "videos": 4, "boundaries": 1000}


def test_scenes_of_stored_rows_are_those_of_the_detector(spark, tmp_path):
    frames = sources.solid_frames(spark, [(c, c, c) for c in (0, 0, 200, 200, 90, 255)])
    for config in (Content(20.0), Hash(0.2, 2, 1)):
        path = str(tmp_path / config.name)
        store.write(path, api.stats(frames, config, Options(1)), spans.totals(frames), config, Options(1), 25.0)
        stored = store.read(spark, path)
        assert store.scenes(stored).orderBy("start").collect() == api.detect(frames, config, Options(1)).scenes.orderBy("start").collect()
    with pytest.raises(store.StatsError, match="hash statistics"):
        store.content_rows(stored)


def test_last_committed_write_counts(spark, tmp_path):
    path = str(tmp_path / "stats")
    with pytest.raises(store.StatsError, match="no statistics.*Recovery: `python -m framecut detect content"):
        store.read(spark, path)
    for n in (10, 20, 30):
        store.write(path, *many_rows(spark, n, 1), Content(), Options(), 25.0)
    assert store.read(spark, path).rows.count() == 30
    os.mkdir(f"{path}/left-over")  # of a write that failed before its header
    (tmp_path / "stats/headers/_draft").write_text("{")
    assert store.read(spark, path).rows.count() == 30
    empty = many_rows(spark, 0, 0)
    store.write(path, *empty, Content(), Options(), 25.0)
    stored = store.read(spark, path)
    assert (stored.rows.count(), store.scenes(stored).count(), stored.header["metric_names"]) == (0, 0, [])


def test_stale_and_foreign_documents(spark, tmp_path):
    clips, path = tmp_path / "clips", str(tmp_path / "stats")
    clips.mkdir()
    for name in ("a.rgb", "b.rgb"):
        (clips / name).write_bytes(b"123")
    store.write(path, *many_rows(spark, 10, 2), Content(), Options(), 25.0, str(clips))
    assert store.read(spark, path).rows.count() == 20
    (clips / "c.rgb").write_bytes(b"new files are no change of old ones")
    os.remove(clips / "a.rgb")
    assert store.read(spark, path).rows.count() == 20
    (clips / "b.rgb").write_bytes(b"1234")
    with pytest.raises(store.StatsError, match="b.rgb has changed"):
        store.read(spark, path)
    os.remove(clips / "b.rgb")
    os.remove(clips / "c.rgb")
    os.rmdir(clips)
    assert store.read(spark, path).rows.count() == 20
    header = store.read_header(path)
    for text, said in ((json.dumps(header | {"version": 9}), "known version"), (json.dumps(header | {"kind": "x"}), "known version"), ("[1]", "known version"), ("{", "malformed")):
        (tmp_path / "stats/headers/9999999999-x.json").write_text(text)
        with pytest.raises(store.StatsError, match=said):
            store.read(spark, path)
