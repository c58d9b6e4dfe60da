"""Video files by stand-ins for ffprobe and ffmpeg, which print what files hold; the similarity session."""

import os
import stat
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from framecut.functions import image
from framecut.operators import similarity
from framecut.sources import media
from framecut.streaming import similarity as pushes

PROBE = """#!{python}
import json, os, sys
path = sys.argv[-1]
if not os.path.exists(path):
    sys.exit("no such file")
facts = json.load(open(path))
if "-show_frames" in sys.argv:
    print("\\n".join(facts["records"]))
else:
    print(json.dumps({{"streams": facts["streams"]}}))
"""
DECODER = """#!{python}
import json, sys
facts = json.load(open(sys.argv[sys.argv.index("-i") + 1]))
sys.stdout.buffer.write(bytes.fromhex(facts["rgb"]))
sys.exit(facts.get("code", 0))
"""
STREAM = {"width": 2, "height": 1, "r_frame_rate": "25/1", "time_base": "1/1000"}


@pytest.fixture
def tools(spark, tmp_path, monkeypatch):
    """Stand-ins first on the path, of this process and of the workers."""
    for name, text in (("ffprobe", PROBE), ("ffmpeg", DECODER)):
        (tmp_path / name).write_text(text.format(python=sys.executable))
        (tmp_path / name).chmod(stat.S_IRWXU)
    path = f"{tmp_path}{os.pathsep}{os.environ['PATH']}"
    monkeypatch.setenv("PATH", path)
    monkeypatch.setitem(spark.sparkContext.environment, "PATH", path)
    return tmp_path


def clip(folder, name, colors, records=None, **more):
    import json

    rgb = "".join(bytes([c] * 6).hex() for c in colors)
    records = [f"best_effort_timestamp={40 * k}|duration=40" for k in range(len(colors))] if records is None else records
    (folder / name).write_text(json.dumps({"streams": [STREAM], "rgb": rgb, "records": records} | more))
    return str(folder / name)


def opened(spark, *paths):
    return media.open_videos(spark.createDataFrame([(p,) for p in paths], "path string"))


def test_frames_in_step_with_their_records():
    take = lambda *a, **k: [(n, r) for n, _, r in media.in_step(*a, **k)]
    calls = []

    def timing(n):
        def records():
            calls.append(n)
            yield from map(str, range(n))

        return records

    assert take("abc", timing(3)) == [(0, "0"), (1, "1"), (2, "2")]
    assert take("abc", timing(9), first=1) == [(0, None), (1, "1"), (2, "2")]
    calls.clear()
    assert take("abc", timing(0), first=3) == [(0, None), (1, None), (2, None)] and take("", timing(0)) == [] and not calls
    for n, first, missing in ((2, 0, 2), (1, 2, 1), (2, 2, 2)):
        with pytest.raises(media.ToolError, match=f"frame {missing}"):
            take("abc", timing(n), first=first)
    lazily = media.in_step("abc", timing(1))
    assert next(lazily)[2] == "0"  # the short list is found when its frame comes


def test_video_files(spark, tools):
    paths = [clip(tools, "a", [0, 9, 200]), clip(tools, "b", [7], ["best_effort_timestamp=N/A|pkt_duration=4"]), clip(tools, "none", [], [])]
    videos = opened(spark, *paths)
    assert sorted((r.frame_rate, r.base.denominator) for r in videos.collect()) == [(25.0, 1000)] * 3
    got = {(r.video_id, r.frame): r for r in media.video_frames(videos).collect()}
    ids = {r.path: r.video_id for r in videos.collect()}
    assert sorted(got) == sorted([(ids[paths[0]], k) for k in range(3)] + [(ids[paths[1]], 0)])
    second = got[ids[paths[0]], 1]
    assert (bytes(second.rgb), second.presentation_time.ticks, second.duration.time_base.denominator) == (bytes([9] * 6), 40, 1000)
    assert got[ids[paths[1]], 0].presentation_time is None and got[ids[paths[1]], 0].duration.ticks == 4
    assert media.decode(videos).count() == 4
    assert [r.presentation_time is None for r in media.video_frames(videos.where(F.col("path") == paths[0]), 2).orderBy("frame").collect()] == [True, True, False]


def test_broken_video_files(spark, tools):
    read = lambda path: media.video_frames(opened(spark, path)).count()
    with pytest.raises(Exception, match="no such file"):
        read(str(tools / "gone"))
    with pytest.raises(Exception, match="no video stream"):
        read(clip(tools, "sound", [1], streams=[]))
    with pytest.raises(Exception, match="truncated frame 1"):
        read(clip(tools, "cut", [1], rgb="00" * 9))
    with pytest.raises(Exception, match="ffmpeg ended with 3"):
        read(clip(tools, "bad", [1, 2], code=3))
    with pytest.raises(Exception, match="no timing record for frame 1"):
        read(clip(tools, "short", [1, 2], ["best_effort_timestamp=0"]))


def test_detect_from_video_files(spark, tools):
    from framecut import __main__ as cli

    path = clip(tools, "v.mp4", [0, 0, 255, 255])
    for k, command in enumerate((["detect", "content"], ["detect-content"])):
        cli.main([*command, path, str(tools / f"out{k}"), "--video", "--threshold", "20", "--min-scene-len", "1", "--stats"])
        assert [(r.start, r.end) for r in spark.read.parquet(str(tools / f"out{k}/scenes")).orderBy("start").collect()] == [(0, 2), (2, 4)]
        assert spark.read.parquet(str(tools / f"out{k}/timing")).where("frame = 3").first().presentation_time.ticks == 120
    cli.main(["detect-hist", path, str(tools / "hist"), "--video", "--min-scene-len", "1"])
    assert spark.read.parquet(str(tools / "hist/scenes")).count() == 2


SIZE = "video_id long, arrival long, frame long, width int, height int, rgb binary"


def images_of(n, seed):
    shape = (8, 8)
    return [np.kron(np.random.default_rng(seed + k).integers(0, 255, shape), np.ones((2, 2)))[:, :, None].repeat(3, 2).astype(np.uint8).tobytes() for k in range(n)]


def run_stream(spark, folder, rows, fps=2.0, most=similarity.MAX_SAMPLES):
    spark.createDataFrame(rows, SIZE).repartition(3).write.mode("append").parquet(f"{folder}/in")
    found = pushes.fingerprint_stream(spark.readStream.schema(SIZE).parquet(f"{folder}/in"), fps, most)
    found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_similarity_session(spark, tmp_path):
    """Two runs of a restarted stream give the hashes and pairs of the batch operators."""
    clips = {v: images_of(12, 20 * v) for v in (0, 1)}
    rows = [(v, k, k, 16, 16, rgb) for v, frames in clips.items() for k, rgb in enumerate(frames)]
    run_stream(spark, str(tmp_path), [r for r in rows if r[1] < 5])
    got = run_stream(spark, str(tmp_path), [r for r in rows if r[1] >= 5])
    frames = spark.createDataFrame(rows, SIZE)
    want = similarity.sampled(frames.select("video_id", "frame", image.fingerprint("rgb", "width", "height").alias("hash")), 2.0)
    shown = lambda df: sorted(map(tuple, df.select("video_id", "frame", "hash").collect()))
    assert shown(got) == shown(want) and len(shown(got)) == 12
    scenes = spark.createDataFrame([(v, k + 1, 4 * k, 4 * k + 4) for v in (0, 1) for k in range(3)], "video_id long, scene_number int, start long, end long")
    pairs = pushes.finish(got, scenes).orderBy("video_id", "rank").collect()
    assert pairs == similarity.similar_pairs(similarity.scene_hashes(want, scenes)).orderBy("video_id", "rank").collect() and len(pairs) == 6


def test_similarity_session_refuses(spark, tmp_path):
    black = bytes(12)
    run = lambda name, rows, **more: run_stream(spark, str(tmp_path / name), rows, **more)
    assert run("sparse", [(0, 0, 4, 2, 2, black), (0, 1, 9, 2, 2, black)]).count() == 1
    with pytest.raises(Exception, match="frames must rise"):  # in the next batch
        run("sparse", [(0, 2, 9, 2, 2, black)])
    with pytest.raises(Exception, match="frames must rise"):  # in order of arrival, not of number
        run("falling", [(0, 0, 6, 2, 2, black), (0, 1, 4, 2, 2, black)])
    for name, row in (("long", (0, 0, 1, 2, 2, bytes(13))), ("flat", (0, 0, 1, 0, 2, b"")), ("null", (0, 0, 1, 2, 2, None))):
        with pytest.raises(Exception, match="wrong length"):
            run(name, [row])
    assert run("full", [(0, k, k, 2, 2, black) for k in range(3)], most=3).count() == 2
    with pytest.raises(Exception, match="at most 3"):  # frames that aren't sampled count too
        run("full", [(0, 3, 3, 2, 2, black)], most=3)
