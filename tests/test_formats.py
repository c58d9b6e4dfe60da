"""Frame sources and statistics sinks as data sources."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framecut.operators import features
from framecut.sinks import statistics
from framecut.sources import formats


def write_clip(path, n, seed, size=30):
    data = np.random.default_rng(seed).integers(0, 256, n * size, np.uint8).tobytes()
    path.write_bytes(data)
    return [data[k * size : (k + 1) * size] for k in range(n)]


def rows_of(df):
    return sorted((r.clip.rsplit("/", 1)[-1], r.frame, bytes(r.rgb)) for r in df.select("clip", "frame", "rgb").collect())


def test_raw_files_in_many_tasks(spark, tmp_path):
    want = {name: write_clip(tmp_path / name, n, k) for k, (name, n) in enumerate([("a.rgb", 25), ("b.rgb", 1), ("empty.rgb", 0), ("_x", 2)])}
    formats.register(spark)
    read = lambda path: spark.read.format("rawframes").option("width", 5).option("height", 2).option("split", 120).load(str(path))
    df = read(tmp_path)
    assert rows_of(df) == sorted((name, k, rgb) for name, frames in want.items() if name[0] != "_" for k, rgb in enumerate(frames))
    assert df.rdd.getNumPartitions() == 8 and df.select("video_id").distinct().count() == 2
    assert len({r.video_id for r in read(tmp_path / "b.rgb").collect()}) == 1
    assert features.image_content_scores(df).count() == 26
    assert read(tmp_path / "empty.rgb").count() == 0
    (tmp_path / "b.rgb").write_bytes(b"x" * 31)
    with pytest.raises(Exception, match="truncated frame 1"):
        read(tmp_path).count()
    with pytest.raises(Exception, match="FileNotFound"):
        read(tmp_path / "none").count()


def test_raw_files_as_a_stream(spark, tmp_path):
    """A file that grows, in parts that end within a frame, gives each frame once, across a restart too."""
    clips, out, mark = tmp_path / "clips", str(tmp_path / "out"), str(tmp_path / "mark")
    clips.mkdir()
    frames = write_clip(tmp_path / "all", 9, 5)
    formats.register(spark)

    def run():
        stream = spark.readStream.format("rawframes").option("width", 5).option("height", 2).load(str(clips))
        stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(once=True).start(out).awaitTermination()
        return [(k, rgb) for _, k, rgb in rows_of(spark.read.parquet(out))]

    whole = b"".join(frames)
    for end in (100, 100, 215, 270):  # 3 frames and a part, nothing new, 7 frames and a part, all
        (clips / "a.rgb").write_bytes(whole[:end])
        assert run() == list(enumerate(frames))[: end // 30]
    assert rows_of(spark.read.parquet(out)) == rows_of(spark.read.format("rawframes").option("width", 5).option("height", 2).load(str(clips)))


def test_a_source_of_the_callers_own(spark):
    class Shades(formats.FrameSource):
        width = height = 1

        def __init__(self, options):
            self.n = int(options["n"])

        def clips(self, whole):
            return {"shades": self.n}

        def read(self, clip, first, count):
            return bytes(v for k in range(first, first + count) for v in (k, k, k))

    formats.register(spark, "shades", Shades)
    assert [r.rgb[0] for r in spark.read.format("shades").option("n", 7).load().orderBy("frame").collect()] == list(range(7))


SCHEMA = "video_id long, frame long, score double, metrics map<string,double>"


def stats(spark, n, start=0):
    return spark.range(start, start + n).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame"), (F.col("id") / 4).alias("score"), F.create_map(F.lit("content_val"), F.col("id") / 4).alias("metrics"))


def frames_in(spark, path):
    return sorted(r.frame for r in statistics.read_statistics(spark, path, SCHEMA).collect())


def test_statistics_of_batches(spark, tmp_path):
    path = str(tmp_path / "s")
    statistics.register(spark)
    for start in (0, 10):
        stats(spark, 10, start).repartition(3).write.format("framestats").mode("append").save(path)
    assert frames_in(spark, path) == list(range(20))
    with pytest.raises(Exception, match="appended"):
        stats(spark, 1).write.format("framestats").mode("overwrite").save(path)
    fails = stats(spark, 10, 20).withColumn("score", F.when(F.col("frame") == 29, F.raise_error(F.lit("broken"))).otherwise(F.col("score")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        fails.repartition(2, "frame").write.format("framestats").mode("append").save(path)
    assert frames_in(spark, path) == list(range(20))


def test_statistics_of_a_restarted_stream(spark, tmp_path):
    source, path, mark = str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "mark")
    statistics.register(spark)

    def run():
        stream = spark.readStream.schema(SCHEMA).json(source)
        stream.writeStream.format("framestats").option("path", path).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()

    stats(spark, 6).write.json(source)
    run()
    stats(spark, 4, 6).write.mode("append").json(source)
    run()
    assert frames_in(spark, path) == list(range(10))
    # The stream stops after the sink's commit and before Spark's own: the batch comes again.
    last = max(int(f) for f in os.listdir(f"{mark}/commits") if f.isdigit())
    for f in (str(last), f".{last}.crc"):
        if os.path.exists(f"{mark}/commits/{f}"):
            os.remove(f"{mark}/commits/{f}")
    files = len(os.listdir(f"{path}/rows"))
    run()
    assert frames_in(spark, path) == list(range(10)) and len(os.listdir(f"{path}/rows")) == files


def test_a_sink_of_the_callers_own(spark, tmp_path):
    class Log(statistics.StatsSink):
        def __init__(self, options):
            self.path = options["path"]

        def start(self):
            self.seen = ["start"]

        def row(self, row):
            self.seen.append(row["frame"])

        def finish(self):
            return [*self.seen, "finish"]

        def commit(self, messages, batch):
            with open(self.path, "w") as f:
                json.dump([messages, batch], f)

    statistics.register(spark, "log", Log)
    stats(spark, 3).coalesce(1).write.format("log").mode("append").save(str(tmp_path / "log"))
    assert json.loads((tmp_path / "log").read_text()) == [[["start", 0, 1, 2, "finish"]], None]
