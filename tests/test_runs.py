"""Comparison of runs: many parts a task, sides however they are dealt, values that are no times."""

import random
import time

from pyspark.sql import functions as F

from framecut.operators import joins


def of(spark, rows):
    return spark.createDataFrame(rows, "video_id long, time double")


def plain(mine, theirs, tolerance):
    """Each of mine, in order, with the nearest of theirs that is unused and within tolerance."""
    left, out = sorted(theirs), []
    for t in sorted(mine):
        best = min(left, key=lambda x: abs(x - t), default=None)
        if best is not None and abs(best - t) <= tolerance:
            left.remove(best)
            out.append(("shared", t, best))
        else:
            out.append(("current_only", t, None))
    return out + [("saved_only", None, t) for t in left]


def test_batches_and_dealing_change_nothing(spark):
    rng = random.Random(7)
    runs = [{v: [round(rng.random() * 20, 2) for _ in range(rng.randint(0, 60))] for v in range(40)} for _ in range(2)]
    want = sorted((v, *r) for v in range(40) for r in plain(runs[0][v], runs[1][v], 0.05))
    sides = [of(spark, [(v, t) for v, ts in run.items() for t in ts]) for run in runs]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for size in (1, 2, 7, 10_000):
            spark.conf.set(key, str(size))
            for dealt in (sides, [s.repartition("video_id") for s in sides]):
                got = joins.compare_runs(*dealt, 30.0).collect()
                assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.set(key, before)


def test_what_is_no_time_stands_alone(spark):
    nan = float("nan")
    got = joins.compare_runs(of(spark, [(1, None), (1, nan), (None, 1.0), (2, 1.0)]), of(spark, [(1, None), (1, nan), (None, 1.0), (0, 1.0)]), 30.0)
    shown = sorted((str(r.video_id), r.kind, str(r.current), str(r.saved)) for r in got.collect())
    assert shown == sorted([("1", "current_only", "None", "None"), ("1", "current_only", "nan", "None"), ("1", "saved_only", "None", "None"), ("1", "saved_only", "None", "nan"), ("None", "shared", "1.0", "1.0"), ("2", "current_only", "1.0", "None"), ("0", "saved_only", "None", "1.0")])
    assert joins.compare_runs(of(spark, []), of(spark, []), 30.0).count() == 0


def test_many_small_parts_need_no_group_each(spark):
    times = lambda shift: spark.range(200_000).select((F.col("id") % 1000).alias("video_id"), (F.floor(F.col("id") / 1000) + shift).alias("time"))
    began = time.perf_counter()
    assert joins.compare_runs(times(0.0), times(0.02), 30.0).where("kind = 'shared'").count() == 200_000
    assert time.perf_counter() - began < 30
