import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framecut.operators import decisions, scans


def by_video():
    return Window.partitionBy("video_id").orderBy("frame")


@pytest.fixture(scope="module")
def long_rows(spark):
    """Videos dense and sparse, with gaps of many chunks, nulls and values that not a few rows share."""
    rng = random.Random(8)
    rows = [(v, f, rng.choice([None, 1.0, 1.0, float(rng.randrange(5)), rng.random()])) for v, share in ((0, 1.0), (1, 0.3), (2, 0.02)) for f in range(300) if rng.random() < share]
    return spark.createDataFrame(rows + [(3, 7, 2.0), (4, 5, None), (4, 9000, 1.0)], "video_id long, frame long, x double").cache()


def same(got, want):
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))


def test_next_and_numbers(long_rows):
    same(scans.with_next(long_rows, "x", chunk=10), long_rows.withColumn("next_x", F.lead("x").over(by_video())))
    same(scans.numbered(long_rows, "k", chunk=10), long_rows.withColumn("k", F.row_number().over(by_video())))


def test_last_known(long_rows):
    want = long_rows.withColumn("state", F.coalesce(F.last("x", ignorenulls=True).over(by_video().rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1.0)))
    same(scans.with_last_known(long_rows, "x", -1.0, chunk=10), want.withColumn("before", F.lag("state").over(by_video())))


@pytest.mark.parametrize("pieces", [2, 5])
def test_ranks_with_ties(long_rows, pieces):
    known = long_rows.where("x is not null")
    same(scans.ranked_by(known, "x", "rank", pieces, chunk=10), known.withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy("x", "frame"))))


@pytest.mark.parametrize(("m", "base"), [(0, 0), (1, 0), (7, 0), (7, 25), (10, 3), (45, 0), (45, 60)])
def test_spaced_equals_a_loop(long_rows, m, base):
    rows = long_rows.where(F.col("frame") >= base)
    want, last = set(), {}
    for v, f in sorted((r.video_id, r.frame) for r in rows.collect()):
        if f - last.get(v, base) >= m:
            want.add((v, f))
            last[v] = f
    assert sorted(map(tuple, scans.spaced(rows, m, F.lit(base), chunk=10).collect())) == sorted(want)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "video_id long, frame long, x double")
    found = [scans.with_next(empty, "x"), scans.numbered(empty, "k"), scans.with_last_known(empty, "x", 0.0), scans.ranked_by(empty, "x", "k"), scans.spaced(empty, 3, F.lit(0)), decisions.rolling(empty, 3)]
    assert not any(df.count() for df in found)


def test_a_long_video_is_dealt_over_tasks(spark):
    """Dense candidates of one video, a single chain: groups hold a chunk each, and one in m is taken."""
    rows = spark.range(0, 200_000, 1, 8).select(F.lit(0).cast("long").alias("video_id"), F.col("id").alias("frame"))
    kept = decisions.greedy(rows, 15).where("accepted")
    assert kept.agg(F.count("*"), F.min("frame"), F.max("frame")).first()[:] == (13_333, 15, 199_995)
    assert kept.where("frame % 15 <> 0").isEmpty()
