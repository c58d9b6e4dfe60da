"""As-of joins of samples and media times, comparison of runs, series for the screen."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _beside(points: DataFrame, marks: DataFrame, point: str, mark: str, strict: bool, chunk: float = 4096.0) -> DataFrame:
    """points with __before and __after: the marks at or below (strict: below) and at or above, of the same video.

    Rows are dealt by (video, chunk of the axis); only the first and last mark of each chunk meet their
    video in one window, and what they carry over comes back to the chunk's rows.
    """
    row = F.struct(*points.columns)
    kind = points.select(row).schema[0].dataType
    both = marks.select("video_id", F.col(mark).cast("double").alias("__at"), F.col(mark).alias("__mark"), F.lit(None).cast(kind).alias("__row")).unionByName(points.select("video_id", F.col(point).cast("double").alias("__at"), F.lit(None).cast(marks.schema[mark].dataType).alias("__mark"), row.alias("__row")))
    both = both.withColumn("__chunk", F.floor(F.col("__at") / chunk))
    by_chunk = Window.partitionBy("video_id").orderBy("__chunk")
    ends = both.groupBy("video_id", "__chunk").agg(F.max("__mark").alias("hi"), F.min("__mark").alias("lo"))
    carried = ends.select("video_id", "__chunk", F.max("hi").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)).alias("__lower"), F.min("lo").over(by_chunk.rowsBetween(1, Window.unboundedFollowing)).alias("__upper"))
    is_point = F.col("__row").isNotNull()
    up = Window.partitionBy("video_id", "__chunk").orderBy("__at", ~is_point if strict else is_point).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("video_id", "__chunk").orderBy(F.col("__at").desc(), is_point).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"__before": F.last("__mark", ignorenulls=True).over(up), "__after": F.last("__mark", ignorenulls=True).over(down)}).where("__row is not null")
    joined = found.join(carried, ["video_id", "__chunk"], "left")
    return joined.select("__row.*", F.coalesce("__before", "__lower").alias("__before"), F.coalesce("__after", "__upper").alias("__after"))


def nearest_sample(times: DataFrame, samples: DataFrame, time: str = "time", at: str = "media_time_seconds") -> DataFrame:
    """times with sample: the one whose media time is nearest, the earlier of two equally near ones."""
    numbered = samples.groupBy("video_id", at).agg(F.min("sample").alias("__sample"))
    rows = _beside(times, numbered, time, at, False)
    near = F.when(F.col("__after").isNull() | (F.col(time) - F.col("__before") <= F.col("__after") - F.col(time)), F.col("__before")).otherwise(F.col("__after"))
    return rows.withColumn("__at", near).join(numbered.withColumnRenamed(at, "__at"), ["video_id", "__at"], "left").withColumnRenamed("__sample", "sample").drop("__before", "__after", "__at")


def previous_sample(points: DataFrame, samples: DataFrame, point: str = "sample_at") -> DataFrame:
    """points with previous: the largest sample strictly below, else one less than the point, but not below 0."""
    return _beside(points, samples, point, "sample", True).withColumn("previous", F.coalesce("__before", F.greatest(F.lit(0), F.col(point) - 1)).cast("long")).drop("__before", "__after")


def media_times(points: DataFrame, samples: DataFrame, duration: Column, fps: Column, count: Column) -> DataFrame:
    """points (video_id, sample) with media_time_seconds: the presented time, else the duration at the end, else sample / fps."""
    rows = points.join(samples.select("video_id", "sample", F.col("media_time_seconds").alias("__t")), ["video_id", "sample"], "left")
    return rows.withColumn("media_time_seconds", F.coalesce("__t", F.when(F.col("sample") >= count, duration), F.col("sample") / fps)).drop("__t")


class Unused:
    """Places 0 to n - 1 of which some are taken; finds the nearest free one on each side, in all but constant time."""

    def __init__(self, n: int):
        self.up, self.down = list(range(n + 1)), list(range(n + 1))  # down holds place k at k + 1

    @staticmethod
    def _end(links: list[int], k: int) -> int:
        end = k
        while links[end] != end:
            end = links[end]
        while links[k] != end:
            links[k], k = end, links[k]
        return end

    def above(self, k: int) -> int:
        """The first free place from k on; n if there is none."""
        return self._end(self.up, k)

    def below(self, k: int) -> int:
        """The last free place before k; -1 if there is none."""
        return self._end(self.down, k) - 1

    def take(self, k: int) -> None:
        self.up[k], self.down[k + 1] = k + 1, k


def _taken(mine: list[float], theirs: list[float], tolerance: float) -> list[tuple[int, int]]:
    """Places of mine, in order, and of the nearest of theirs within tolerance that none before has taken."""
    free, out = Unused(len(theirs)), []
    for i, t in enumerate(mine):
        at = bisect.bisect_left(theirs, t)
        near = [k for k in (free.below(at), free.above(at)) if 0 <= k < len(theirs)]
        best = min(near, key=lambda k: (abs(theirs[k] - t), k), default=None)
        if best is not None and abs(theirs[best] - t) <= tolerance:
            free.take(best)
            out.append((i, best))
    return out


def compare_runs(current: DataFrame, saved: DataFrame, fps: float) -> DataFrame:
    """video_id, kind (shared, current_only, saved_only), current, saved: times of two runs' boundaries.

    In order of current boundaries each takes the nearest unused saved one within tolerance.  Runs
    fall apart where neighbours stand more than the tolerance apart.  Rows come sorted, so a task goes
    through many parts of a batch at once; those of one or two rows need no walk.
    """
    tolerance = max(0.05, 0.5 / max(1.0, fps))
    side = lambda rows, k: rows.select(F.col("video_id").cast("long").alias("video_id"), F.col("time").cast("double").alias("time"), F.lit(k).alias("side"))
    # Dealt by a hash of its own: where both sides are dealt by video_id already, Spark leaves that shuffle out, though each side's partitions are joined apart.
    rows = side(current, 0).unionByName(side(saved, 1)).repartition(F.xxhash64("video_id")).sortWithinPartitions("video_id", "time", "side")

    def starts(video: pa.ChunkedArray, time: pa.ChunkedArray) -> np.ndarray:
        """Whether each row begins a part; the first does."""
        known, number = (x.to_numpy() for x in (video.is_valid(), video.fill_null(0)))
        at = time.fill_null(float("nan")).to_numpy()
        with np.errstate(invalid="ignore"):
            near = at[1:] - at[:-1] <= tolerance  # what is no number is near nothing
        return np.concatenate(([True], (number[1:] != number[:-1]) | (known[1:] != known[:-1]) | ~near))

    def solved(table: pa.Table) -> list[pa.RecordBatch]:
        time, kind = table.column("time"), table.column("side").to_numpy()
        first = np.flatnonzero(starts(table.column("video_id"), time))
        length = np.diff(np.append(first, table.num_rows))
        partner = np.full(table.num_rows, -1)
        two = first[length == 2]
        two = two[kind[two] != kind[two + 1]]
        partner[two], partner[two + 1] = two + 1, two
        at = time.to_numpy()
        for k, n in zip(first[length > 2].tolist(), length[length > 2].tolist(), strict=True):
            mine, theirs = (k + np.flatnonzero(kind[k : k + n] == s) for s in (0, 1))
            for i, j in _taken(at[mine].tolist(), at[theirs].tolist(), tolerance):
                partner[mine[i]], partner[theirs[j]] = theirs[j], mine[i]
        own, met = kind == 0, partner >= 0
        kept = np.flatnonzero(own | ~met)
        own, met, partner = own[kept], met[kept], partner[kept]
        place = lambda at, known: time.take(pa.array(at, pa.int64(), mask=~known))
        columns = [table.column("video_id").take(pa.array(kept)), pa.array(np.where(~own, "saved_only", np.where(met, "shared", "current_only")), pa.string()), place(kept, own), place(np.where(own, partner, kept), ~own | met)]
        return pa.table(dict(zip(("video_id", "kind", "current", "saved"), columns, strict=True))).combine_chunks().to_batches()

    def run(batches):
        held: list[pa.RecordBatch] = []  # the part that isn't over
        for b in batches:
            if not b.num_rows:
                continue
            seam = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), b] if held else [b])
            begins = np.flatnonzero(starts(seam.column("video_id"), seam.column("time"))[1 if held else 0 :])
            if held and len(begins):
                yield from solved(pa.Table.from_batches([*held, b.slice(0, begins[-1])]))
                held = []
            elif len(begins) > 1:
                yield from solved(pa.Table.from_batches([b.slice(0, begins[-1])]))
            held.append(b.slice(begins[-1]) if len(begins) else b)
        if held:
            yield from solved(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "video_id long, kind string, current double, saved double")


def downsample(series: DataFrame, columns: int, value: str = "score") -> DataFrame:
    """video_id, bucket, value: the largest value of the frames that share a screen column."""
    w = Window.partitionBy("video_id").orderBy("frame")
    placed = series.withColumn("__k", F.row_number().over(w) - 1).join(series.groupBy("video_id").agg(F.count("*").alias("__n")), "video_id")
    bucket = F.floor(F.coalesce(F.try_divide(F.col("__k").cast("double"), (F.col("__n") - 1).cast("double")), F.lit(0.0)) * (columns - 1)).cast("long")
    return placed.groupBy("video_id", bucket.alias("bucket")).agg(F.max(value).alias(value))


def recent(snapshots: DataFrame, most: int = 8) -> DataFrame:
    """The most recent snapshots (id, saved_at, …), one for each id, newest first."""
    latest = Window.partitionBy("id").orderBy(F.col("saved_at").desc())
    return snapshots.withColumn("__k", F.row_number().over(latest)).where("__k = 1").drop("__k").orderBy(F.col("saved_at").desc(), "id").limit(most)


def even_frames(start: Column, end: Column, count: int) -> Column:
    """Evenly spaced frames of a span, first and last included; an empty span gives its start."""
    last = F.greatest(end - 1, start)
    n = F.least(F.lit(count), last - start + 1)
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.when(n <= 1, start).otherwise(start + F.floor(k * (last - start) / (count - 1) + 0.5)).cast("long"))
    return F.array_distinct(spread)


def slider_to_threshold(position: Column, high: float, curve: float = 4.0) -> Column:
    """Threshold of a slider position in [0, 1] on a logarithmic scale, and back by threshold_to_slider."""
    return high * F.expm1(position * curve) / F.expm1(F.lit(curve))


def threshold_to_slider(threshold: Column, high: float, curve: float = 4.0) -> Column:
    return F.log1p(threshold / high * F.expm1(F.lit(curve))) / curve
