"""Windows and folds over long videos, two levels deep.

Rows are dealt by (video, chunk of CHUNK frames).  A chunk hands on a few values, which meet those of the video's other
chunks in one window or fold; what that gives returns to the chunk's rows.  So no task sorts or holds a whole video, only
one short row for each of its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def dealt(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """rows with __chunk, all of a chunk in one task."""
    return rows.withColumn("__chunk", F.floor(F.col("frame") / chunk)).repartition("video_id", "__chunk")


def by_chunk() -> Window:
    """The chunks of a video in order."""
    return Window.partitionBy("video_id").orderBy("__chunk")


def in_chunk() -> Window:
    """The rows of a chunk in order."""
    return Window.partitionBy("video_id", "__chunk").orderBy("frame")


def handed_on(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """Dealt rows with what carried (video_id, __chunk, …) holds for their chunk.

    Null-safe, so that no filter goes below only one side and both keep sharing the shuffle.
    """
    carried = carried.withColumnsRenamed({"video_id": "__video", "__chunk": "__of"})
    return rows.join(carried, F.col("video_id").eqNullSafe(F.col("__video")) & F.col("__chunk").eqNullSafe(F.col("__of")), "left").drop("__video", "__of")


def with_next(rows: DataFrame, column: str, chunk: int = CHUNK) -> DataFrame:
    """rows with next_<column> of the row after in frame order; null for a video's last row."""
    found = dealt(rows, chunk)
    firsts = found.groupBy("video_id", "__chunk").agg(F.min_by(F.struct(column), "frame").alias("__first"))
    carried = firsts.select("video_id", "__chunk", F.lead("__first").over(by_chunk()).alias("__first"))
    inside = F.lead(F.struct(column)).over(in_chunk())
    joined = handed_on(found.withColumn("__next", inside), carried)
    return joined.withColumn(f"next_{column}", F.coalesce("__next", "__first")[column]).drop("__chunk", "__next", "__first")


def with_last_known(rows: DataFrame, column: str, default, chunk: int = CHUNK) -> DataFrame:
    """rows with state, column's last value that isn't null (default before the first), and before, the previous row's state.

    before is null for a video's first row.
    """
    found = dealt(rows, chunk)
    ends = found.groupBy("video_id", "__chunk").agg(F.max(F.when(F.col(column).isNotNull(), F.struct("frame", column)))[column].alias("__end"))
    earlier = by_chunk().rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("video_id", "__chunk", F.when(F.count(F.lit(1)).over(earlier) > 0, F.coalesce(F.last("__end", ignorenulls=True).over(earlier), F.lit(default))).alias("__entry"))
    within = found.withColumn("__seen", F.last(column, ignorenulls=True).over(in_chunk().rowsBetween(Window.unboundedPreceding, 0))).withColumns({"__lag": F.lag("__seen").over(in_chunk()), "__n": F.row_number().over(in_chunk())})
    joined = handed_on(within, carried)
    state = lambda seen: F.coalesce(seen, "__entry", F.lit(default))
    return joined.withColumns({"state": state("__seen"), "before": F.when(F.col("__n") == 1, F.col("__entry")).otherwise(state("__lag"))}).drop("__chunk", "__seen", "__lag", "__n", "__entry")


def numbered(rows: DataFrame, name: str, chunk: int = CHUNK) -> DataFrame:
    """rows with their number in frame order, from 1."""
    found = dealt(rows, chunk)
    counts = found.groupBy("video_id", "__chunk").agg(F.count("*").alias("__rows"))
    carried = counts.select("video_id", "__chunk", F.coalesce(F.sum("__rows").over(by_chunk().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__below"))
    joined = handed_on(found.withColumn("__n", F.row_number().over(in_chunk())), carried)
    return joined.withColumn(name, (F.col("__below") + F.col("__n")).cast("int")).drop("__chunk", "__n", "__below")


def spaced(candidates: DataFrame, m: int, base: Column, chunk: int = CHUNK) -> DataFrame:
    """video_id, frame of the candidates that lie m or more after the last one taken (after base, before the first).

    Whatever was taken before a chunk, the first taken in it is one of its first m frames or the next candidate after
    these.  So each chunk tells for each such start where it ends, a fold over a video's chunks picks the
    starts, and each chunk is walked once more from its own.
    """
    size = max(chunk, m)
    found = candidates.groupBy("video_id", F.floor(F.col("frame") / size).alias("__chunk")).agg(F.array_sort(F.collect_set("frame")).alias("frames"), F.min(base.cast("long")).alias("base"))
    border = F.greatest(F.col("__chunk") * size, F.col("base")) + m
    starts = F.concat(F.filter("frames", lambda f: f < border), F.slice(F.filter("frames", lambda f: f >= border), 1, 1))
    end_of = lambda s: F.aggregate("frames", s, lambda last, f: F.when(f - last >= m, f).otherwise(last))
    steps = F.transform(starts, lambda s: F.struct(s.alias("start"), end_of(s).alias("end")))
    videos = found.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("__chunk", steps.alias("steps")))).alias("chunks"), F.min("base").alias("base"))
    taken = lambda c, last: F.get(F.filter(c["steps"], lambda s: s["start"] - last >= m), F.lit(0))["end"]
    none = F.array().cast("array<struct<__chunk:bigint,entry:bigint>>")
    entries = F.aggregate("chunks", F.struct(F.col("base").alias("last"), none.alias("entries")), lambda a, c: F.struct(F.coalesce(taken(c, a["last"]), a["last"]).alias("last"), F.concat(a["entries"], F.array(F.struct(c["__chunk"].alias("__chunk"), a["last"].alias("entry")))).alias("entries")), lambda a: a["entries"])
    entered = videos.select("video_id", F.explode(entries).alias("e")).select("video_id", "e.__chunk", "e.entry")
    start = F.struct(F.col("entry").alias("last"), F.array().cast("array<bigint>").alias("kept"))
    kept = F.aggregate("frames", start, lambda a, f: F.when(f - a["last"] >= m, F.struct(f.alias("last"), F.concat(a["kept"], F.array(f)).alias("kept"))).otherwise(a), lambda a: a["kept"])
    return found.join(entered, ["video_id", "__chunk"]).select("video_id", F.explode(kept).alias("frame"))


def ranked_by(rows: DataFrame, value: str, name: str, pieces: int = 64, chunk: int = CHUNK) -> DataFrame:
    """rows with their number by (value, frame) within a video, from 1.

    Approximate quantiles of a video cut its values into pieces; the pieces' exact counts put each where it belongs.  A
    value that many rows share is itself a cut: its rows are a piece of their own, in order of frames, and so dealt by chunks.
    """
    cuts = rows.groupBy("video_id").agg(F.array_distinct(F.percentile_approx(value, F.array(*(F.lit(k / pieces) for k in range(1, pieces))), F.lit(10_000))).alias("__cuts"))
    of = F.col(value)
    below = F.size(F.filter("__cuts", lambda c: c < of))
    equal = F.exists("__cuts", lambda c: c == of)
    placed = rows.join(cuts, "video_id").withColumns({"__piece": 2 * below + equal.cast("int"), "__chunk": F.when(equal, F.floor(F.col("frame") / chunk)).otherwise(0)}).drop("__cuts")
    placed = placed.repartition("video_id", "__piece", "__chunk")
    counts = placed.groupBy("video_id", "__piece", "__chunk").agg(F.count("*").alias("__rows"))
    order = Window.partitionBy("video_id").orderBy("__piece", "__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select("video_id", "__piece", "__chunk", F.coalesce(F.sum("__rows").over(order), F.lit(0)).alias("__below"))
    inside = placed.withColumn("__n", F.row_number().over(Window.partitionBy("video_id", "__piece", "__chunk").orderBy(value, "frame")))
    joined = inside.join(carried, ["video_id", "__piece", "__chunk"])
    return joined.withColumn(name, (F.col("__below") + F.col("__n")).cast("int")).drop("__piece", "__chunk", "__n", "__below")
