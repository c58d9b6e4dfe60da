"""Similar scenes by 64-bit fingerprints."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spans import containing

MAX_SCENES, MAX_PAIRS, BITS, MAX_SAMPLES = 1024, 48, 64, 200_000


def stride(fps: float) -> int:
    if not math.isfinite(fps) or fps <= 0:
        raise ValueError("fps must be finite and above 0")
    return min(max(math.ceil(fps), 1), 2**32 - 1)


def sampled(frames: DataFrame, fps: float) -> DataFrame:
    """Every stride-th frame; more than MAX_SAMPLES samples of a video or falling frame numbers are errors."""
    rows = frames.where(F.col("frame") % stride(fps) == 0)
    w = Window.partitionBy("video_id").orderBy("frame")
    rows = rows.withColumns({"__n": F.row_number().over(w), "__prev": F.lag("frame").over(w)})
    bad = (F.col("__n") > MAX_SAMPLES) | (F.col("__prev") == F.col("frame"))
    return rows.where(F.when(bad, F.raise_error(F.lit("too many or repeated samples")).cast("boolean")).otherwise(True)).drop("__n", "__prev")


def even_scenes(spans: DataFrame, limit: int = MAX_SCENES) -> DataFrame:
    """All scenes of a video, or limit of them spread evenly with both ends."""
    n = spans.groupBy("video_id").agg(F.count("*").alias("n"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda k: (F.floor(k * (F.col("n") - 1) / max(1, limit - 1)) + 1).cast("int"))
    picked = n.where(F.col("n") > limit).select("video_id", F.explode(F.array_distinct(slots)).alias("scene_number"))
    few = spans.join(n.where(F.col("n") <= limit), "video_id", "left_semi")
    return few.unionByName(spans.join(picked, ["video_id", "scene_number"], "left_semi"))


def scene_hashes(signatures: DataFrame, spans: DataFrame) -> DataFrame:
    """video_id, scene_number, hash (bitwise majority; a tie takes the first frame's bit), samples."""
    rows = containing(signatures.select("video_id", "frame", "hash"), spans, "frame").where("scene_number is not null")
    ones = [F.sum(F.shiftrightunsigned("hash", k).bitwiseAND(F.lit(1).cast("long"))) for k in range(BITS)]
    counted = rows.groupBy("video_id", "scene_number").agg(F.count("*").alias("samples"), F.min_by("hash", "frame").alias("first"), F.array(*ones).alias("ones"))
    one = F.lit(1).cast("long")
    shift = lambda name, value, k: F.call_function(name, value, k)

    def with_bit(value, votes, k):
        bit = F.when(2 * votes > F.col("samples"), one).when(2 * votes < F.col("samples"), F.lit(0).cast("long")).otherwise(shift("shiftrightunsigned", F.col("first"), k).bitwiseAND(one))
        return value.bitwiseOR(shift("shiftleft", bit, k))

    numbered = F.transform("ones", lambda votes, k: F.struct(votes.alias("votes"), k.alias("k")))
    value = F.aggregate(numbered, F.lit(0).cast("long"), lambda a, x: with_bit(a, x["votes"], x["k"]))
    return counted.select("video_id", "scene_number", value.alias("hash"), "samples")


def similar_pairs(hashes: DataFrame, most: int = MAX_PAIRS) -> DataFrame:
    """The most closest pairs of scenes of each video; hashes has at most MAX_SCENES scenes a video."""
    scene = F.struct("scene_number", "hash")
    listed = hashes.groupBy("video_id").agg(F.sort_array(F.collect_list(scene)).alias("scenes"))
    first = listed.select("video_id", "scenes", F.posexplode("scenes").alias("k", "a"))
    pairs = first.select("video_id", "a", F.explode(F.slice("scenes", F.col("k") + 2, F.size("scenes"))).alias("b"))
    distance = F.bit_count(F.col("a.hash").bitwiseXOR(F.col("b.hash"))).cast("int")
    pairs = pairs.select("video_id", F.col("a.scene_number").alias("first_scene"), F.col("b.scene_number").alias("second_scene"), distance.alias("distance"))
    order = Window.partitionBy("video_id").orderBy("distance", "first_scene", "second_scene")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).withColumn("similarity", 1.0 - F.col("distance") / BITS)


def similarity_report(signatures: DataFrame, spans: DataFrame, limit: int = MAX_SCENES) -> DataFrame:
    """video_id with counts of scenes: total, selected, considered, without fingerprint; and whether some were left out."""
    chosen = even_scenes(spans, limit)
    known = scene_hashes(signatures, chosen).groupBy("video_id").agg(F.count("*").alias("considered"))
    counts = spans.groupBy("video_id").agg(F.count("*").alias("total_scenes")).join(chosen.groupBy("video_id").agg(F.count("*").alias("selected_scenes")), "video_id").join(known, "video_id", "left")
    return counts.select("video_id", "total_scenes", "selected_scenes", F.coalesce("considered", F.lit(0)).alias("considered_scenes"), (F.col("selected_scenes") - F.coalesce("considered", F.lit(0))).alias("without_fingerprint"), (F.col("total_scenes") > F.col("selected_scenes")).alias("truncated"))


def report_pairs(pairs: DataFrame, minimum: float, most: int = 16) -> DataFrame:
    """The first most pairs of each video that are similar enough; pairs are ranked by similarity."""
    return pairs.where((F.col("similarity") >= minimum) & (F.col("rank") <= most)).orderBy("video_id", "rank")


def pair_scenes(pairs: DataFrame, scenes: DataFrame) -> DataFrame:
    """pairs (…, number, start) with the scene of that number if it starts there, else the scene that starts there."""
    by_number = scenes.select("video_id", F.col("scene_number").alias("number"), F.col("start").alias("__s"), F.struct("scene_number", "start", "end").alias("__n"))
    by_start = scenes.select("video_id", F.col("start"), F.struct("scene_number", "start", "end").alias("__a"))
    rows = pairs.join(by_number, ["video_id", "number"], "left").join(by_start, ["video_id", "start"], "left")
    return rows.withColumn("scene", F.coalesce(F.when(F.col("__s") == F.col("start"), F.col("__n")), F.col("__a"))).drop("__s", "__n", "__a")
