"""Detected boundaries against reference ones, parity of scene lists, benchmark tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


class Matching:
    """Ordered one-to-one matching of one part: most pairs, then least total delta, by a banded table.

    A reference boundary meets only the candidates within the tolerance, so row i keeps the scores of its candidates'
    places low[i] to high[i]; left of them a row equals the one above, right of them its last score goes on.  A score is
    pairs * UNIT - delta.  Of equally good choices a match comes first, then leaving out the reference, then the candidate.
    """

    def __init__(self, reference: list[int], candidate: list[int], tolerance: int):
        self.reference, self.candidate, self.tolerance = reference, candidate, tolerance
        unit = 1 + tolerance * (len(reference) + 1)
        self.low, self.high, self.score = [0], [0], [[0]]
        lo = hi = 0
        for frame in reference:
            while lo < len(candidate) and candidate[lo] < frame - tolerance:
                lo += 1
            hi = max(hi, lo)
            while hi < len(candidate) and candidate[hi] <= frame + tolerance:
                hi += 1
            row = [self.at(len(self.score) - 1, lo)]
            for j in range(lo + 1, hi + 1):
                match = self.at(len(self.score) - 1, j - 1) + unit - abs(candidate[j - 1] - frame)
                row.append(max(match, self.at(len(self.score) - 1, j), row[-1]))
            self.low.append(lo)
            self.high.append(hi)
            self.score.append(row)
        self.unit = unit

    def at(self, i: int, j: int) -> int:
        """The best score of the first i references with the first j candidates, for j from low[i] on."""
        return self.score[i][min(j, self.high[i]) - self.low[i]]

    def pairs(self, more: bool) -> tuple[list[tuple[int | None, int | None]], bool]:
        """The pairs in order, None for unmatched; and whether candidates are left when the references have run out.

        more: whether later parts have left over candidates, whose turn would come before that of this part's.
        """
        i, j, out = len(self.reference), len(self.candidate), []
        while more and i and self.at(i - 1, j) == self.at(i, j):
            i -= 1
            out.append((self.reference[i], None))
        more = more and not i
        while i and j:
            now = self.at(i, j) if j >= self.low[i] else None
            if self.low[i] < j <= self.high[i] and now == self.at(i - 1, j - 1) + self.unit - abs(self.candidate[j - 1] - self.reference[i - 1]):
                i, j = i - 1, j - 1
                out.append((self.reference[i], self.candidate[j]))
            elif j <= self.low[i] or now == self.at(i - 1, j):
                i -= 1
                out.append((self.reference[i], None))
            else:
                j -= 1
                out.append((None, self.candidate[j]))
        left = more or j > 0
        out += [(None, c) for c in reversed(self.candidate[:j])] + [(r, None) for r in reversed(self.reference[:i])]
        return out[::-1], left


def matches(reference: DataFrame, candidate: DataFrame, tolerance: int) -> DataFrame:
    """case_id, kind (match, false_positive, false_negative), reference_frame, candidate_frame, delta.

    Boundaries of (case_id, frame).  No match crosses a gap above the tolerance, so cases fall into
    parts there, each solved by itself.  Among equally good matchings a part's choice depends on one thing of
    the later parts: whether they leave over a candidate.  So each part is solved for both answers, and the answers
    are settled from each case's end, with one row a part.
    """
    rows = reference.select("case_id", "frame", F.lit(0).alias("side")).unionByName(candidate.select("case_id", "frame", F.lit(1).alias("side")))
    w = Window.partitionBy("case_id").orderBy("frame", "side")
    parted = rows.withColumn("new", F.coalesce((F.col("frame") - F.lag("frame").over(w) > tolerance).cast("int"), F.lit(1))).withColumn("part", F.sum("new").over(w))

    def run(key, table):
        sides = [sorted(f for f, s in zip(table.column("frame").to_pylist(), table.column("side").to_pylist(), strict=True) if s == side) for side in (0, 1)]
        solved = Matching(*sides, tolerance)
        (plain, left), (other, left_of_other) = solved.pairs(False), solved.pairs(True)
        found = [(None, *p) for p in plain] if plain == other else [(False, *p) for p in plain] + [(True, *p) for p in other]
        n = len(found)
        kinds = ["match" if a is not None and b is not None else "false_negative" if b is None else "false_positive" for _, a, b in found]
        columns = [pa.array([key[0].as_py()] * n, pa.string()), pa.array([key[1].as_py()] * n, pa.int64()), pa.array([f[0] for f in found], pa.bool_()), pa.array([left] * n), pa.array([left_of_other] * n), pa.array(kinds, pa.string())]
        columns += [pa.array([f[k] for f in found], pa.int64()) for k in (1, 2)]
        return pa.table(dict(zip(("case_id", "part", "more", "left", "left_of_other", "kind", "reference_frame", "candidate_frame"), columns, strict=True)))

    schema = "case_id string, part long, more boolean, left boolean, left_of_other boolean, kind string, reference_frame long, candidate_frame long"
    found = cut(parted.select(F.col("case_id").cast("string").alias("case_id"), "part", F.col("frame").cast("long").alias("frame"), "side").groupBy("case_id", "part").applyInArrow(run, schema))
    choice = found.groupBy("case_id", "part").agg(F.first("left").alias("left"), F.first("left_of_other").alias("left_of_other"))
    # From the end: the nearest later part whose answer is the same for both, turned once for each part between that turns it.
    later = Window.partitionBy("case_id").orderBy(F.desc("part"))
    before = later.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("left") == F.col("left_of_other"), F.col("left"))
    turns = F.sum((F.col("left") & ~F.col("left_of_other")).cast("int")).over(later)
    seen = choice.select("case_id", "part", turns.alias("turns"), fixed.alias("fixed"))
    since = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns")), ignorenulls=True).over(before)
    total = F.coalesce(F.lag("turns").over(later), F.lit(0)) - F.coalesce(since["turns"], F.lit(0))
    settled = seen.select("case_id", "part", (F.coalesce(since["fixed"], F.lit(False)) != (total % 2 == 1)).alias("answer"))
    kept = found.join(settled, ["case_id", "part"]).where("more is null or more = answer")
    return kept.select("case_id", "kind", "reference_frame", "candidate_frame", (F.col("candidate_frame") - F.col("reference_frame")).alias("delta"))


def case_metrics(found: DataFrame) -> DataFrame:
    """Counts and delta statistics of each case; 0 where nothing matched."""
    kind = lambda k: F.count(F.when(F.col("kind") == k, 1))
    n = kind("match")
    return found.groupBy("case_id").agg(
        (n + kind("false_negative")).alias("reference_boundaries"),
        (n + kind("false_positive")).alias("candidate_boundaries"),
        n.alias("matched_boundaries"),
        kind("false_positive").alias("false_positives"),
        kind("false_negative").alias("false_negatives"),
        F.coalesce(F.max(F.abs("delta")), F.lit(0)).alias("max_absolute_delta"),
        F.coalesce(F.avg(F.abs("delta")), F.lit(0.0)).alias("mean_absolute_delta"),
    )


def quality_totals(metrics: DataFrame) -> DataFrame:
    sums = ["reference_boundaries", "candidate_boundaries", "matched_boundaries", "false_positives", "false_negatives"]
    return metrics.agg(F.count("*").alias("cases"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums))


def worst_divergences(found: DataFrame, most: int = 10) -> DataFrame:
    """The gravest differences: unmatched boundaries first, then by delta; ties by case, false negatives first, and frame."""
    order = F.when(F.col("kind") == "false_negative", 0).when(F.col("kind") == "false_positive", 1).otherwise(2)
    rows = found.where((F.col("kind") != "match") | (F.col("delta") != 0)).select(
        "case_id",
        F.when(F.col("kind") == "match", "frame_delta").otherwise(F.col("kind")).alias("kind"),
        F.coalesce("reference_frame", "candidate_frame").alias("frame"),
        F.coalesce(F.abs("delta"), F.lit(0)).alias("absolute_delta"),
        F.when(F.col("kind") == "match", 1).otherwise(2).alias("severity"),
        order.alias("seq"),
    )
    return rows.orderBy(F.col("severity").desc(), F.col("absolute_delta").desc(), "case_id", "seq", "frame").limit(most).drop("seq")


def select_cases(cases: DataFrame, ids: list[str] | None = None, detectors: list[str] | None = None) -> DataFrame:
    """Enabled cases (id, detector, enabled) of the given ids and detectors; unknown values are errors."""
    for column, wanted in (("id", ids), ("detector", detectors)):
        if wanted:
            known = {r[0] for r in cases.where(F.col(column).isin(wanted)).select(column).distinct().collect()}
            if missing := set(wanted) - known:
                raise ValueError(f"unknown {column}: {', '.join(sorted(missing))}")
            cases = cases.where(F.col(column).isin(wanted))
    return cases.where("enabled")


def parity(expected: DataFrame, actual: DataFrame, tolerance: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Scenes (keys, scene, start, end) that differ by more than tolerance or stand on one side only; keys such as video_id."""
    e, a = expected.alias("e"), actual.alias("a")
    names = (*keys, "scene")
    both = e.join(a, [F.col(f"e.{c}") == F.col(f"a.{c}") for c in names], "full")
    off = lambda c: F.abs(F.col(f"e.{c}") - F.col(f"a.{c}"))
    rows = both.select(*(F.coalesce(f"e.{c}", f"a.{c}").alias(c) for c in names), off("start").alias("start_delta"), off("end").alias("end_delta"))
    return rows.where(F.col("start_delta").isNull() | (F.col("start_delta") > tolerance) | (F.col("end_delta") > tolerance))


def stale_fixtures(goldens: DataFrame, files: DataFrame) -> DataFrame:
    """Goldens (path, sha256) whose file (path, content) is gone or has another hash."""
    now = files.select("path", F.sha2("content", 256).alias("__now"))
    return goldens.join(now, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("__now"))).drop("__now")


def stale_metadata(goldens: DataFrame, expected: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """case_id, key, expected, observed where a golden says another thing than its case, or nothing.

    Both sides: case_id, metadata (map of texts).  What a case doesn't name may differ, but required keys must be there.
    A case without a golden differs in every key; goldens without a case don't count.
    """
    wanted = expected.select("case_id", F.explode("metadata").alias("key", "expected"), F.lit(False).alias("__any"))
    for key in required:
        wanted = wanted.unionByName(expected.where(~F.map_contains_key("metadata", F.lit(key))).select("case_id", F.lit(key).alias("key"), F.lit(None).cast("string").alias("expected"), F.lit(True).alias("__any")))
    found = wanted.join(goldens.select("case_id", F.col("metadata").alias("__is")), "case_id", "left")
    rows = found.withColumn("observed", F.element_at("__is", F.col("key"))).drop("__is")
    differs = F.when(F.col("__any"), F.col("observed").isNull()).otherwise(~F.col("expected").eqNullSafe(F.col("observed")))
    return rows.where(differs).drop("__any")


def bench_pairs(runs: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """id, reference, candidate, ratio, winner from runs (label "<case> <kind>", mean).

    A repeated or missing kind is an error; ratio is reference / candidate (infinite if only the
    candidate is 0, 0 if both are).  cases (id, …) adds its columns.
    """
    parted = runs.select(F.regexp_extract("label", r"^(.*) (\S+)$", 1).alias("id"), F.regexp_extract("label", r"^(.*) (\S+)$", 2).alias("kind"), "mean")
    of = lambda k, f: f(F.when(F.col("kind") == k, F.col("mean")))
    paired = parted.groupBy("id").agg(of("reference", F.count).alias("__r"), of("candidate", F.count).alias("__c"), F.count("*").alias("__n"), of("reference", F.max).alias("reference"), of("candidate", F.max).alias("candidate"))
    bad = (F.col("__r") != 1) | (F.col("__c") != 1) | (F.col("__n") != 2)
    good = paired.where(F.when(bad, F.raise_error(F.concat(F.lit("incomplete or repeated runs of "), F.col("id"))).cast("boolean")).otherwise(True))
    ratio = F.when(F.col("candidate") > 0, F.col("reference") / F.col("candidate")).when(F.col("reference") > 0, F.lit(float("inf"))).otherwise(0.0)
    out = good.select("id", "reference", "candidate", ratio.alias("ratio"), F.when(F.col("candidate") < F.col("reference"), "candidate").when(F.col("candidate") > F.col("reference"), "reference").otherwise("tie").alias("winner"))
    return (out.join(cases, "id") if cases is not None else out).orderBy("id")


def bench_view(pairs: DataFrame, corpus: list[str]) -> DataFrame:
    """pairs (id, corpus, ratio) in corpus order with a label of the ratio."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, corpus)), F.col("corpus")), F.lit(0))
    label = F.when(F.col("ratio") > 1, F.concat(F.round("ratio", 2).cast("string"), F.lit("× faster"))).when(F.col("ratio") == 1, F.lit("tie")).otherwise(F.concat(F.round(1 / F.col("ratio"), 2).cast("string"), F.lit("× slower")))
    return pairs.withColumn("label", label).orderBy(F.when(rank == 0, len(corpus) + 1).otherwise(rank), "id")


def snapshot(metrics: DataFrame, private: list[str]) -> DataFrame:
    """metrics without private columns, for publication."""
    return metrics.drop(*private)
