"""Line dedup by distinct-site spread, in DataFrame functions only.

A line (without outer white space) that stands on at least ``min_sites`` distinct sites is
boilerplate: every occurrence but the first (smallest id, then earliest line) is removed, so no
content leaves the corpus altogether.

1. The lines of all texts are written once, as keys of 128 bits; all that follows reads this table.
2. One aggregation per line keeps the smallest and largest site hash, with map-side combine: a
   line with two different ones spans sites, and only such lines go on.
3. HyperLogLog sketches of their sites merge by aggregation.  An estimate well above the
   threshold decides; one near the threshold is replaced by an exact distinct count.
4. The boilerplate lines meet the occurrences again; what they remove comes back per text.

Wherever lines meet occurrences, the most frequent ones are broadcast, a fixed number of them, so no line's occurrences
gather in one task.

Defined results: a null text has no lines and stays null; empty lines stay, and a line
of any other length counts; a text of any length is split whole; a null site counts as a site of its own;
among rows of one id the earliest line is first; repeated rows are removed alike; an empty table
gives no rows; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, heavy_join, text_keys
from .spans import bound, upto

MIN_SITES = 10
#: log2 of the sketch's buckets: a relative error of about 1.04 / 2^(LG_K / 2).
LG_K = 12
#: Lines of a text whose removal is looked up at once.
CHUNK = 256
#: Estimates within this share of the threshold are counted exactly: over six times the error.
NEAR = 0.1


LINE = ["__l1", "__l2"]


def _occurrences(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """__id, __k1, __k2 (of the text), __site, __pos and the line's two keys, for every line that isn't empty."""
    parts = F.split(F.col(text_col), "\n", -1)
    line = F.trim(F.col("x"), F.lit(" \t\r\x0b\x0c"))
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.lit(1), F.col(site_col)).alias("__site"), *text_keys(F.col(text_col)), F.posexplode(parts).alias("__pos", "x")).withColumn("x", line)
    return rows.where("x <> ''").select("__id", "__k1", "__k2", "__site", "__pos", F.xxhash64("x").alias("__l1"), F.xxhash64(F.lit(7), "x").alias("__l2"))


def _of(occ: DataFrame, lines: DataFrame) -> DataFrame:
    """The occurrences of the lines (keys, n occurrences, others), with the others; frequent lines are dealt over all tasks."""
    return heavy_join(occ, cut(lines.withColumn("__in", F.lit(True))), LINE, "n").where("__in").drop("__in")


def _boilerplate(occ: DataFrame, min_sites: int) -> DataFrame:
    """Keys, first occurrence (id, position) and number of occurrences n of the lines on at least min_sites sites."""
    wide = occ.groupBy(*LINE).agg(F.min("__site").alias("lo"), F.max("__site").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select(*LINE, "n")
    place = F.struct(F.col("__id").isNull().alias("null"), F.col("__id").alias("id"), F.col("__pos").alias("pos"))
    spread = cut(_of(occ, wide).groupBy(*LINE).agg(F.hll_sketch_estimate(F.hll_sketch_agg("__site", F.lit(LG_K))).alias("estimate"), F.min(place).alias("first"), F.count("*").alias("n")))
    sure = spread.where(F.col("estimate") > min_sites * (1 + NEAR) + 1).select(*LINE, "first", "n")
    near = spread.where(F.col("estimate").between(min_sites * (1 - NEAR) - 1, min_sites * (1 + NEAR) + 1)).select(*LINE, "first", "n")
    exact = _of(occ, near.select(*LINE, "n")).select(*LINE, "__site").distinct().groupBy(*LINE).agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.union(near.join(exact.select(*LINE), LINE, "left_semi"))


def _removed(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int) -> DataFrame:
    """__id, __k1, __k2 (of the text) and gone, the positions of its lines that go."""
    occ = cut(_occurrences(docs, id_col, text_col, site_col))
    hit = _of(occ, _boilerplate(occ, min_sites)).where(~(F.col("__id").eqNullSafe(F.col("first.id")) & (F.col("__pos") == F.col("first.pos"))))
    return hit.groupBy("__id", "__k1", "__k2").agg(F.collect_set("__pos").alias("__gone"))


def _clean(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int) -> DataFrame:
    """docs with __gone (null where nothing goes) and __clean."""
    gone = cut(_removed(docs, id_col, text_col, site_col, min_sites)).withColumnsRenamed({"__k1": "__g1", "__k2": "__g2"})
    k1, k2 = text_keys(F.col(text_col))
    keyed = docs.select("*", k1, k2)
    joined = keyed.join(gone, (F.col("__k1") == F.col("__g1")) & (F.col("__k2") == F.col("__g2")) & F.col(id_col).eqNullSafe(F.col("__id")), "left")
    # Positions are looked up among those of their chunk, so that work grows with the lines, not their square.
    chunks = F.transform(upto(F.ceil((F.array_max("__gone") + 1) / CHUNK)), lambda c: F.filter("__gone", lambda g: F.floor(g / CHUNK) == c))
    goes = lambda found, i: F.coalesce(F.array_contains(F.get(found, F.floor(i / CHUNK).cast("int")), i), F.lit(False))
    kept = bound(chunks, lambda found: F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~goes(found, i)))
    clean = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("__clean", clean)


def line_report(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """id_col, n_lines, n_removed and clean_text for each row of docs."""
    return _clean(docs.select(id_col, text_col, site_col), id_col, text_col, site_col, min_sites).select(
        id_col,
        F.coalesce(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("__clean", F.lit("")).alias("clean_text"),
    )


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with the boilerplate lines taken out of text_col; columns and rows stay."""
    others = F.struct(*(c for c in docs.columns if c != text_col))
    bare = docs.select(others.alias("others"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(site_col).alias("site"))
    out = _clean(bare, "id", "text", "site", min_sites)
    return out.select(*(F.col("__clean").alias(c) if c == text_col else F.col("others").getField(c).alias(c) for c in docs.columns))
