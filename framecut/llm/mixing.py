"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Sizes are words.  Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share
SHARE of all sizes; a target stops at CAP times its source's size and the excess goes to the
others by weight.  This has a closed form: target = min(cap, level * weight), with one level.

A document's fractional copies are target / source size.  Its whole copies are taken; the rest
is a probability.  Pivotal rounding pairs two fractional documents of a source and moves mass
(size times probability) between them at random, so that one becomes 0 or 1, the expected
values stay and the source's sum stays.  Blocks of about BLOCK documents are folded at once; the
one residual of each block goes on to the next level of the tree, so no source meets in one task.
The last residual of a source is taken in part (that many words), which meets the target to
within one word; every other document is taken 0, 1 or 2 times.

Defined results: null text and text without words have size 0 and are taken 0 times; a null
source is a source; rows with one id are separate rows, in whatever sources; rows equal in source, id
and text share one draw; equal inputs give equal draws (hashes of id, text and SEED), and documents
of equal order hash are paired by key; a text of any length counts whole; an empty table gives no
rows; extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK = 256
SEED = 20240229
#: Probabilities this close to 0 or 1 count as integral.
EPSILON = 1e-9


def words_of(text):
    """Number of runs of characters other than space and \\t-\\r."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """__source, source_size, target for (__source, source_size); one row for each source."""
    order = Window.orderBy(F.col("__source").isNull(), F.col("__source"))
    weighted = sources.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double"))
    weighted = weighted.withColumn("cap", F.lit(float(CAP)) * F.col("source_size"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("__source").isNull(), F.col("__source"))
    filled = weighted.withColumns(
        {
            "goal": SHARE * F.sum("source_size").over(everything),
            "before_cap": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open_w": F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    # The level if exactly the sources before this one are full; the right one is the first that this source's cap allows.
    level = (F.col("goal") - F.col("before_cap")) / F.col("open_w")
    found = filled.withColumn("level", level).withColumn("fits", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")))
    first = F.first("fits", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return found.withColumn("final", first).select("__source", "source_size", F.least("cap", F.coalesce(F.col("final") * F.col("w"), F.col("cap"))).alias("target"))


#: One fold step.  acc: out (decided rows), key, size, p of the fractional row that is carried; x: the next row.
#: up: mass that can move from x to the carried row before one is integral; down: the other way.
_FOLD = f"""
aggregate(
  items,
  named_struct('out', cast(array() as array<struct<key: bigint, p: double>>), 'key', cast(null as bigint), 'size', 0L, 'p', 0D),
  (acc, x) -> CASE
    WHEN acc.key IS NULL THEN named_struct('out', acc.out, 'key', x.key, 'size', x.size, 'p', x.p)
    ELSE transform(
      array(named_struct('up', least((1 - acc.p) * acc.size, x.p * x.size), 'down', least(acc.p * acc.size, (1 - x.p) * x.size))),
      m -> transform(
        array(CASE WHEN pmod(xxhash64(acc.key, x.key, {SEED}L), 1048576) * (m.up + m.down) < m.down * 1048576D
          THEN named_struct('a', acc.p + m.up / acc.size, 'b', x.p - m.up / x.size)
          ELSE named_struct('a', acc.p - m.down / acc.size, 'b', x.p + m.down / x.size) END),
        n -> CASE
          WHEN n.a <= {EPSILON} OR n.a >= 1 - {EPSILON} THEN CASE
            WHEN n.b <= {EPSILON} OR n.b >= 1 - {EPSILON}
            THEN named_struct('out', concat(acc.out, array(named_struct('key', acc.key, 'p', rint(n.a)), named_struct('key', x.key, 'p', rint(n.b)))), 'key', cast(null as bigint), 'size', 0L, 'p', 0D)
            ELSE named_struct('out', concat(acc.out, array(named_struct('key', acc.key, 'p', rint(n.a)))), 'key', x.key, 'size', x.size, 'p', n.b) END
          ELSE named_struct('out', concat(acc.out, array(named_struct('key', x.key, 'p', rint(n.b)))), 'key', acc.key, 'size', acc.size, 'p', n.a) END
      )[0]
    )[0] END
)"""


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """id_col, source, size, source_size, target, taken for each row of docs (source under __source)."""
    rows = cut(docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), words_of(F.col(text_col)).alias("size"), F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col)).alias("__key")))
    per = rows.groupBy("__source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__n"))
    goal = cut(targets(per.select("__source", "source_size")).join(per.select(F.col("__source").alias("__s"), "__n"), F.col("__source").eqNullSafe(F.col("__s"))).select("__source", "source_size", "target", "__n"))
    goal = goal.withColumnRenamed("__source", "__s")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = rows.join(goal, F.col("__source").eqNullSafe(F.col("__s")), "left").withColumn("copies", copies)
    placed = placed.withColumn("whole", F.floor(F.col("copies") + EPSILON)).withColumn("p", F.greatest(F.col("copies") - F.col("whole"), F.lit(0.0)))

    # Equal rows (same id and text) are one unit of their joint size here, and share its draw below.
    fractional = placed.where((F.col("size") > 0) & (F.col("p") > EPSILON)).groupBy("__source", "__key").agg(F.sum("size").alias("size"), F.first("p").alias("p"), F.first("__n").alias("__n"))
    largest = goal.agg(F.max("__n")).first()[0] or 0
    open_, decided, level = fractional.select(source_key("__source").alias("s"), F.col("__key").alias("key"), "size", "p", F.col("__n").alias("n")), [], 0
    while True:
        blocks = F.ceil(F.col("n") / block)
        level += 1
        dealt = open_.withColumn("bucket", F.pmod(F.xxhash64(F.lit(level), "key"), F.greatest(blocks, F.lit(1))))
        groups = dealt.groupBy("s", "bucket").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(level + 1000), "key").alias("order"), "key", "size", "p"))).alias("items"))
        folded = cut(groups.select("s", F.ceil(F.col("n") / block).alias("n"), F.expr(_FOLD).alias("f")))
        decided.append(folded.select("s", F.explode("f.out").alias("x")).select("s", "x.key", "x.p"))
        open_ = folded.where("f.key is not null").select("s", "f.key", "f.size", "f.p", "n")
        largest = math.ceil(largest / block)
        if largest <= 1:
            break
    decided.append(open_.select("s", "key", "p"))
    chosen = decided[0]
    for d in decided[1:]:
        chosen = chosen.union(d)
    taken = F.col("whole") * F.col("size") + F.coalesce(F.round(F.col("draw") * F.col("size")), F.lit(0.0))
    drawn = placed.withColumn("s", source_key("__source")).join(chosen.select("s", F.col("key").alias("__key"), F.col("p").alias("draw")), ["s", "__key"], "left")
    return drawn.select(F.col("__id").alias(id_col), "__source", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("__key"))


def source_key(source):
    """A number of a source, null included."""
    return F.xxhash64(F.lit(3), source)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, with size, source_size, target and taken (columns of those names are replaced)."""
    new = ["size", "source_size", "target", "taken"]
    found = mix(docs, id_col, text_col, source_col).where("taken > 0").select(source_key("__source").alias("s"), F.col("__key").alias("key"), *new).dropDuplicates(["s", "key"])
    kept = [c for c in docs.columns if c not in new]
    keyed = docs.select(F.struct(*kept).alias("row"), source_key(source_col).alias("s"), F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col)).alias("key"))
    return keyed.join(found, ["s", "key"]).select(*(F.col("row").getField(c).alias(c) for c in kept), *new)
