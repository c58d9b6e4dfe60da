"""Filter interaction audit: what each order of five filters keeps, removes and wastes, by part of the corpus.

A document's failures are one five-bit mask, worked out by built-in functions; the smallest id of every text comes
from grouping by the text (its SHA-256).  A part then is a histogram of 32 masks, with the documents labelled good
and toxic in each, and all 120 orders of the filters are read off these 32 cells: texts are looked at once, whatever
the number of orders.

Filters: A, too few words; B, too few distinct words; C, too many capitals (A-Z); D, any of the marks; E, the text of
a smaller id.

Defined results: a null or empty text has no word, so it fails A only (and E beside another one, as null and empty are
the same text); a long text is judged whole; rows of one id are judged each by itself, and none of them repeats
another; a row without id is never first of its text, nor a repeat, and has no label; a document is good or toxic if any
of its labels says so; a null part is the empty string; an empty table gives no rows; an empty labels table or null
labels lose nothing; extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, heavy_join

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
MIN_WORDS = 100
#: Distinct words in a hundred, at least.
MIN_DISTINCT = 80
#: Capitals in a hundred code points, at most.
MAX_CAPITALS = 10
MARKS = r"[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """Bits 0 to 3: the text fails A, B, C, D."""
    words = F.array_remove(F.split(text, SPACES), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    tests = [n < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * F.length(text), text.rlike(MARKS)]
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc, part, mask of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), failures(text).alias("mask"))
    rows = cut(rows)
    firsts = rows.groupBy("key").agg(F.min("doc").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    seen = heavy_join(rows, cut(firsts), ["key"], "copies")
    return seen.select("doc", "part", (F.col("mask") + F.when(F.col("doc") > F.col("first"), 1 << 4).otherwise(0)).alias("mask"))


def cells(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic for (doc, part, mask) rows: 32 cells a part at most."""
    marks = labels.groupBy(F.col(id_col).alias("doc")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    counted = rows.where("doc is not null").join(marks.where("doc is not null"), "doc", "left").select("part", "mask", "good", "toxic")
    alone = rows.where("doc is null").select("part", "mask", F.lit(None).cast("long").alias("good"), F.lit(None).cast("long").alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return counted.unionByName(alone).groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def orders(histogram: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of every order of the filters, from (part, mask, n, good, toxic)."""
    parts = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    plan = [(order, k + 1, 1 << FILTERS.index(order[k]), sum(1 << FILTERS.index(f) for f in order[:k])) for order in ORDERS for k in range(len(order))]
    steps = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "own", "earlier"), p, strict=True)) for p in plan])), "array<struct<filter_order string, step int, own int, earlier int>>")
    rows = parts.select("part", "cells", F.explode(steps).alias("s")).select("part", "cells", "s.*")

    def total(what, where) -> Column:
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda a, c: a + what(c))

    fails = lambda c: c["mask"].bitwiseAND(F.col("own")) != 0
    passed = lambda c: c["mask"].bitwiseAND(F.col("earlier")) == 0
    removed = lambda c: fails(c) & passed(c)
    return rows.select(
        "part", "filter_order", "step",
        total(lambda c: c["n"], lambda c: ~fails(c) & passed(c)).alias("kept"),
        total(lambda c: c["n"], removed).alias("removed"),
        total(lambda c: c["n"], lambda c: fails(c) & ~passed(c)).alias("redundant"),
        total(lambda c: c["n"], lambda c: c["mask"] == F.col("own")).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"),
        total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        # Of the orders, one in as many as a document has failures tests this filter before its other ones.
        total(lambda c: c["n"] * F.floor(F.lit(len(ORDERS)) / F.bit_count(c["mask"])), fails).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step of it, zeros included."""
    return orders(cells(masks(docs, id_col, text_col, part_col), labels, id_col))
