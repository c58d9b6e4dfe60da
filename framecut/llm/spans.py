"""Spans of regular-expression matches as DataFrame expressions.

``split`` and ``regexp_extract_all`` walk a text alike, so the pieces between matches and the
matches themselves give every position, in code points, without leaving the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: left: up to CONTEXT characters before the match, through at most BACK earlier matches.
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,txt:string,left:string>>"
CONTEXT, BACK = 64, 8
#: Matches summed at once, and code points of a text that are searched for overlaps at once: work grows with the text, not its square.
CHUNK, BLOCK, BLOCKS = 256, 1024, 64


def bound(value: Column, function) -> Column:
    """function(value) where value is worked out once."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def upto(n: Column) -> Column:
    """The numbers 0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def running_sums(values: Column) -> Column:
    """The sum of each value of an array and those before it; CHUNK values are summed, then the sums of chunks."""
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))
    sums = lambda v: F.aggregate(v, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(last(a) + x)))
    inside = lambda v: F.transform(upto(F.ceil(F.size(v) / CHUNK)), lambda c: sums(F.slice(v, c * CHUNK + 1, F.lit(CHUNK))))
    shifted = lambda parts, ends: F.flatten(F.transform(parts, lambda v, c: F.transform(v, lambda x: x + F.coalesce(F.get(ends, c - 1), F.lit(0)))))
    return bound(bound(values, inside), lambda parts: bound(sums(F.transform(parts, last)), lambda ends: shifted(parts, ends)))


def find_spans(text: Column, regex: str, kind: str, rank: int, keep=None, context: bool = False, needs: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of regex in text, those for which keep(txt) holds; needs is false only where there is none."""
    parts = F.struct(F.split(text, regex, -1).alias("p"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("m"))

    def before(s, i):
        tail = lambda x: F.right(F.coalesce(x, F.lit("")), F.lit(CONTEXT))
        around = [tail(F.get(s[c], i - k)) for k in range(BACK, 0, -1) for c in ("p", "m")]
        return F.right(F.concat(*around, tail(F.get(s["p"], i))), F.lit(CONTEXT))

    def spans(s):
        lengths = F.transform(s["m"], lambda x, i: F.length(F.get(s["p"], i)) + F.length(x))
        return bound(running_sums(lengths), lambda ends: F.transform(s["m"], lambda x, i: span(s, ends, x, i)))

    def span(s, ends, x, i):
        end = F.get(ends, i)
        left = before(s, i) if context else F.lit("")
        return F.struct((end - F.length(x)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x.alias("txt"), left.alias("left"))

    found = bound(parts, spans).cast(SPAN)
    found = F.filter(found, lambda x: keep(x["txt"])) if keep else found
    return found if needs is None else F.when(needs, found).otherwise(F.array().cast(SPAN))


def in_blocks(spans: Column) -> Column:
    """For each BLOCK code points of a text, the spans that reach into them, as far as the last span."""
    reach = lambda found, low, high: F.filter(found, lambda x: (x["start"] < high) & (x["end"] > low))

    def fine(k):
        low = k * (BLOCK * BLOCKS)
        return bound(reach(spans, low, low + BLOCK * BLOCKS), lambda part: F.transform(upto(F.lit(BLOCKS)), lambda j: reach(part, low + j * BLOCK, low + (j + 1) * BLOCK)))

    last = F.aggregate(spans, F.lit(0), lambda a, x: F.greatest(a, x["end"]))
    return F.flatten(F.transform(upto(F.ceil(last / (BLOCK * BLOCKS))), fine))


def overlapping(x: Column, blocks: Column) -> Column:
    """Those spans of in_blocks() that overlap x, in the order of their array (one in several blocks several times)."""
    numbers = F.sequence(F.floor(x["start"] / BLOCK).cast("int"), F.floor((x["end"] - 1) / BLOCK).cast("int"))
    here = F.flatten(F.transform(numbers, lambda k: F.coalesce(F.get(blocks, k), F.array().cast(SPAN))))
    return F.filter(here, lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"]))


def outside(spans: Column, blocks: Column) -> Column:
    """The spans that overlap none of those of in_blocks()."""
    return F.filter(spans, lambda c: F.size(overlapping(c, blocks)) == 0)


def ordered(*groups: Column) -> Column:
    """All spans by start, then kind as listed, without texts."""
    bare = F.concat(*groups)
    return F.sort_array(F.transform(bare, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(spans: Column) -> Column:
    return F.sha2(joined(spans), 256)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
