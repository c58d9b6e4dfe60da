"""The total order of doubles: -0.0 stands below 0.0, and what is no number last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total_key(x: Column) -> Column:
    """What sorts doubles in total order, for orderBy and array_sort.

    Spark itself takes both zeros as equal; only their text tells them apart.  Spark keeps no sign of NaN.
    """
    x = x.cast("double")
    return F.struct(x.alias("value"), F.when(x == 0, ~F.startswith(x.cast("string"), F.lit("-"))).alias("side"))


def total_sort(values: Column) -> Column:
    """An array of doubles in total order, nulls at its end."""
    keyed = F.transform(values, lambda x: F.when(x.isNotNull(), total_key(x)))
    return F.transform(F.array_sort(keyed), lambda k: k["value"])


def total_median(values: Column) -> Column:
    """The middle of an array of doubles in total order, or the mean of its two middle ones; nulls don't count."""
    known = total_sort(F.filter(values, lambda x: x.isNotNull()))
    half = F.floor(F.size(known) / 2).cast("int")
    at = lambda k: F.get(known, k)
    return F.when(F.size(known) == 0, F.lit(None).cast("double")).when(F.size(known) % 2 == 1, at(half)).otherwise((at(half - 1) + at(half)) / 2)
