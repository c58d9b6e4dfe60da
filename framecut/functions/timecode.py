"""Timecodes and rational times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def frames_of(text: Column, rate: Column) -> Column:
    """Frames of ``H:M:S``, ``<seconds>s`` or a frame number; null if it is none of them.

    Seconds become frames by rounding halves up; negative ones give 0.
    """
    parts = F.split(text, ":")
    number = lambda x: x.try_cast("double")
    clock = number(F.get(parts, F.lit(0))) * 3600 + number(F.get(parts, F.lit(1))) * 60 + number(F.get(parts, F.lit(2)))
    seconds = F.when(F.contains(text, F.lit(":")), F.when(F.size(parts) == 3, clock)).when(F.endswith(text, F.lit("s")), number(text.substr(F.lit(1), F.length(text) - 1)))
    rounded = F.when(F.isnan(seconds), 0).when(seconds.isNotNull(), F.greatest(F.lit(0.0), F.floor(seconds * rate + 0.5))).cast("long")
    plain = F.when(text.rlike("^[+]?[0-9]+$"), text.try_cast("long"))
    return F.when(F.contains(text, F.lit(":")) | F.endswith(text, F.lit("s")), rounded).otherwise(plain)


def clock(frames: int, rate: float) -> str:
    """HH:MM:SS.mmm of a frame; seconds aren't carried when they round up to 60."""
    total = frames / rate
    return f"{math.floor(total / 3600):02d}:{math.floor(total % 3600 / 60):02d}:{total % 60:06.3f}"


def clock_parts(frames: Column, rate: Column) -> Column:
    """Hours, minutes and seconds (unrounded) of a frame."""
    total = frames.cast("double") / rate
    return F.struct(F.floor(total / 3600).cast("long").alias("hours"), F.floor((total % 3600) / 60).cast("long").alias("minutes"), (total % 60).alias("seconds"))


def millisecond_clock(frames: Column, rate: Column) -> Column:
    """Whole hours, minutes, seconds and milliseconds, with carry."""
    ms = F.rint(frames.cast("double") * 1000 / rate).cast("long")
    part = lambda unit, size: F.floor(ms / unit) % size
    return F.struct(F.floor(ms / 3_600_000).cast("long").alias("hours"), part(60_000, 60).cast("long").alias("minutes"), part(1000, 60).cast("long").alias("seconds"), (ms % 1000).cast("long").alias("millis"))


def ratio(text: Column) -> Column:
    """``30000/1001`` or a plain number as double; a zero denominator is an error."""
    over = F.get(F.split(text, "/"), F.lit(1)).try_cast("double")
    value = F.get(F.split(text, "/"), F.lit(0)).try_cast("double")
    return F.when(over == 0, F.raise_error(F.concat(F.lit("zero denominator in "), text))).otherwise(F.when(over.isNull(), value).otherwise(value / over))


def seconds(time: Column) -> Column:
    """A media time (ticks, time base) as double, for display."""
    return time["ticks"].cast("double") * time["time_base"]["numerator"] / time["time_base"]["denominator"]
