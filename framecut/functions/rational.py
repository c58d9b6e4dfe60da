"""Exact rational times by built-in functions: whole decimals of 38 digits hold all products that occur."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE, LARGEST, PART = "decimal(38,0)", 2**63 - 1, 2**31
#: Euclid's algorithm takes at most 93 steps where the smaller number is below 2^63.
STEPS = 94


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor, not below 0; b is below 2^63 in size."""
    pair = lambda x, y: F.struct(x.cast(WIDE).alias("x"), y.cast(WIDE).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(pair(s["y"], s["x"] % s["y"]))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), pair(a, b), step, lambda s: F.abs(s["x"]))


def quotient(a: Column, b: Column) -> Column:
    """a / b where that is whole; null above 32 digits, which no time has."""
    return F.try_divide(a.cast(WIDE), b.cast(WIDE)).cast(WIDE)


def reduced(base: Column) -> Column:
    """A positive time base in lowest terms as struct (n, d); null where a part is 0, missing or above 31 bits then."""
    n, d = base["numerator"].cast(WIDE), base["denominator"].cast(WIDE)
    parts = let(gcd(n, d), lambda g: F.struct(quotient(F.abs(n), g).alias("n"), quotient(F.abs(d), g).alias("d")))
    return F.when(n * d > 0, let(parts, lambda p: F.when(F.greatest(p["n"], p["d"]) < PART, p)))


def _media(ticks: Column, n: Column, d: Column) -> Column:
    """A media time; null where a part can't be represented."""
    base = F.struct(n.cast("long").alias("numerator"), d.cast("long").alias("denominator"))
    return F.when((F.abs(ticks) <= LARGEST) & (F.greatest(n, d) < PART), F.struct(ticks.cast("long").alias("ticks"), base.alias("time_base")))


def _common(t: Column, u: Column, a: Column, b: Column) -> Column:
    """t ticks of base a and u ticks of base b in the finest base common to both, or the coarsest that holds the sum."""

    def summed(g: Column) -> Column:
        ticks = t * quotient(a["n"] * b["d"], g) + u * quotient(b["n"] * a["d"], g)
        low = gcd(g, a["d"] * b["d"])
        return let(low, lambda x: F.struct(ticks.alias("t"), quotient(g, x).alias("n"), quotient(a["d"] * b["d"], x).alias("d")))

    def coarsened(s: Column) -> Column:
        coarse = let(gcd(s["t"], s["d"]), lambda g: _media(quotient(s["t"], g), s["n"], quotient(s["d"], g)))
        return F.when(F.abs(s["t"]) <= LARGEST, _media(s["t"], s["n"], s["d"])).otherwise(coarse)

    return let(let(gcd(a["n"] * b["d"], b["n"] * a["d"]), summed), coarsened)


def exact_end(time: Column, duration: Column) -> Column:
    """Presentation time plus duration without rounding; null where unknown or not representable.

    The presentation's base is kept as it stands if the sum is whole in it; else the sum takes the finest
    common base, and if that overflows the coarsest one that holds it.
    """
    t, u = time["ticks"].cast(WIDE), duration["ticks"].cast(WIDE)

    def summed(v: Column) -> Column:
        a, b = v["a"], v["b"]
        scaled, unit = u * b["n"] * a["d"], b["d"] * a["n"]
        whole = t + quotient(scaled - scaled % unit, unit)
        kept = F.struct(whole.cast("long").alias("ticks"), time["time_base"].alias("time_base"))
        return F.when((scaled % unit == 0) & (F.abs(whole) <= LARGEST), kept).otherwise(_common(t, u, a, b))

    bases = F.struct(reduced(time["time_base"]).alias("a"), reduced(duration["time_base"]).alias("b"))
    known = lambda v: v["a"].isNotNull() & v["b"].isNotNull() & (u >= 0) & t.isNotNull()
    return let(bases, lambda v: F.when(known(v), summed(v)))
