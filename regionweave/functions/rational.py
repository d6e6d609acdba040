"""Exact fractions as STRUCT<num BIGINT, den BIGINT>, reduced, with a positive denominator. NULL stays NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Divisors below this are looked up: the table holds gcd(y, r) of every y and remainder r.
SMALL = 64
_SMALL_GCD = ",".join(str(math.gcd(y, r)) for y in range(SMALL) for r in range(SMALL))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two integers; 0 only for two zeros. One step of Euclid's and a look into a table where `b` is small, all steps (92 are enough for 64 bits) elsewhere."""
    x, y = F.abs(a).cast("long"), F.abs(b).cast("long")
    table = F.split(F.lit(_SMALL_GCD), ",").cast("array<long>")
    return F.when((y > 0) & (y < SMALL), F.get(table, (y * SMALL + x % y).cast("int"))).otherwise(_euclid(a, b))


def _euclid(a: Column, b: Column) -> Column:
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % s["y"]).alias("y")))
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["x"]


def rat(n: Column, d: Column) -> Column:
    """The fraction n/d; a zero denominator fails the query."""
    g = gcd(n, d)
    sign = F.when(d < 0, -1).otherwise(1)
    bad = F.raise_error(F.lit("zero denominator")).cast("long")
    num, den = _div(sign * n, g), F.when(d == 0, bad).otherwise(_div(sign * d, g))
    return F.when(n.isNotNull() & d.isNotNull(), F.struct(num.alias("num"), den.alias("den")))


def _div(n: Column, g: Column) -> Column:
    """Whole division by a divisor."""
    return F.round(n.cast("decimal(20,0)") / g.cast("decimal(20,0)")).cast("long")


def _wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def less(a: Column, b: Column) -> Column:
    """a < b, by cross products that cannot overflow."""
    return _wide(a["num"]) * _wide(b["den"]) < _wide(b["num"]) * _wide(a["den"])


def add(a: Column, b: Column) -> Column:
    return rat(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])


def subtract(a: Column, b: Column) -> Column:
    return rat(a["num"] * b["den"] - b["num"] * a["den"], a["den"] * b["den"])


def multiply(a: Column, b: Column) -> Column:
    return rat(a["num"] * b["num"], a["den"] * b["den"])


def parse(text: Column) -> Column:
    """A fraction from text: "3", "1/3" or a plain decimal with up to 18 digits after the point; other text gives NULL."""
    whole = F.regexp_extract(text, r"^\s*(-?\d+)\s*(?:/\s*\d+)?\s*$", 1)
    over = F.regexp_extract(text, r"^\s*-?\d+\s*/\s*(\d+)\s*$", 1)
    lead, digits = F.regexp_extract(text, r"^\s*(-?\d*)\.(\d+)\s*$", 1), F.regexp_extract(text, r"^\s*-?\d*\.(\d{1,18})\s*$", 1)
    plain = F.when(whole != "", rat(whole.try_cast("long"), F.when(over != "", over.try_cast("long")).otherwise(F.lit(1).cast("long"))))
    scale = F.pow(F.lit(10), F.length(digits)).cast("long")
    point = F.when(digits != "", rat(F.concat(lead, digits).try_cast("long"), scale))
    return F.coalesce(plain, point)


def to_json(x: Column) -> Column:
    return F.to_json(F.struct(x["num"].alias("num"), x["den"].alias("den")))


def from_json(text: Column) -> Column:
    got = F.from_json(text, "num long, den long")
    return rat(got["num"], got["den"])
