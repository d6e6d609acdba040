"""Predicates on closed intervals and boxes, as column expressions over integer, decimal or double ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .algebra import ALLEN

Span = tuple[Column, Column]


def overlap(a: Span, b: Span) -> Column:
    """Interiors meet."""
    return (a[0] < b[1]) & (b[0] < a[1])


def meet(a: Span, b: Span) -> Column:
    """The closed intervals meet."""
    return (a[0] <= b[1]) & (b[0] <= a[1])


def touch(a: Span, b: Span) -> Column:
    """One ends where the other starts."""
    return (a[1] == b[0]) | (b[1] == a[0])


def apart(a: Span, b: Span) -> Column:
    """There is a gap between them."""
    return (a[1] < b[0]) | (b[1] < a[0])


def within(a: Span, b: Span) -> Column:
    return (a[0] >= b[0]) & (a[1] <= b[1])


def inside(a: Span, b: Span) -> Column:
    """Within, with room at both ends."""
    return (a[0] > b[0]) & (a[1] < b[1])


def same(a: Span, b: Span) -> Column:
    return (a[0] == b[0]) & (a[1] == b[1])


def valid(*spans: Span) -> Column:
    """Whether every axis has a lower end below its upper end."""
    return _all([s[0] < s[1] for s in spans])


def _all(c: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, c)


def _any(c: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, c)


def allen(a: Span, b: Span) -> Column:
    """Allen bit of two intervals whose ends are ordered."""
    bit = ALLEN.bit
    return (
        F.when(a[1] < b[0], bit("b"))
        .when(b[1] < a[0], bit("bi"))
        .when(a[1] == b[0], bit("m"))
        .when(b[1] == a[0], bit("mi"))
        .when(a[0] == b[0], F.when(a[1] == b[1], bit("eq")).when(a[1] < b[1], bit("s")).otherwise(bit("si")))
        .when(a[1] == b[1], F.when(a[0] > b[0], bit("f")).otherwise(bit("fi")))
        .when(a[0] < b[0], F.when(a[1] < b[1], bit("o")).otherwise(bit("di")))
        .otherwise(F.when(a[1] < b[1], bit("d")).otherwise(bit("oi")))
    )


def rcc8(a: list[Span], b: list[Span]) -> Column:
    """RCC-8 bit of two boxes of any number of axes."""
    axes = list(zip(a, b, strict=True))
    every = lambda p: _all([p(x, y) for x, y in axes])
    swapped = lambda p: _all([p(y, x) for x, y in axes])
    return (
        F.when(_any([apart(x, y) for x, y in axes]), 1)
        .when(~every(overlap), 2)
        .when(every(same), 128)
        .when(every(inside), 16)
        .when(every(within), 8)
        .when(swapped(inside), 64)
        .when(swapped(within), 32)
        .otherwise(4)
    )


def contact_dimension(a: list[Span], b: list[Span]) -> Column:
    """Dimension of the contact of two boxes that only touch: the axes on which their interiors meet; NULL for other pairs."""
    axes = list(zip(a, b, strict=True))
    shared = reduce(lambda x, y: x + y, [overlap(x, y).cast("int") for x, y in axes])
    return F.when(rcc8(a, b) == 2, shared)
