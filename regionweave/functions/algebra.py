"""Relation algebras over bit masks: RCC-8, RCC-5 and Allen's intervals, as column expressions.

A mask is an INT whose bits are possible base relations. Composition tables are small driver-side tuples that become array literals or a broadcast table; the Allen table is derived by enumerating intervals, so no large table is written down.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache, cached_property
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Base relations in bit order, and the composition tables of the literature (rows and columns in bit order).
RCC8_BASE = ("DC", "EC", "PO", "TPP", "NTPP", "TPPi", "NTPPi", "EQ")
RCC5_BASE = ("DR", "PO", "PP", "PPi", "EQ")
ALLEN_BASE = ("b", "bi", "m", "mi", "o", "oi", "s", "si", "d", "di", "f", "fi", "eq")
RCC8_TABLE = (
    (255, 31, 31, 31, 31, 1, 1, 1),
    (103, 175, 31, 30, 28, 3, 1, 2),
    (103, 103, 255, 28, 28, 103, 103, 4),
    (1, 3, 31, 24, 16, 175, 103, 8),
    (1, 1, 31, 16, 16, 31, 255, 16),
    (103, 102, 100, 172, 28, 96, 64, 32),
    (103, 100, 100, 100, 252, 64, 64, 64),
    (1, 2, 4, 8, 16, 32, 64, 128),
)
RCC5_TABLE = ((31, 7, 7, 1, 1), (11, 31, 6, 11, 2), (1, 7, 4, 31, 4), (11, 10, 30, 8, 8), (1, 2, 4, 8, 16))


def allen_name(a_lo, a_hi, b_lo, b_hi) -> str:
    """Allen relation of two intervals with ordered ends, by the signs of their four end comparisons."""
    sign = lambda x, y: (x > y) - (x < y)
    start, end = sign(a_lo, b_lo), sign(a_hi, b_hi)
    if sign(a_hi, b_lo) < 0:
        return "b"
    if sign(b_hi, a_lo) < 0:
        return "bi"
    if a_hi == b_lo:
        return "m"
    if b_hi == a_lo:
        return "mi"
    return {(0, 0): "eq", (0, -1): "s", (0, 1): "si", (1, 0): "f", (-1, 0): "fi", (-1, -1): "o", (1, 1): "oi", (1, -1): "d", (-1, 1): "di"}[start, end]


@cache
def _allen_table() -> tuple[tuple[int, ...], ...]:
    """Composition by enumeration: six distinct ends are enough for any three intervals."""
    spans = [(lo, hi) for lo in range(6) for hi in range(lo + 1, 6)]
    at = {n: i for i, n in enumerate(ALLEN_BASE)}
    base = {(a, b): at[allen_name(*a, *b)] for a, b in product(spans, repeat=2)}
    table = [[0] * 13 for _ in range(13)]
    for a, b, c in product(spans, repeat=3):
        table[base[a, b]][base[b, c]] |= 1 << base[a, c]
    return tuple(map(tuple, table))


@dataclass(frozen=True)
class Algebra:
    """A relation algebra; its methods make column expressions over INT masks. NULL masks give NULL."""

    name: str
    base: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...] = field(repr=False)  # base relations that are each other's converse

    @property
    def universal(self) -> int:
        return (1 << len(self.base)) - 1

    @property
    def equal(self) -> int:
        return 1 << (len(self.base) - 1)

    @cached_property
    def table(self) -> tuple[tuple[int, ...], ...]:
        return {"rcc8": RCC8_TABLE, "rcc5": RCC5_TABLE}.get(self.name) or _allen_table()

    def bit(self, name: str) -> int:
        """The bit of a base relation; an unknown name is an error."""
        if name not in self.base:
            raise ValueError(f"unknown {self.name} relation {name!r}")
        return 1 << self.base.index(name)

    def mask(self, *names: str) -> int:
        """The mask of several base relations; none gives the empty mask."""
        return sum({self.bit(n) for n in names})

    def bit_of(self, name: Column) -> Column:
        """The bit of a column of base names; an unknown name fails the query."""
        known = F.create_map(*[F.lit(x) for n in self.base for x in (n, self.bit(n))])
        return F.when(name.isNotNull(), F.coalesce(F.element_at(known, name), F.raise_error(F.concat(F.lit(f"unknown {self.name} relation "), name)).cast("int")))

    def mask_of(self, names: Column) -> Column:
        """The mask of an array of base names."""
        return F.aggregate(names, F.lit(0), lambda a, n: a.bitwiseOR(self.bit_of(n)))

    def names_of(self, mask: Column) -> Column:
        """Names of a mask's base relations, in bit order."""
        return F.filter(F.array(*map(F.lit, self.base)), lambda n, i: F.getbit(mask, i) == 1)

    def text_of(self, mask: Column) -> Column:
        """Names of a mask's base relations, in bit order, joined by commas; of a small algebra by one look into a table of all masks."""
        if len(self.base) > 8:
            return F.array_join(self.names_of(mask), ",")
        texts = ";".join(",".join(n for i, n in enumerate(self.base) if m >> i & 1) for m in range(self.universal + 1))
        return F.coalesce(F.get(F.split(F.lit(texts), ";"), mask.bitwiseAND(F.lit(self.universal))), F.lit(""))

    def check(self, mask: Column) -> Column:
        """The mask itself; one outside the algebra fails the query."""
        bad = F.raise_error(F.concat(F.lit(f"not a {self.name} mask: "), mask.cast("string"))).cast("int")
        return F.when((mask >= 0) & (mask <= self.universal), mask).when(mask.isNotNull(), bad)

    def converse(self, mask: Column) -> Column:
        """The mask with both regions exchanged: every pair of converse bits changes places."""
        stay, up = self.universal, {}
        for a, b in self.pairs:
            stay &= ~(self.bit(a) | self.bit(b))
            d = self.base.index(b) - self.base.index(a)
            up[d] = up.get(d, 0) | self.bit(a)
        out = mask.bitwiseAND(F.lit(stay))
        for d, bits in up.items():
            out = out.bitwiseOR(F.shiftleft(mask.bitwiseAND(F.lit(bits)), d)).bitwiseOR(F.shiftright(mask.bitwiseAND(F.lit(bits << d)), d))
        return out

    def compose(self, a: Column, b: Column) -> Column:
        """Weak composition: the union over base relations of both masks; an empty mask gives the empty mask."""
        # entry (i, j) of the table counts when bit i of a and bit j of b are set; rows are grouped by the columns that set each result bit
        out = F.lit(0)
        for i, row in enumerate(self.table):
            by_result: dict[int, int] = {}
            for j, c in enumerate(row):
                for k in range(len(self.base)):
                    if c >> k & 1:
                        by_result[k] = by_result.get(k, 0) | 1 << j
            groups: dict[int, int] = {}
            for k, columns in by_result.items():
                groups[columns] = groups.get(columns, 0) | 1 << k
            hit = F.lit(0)
            for columns, result in groups.items():
                hit = hit.bitwiseOR(F.when(b.bitwiseAND(F.lit(columns)) != 0, result).otherwise(0))
            out = out.bitwiseOR(F.when(F.getbit(a, F.lit(i)) == 1, hit).otherwise(0))
        return F.when(a.isNotNull() & b.isNotNull(), out)

    def compose_masks(self, a: int, b: int) -> int:
        """Composition of two masks on the driver."""
        out = 0
        for i, j in product(range(len(self.base)), repeat=2):
            if a >> i & 1 and b >> j & 1:
                out |= self.table[i][j]
        return out

    def converse_mask(self, m: int) -> int:
        swap = {self.base.index(a): self.base.index(b) for a, b in self.pairs}
        swap |= {b: a for a, b in swap.items()}
        return sum(1 << swap.get(i, i) for i in range(len(self.base)) if m >> i & 1)

    def is_base(self, mask: Column) -> Column:
        """Whether exactly one base relation is possible."""
        return F.bit_count(mask) == 1

    def intersect(self, mask: Column) -> Column:
        """Aggregate: what all masks of a group allow; everything for none."""
        return F.coalesce(F.bit_and(mask), F.lit(self.universal))

    def union(self, mask: Column) -> Column:
        """Aggregate: what any mask of a group allows; nothing for none."""
        return F.coalesce(F.bit_or(mask), F.lit(0))

    def masks(self, spark: SparkSession) -> DataFrame:
        """All masks of the algebra, as column mask."""
        return spark.range(self.universal + 1).select(F.col("id").cast("int").alias("mask"))

    def base_compositions(self, spark: SparkSession) -> DataFrame:
        """The composition table: a, b (names), mask."""
        return spark.createDataFrame([(x, y, self.table[i][j]) for i, x in enumerate(self.base) for j, y in enumerate(self.base)], "a string, b string, mask int")

    def table_sql(self, name: str = "comp") -> str:
        """The composition table as a SQL common table expression of bits (a, b, c)."""
        rows = ",".join(f"({1 << i},{1 << j},{c})" for i, row in enumerate(self.table) for j, c in enumerate(row))
        return f"{name}(a, b, c) AS (VALUES {rows})"


RCC8 = Algebra("rcc8", RCC8_BASE, (("TPP", "TPPi"), ("NTPP", "NTPPi")))
RCC5 = Algebra("rcc5", RCC5_BASE, (("PP", "PPi"),))
ALLEN = Algebra("allen", ALLEN_BASE, (("b", "bi"), ("m", "mi"), ("o", "oi"), ("s", "si"), ("d", "di"), ("f", "fi")))


def rcc8_to_rcc5(mask: Column) -> Column:
    """The coarser mask: tangency is forgotten."""
    out = F.lit(0)
    for fine, coarse in ((("DC", "EC"), "DR"), (("PO",), "PO"), (("TPP", "NTPP"), "PP"), (("TPPi", "NTPPi"), "PPi"), (("EQ",), "EQ")):
        out = out.bitwiseOR(F.when(mask.bitwiseAND(F.lit(RCC8.mask(*fine))) != 0, RCC5.bit(coarse)).otherwise(0))
    return F.when(mask.isNotNull(), out)


# Masks that the literature's NP8 lists one by one.
NP8_LISTED = (146, 147, 194, 195)
FRAGMENTS = ("H8", "C8", "Q8")


def fragment(name: str, mask: Column) -> Column:
    """Whether a mask lies in a tractable fragment (H8, C8, Q8) or among the intractable masks (NP8)."""
    has = lambda *n: mask.bitwiseAND(F.lit(RCC8.mask(*n))) != 0
    np8 = (~has("PO") & has("TPP", "NTPP") & has("TPPi", "NTPPi")) | mask.isin(*NP8_LISTED)
    rest = {
        "NP8": F.lit(True),
        "H8": (has("EQ") & has("NTPP") & ~has("TPP")) | (has("EQ") & has("NTPPi") & ~has("TPPi")),
        "C8": has("EC") & ~has("PO") & has("TPP", "NTPP", "TPPi", "NTPPi", "EQ"),
        "Q8": has("EQ") & ~has("PO") & has("TPP", "NTPP", "TPPi", "NTPPi"),
    }[name]
    return np8 if name == "NP8" else ~np8 & ~rest


def fragments_of(mask: Column) -> Column:
    """Names of the tractable fragments that hold a mask."""
    return F.filter(F.array(*[F.when(fragment(n, mask), F.lit(n)) for n in FRAGMENTS]), lambda n: n.isNotNull())


# Allen masks by what they say of one axis.
APART, TOUCHING, A_IN_B, B_IN_A = 3, 12, 5440, 6784


def rcc8_of_axes(x: Column, y: Column) -> Column:
    """RCC-8 bit of two boxes from their base Allen masks on both axes."""
    has = lambda c, m: c.bitwiseAND(F.lit(m)) != 0
    both = lambda m: has(x, m) & has(y, m)
    eq, d, di = ALLEN.bit("eq"), ALLEN.bit("d"), ALLEN.bit("di")
    return (
        F.when(has(x, APART) | has(y, APART), 1)
        .when(has(x, TOUCHING) | has(y, TOUCHING), 2)
        .when(both(eq), 128)
        .when(both(d), 16)
        .when(both(A_IN_B), 8)
        .when(both(di), 64)
        .when(both(B_IN_A), 32)
        .otherwise(4)
    )


# Allen relations of one axis that `rcc8_of_axes` does not tell apart.
ALIKE = (("b", "bi"), ("m", "mi"), ("eq",), ("d",), ("s", "f"), ("di",), ("si", "fi"), ("o", "oi"))


@cache
def _rect_table() -> tuple[tuple[int, ...], ...]:
    """RCC-8 bits of base relations of both axes, by their places in ALIKE."""
    inside, around = {"eq", "d", "s", "f"}, {"eq", "di", "si", "fi"}

    def bit(x: str, y: str) -> int:
        if "b" in (x, y):
            return 1
        if "m" in (x, y):
            return 2
        if x == y and x in ("eq", "d", "di"):
            return {"eq": 128, "d": 16, "di": 64}[x]
        return 8 if {x, y} <= inside else 32 if {x, y} <= around else 4

    return tuple(tuple(bit(x[0], y[0]) for y in ALIKE) for x in ALIKE)


def rcc8_of_rect(x: Column, y: Column) -> Column:
    """RCC-8 mask of a pair of Allen masks: the union over their base relations; empty if either axis is empty."""
    has = lambda c, names: c.bitwiseAND(F.lit(ALLEN.mask(*names))) != 0
    out = F.lit(0)
    for alike, row in zip(ALIKE, _rect_table(), strict=True):
        hit = F.lit(0)
        for bit in sorted(set(row)):
            names = [n for other, r in zip(ALIKE, row, strict=True) if r == bit for n in other]
            hit = hit.bitwiseOR(F.when(has(y, names), bit).otherwise(0))
        out = out.bitwiseOR(F.when(has(x, alike), hit).otherwise(0))
    return out
