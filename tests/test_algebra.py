"""Laws of the relation algebras over all masks, and agreement between classifiers."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from regionweave.functions import algebra as al
from regionweave.functions.algebra import ALLEN, RCC5, RCC8


@pytest.mark.parametrize("a", [RCC8, RCC5, ALLEN], ids=lambda a: a.name)
def test_converse_and_names(spark, a):
    m = F.col("mask")
    rows = a.masks(spark).select("mask", a.converse(m).alias("c"), a.converse(a.converse(m)).alias("cc"), a.mask_of(a.names_of(m)).alias("again"), a.is_base(m).alias("base")).collect()
    assert len(rows) == a.universal + 1
    for r in rows:
        assert r.c == a.converse_mask(r.mask) and r.cc == r.mask == r.again and r.base == (r.mask.bit_count() == 1)


@pytest.mark.parametrize("a", [RCC8, RCC5, ALLEN], ids=lambda a: a.name)
def test_composition_laws(a):
    bits = [1 << i for i in range(len(a.base))]
    for x, y in product(bits, repeat=2):
        c = a.compose_masks(x, y)
        assert c and a.converse_mask(c) == a.compose_masks(a.converse_mask(y), a.converse_mask(x))
    for x in bits:
        assert a.compose_masks(a.equal, x) == x == a.compose_masks(x, a.equal)
        assert a.compose_masks(x, a.converse_mask(x)) & a.equal


def test_rcc5_is_the_quotient_of_rcc8(spark):
    for x, y in product(range(8), repeat=2):
        fine = RCC8.table[x][y]
        rows = spark.range(1).select(al.rcc8_to_rcc5(F.lit(fine)), al.rcc8_to_rcc5(F.lit(1 << x)), al.rcc8_to_rcc5(F.lit(1 << y))).first() if (x, y) in ((0, 1), (3, 4), (5, 6)) else None
        if rows:
            assert rows[0] & ~RCC5.compose_masks(rows[1], rows[2]) == 0


def test_fragment_sizes(spark):
    row = RCC8.masks(spark).select(*[F.count_if(al.fragment(n, F.col("mask"))).alias(n) for n in ("NP8", "H8", "C8", "Q8")]).first()
    assert tuple(row) == (76, 148, 158, 160)


def test_bad_masks_and_names(spark):
    with pytest.raises(ValueError):
        RCC8.bit("dc")
    with pytest.raises(Exception, match="not a rcc8 mask"):
        spark.range(1).select(RCC8.check(F.lit(256))).collect()
    assert spark.range(1).select(RCC8.compose(F.lit(None).cast("int"), F.lit(1))).first()[0] is None
