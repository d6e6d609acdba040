"""Touching pairs of a table of copies: joined by classes of equal boxes in tasks that are not coalesced, with the rows that SQL gives."""

import pytest

from regionweave import catalog
from regionweave.operators import boxes as bx

COPIES = 6
QUERIES = (
    "rect_to_rcc8",
    "view_similarity",
    "witness_violations",
    "compare_realizations",
    "contact_dim",
    "de9im_pairs",
    "de9im_to_rcc8",
    "rcc8_hist",
    "rcc8_pairs",
    "rect_converse",
    "rect_pairs",
    "verify_constraints",
    "view_affine",
    "view_topology",
)


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Parts with shifted keys; some keys are others plus 1,000,000."""
    folder = tmp_path_factory.mktemp("copies")
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    # 29391 = 3 * 97 * 101 keys on, boxes lie in the same places
    shifts = [i * 29391 for i in range(COPIES - 1)] + [1_000_000]
    out = part
    for s in shifts[1:]:
        out = out.unionByName(part.selectExpr(f"p_partkey + {s} as p_partkey", *[c for c in part.columns if c != "p_partkey"]))
    out.coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_copies_are_joined_by_classes(spark, copies, name):
    import duckdb

    got = catalog.QUERIES[name](spark, copies)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW part AS SELECT * FROM '{copies}/part.parquet/*.parquet'")
    wanted = db.sql(catalog.ORACLE_SQL[name])
    pairs = lambda rows: sorted(map(str, map(tuple, rows)))
    assert pairs(got.select(*wanted.columns).collect()) == pairs(wanted.fetchall())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "FullOuter" not in plan and "explode(a" in plan


def test_classes_stand_for_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(bx, "BLOCK", 3)
    rows = [(i, x, x + 4, 0, 3) for i in range(20) for x in (i % 2,)] + [(100, 50, 60, 0, 3), (101, 30, 50, -20, 0)]
    b = spark.createDataFrame(rows, "region long, x0 long, x1 long, y0 long, y1 long")
    slow = bx.relations(bx.all_pairs(b)).filter("mask <> 1").select("a", "b", "mask")
    fast = bx.expanded(bx.relations(bx.touching_classes(b)).select("a", "b", "mask"))
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))




def test_queries_agree_with_the_operators_that_look_boxes_up(spark, copies):
    from pyspark.sql import functions as F

    from regionweave.operators import spec as sp
    from regionweave.sources import fixtures as fx

    boxes = fx.boxes(spark, copies)
    pairs, same = bx.touching_pairs(boxes).select("a", "b"), lambda x, y: sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))
    stated = pairs.selectExpr("a as src", "b as dst", "case when (a * 3 + b) % 4 = 0 then 6 else 252 end as mask")
    met = catalog.QUERIES["verify_constraints"](spark, copies).filter("observed is not null")
    assert same(met, bx.verdicts(stated, boxes).select("src", "dst", "observed", "verdict"))
    assert same(catalog.QUERIES["witness_violations"](spark, copies), bx.witness_verdicts(pairs.withColumn("dim", F.expr("cast(a % 2 as int)")), boxes))
    assert {r.code for r in bx.witness_verdicts(spark.createDataFrame([(-5, -6, 1)], "a long, b long, dim int"), boxes).collect()} == {"missing_region"}
    items = sp.observations(bx.relations(bx.touching_pairs(boxes)).withColumn("real", F.lit(0)))
    two = items.filter("b % 5 <> 0").withColumn("value", F.expr("case when kind = 'rcc8' and b % 6 = 0 then 'PO' else value end"))
    assert same(catalog.QUERIES["compare_realizations"](spark, copies), sp.compare(items.filter("a % 5 <> 0"), two))


def test_divisors_and_names_are_looked_up_alike(spark):
    import math

    from pyspark.sql import functions as F

    from regionweave.functions import rational as rt
    from regionweave.functions.algebra import RCC8

    rows = [(a, b) for a in (0, 1, -12, 63, 64, 6300, 2**62) for b in (0, 1, -6, 36, 63, 64, 4096)]
    got = spark.createDataFrame([*rows, (None, 4), (4, None)], "a long, b long").select("a", "b", rt.gcd(F.col("a"), F.col("b")).alias("g")).collect()
    assert all(r.g == (None if r.a is None or r.b is None else math.gcd(r.a, r.b)) for r in got)
    masks = RCC8.masks(spark).select(RCC8.text_of(F.col("mask")).alias("x"), F.array_join(RCC8.names_of(F.col("mask")), ",").alias("y")).collect()
    assert all(r.x == r.y for r in masks)


def test_rectangle_masks_are_unions_of_their_base_relations(spark):
    import random

    from pyspark.sql import functions as F

    from regionweave.functions import algebra as al

    r = random.Random(4)
    rows = [(x, y) for x in [0, *(1 << i for i in range(13))] for y in [0, *(1 << i for i in range(13))]] + [(r.randrange(8192), r.randrange(8192)) for _ in range(60)]
    base = spark.createDataFrame([(1 << i, 1 << j) for i in range(13) for j in range(13)], "x int, y int").select("x", "y", al.rcc8_of_axes(F.col("x"), F.col("y")).alias("m")).collect()
    got = spark.createDataFrame(rows, "x int, y int").select("x", "y", al.rcc8_of_rect(F.col("x"), F.col("y")).alias("m")).collect()
    for g in got:
        wanted = 0
        for b in base:
            wanted |= b.m if g.x & b.x and g.y & b.y else 0
        assert g.m == wanted
