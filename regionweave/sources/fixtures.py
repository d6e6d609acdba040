"""Integer tables derived from the driver's tables: boxes, intervals, a grid field, flows, signatures, networks and a contact graph.

Every one covers its whole source table; sizes follow it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of parts: region, x0, x1, y0, y1, z0, z1. Three parts share a corner; sizes vary."""
    g = "p_partkey div 3"
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey as region", f"3 * (({g}) * 31 % 101) as x0", f"3 * (({g}) * 31 % 101) + 1 + p_size % 11 as x1",
        f"3 * (({g}) * 17 % 97) as y0", f"3 * (({g}) * 17 % 97) + 1 + p_size div 5 as y1", "p_partkey % 3 as z0", "p_partkey % 3 + 1 + p_size % 2 as z1",
    )


BOXES_SQL = """boxes AS (
  SELECT p_partkey AS region, 3 * ((p_partkey // 3) * 31 % 101) AS x0, 3 * ((p_partkey // 3) * 31 % 101) + 1 + p_size % 11 AS x1,
         3 * ((p_partkey // 3) * 17 % 97) AS y0, 3 * ((p_partkey // 3) * 17 % 97) + 1 + p_size // 5 AS y1,
         p_partkey % 3 AS z0, p_partkey % 3 + 1 + p_size % 2 AS z1 FROM part)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in which a user was active on a day: user_id, day, lo, hi."""
    e = read(spark, sf_dir, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min(F.hour("ts")).alias("lo"), (F.max(F.hour("ts")) + 1).alias("hi"))


INTERVALS_SQL = "intervals AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(min(hour(ts)) AS INT) AS lo, CAST(max(hour(ts)) + 1 AS INT) AS hi FROM events GROUP BY 1, 2)"


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user group and hour: i0, i1, value, over the whole 15 by 24 grid."""
    e = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 15).cast("int").alias("i0"), F.hour("ts").alias("i1")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(15 * 24).selectExpr("cast(id div 24 as int) as i0", "cast(id % 24 as int) as i1")
    return grid.join(e, ["i0", "i1"], "left").select("i0", "i1", F.coalesce("n", F.lit(0)).alias("value"))


FIELD_SQL = """field AS (
  SELECT g.i0, g.i1, coalesce(n, 0) AS value
  FROM (SELECT CAST(range // 24 AS INT) AS i0, CAST(range % 24 AS INT) AS i1 FROM range(360)) g
  LEFT JOIN (SELECT CAST(user_id % 15 AS INT) AS i0, CAST(hour(ts) AS INT) AS i1, count(*) AS n FROM events GROUP BY 1, 2) e ON g.i0 = e.i0 AND g.i1 = e.i1)"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of order flow: edge, tail, head, weight. The weight is signed: odd edges run backwards."""
    o = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).alias("tail"), (F.col("o_orderkey") % 40).alias("head")).agg(F.count(F.lit(1)).alias("n"))
    edge = F.col("tail") * 40 + F.col("head")
    return o.select(edge.alias("edge"), "tail", "head", F.when(edge % 2 == 1, -F.col("n")).otherwise(F.col("n")).alias("weight"))


FLOWS_SQL = """flows AS (
  SELECT tail * 40 + head AS edge, tail, head, CASE WHEN (tail * 40 + head) % 2 = 1 THEN -n ELSE n END AS weight
  FROM (SELECT o_custkey % 40 AS tail, o_orderkey % 40 AS head, count(*) AS n FROM orders GROUP BY 1, 2))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point memberships for an overlay: point, region (an event type)."""
    return read(spark, sf_dir, "events").selectExpr("event_id div 4 as point", "event_type as region")


POINTS_SQL = "points AS (SELECT event_id // 4 AS point, event_type AS region FROM events)"


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RCC-8 networks of eight boxes each: net, i, j, mask. Every fifth arc also allows PO, every third pair of regions is unstated."""
    from ..functions.intervals import rcc8

    b = boxes(spark, sf_dir).withColumn("net", F.expr("region div 8"))
    a, c = (b.select("net", *[F.col(x).alias(f"{s}_{x}") for x in ("region", "x0", "x1", "y0", "y1")]) for s in "ab")
    pairs = a.join(c, "net").filter("a_region < b_region and (a_region + b_region) % 3 <> 0")
    span = lambda s: [(F.col(f"{s}_x0"), F.col(f"{s}_x1")), (F.col(f"{s}_y0"), F.col(f"{s}_y1"))]
    mask = rcc8(span("a"), span("b")).bitwiseOR(F.when(F.expr("(a_region * 7 + b_region) % 5 = 0"), 4).otherwise(0))
    return pairs.select("net", F.col("a_region").alias("i"), F.col("b_region").alias("j"), mask.alias("mask"))


RCC8_CASE = """CASE WHEN a.x1 < b.x0 OR b.x1 < a.x0 OR a.y1 < b.y0 OR b.y1 < a.y0 THEN 1
    WHEN NOT (a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1) THEN 2
    WHEN a.x0 = b.x0 AND a.x1 = b.x1 AND a.y0 = b.y0 AND a.y1 = b.y1 THEN 128
    WHEN a.x0 > b.x0 AND a.x1 < b.x1 AND a.y0 > b.y0 AND a.y1 < b.y1 THEN 16
    WHEN a.x0 >= b.x0 AND a.x1 <= b.x1 AND a.y0 >= b.y0 AND a.y1 <= b.y1 THEN 8
    WHEN b.x0 > a.x0 AND b.x1 < a.x1 AND b.y0 > a.y0 AND b.y1 < a.y1 THEN 64
    WHEN b.x0 >= a.x0 AND b.x1 <= a.x1 AND b.y0 >= a.y0 AND b.y1 <= a.y1 THEN 32
    ELSE 4 END"""

ARCS_SQL = f"""{BOXES_SQL},
arcs AS (
  SELECT a.region // 8 AS net, a.region AS i, b.region AS j,
         ({RCC8_CASE}) | CASE WHEN (a.region * 7 + b.region) % 5 = 0 THEN 4 ELSE 0 END AS mask
  FROM boxes a JOIN boxes b ON a.region // 8 = b.region // 8 AND a.region < b.region AND (a.region + b.region) % 3 <> 0)"""


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access graphs of twelve customers each: g, u, v, passable. One edge in six is blocked."""
    c = read(spark, sf_dir, "customer").selectExpr("c_custkey div 12 as g", "c_custkey as u", "c_nationkey as k")
    step = c.withColumn("v", F.explode(F.array(F.expr("u + 1"), F.expr("g * 12 + (u + k) % 12"))))
    return step.filter("v div 12 = g and v <> u").selectExpr("g", "least(u, v) as u", "greatest(u, v) as v", "(u * 5 + v) % 6 <> 0 as passable").groupBy("g", "u", "v").agg(F.bool_or("passable").alias("passable"))


CONTACTS_SQL = """contacts AS (
  SELECT g, least(u, v) AS u, greatest(u, v) AS v, bool_or((u * 5 + v) % 6 <> 0) AS passable
  FROM (SELECT c_custkey // 12 AS g, c_custkey AS u, unnest([c_custkey + 1, (c_custkey // 12) * 12 + (c_custkey + c_nationkey) % 12]) AS v FROM customer)
  WHERE v // 12 = g AND v <> u GROUP BY g, least(u, v), greatest(u, v))"""
