"""Cochains on an oriented complex of vertices, edges and faces.

Edges are rows (edge, tail, head), faces rows (face, edge, sign), cochains rows (cell, value); a cell without a row has value 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, nx: int, ny: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, edges and faces of an nx by ny grid, with text ids."""
    at = lambda n0, n1: spark.range(n0 * n1).selectExpr(f"id div {n1} as i", f"id % {n1} as j")
    v = lambda i, j: f"concat_ws(':', 'v', {i}, {j})"
    vertices = at(nx + 1, ny + 1).selectExpr(f"{v('i', 'j')} as vertex")
    across = at(nx, ny + 1).selectExpr("concat_ws(':', 'eh', i, j) as edge", f"{v('i', 'j')} as tail", f"{v('i + 1', 'j')} as head")
    up = at(nx + 1, ny).selectExpr("concat_ws(':', 'ev', i, j) as edge", f"{v('i', 'j')} as tail", f"{v('i', 'j + 1')} as head")
    sides = "array(struct(concat_ws(':', 'eh', i, j) as edge, 1 as sign), struct(concat_ws(':', 'ev', i + 1, j) as edge, 1 as sign), struct(concat_ws(':', 'eh', i, j + 1) as edge, -1 as sign), struct(concat_ws(':', 'ev', i, j) as edge, -1 as sign))"
    faces = at(nx, ny).selectExpr("concat_ws(':', 'f', i, j) as face", f"explode({sides}) as s").selectExpr("face", "s.edge", "s.sign")
    return vertices, across.unionByName(up), faces


def _of(cochain: DataFrame, name: str) -> DataFrame:
    return cochain.select(F.col("cell").alias(name), F.col("value").alias(f"{name}_"))


def d0(c0: DataFrame, edges: DataFrame) -> DataFrame:
    """Per edge: the value at its head less that at its tail."""
    joined = edges.join(_of(c0, "head"), "head", "left").join(_of(c0, "tail"), "tail", "left")
    return joined.select(F.col("edge").alias("cell"), (F.coalesce("head_", F.lit(0)) - F.coalesce("tail_", F.lit(0))).alias("value"))


def d1(c1: DataFrame, face_edges: DataFrame) -> DataFrame:
    """Per face: the signed sum around it."""
    joined = face_edges.join(_of(c1, "edge"), "edge", "left")
    return joined.groupBy(F.col("face").alias("cell")).agg(F.sum(F.col("sign") * F.coalesce("edge_", F.lit(0))).alias("value"))


def divergence(c1: DataFrame, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per vertex: what leaves it less what enters; 0 where nothing does."""
    e = edges.join(_of(c1, "edge"), "edge")
    ends = e.select(F.col("tail").alias("vertex"), F.col("edge_").alias("w")).unionByName(e.select(F.col("head").alias("vertex"), (-F.col("edge_")).alias("w")))
    total = ends.groupBy("vertex").agg(F.sum("w").alias("value"))
    return vertices.select("vertex").join(total, "vertex", "left").select("vertex", F.coalesce("value", F.lit(0)).alias("value"))


def conservation(div: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Vertices whose divergence is not what `source` (vertex, value; 0 by default) prescribes."""
    if source is None:
        return div.filter("value <> 0").withColumn("prescribed", F.lit(0))
    return div.join(source.select("vertex", F.col("value").alias("s_")), "vertex", "left").withColumn("prescribed", F.coalesce("s_", F.lit(0))).drop("s_").filter("value <> prescribed")


def sources_sinks(div: DataFrame) -> DataFrame:
    return div.filter("value <> 0").withColumn("kind", F.when(F.col("value") > 0, "source").otherwise("sink"))


def manifold_guard(face_edges: DataFrame) -> DataFrame:
    """Edges on the border of three different faces or more."""
    return face_edges.groupBy("edge").agg(F.count_distinct("face").alias("faces")).filter("faces >= 3")


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two cochains agree, missing cells counting as 0."""
    both = _of(a, "x").join(_of(b, "y"), F.col("x") == F.col("y"), "full")
    return both.agg(F.coalesce(F.bool_and(F.coalesce("x_", F.lit(0)) == F.coalesce("y_", F.lit(0))), F.lit(True)).alias("equal"))


def is_zero(c: DataFrame) -> DataFrame:
    return c.agg(F.coalesce(F.bool_and(F.col("value") == 0), F.lit(True)).alias("zero"))


def flow_graph(c1: DataFrame, edges: DataFrame) -> DataFrame:
    """Directed flow: every edge turned along its flow, edges without flow left out, magnitudes of parallel edges added, with their contributions in order of edge."""
    e = edges.join(_of(c1, "edge"), "edge").filter("edge_ <> 0")
    turned = e.select(F.when(F.col("edge_") > 0, F.col("tail")).otherwise(F.col("head")).alias("u"), F.when(F.col("edge_") > 0, F.col("head")).otherwise(F.col("tail")).alias("v"), "edge", F.col("edge_").alias("w"))
    return turned.groupBy("u", "v").agg(F.sum(F.abs("w")).alias("weight"), F.array_sort(F.collect_list(F.struct("edge", "w"))).alias("parts"))
