"""Shared boundaries: witnesses that name one cell, checks against a cell complex, what RCC-8 forgets of them, and regrounding that leaves a boundary's identity alone.

Witnesses are rows (spec, id, cells, a, b, dim): `cells` is the array of cells that the contact occupies, a and b the regions it joins. A request that cannot be met is a row with a reason, so one bad row does not stop the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import RCC8
from .spec import boundary_constraint, boundary_regions


def shared_boundary(requests: DataFrame) -> DataFrame:
    """Two witnesses for every request (spec, a, b, cell, dim), one seen from each region: spec, id, cells, a, b, dim, reason. A refused request is one row without id: same_region, no_cell or bad_contact_dim."""
    reason = F.when(F.col("a") == F.col("b"), "same_region").when(F.coalesce(F.col("cell"), F.lit("")) == "", "no_cell").when(~F.coalesce(F.col("dim").isin(0, 1, 2), F.lit(False)), "bad_contact_dim").otherwise("")
    told = requests.withColumn("reason", reason)
    view = lambda x, y: F.struct(F.concat(F.lit("w:"), "cell", F.lit(":"), F.col(x).cast("string")).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))
    refused = F.struct(F.lit(None).cast("string").alias("id"), F.col("a").alias("x"), F.col("b").alias("y"))
    seen = told.withColumn("w_", F.explode(F.when(F.col("reason") == "", F.array(view("a", "b"), view("b", "a"))).otherwise(F.array(refused))))
    return seen.select("spec", "w_.id", F.array("cell").alias("cells"), F.col("w_.x").alias("a"), F.col("w_.y").alias("b"), "dim", "reason")


def cell_faults(witnesses: DataFrame, cells: DataFrame) -> DataFrame:
    """Witnesses that a cell complex (spec, id, dim) contradicts: spec, id, code, detail. unknown_cell for each cell that it does not have, dim_mismatch where the greatest dimension of the known ones is not the intended one."""
    known = cells.select("spec", F.col("id").alias("cell"), F.col("dim").alias("own"))
    each = witnesses.select("spec", "id", "dim", F.explode(F.array_distinct("cells")).alias("cell")).join(known, ["spec", "cell"], "left")
    unknown = each.filter("own is null").select("spec", "id", F.lit("unknown_cell").alias("code"), F.col("cell").alias("detail"))
    top = each.groupBy("spec", "id", "dim").agg(F.max("own").alias("top")).filter("top is not null and not (top <=> dim)")
    return unknown.unionByName(top.select("spec", "id", F.lit("dim_mismatch").alias("code"), F.col("top").cast("string").alias("detail")))


def witness_views(witnesses: DataFrame, by: list[str]) -> DataFrame:
    """Per group of witnesses: how many there are, whether RCC-8 sees one relation in all of them (every contact is EC), and whether they differ pairwise in dimension or cells."""
    entailed = F.lit(RCC8.bit("EC"))
    counts = witnesses.groupBy(*by).agg(F.count(F.lit(1)).alias("witnesses"), F.count_distinct(entailed).alias("masks"), F.count_distinct(F.struct("dim", "cells")).alias("kinds"))
    return counts.select(*by, "witnesses", (F.col("masks") == 1).alias("collapses"), ((F.col("witnesses") >= 2) & (F.col("kinds") == F.col("witnesses"))).alias("distinguishable"))


def _anchors(witnesses: DataFrame) -> DataFrame:
    """Per cell: the ids of witnesses that name it, and the regions that share it."""
    each = witnesses.select("spec", F.explode("cells").alias("cell"), "id", F.array("a", "b").alias("r"))
    return each.groupBy("spec", "cell").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("r")))).alias("regions"))


def id_stability(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per cell that witnesses named before: whether the same witnesses name it and the same regions share it after."""
    one, two = _anchors(before), _anchors(after).withColumnsRenamed({"ids": "ids_", "regions": "regions_"})
    same = F.coalesce((F.col("ids") == F.col("ids_")) & (F.col("regions") == F.col("regions_")), F.lit(False))
    return one.join(two, ["spec", "cell"], "left").select("spec", "cell", same.alias("stable"))


def reground(cells: DataFrame, constraints: DataFrame, ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcome of every decision (spec, id, cell) on a boundary, and the constraint it is routed to: grounded, or regrounded where a decision of the ledger (spec, id, target) is released first. Refused: not_shared, duplicate_decision, no_constraint, refused_invariant, and unbacked for a grounded constraint that no decision targets. Witnesses are not touched."""
    shared = boundary_regions(cells)
    wall = boundary_constraint(shared, constraints).withColumnRenamed("id", "target")
    held = constraints.select("spec", F.col("id").alias("target"), "status")
    used = ledger.select("spec", "id", F.lit(True).alias("used_")).distinct()
    backed = ledger.select("spec", "target", F.lit(True).alias("backed_")).distinct()
    joined = decisions.join(shared, ["spec", "cell"], "left").join(wall, ["spec", "cell"], "left").join(held, ["spec", "target"], "left").join(used, ["spec", "id"], "left").join(backed, ["spec", "target"], "left")
    outcome = (
        F.when(F.coalesce(F.size("regions"), F.lit(0)) < 2, "not_shared")
        .when(F.col("used_"), "duplicate_decision")
        .when(F.col("target").isNull(), "no_constraint")
        .when(F.col("status") == "invariant", "refused_invariant")
        .when(F.col("status") == "delegated", "grounded")
        .when(F.col("backed_"), "regrounded")
        .otherwise("unbacked")
    )
    return joined.select("spec", "id", "cell", F.when(outcome.isin("grounded", "regrounded"), F.col("target")).alias("target"), outcome.alias("outcome"))
