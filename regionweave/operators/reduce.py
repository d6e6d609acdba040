"""Specifications made smaller before they are solved, with a ledger of what was done: regions that are equal become one, domains shrink through containment, and contradictions that show early are rows.

Regions are rows (spec, id, ord: their place in the declaration), constraints (spec, id, src, dst, mask), bounds (spec, region, axis, lo, hi) with null for an open side. Each step keeps the set of solutions; a specification without contradiction here may still have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import RCC8
from ..functions.durable import durable
from .graphs import component_labels

INSIDE = RCC8.mask("TPP", "NTPP", "EQ")
AROUND = RCC8.mask("TPPi", "NTPPi", "EQ")


def representatives(regions: DataFrame, constraints: DataFrame) -> DataFrame:
    """Per region that an equality ties to others (spec, id, rep): the member of its class that was declared first; members that were not declared follow it, and a class of such members alone is left as it is."""
    eq = constraints.filter((F.col("mask") == RCC8.equal) & (F.col("src") != F.col("dst"))).select(F.col("spec").alias("g"), F.col("src").alias("u"), F.col("dst").alias("v"))
    member = component_labels(eq).select(F.col("g").alias("spec"), F.col("node").alias("id"), "label")
    placed = member.join(regions.select("spec", "id", "ord"), ["spec", "id"], "left")
    first = placed.groupBy("spec", "label").agg(F.min_by("id", F.struct(F.col("ord").isNull().alias("u"), "ord", "id")).alias("rep"), F.count("ord").alias("declared")).filter("declared > 0")
    return member.join(first, ["spec", "label"]).select("spec", "id", "rep")


def _moved(rows: DataFrame, reps: DataFrame, column: str) -> DataFrame:
    """`rows` with representatives in place of the regions in `column`."""
    r = reps.select("spec", F.col("id").alias(column), "rep")
    return rows.join(r, ["spec", column], "left").withColumn(column, F.coalesce("rep", column)).drop("rep").select(*rows.columns)


def _moved_lists(rows: DataFrame, reps: DataFrame, column: str, ordered: bool) -> DataFrame:
    """`rows` (spec, id, `column`: array of regions) with representatives, each once: in the first place it had, or in order."""
    each = _moved(rows.select("spec", "id", F.posexplode(column).alias("p_", "r_")), reps, "r_")
    once = each.groupBy("spec", "id", "r_").agg(F.min("p_").alias("p_")).groupBy("spec", "id")
    listed = once.agg(F.transform(F.array_sort(F.collect_list(F.struct("p_", "r_"))), lambda x: x["r_"]).alias("l_") if ordered else F.array_sort(F.collect_list("r_")).alias("l_"))
    kept = rows.join(listed, ["spec", "id"], "left")
    return kept.withColumn(column, F.coalesce("l_", F.slice(column, 1, 0))).select(*rows.columns)


def rewritten(constraints: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Constraints between representatives, and those dropped since they hold of themselves (a region to itself, equality allowed)."""
    moved = _moved(_moved(constraints, reps, "src"), reps, "dst")
    trivial = (F.col("src") == F.col("dst")) & (F.col("mask").bitwiseAND(F.lit(RCC8.equal)) != 0)
    return moved.filter(~trivial), moved.filter(trivial).select("spec", "id")


def tightened(constraints: DataFrame, bounds: DataFrame) -> DataFrame:
    """Bounds (spec, region, axis, lo, hi) after every contained region has taken those of the regions around it, through any number of containments. A region without bounds takes its containers'.

    In a round only regions that changed hand their bounds on, so rounds follow the depth of containment; masks that leave containment open hand nothing on.
    """
    m = F.col("mask")
    inner = constraints.filter((m != 0) & (m.bitwiseAND(F.lit(255 & ~INSIDE)) == 0)).select("spec", F.col("src").alias("inner"), F.col("dst").alias("region"))
    outer = constraints.filter((m != 0) & (m.bitwiseAND(F.lit(255 & ~AROUND)) == 0) & (m.bitwiseAND(F.lit(255 & ~INSIDE)) != 0)).select("spec", F.col("dst").alias("inner"), F.col("src").alias("region"))
    edges = durable(inner.unionByName(outer).filter("inner <> region").distinct())
    key = ["spec", "region", "axis"]
    now = durable(bounds.groupBy(*key).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi")).withColumn("news", F.lit(True)))
    while True:
        told = now.filter("news").join(edges, ["spec", "region"]).select("spec", F.col("inner").alias("region"), "axis", "lo", "hi", F.lit(False).alias("own"))
        both = now.select(*key, "lo", "hi", F.lit(True).alias("own")).unionByName(told)
        mine = lambda c: F.max(F.when(F.col("own"), F.col(c)))
        new = both.groupBy(*key).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"), mine("lo").alias("l_"), mine("hi").alias("h_"), F.bool_or("own").alias("o_"))
        now = durable(new.select(*key, "lo", "hi", (~(F.col("lo").eqNullSafe(F.col("l_")) & F.col("hi").eqNullSafe(F.col("h_")) & F.col("o_"))).alias("news")))
        if now.filter("news").isEmpty():
            return now.drop("news")


def presolved(regions: DataFrame, constraints: DataFrame, bounds: DataFrame, witnesses: DataFrame | None = None, overlays: DataFrame | None = None) -> dict[str, DataFrame]:
    """The smaller specification and its ledger: regions, constraints, witnesses (spec, id, regions), overlays (spec, id, members), substitutions (spec, id, rep), dropped (spec, id), bounds, and contradictions (spec, code, a, b).

    Codes: empty_mask of a constraint (a its id), self_relation that excludes equality (a its id, b the region), empty_pair of constraints on one pair that have nothing in common, empty_domain with no room for a box on an axis (b). No bounds, no tightening: pass an empty table.
    """
    reps = durable(representatives(regions, constraints))
    kept, dropped = rewritten(constraints, reps)
    kept = durable(kept)
    text = lambda c: F.col(c).cast("string")
    row = lambda df, code, a, b: df.select("spec", F.lit(code).alias("code"), a.alias("a"), b.alias("b"))
    turned = F.when(F.col("src") <= F.col("dst"), F.col("mask")).otherwise(RCC8.converse(F.col("mask")))
    pairs = kept.select("spec", F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), turned.alias("m")).groupBy("spec", "x", "y").agg(F.bit_and("m").alias("m"))
    domains = durable(tightened(kept, _moved(bounds, reps, "region")))
    found = row(constraints.filter("mask = 0"), "empty_mask", text("id"), F.lit(""))
    found = found.unionByName(row(kept.filter("src = dst"), "self_relation", text("id"), text("src")))
    found = found.unionByName(row(pairs.filter("m = 0"), "empty_pair", text("x"), text("y")))
    found = found.unionByName(row(domains.filter("lo >= hi"), "empty_domain", text("region"), text("axis")))
    gone = reps.filter("id <> rep")
    out = {"regions": regions.join(gone.select("spec", "id"), ["spec", "id"], "left_anti"), "constraints": kept, "dropped": dropped, "bounds": domains, "contradictions": found}
    out["substitutions"] = gone.join(regions.select("spec", "id"), ["spec", "id"], "left_semi")
    if witnesses is not None:
        out["witnesses"] = _moved_lists(witnesses, reps, "regions", True)
    if overlays is not None:
        out["overlays"] = _moved_lists(overlays, reps, "members", False)
    return out
