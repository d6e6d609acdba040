"""Overlays: the distinct sets of regions that points lie in, their order, meets and defects.

An atom is a sorted array of region names (`members`); the order is strict inclusion of the sets. Subsets are found through an equi-join on the atom's least member, so atoms that share nothing never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def atom_id(members: Column) -> Column:
    """Canonical id of a signature: each member behind its length, so that no two signatures share an id."""
    return F.concat(F.lit("o:"), F.array_join(F.transform(F.array_sort(members), lambda m: F.concat(F.length(m).cast("string"), F.lit("~"), m)), ";"))


def build(points: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Atoms of point memberships (point, region): members, nonempty, id, ord. A region missing from `regions` fails the query; points in no region make no atom."""
    if regions is not None:
        known = regions.select(F.col("id").alias("known_")).distinct()
        bad = F.raise_error(F.concat(F.lit("unknown region "), "region")).cast("string")
        points = points.join(known, F.col("region") == F.col("known_"), "left").withColumn("region", F.when(F.col("known_").isNull(), bad).otherwise(F.col("region"))).drop("known_")
    atoms = points.filter("region is not null").groupBy("point").agg(F.array_sort(F.collect_set("region")).alias("members")).select("members").distinct()
    return atoms.select("members", F.lit(True).alias("nonempty"), atom_id(F.col("members")).alias("id"))


def order(atoms: DataFrame) -> DataFrame:
    """Pairs of atoms (a, b) where a is a strict subset of b, by members."""
    a = atoms.select(F.col("members").alias("a"), F.element_at("members", 1).alias("key"))
    b = atoms.select(F.col("members").alias("b"), F.explode("members").alias("key"))
    return a.join(b, "key").filter((F.size("a") < F.size("b")) & (F.size(F.array_except("a", "b")) == 0)).select("a", "b")


def compare(a: Column, b: Column) -> Column:
    """sub, sup, equal or incomparable, of two signatures."""
    less, more = F.size(F.array_except(a, b)) == 0, F.size(F.array_except(b, a)) == 0
    return F.when(less & more, "equal").when(less, "sub").when(more, "sup").otherwise("incomparable")


def covering(atoms: DataFrame) -> DataFrame:
    """The order without pairs that pass through a third atom."""
    o = order(atoms)
    through = o.select("a", F.col("b").alias("m")).join(o.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
    return o.join(through, ["a", "b"], "left_anti")


def pairs(atoms: DataFrame) -> DataFrame:
    """Pairs of atoms that share a region, each once, with what they share."""
    e = atoms.select("members", "id", F.explode("members").alias("key"))
    a, b = e.select(F.col("members").alias("a"), F.col("id").alias("a_id"), "key"), e.select(F.col("members").alias("b"), F.col("id").alias("b_id"), "key")
    return a.join(b, "key").filter("a_id < b_id").select("a", "b").distinct().withColumn("shared", F.array_intersect("a", "b"))


def closure_defects(atoms: DataFrame) -> DataFrame:
    """Pairs of occupied atoms whose common regions, not none, are no occupied atom themselves."""
    held = atoms.filter("nonempty")
    return pairs(held).withColumn("shared", F.array_sort("shared")).join(held.select(F.col("members").alias("shared")).distinct(), "shared", "left_anti").select("a", "b", "shared")


def meets(atoms: DataFrame) -> DataFrame:
    """For every pair of occupied atoms that share a region: their maximal common lower bounds (inclusive) and their number."""
    held = atoms.filter("nonempty")
    own = held.select(F.col("members").alias("low"), F.element_at("members", 1).alias("key"))
    below = pairs(held).select("a", "b", "shared", F.explode("shared").alias("key")).join(own, "key").filter(F.size(F.array_except("low", "shared")) == 0).select("a", "b", "low")
    lows = below.groupBy("a", "b").agg(F.collect_set("low").alias("lows"))  # at most one row an atom: signatures, not points
    top = F.filter("lows", lambda x: ~F.exists("lows", lambda y: (F.size(x) < F.size(y)) & (F.size(F.array_except(x, y)) == 0)))
    found = lows.select("a", "b", top.alias("tops"))
    return pairs(held).select("a", "b").join(found, ["a", "b"], "left").select("a", "b", F.coalesce("tops", F.array().cast("array<array<string>>")).alias("tops")).withColumn("n", F.size("tops"))


def meet_defects(atoms: DataFrame) -> DataFrame:
    """Pairs of occupied atoms without exactly one greatest lower bound. Atoms that share nothing have none; they are found by count, not listed."""
    return meets(atoms).filter("n <> 1")


def is_meet_semilattice(atoms: DataFrame) -> Column:
    """Aggregate input: whether every pair has its meet, given `meets` joined with the number of atoms."""
    return F.bool_and(F.col("n") == 1)


def forbidden(atoms: DataFrame, rules: DataFrame) -> DataFrame:
    """Signatures with a rule (members, must: empty or nonempty) that the overlay breaks, with a code."""
    held = atoms.filter("nonempty").select("members").distinct().withColumn("there", F.lit(True))
    joined = rules.join(held, "members", "left")
    code = F.when((F.col("must") == "empty") & F.col("there"), "forbidden_nonempty").when((F.col("must") == "nonempty") & F.col("there").isNull(), "required_nonempty_but_empty")
    return joined.withColumn("code", code).filter("code is not null").select("members", "code")


def axiom_violations(atoms: DataFrame) -> DataFrame:
    """Atoms (members, id) that break an axiom: empty_signature, id_not_canonical, duplicate_signature."""
    one = atoms.select("members", "id", F.when(F.size("members") == 0, "empty_signature").when(~F.col("id").eqNullSafe(atom_id(F.col("members"))), "id_not_canonical").alias("code")).filter("code is not null")
    twice = atoms.groupBy(F.array_sort(F.array_distinct("members")).alias("members")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n > 1").select("members", "id", F.lit("duplicate_signature").alias("code"))
    return one.unionByName(twice)
