"""From documents to documents: editing, observing, solving and verifying specifications that arrive as JSON, and the guard of what a session may not change.

Tables are those of `sources.codec.read_specs`; an edit that cannot be made is a row with a reason, an unreadable document an error document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions.algebra import RCC8
from ..functions.durable import durable
from ..sources import codec as cd
from . import solve as sv
from .boxes import AXES, snapped

#: Contact dimensions by name.
CONTACT = {"point": 0, "line": 1, "edge": 1, "face": 2}


def with_regions(regions: DataFrame, named: DataFrame, declared: bool = True) -> DataFrame:
    """Regions (spec, id, declared_origin) and those of `named` (spec, id) that were missing, each once."""
    new = named.select("spec", "id").filter("id is not null").distinct().join(regions.select("spec", "id"), ["spec", "id"], "left_anti")
    return regions.unionByName(new.withColumn("declared_origin", F.lit(declared)), allowMissingColumns=True)


def dimension_of(name: Column) -> Column:
    """A contact dimension from its name or number; null for anything else."""
    word = F.lower(F.trim(name.cast("string")))
    return F.coalesce(*[F.when(word == n, d) for n, d in CONTACT.items()], F.when(word.isin("0", "1", "2"), word.cast("int")))


def witness_id(regions: Column, dim: Column, component: Column | int = 0) -> Column:
    """The id of a witness that was given none: equal regions, dimension and component give equal ids."""
    at = component if isinstance(component, Column) else F.lit(component)
    return F.concat(F.lit("w:"), F.array_join(F.transform(regions, lambda r: r.cast("string")), "-"), F.lit(":d"), dim.cast("string"), F.lit(":c"), at.cast("string"))


def add_witnesses(witnesses: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of every request (spec, a, b, dim: a name or a number) to witness a contact: spec, id, a, b, dim, outcome. added; present where the same id is there with the same dimension; conflict with another dimension; bad_contact_dim. Equal requests are one."""
    asked = requests.select("spec", "a", "b", dimension_of(F.col("dim")).alias("dim")).distinct()
    asked = asked.withColumn("id", witness_id(F.array("a", "b"), F.col("dim")))
    held = witnesses.groupBy("spec", "id").agg(F.min("intended_contact_dimension").alias("h_"))
    outcome = F.when(F.col("dim").isNull(), "bad_contact_dim").when(F.col("h_").isNull(), "added").when(F.col("h_") == F.col("dim"), "present").otherwise("conflict")
    return asked.join(held, ["spec", "id"], "left").select("spec", "id", "a", "b", "dim", outcome.alias("outcome"))


def lift(boxes: DataFrame, tolerance: float = 0, dims: int = 2) -> dict[str, DataFrame]:
    """Tables of the specification that drawings show, from boxes (spec, region, pos, x0, x1, ...): a delegated constraint for each pair of a drawing in order of pos, and a witness marked as observed for each contact. Ends are snapped to `tolerance` first; a box that loses its room fails the query.

    Every pair of one drawing is a constraint of its document, so the result is as large as a document of it must be; drawings are dealt to tasks by their keys.
    """
    b = snapped(boxes, tolerance, dims).withColumn("region", F.col("region").cast("string"))
    side = lambda s: b.select("spec", F.col("region").alias(s), F.col("pos").alias(f"{s}_p"), *[F.col(f"{d}{e}").alias(f"{s}_{d}{e}") for d in AXES[dims] for e in (0, 1)])
    pairs = side("a").join(side("b"), "spec").filter(F.struct("a_p", "a") < F.struct(F.col("b_p").alias("a_p"), F.col("b").alias("a")))
    span = lambda s: [(F.col(f"{s}_{d}0"), F.col(f"{s}_{d}1")) for d in AXES[dims]]
    mask = iv.rcc8(span("a"), span("b"))
    seen = pairs.select("spec", "a", "b", "a_p", "b_p", mask.alias("mask"), F.when(mask == RCC8.bit("EC"), iv.contact_dimension(span("a"), span("b"))).cast("int").alias("dim"))
    text = F.array_sort(F.collect_set("region"))
    given = F.struct(F.lit("lift").alias("activity"), F.lit("observer").alias("actor"), text.alias("inputs"), F.lit(f"observed_tolerant;tolerance={tolerance}").alias("note"), F.lit("lift").alias("origin"))
    prov = b.groupBy("spec").agg(given.alias("prov"))
    c = seen.select("spec", F.concat(F.lit("lift:"), "a", F.lit("->"), "b").alias("id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.col("mask").alias("rcc8_mask"), F.lit("delegated").alias("status"), F.dense_rank().over(W.partitionBy("spec").orderBy("a_p", "a", "b_p", "b")).alias("pos")).join(prov, "spec")
    w = seen.filter("dim is not null").select("spec", witness_id(F.array("a", "b"), F.col("dim")).alias("id"), F.array("a", "b").alias("incident_regions"), F.col("dim").alias("intended_contact_dimension"), F.lit("observed_tolerant").alias("epistemic")).join(prov, "spec")
    r = b.select("spec", F.col("region").alias("id"), F.lit(False).alias("declared_origin")).join(prov, "spec")
    return {"specs": b.select("spec").distinct(), "regions": r, "constraints": c, "witnesses": w}


def _rows(t: dict[str, DataFrame]) -> DataFrame:
    """Constraints and witnesses of tables as rows for the solver; a witness of many regions is one row for each pair."""
    name = F.when(F.col("id") == "", F.concat("src", F.lit("->"), "dst")).otherwise(F.col("id"))
    c = t["constraints"].select("spec", F.lit("c").alias("kind"), name.alias("id"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("rcc8_mask").alias("value"))
    each = F.expr("explode(flatten(transform(incident_regions, (x, i) -> transform(slice(incident_regions, i + 2, size(incident_regions)), y -> struct(x as a, y as b)))))")
    w = t["witnesses"].select("spec", F.lit("w").alias("kind"), "id", F.col("intended_contact_dimension").alias("value"), each.alias("p")).select("spec", "kind", "id", "p.a", "p.b", "value")
    return c.unionByName(w)


def solve_documents(docs: DataFrame, scenario: str = "", **options) -> DataFrame:
    """A realization document (spec, doc) for every specification document (spec, doc), or an error document for one that cannot be read: boxes in order of region, and the constraints' ids under satisfied, violated or undecided as the status says. An empty specification is realized by no boxes."""
    t = cd.read_specs(docs)
    rows = durable(_rows(t)).withColumn("scenario", F.lit(scenario))
    done = durable(sv.run(rows, **options))
    ids = F.when(F.col("ids") == "", F.array().cast("array<string>")).otherwise(F.split("ids", ","))
    own = t["constraints"].groupBy("spec").agg(F.array_sort(F.collect_set(F.when(F.col("id") == "", F.concat("src", F.lit("->"), "dst")).otherwise(F.col("id")))).alias("own"))
    none = F.array().cast("array<string>")
    status = F.coalesce("status", F.lit("realized_in_selected_domain_D"))
    told = t["specs"].select("spec").join(done, "spec", "left").join(own, "spec", "left").withColumn("s_", status)
    real = told.select(
        F.col("spec").alias("real"), F.lit(f"pipeline:{scenario or 0}").alias("id"), F.col("s_").alias("status"), F.lit(scenario).alias("scenario_id"),
        F.when(F.col("s_") == "rcc_consistent", F.coalesce("own", none)).when(F.col("s_") == "realized_in_selected_domain_D", F.coalesce(ids, none)).otherwise(none).alias("satisfied"),
        F.when(F.col("s_") == "inconsistent", F.when(F.size(ids) > 0, ids).otherwise(F.coalesce("own", none))).otherwise(none).alias("violated"),
        F.when(F.col("s_") == "unknown", ids).otherwise(none).alias("undecided"),
    )
    found = done.select(F.col("spec").alias("real"), F.explode(F.from_json("boxes", "map<string, array<array<string>>>")).alias("region_id", "ends"))
    cut = lambda at: F.transform("ends", lambda e: F.struct(F.coalesce(F.get(F.split(e[at], "/"), F.lit(1)), F.lit("1")).cast("bigint").alias("den"), F.get(F.split(e[at], "/"), F.lit(0)).cast("bigint").alias("num")))
    boxes = found.select("real", "region_id", F.col("region_id").alias("id"), cut(0).alias("lo"), cut(1).alias("hi"))
    out = cd.write_realizations(real, boxes).withColumnRenamed("real", "spec")
    bad = cd.error_documents(t["faults"]).unionByName(told.filter("s_ = 'malformed'").select("spec", F.lit('{"error":{"message":"a region related to itself","type":"PipelineError"}}').alias("doc")))
    return out.join(bad.select("spec"), "spec", "left_anti").unionByName(bad)


# --- what a session may not change ---


def decided(constraints: DataFrame) -> DataFrame:
    """Constraints that a reading of geometry leaves alone: spec, id, mask, status of the grounded and the invariant ones."""
    return constraints.filter("status in ('grounded', 'invariant')").select("spec", "id", "mask", "status")


def invariants(constraints: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ids of the invariant core (spec, id): by status, or named in `ledger` (spec, id)."""
    return constraints.filter("status = 'invariant'").select("spec", "id").unionByName(ledger.select("spec", "id")).distinct()


def guard(before: DataFrame, after: DataFrame, core: DataFrame, decisions_before: DataFrame, decisions_after: DataFrame) -> DataFrame:
    """Why a whole specification may not replace another (spec, code, id), none if it may: ledger_changed where the decisions (spec, pos, id) are not the same in order, dropped_invariant and altered_invariant for ids of `core` (spec, id) that are gone or have another mask or status."""
    trail = lambda d: d.groupBy("spec").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("l"))
    moved = trail(decisions_before).join(trail(decisions_after).withColumnRenamed("l", "m"), "spec", "full").filter("not (transform(l, x -> x.id) <=> transform(m, x -> x.id))")
    b = before.select("spec", "id", F.col("mask").alias("was"))
    a = after.select("spec", "id", "mask", "status", F.lit(True).alias("there"))
    kept = core.join(b, ["spec", "id"], "left").join(a, ["spec", "id"], "left")
    code = F.when(F.col("there").isNull(), "dropped_invariant").when((F.col("status") != "invariant") | (F.col("was").isNotNull() & (F.col("was") != F.col("mask"))), "altered_invariant")
    return moved.select("spec", F.lit("ledger_changed").alias("code"), F.lit("").alias("id")).unionByName(kept.select("spec", code.alias("code"), "id").filter("code is not null"))
