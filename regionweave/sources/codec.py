"""Specifications and realizations as JSON documents, Turtle text, and content hashes.

Fields of the schemas stand in alphabetical order and nulls are written, so the text of a document is canonical and its digest is stable. A document becomes one table per kind of record and back; `pos` is a record's place in its list. A document that cannot be read is a row of reasons in `faults` and gives no records, so one bad document does not stop the others. Numerators and denominators are 64-bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.algebra import RCC8

SCHEMA_VERSION = "0.0.1"
PROV = "struct<activity:string,actor:string,inputs:array<string>,note:string,origin:string>"
RAT = "struct<den:bigint,num:bigint>"
CONSTRAINT = f"struct<dst:string,id:string,prov:{PROV},rcc8_mask:int,rcc8_names:array<string>,src:string,status:string>"
REGION = f"struct<declared_origin:boolean,id:string,prov:{PROV},semantic_type:string>"
WITNESS = f"struct<boundary_role:string,cell_ids:array<string>,component_index:int,epistemic:string,id:string,incident_regions:array<string>,intended_contact_dimension:int,prov:{PROV}>"
OVERLAY = f"struct<id:string,members:array<string>,nonempty:boolean,prov:{PROV}>"
GROUNDING = f"struct<actor:string,fixed_value_or_domain:string,id:string,prov:{PROV},rationale:string,reversibility:string,target:string>"
INVARIANT = "struct<relation_invariants:array<string>,witness_invariants:array<string>>"
OBSERVATION = "struct<kinds:array<string>>"
BOX = f"struct<hi:array<{RAT}>,lo:array<{RAT}>,region_id:string>"
CELL = "struct<dim:int,id:string>"
CONTRACT = "struct<completeness_claim:string,domain:string,objectives:array<string>,solver:string,timeout_ms:int>"
LOSSES = f"struct<approximated:array<string>,dropped:array<string>,preserved:array<string>,provenance:{PROV},reversible:boolean,scope_note:string,source_kind:string,target_kind:string>"

#: Lists of a specification: name and schema of a record.
LISTS = {"constraints": CONSTRAINT, "groundings": GROUNDING, "overlays": OVERLAY, "regions": REGION, "witnesses": WITNESS}
SPEC = f"struct<constraints:array<{CONSTRAINT}>,groundings:array<{GROUNDING}>,invariant:{INVARIANT},observation:{OBSERVATION},overlays:array<{OVERLAY}>,regions:array<{REGION}>,schema_version:string,witnesses:array<{WITNESS}>>"
REALIZATION = f"struct<boxes:array<{BOX}>,id:string,prov:{PROV},satisfied:array<string>,scenario_id:string,schema_version:string,status:string,undecided:array<string>,violated:array<string>>"

# Names that documents may hold, and what a missing field means.
STATUS = ("invariant", "grounded", "delegated")
EPISTEMIC = ("asserted", "derived_exact", "observed_tolerant", "undecided")
RUNGS = ("abstract", "rcc_consistent", "realized_in_selected_domain_D", "fabrication_valid", "inconsistent", "unknown")
OBSERVED = ("atom_occupancy", "cell_identity", "contact_dimension", "rcc8")
MISSING = {
    "constraints": {"id": "", "status": "delegated"},
    "groundings": {"actor": "designer", "fixed_value_or_domain": "", "rationale": "", "reversibility": "high"},
    "overlays": {"nonempty": True},
    "regions": {"declared_origin": True, "semantic_type": ""},
    "witnesses": {"boundary_role": "shared_boundary", "component_index": 0, "epistemic": "asserted"},
    "contracts": {"completeness_claim": "sound_within_selected_domain", "domain": "aabb_2d", "solver": "z3", "timeout_ms": 10000},
}
NEEDED = {"constraints": ("src", "dst", "rcc8_mask"), "groundings": ("id", "target"), "overlays": ("id",), "regions": ("id",), "witnesses": ("id", "intended_contact_dimension")}
_BAD = "_corrupt_record"


def encode(value: Column) -> Column:
    """Canonical JSON of a struct whose fields are in alphabetical order."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def decode(text: Column, schema: str) -> Column:
    """A struct from JSON; missing fields are null, text that is no JSON fails the query."""
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def _gently(text: Column, schema: str) -> Column:
    """A struct from JSON with the text itself in `_corrupt_record` where it does not fit the schema: no JSON, or a value of another type, such as a decimal point in a fraction."""
    return F.from_json(text, schema[:-1] + f",{_BAD}:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _fields(schema: str) -> dict[str, str]:
    """Top-level fields of a struct type."""
    out, depth, part = [], 0, ""
    for ch in schema[len("struct<") : -1]:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += ch
    return dict(p.split(":", 1) for p in [*out, part])


def _record(columns: list[str], schema: str, missing: dict) -> Column:
    """A record of the columns that a table has; the others take what a missing field means, lists are empty."""
    parts = []
    for name, kind in _fields(schema).items():
        value = F.col(name).cast(kind) if name in columns else F.lit(None).cast(kind)
        default = F.lit(missing[name]).cast(kind) if name in missing else F.array().cast(kind) if kind.startswith("array") else None
        parts.append((value if default is None else F.coalesce(value, default)).alias(name))
    return F.struct(*parts)


def _listed(table: DataFrame, key: str, name: str, record: Column, schema: str) -> DataFrame:
    """Per key, records in order of pos where the table has it, then of id and of their text."""
    pos = F.col("pos").cast("long") if "pos" in table.columns else F.lit(0).cast("long")
    own = F.col("id").cast("string") if "id" in table.columns else F.lit("")
    rows = table.select(key, F.struct(pos.alias("p"), own.alias("i"), encode(record).alias("t"), record.alias("v")).alias("r_"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("r_")), lambda x: x["v"]).cast(f"array<{schema}>").alias(name))


def write_specs(specs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One JSON document (spec, doc) for every row of `specs` (spec, and schema_version if it has it).

    `tables` has any of constraints, groundings, overlays, regions, witnesses (spec, pos, and fields of the record, prov among them), invariants (spec, relation_invariants, witness_invariants: one row a spec) and observations (spec, kinds: one row a spec). A missing table or field takes its default. Names of relations are derived from masks; members and kinds are sets, written in order.
    """
    out = specs.select("spec", (F.coalesce("schema_version", F.lit(SCHEMA_VERSION)) if "schema_version" in specs.columns else F.lit(SCHEMA_VERSION)).alias("schema_version"))
    for name, schema in LISTS.items():
        t = tables.get(name)
        if t is None:
            out = out.withColumn(name, F.array().cast(f"array<{schema}>"))
            continue
        if name == "constraints":
            t = t.withColumn("rcc8_names", F.array_sort(RCC8.names_of(F.col("rcc8_mask"))))
        if name == "overlays":
            t = t.withColumn("members", F.array_sort(F.array_distinct(F.col("members").cast("array<string>"))))
        listed = _listed(t, "spec", name, _record(t.columns, schema, MISSING[name]), schema)
        out = out.join(listed, "spec", "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{schema}>")))
    in_order = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>"))))
    inv, obs = tables.get("invariants"), tables.get("observations")
    if inv is None:
        out = out.withColumns({"relation_invariants": F.array().cast("array<string>"), "witness_invariants": F.array().cast("array<string>")})
    else:
        out = out.join(inv.select("spec", "relation_invariants", "witness_invariants"), "spec", "left")
    out = out.withColumn("kinds", F.lit(None).cast("array<string>")) if obs is None else out.join(obs.select("spec", "kinds"), "spec", "left")
    kinds = F.when(F.col("kinds").isNull(), F.array(*map(F.lit, OBSERVED))).otherwise(in_order("kinds"))
    doc = F.struct("constraints", "groundings", F.struct(in_order("relation_invariants").alias("relation_invariants"), in_order("witness_invariants").alias("witness_invariants")).alias("invariant"), F.struct(kinds.alias("kinds")).alias("observation"), "overlays", "regions", "schema_version", "witnesses")
    return out.select("spec", encode(doc.cast(SPEC)).alias("doc"))


def _faults(d: Column) -> Column:
    """Reasons why a parsed specification cannot be taken, as an array of text."""
    any_of = lambda name, test: F.coalesce(F.exists(d[name], lambda r: F.coalesce(test(r), F.lit(False))), F.lit(False))
    checks = [(any_of(name, lambda r, f=f: r[f].isNull()), f"{name}: {f} is missing") for name, fs in NEEDED.items() for f in fs]
    checks.append((any_of("constraints", lambda r: ~F.coalesce(r["status"], F.lit("delegated")).isin(*STATUS)), "constraints: unknown status"))
    checks.append((any_of("constraints", lambda r: (r["rcc8_mask"] < 0) | (r["rcc8_mask"] > 255)), "constraints: mask out of range"))
    checks.append((any_of("witnesses", lambda r: ~F.coalesce(r["epistemic"], F.lit("asserted")).isin(*EPISTEMIC)), "witnesses: unknown epistemic status"))
    return F.when(d.isNull() | d[_BAD].isNotNull(), F.array(F.lit("not a specification"))).otherwise(F.array_compact(F.array(*[F.when(test, text) for test, text in checks])))


def read_specs(docs: DataFrame) -> dict[str, DataFrame]:
    """Tables of JSON documents (spec, doc): faults (spec, fault), specs (spec, schema_version), one table per kind of record (spec, pos and its fields, defaults filled), invariants and observations. Null, empty and unreadable documents are faults; an empty object is an empty specification. Documents with a fault give no records."""
    parsed = docs.select("spec", _gently(F.col("doc"), SPEC).alias("d")).withColumn("f", _faults(F.col("d")))
    good = parsed.filter(F.size("f") == 0)
    out = {"faults": parsed.select("spec", F.explode("f").alias("fault")), "specs": good.select("spec", F.coalesce("d.schema_version", F.lit(SCHEMA_VERSION)).alias("schema_version"))}
    for name, schema in LISTS.items():
        rows = good.select("spec", F.posexplode(f"d.{name}").alias("pos", "r")).select("spec", "pos", "r.*")
        out[name] = rows.select("spec", "pos", _record(rows.columns, schema, MISSING[name]).alias("r")).select("spec", "pos", "r.*")
    none = F.array().cast("array<string>")
    out["invariants"] = good.select("spec", *[F.coalesce(f"d.invariant.{n}", none).alias(n) for n in ("relation_invariants", "witness_invariants")])
    kinds = F.when(F.col("d.observation").isNull(), F.array(*map(F.lit, OBSERVED))).otherwise(F.coalesce("d.observation.kinds", none))
    out["observations"] = good.select("spec", kinds.alias("kinds"))
    return out


def write_realizations(realizations: DataFrame, boxes: DataFrame) -> DataFrame:
    """One JSON document (real, doc) for every realization (real, and any of id, status, satisfied, violated, undecided, scenario_id, prov) with its boxes (real, pos, region_id, lo, hi: arrays of fractions)."""
    r = realizations.withColumn("schema_version", F.lit(SCHEMA_VERSION))
    listed = _listed(boxes, "real", "boxes", _record(boxes.columns, BOX, {}), BOX)
    joined = r.join(listed, "real", "left")
    return joined.select("real", encode(_record(joined.columns, REALIZATION, {"id": "", "scenario_id": "", "status": "unknown"})).alias("doc"))


def read_realizations(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Realizations (real and fields), their boxes (real, pos, region_id, lo, hi) and faults (real, fault) of JSON documents (real, doc). A coordinate that is no exact fraction, an unknown status and a box without region or of unequal corners are faults."""
    parsed = docs.select("real", _gently(F.col("doc"), REALIZATION).alias("d"))
    d = F.col("d")
    whole = lambda xs: F.forall(xs, lambda c: c["num"].isNotNull() & c["den"].isNotNull() & (c["den"] != 0))
    fine = F.forall(d["boxes"], lambda b: F.coalesce(b["region_id"].isNotNull() & (F.size(b["lo"]) == F.size(b["hi"])) & whole(b["lo"]) & whole(b["hi"]), F.lit(False)))
    checks = [(d.isNull() | d[_BAD].isNotNull(), "not a realization"), (~F.coalesce(fine, F.lit(True)), "boxes: not exact"), (d["id"].isNull(), "id is missing"), (~F.coalesce(d["status"], F.lit("unknown")).isin(*RUNGS), "unknown status")]
    parsed = parsed.withColumn("f", F.array_compact(F.array(*[F.when(t, m) for t, m in checks])))
    good = parsed.filter(F.size("f") == 0).select("real", "d.*")
    filled = good.select("real", _record(good.columns, REALIZATION, {"id": "", "scenario_id": "", "status": "unknown"}).alias("r")).select("real", "r.*")
    boxes = filled.select("real", F.posexplode("boxes").alias("pos", "b")).select("real", "pos", "b.region_id", "b.lo", "b.hi")
    return filled.drop("boxes"), boxes, parsed.select("real", F.explode("f").alias("fault"))


def write_records(table: DataFrame, kind: str) -> DataFrame:
    """One JSON text per row, in a column doc, of small records: cells (id, dim), contracts (of a solver) and losses (reports on what a translation keeps)."""
    schema = {"cells": CELL, "contracts": CONTRACT, "losses": LOSSES}[kind]
    missing = MISSING.get(kind, {"reversible": False, "scope_note": ""} if kind == "losses" else {})
    return table.withColumn("doc", encode(_record(table.columns, schema, missing)))


def read_records(docs: DataFrame, kind: str) -> DataFrame:
    """The fields of records written by `write_records` in place of doc, defaults filled, and `fault`: null, or why the text is refused. A loss report names an aspect once, and is reversible only if it preserves one."""
    schema = {"cells": CELL, "contracts": CONTRACT, "losses": LOSSES}[kind]
    missing = MISSING.get(kind, {"reversible": False, "scope_note": ""} if kind == "losses" else {})
    keep = [c for c in docs.columns if c != "doc"]
    raw = docs.select(*keep, _gently(F.col("doc"), schema).alias("d_"))
    d = F.col("d_")
    fault = F.when(d.isNull() | d[_BAD].isNotNull(), "not a record")
    if kind == "cells":
        fault = fault.when(d["id"].isNull() | d["dim"].isNull(), "id or dim is missing")
    if kind == "losses":
        none = F.array().cast("array<string>")
        named = F.concat(*[F.coalesce(d[n], none) for n in ("approximated", "dropped", "preserved")])
        fault = fault.when(d["source_kind"].isNull() | d["target_kind"].isNull(), "kind is missing").when(F.exists(named, lambda x: x.isNull() | (x == "")), "empty aspect").when(F.size(F.array_distinct(named)) < F.size(named), "an aspect has two fates").when(F.coalesce(d["reversible"], F.lit(False)) & (F.coalesce(F.size(d["preserved"]), F.lit(0)) == 0), "reversible without preserved aspects")
    wide = raw.select(*keep, fault.alias("fault"), *[d[n].alias(n) for n in _fields(schema)])
    return wide.select(*keep, "fault", _record(wide.columns, schema, missing).alias("d_")).select(*keep, "fault", "d_.*")


def error_documents(faults: DataFrame, key: str = "spec") -> DataFrame:
    """One JSON error document (key, doc) per unreadable document, in place of a result: {"error": {"message", "type"}}."""
    text = F.array_join(F.array_sort(F.collect_set("fault")), "; ")
    return faults.groupBy(key).agg(text.alias("m_")).select(key, encode(F.struct(F.struct(F.col("m_").alias("message"), F.lit("ValueError").alias("type")).alias("error"))).alias("doc"))


def spec_documents(constraints: DataFrame, regions: DataFrame) -> DataFrame:
    """One JSON document per specification (spec, doc) from constraints (spec, id, src, dst, mask, status) and regions (spec, id), each in order of id as text."""
    c = constraints.select("spec", "id", "src", "dst", F.col("mask").alias("rcc8_mask"), "status")
    return write_specs(regions.select("spec").distinct(), {"constraints": c, "regions": regions.select("spec", "id")})


def read_documents(docs: DataFrame) -> DataFrame:
    """Constraints (spec, id, src, dst, mask, status) of JSON documents (spec, doc); names are ignored, documents with a fault have none."""
    return read_specs(docs)["constraints"].select("spec", "id", "src", "dst", F.col("rcc8_mask").alias("mask"), "status")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Documents from a folder of JSON files, one a file: spec (the file's name), doc."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1).alias("spec"), F.col("value").alias("doc"))


def save(docs: DataFrame, path: str) -> None:
    """One JSON document a line."""
    docs.select("doc").write.mode("errorifexists").text(path)


# --- Turtle ---

# Prefixes and the term for each relation that has one.
PREFIXES = "@prefix bot: <https://w3id.org/bot#> .\n@prefix prov: <http://www.w3.org/ns/prov#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n@prefix ex: <urn:regions:> .\n@prefix t: <urn:regions:terms:> .\n"
ADJACENT, CONTAINS = "bot:adjacentZone", "bot:containsZone"


def iri(local: Column) -> Column:
    """A local name as an IRI: characters that a name may not hold are percent-escaped."""
    safe = F.url_encode(local)
    for raw, esc in (("+", "%20"), ("*", "%2A"), ("%3A", ":")):
        safe = F.replace(safe, F.lit(raw), F.lit(esc))
    return F.concat(F.lit("ex:"), F.regexp_replace(safe, r"\.$", "%2E"))


def literal(text: Column) -> Column:
    """A string literal with backslash, quote and line ends escaped."""
    out = text
    for raw, esc in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(esc))
    return F.concat(F.lit('"'), out, F.lit('"'))


def triples(constraints: DataFrame) -> DataFrame:
    """Triples (spec, s, p, o) of constraints with a single relation that has a term: contact and overlap are adjacency, containment points from the larger region to the smaller."""
    m = F.col("mask")
    s, d = iri(F.col("src").cast("string")), iri(F.col("dst").cast("string"))
    out = F.when(m.isin(2, 4), F.struct(s.alias("s"), F.lit(ADJACENT).alias("p"), d.alias("o"))).when(m.isin(8, 16), F.struct(d.alias("s"), F.lit(CONTAINS).alias("p"), s.alias("o"))).when(m.isin(32, 64), F.struct(s.alias("s"), F.lit(CONTAINS).alias("p"), d.alias("o")))
    return constraints.select("spec", out.alias("t")).filter("t is not null").select("spec", "t.s", "t.p", "t.o")


def loss_items(constraints: DataFrame) -> DataFrame:
    """What the triples do not say (spec, id, category): disjunction, partial_overlap, equality, and delegated_freedom of constraints still open to change."""
    m = F.col("mask")
    kinds = F.array_compact(F.array(F.when(F.bit_count(m) > 1, "disjunction"), F.when(m == 4, "partial_overlap"), F.when(m == 128, "equality"), F.when(F.col("status") == "delegated", "delegated_freedom")))
    return constraints.select("spec", "id", F.explode(kinds).alias("category"))


def turtle(constraints: DataFrame) -> DataFrame:
    """One Turtle text per specification: prefixes, then its triples in order."""
    line = F.concat_ws(" ", "s", "p", "o", F.lit("."))
    return triples(constraints).groupBy("spec").agg(F.concat(F.lit(PREFIXES), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n")).alias("turtle"))


def _statements(rows: DataFrame, subject: Column, parts: list[tuple[str, Column]]) -> DataFrame:
    """Triples (spec, s, p, o) about one subject a row; an object that is null gives none."""
    said = F.array_compact(F.array(*[F.when(o.isNotNull(), F.struct(F.lit(p).alias("p"), o.alias("o"))) for p, o in parts]))
    return rows.select("spec", subject.alias("s"), F.explode(said).alias("t_")).select("spec", "s", "t_.p", "t_.o")


def _constraint_name() -> Column:
    return F.when(F.col("id") != "", F.col("id")).otherwise(F.concat(F.lit("constraint/"), "src", F.lit("--"), "dst"))


def _contact_name(dim: Column) -> Column:
    return F.when(dim == 0, "point").when(dim == 1, "line").when(dim == 2, "face").otherwise(dim.cast("string"))


def spec_triples(tables: dict[str, DataFrame]) -> DataFrame:
    """All triples (spec, s, p, o) of specifications as `read_specs` gives them: regions as spaces, constraints with relation, status and the adjacency or containment they amount to, witnesses as interfaces, decisions as activities of agents. Each triple once."""
    filled = lambda c: F.when(F.col(c) != "", literal(F.col(c)))
    r, c, w, g = (tables[k] for k in ("regions", "constraints", "witnesses", "groundings"))
    out = _statements(r, iri(F.col("id")), [("a", F.lit("bot:Space")), ("rdfs:label", filled("semantic_type")), ("t:semanticType", filled("semantic_type")), ("t:declaredOrigin", F.col("declared_origin").cast("string"))])
    names = F.array_join(RCC8.names_of(F.col("rcc8_mask")), "|")
    out = out.unionByName(_statements(c, iri(_constraint_name()), [("a", F.lit("t:RelationConstraint")), ("t:source", iri(F.col("src"))), ("t:target", iri(F.col("dst"))), ("t:rcc8", literal(F.when(names == "", "EMPTY").otherwise(names))), ("t:editStatus", literal(F.col("status")))]))
    out = out.unionByName(triples(c.withColumnRenamed("rcc8_mask", "mask")))
    out = out.unionByName(_statements(w, iri(F.col("id")), [("a", F.lit("bot:Interface")), ("t:contactDimension", literal(_contact_name(F.col("intended_contact_dimension"))))]))
    out = out.unionByName(w.select("spec", iri(F.col("id")).alias("s"), F.lit("bot:interfaceOf").alias("p"), F.explode("incident_regions").alias("r_")).select("spec", "s", "p", iri(F.col("r_")).alias("o")))
    agent = iri(F.concat(F.lit("agent/"), "actor"))
    out = out.unionByName(_statements(g, iri(F.col("id")), [("a", F.lit("prov:Activity")), ("prov:wasAssociatedWith", agent), ("prov:generated", F.when(F.col("target") != "", iri(F.col("target")))), ("t:fixedValue", filled("fixed_value_or_domain")), ("t:rationale", filled("rationale")), ("t:reversibility", literal(F.col("reversibility")))]))
    return out.unionByName(_statements(g, agent, [("a", F.lit("prov:Agent")), ("rdfs:label", literal(F.col("actor")))])).distinct()


def spec_losses(tables: dict[str, DataFrame]) -> DataFrame:
    """What the standard terms among those triples do not say (spec, category, subject): the categories of `loss_items`, contact_dimension of witnesses that are no faces, overlay_atom, and field_origin of regions that nobody declared."""
    c = tables["constraints"].withColumn("id", _constraint_name()).withColumnRenamed("rcc8_mask", "mask")
    base = loss_items(c).select("spec", "category", F.col("id").alias("subject"))
    none = c.filter("mask = 0").select("spec", F.lit("disjunction").alias("category"), F.col("id").alias("subject"))
    of = lambda name, test, kind: tables[name].filter(test).select("spec", F.lit(kind).alias("category"), F.col("id").alias("subject"))
    out = base.unionByName(none).unionByName(of("witnesses", "intended_contact_dimension <> 2", "contact_dimension"))
    return out.unionByName(of("overlays", "true", "overlay_atom")).unionByName(of("regions", "not declared_origin", "field_origin"))


def spec_turtle(tables: dict[str, DataFrame]) -> DataFrame:
    """One Turtle text per specification: prefixes, then all its triples in order; a specification without records is its prefixes."""
    lines = spec_triples(tables).groupBy("spec").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "s", "p", "o", F.lit(".")))), "\n").alias("l_"))
    return tables["specs"].select("spec").join(lines, "spec", "left").select("spec", F.concat(F.lit(PREFIXES), F.coalesce(F.concat(F.lit("\n"), "l_", F.lit("\n")), F.lit(""))).alias("turtle"))
