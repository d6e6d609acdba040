"""Documents of every kind of record, and reduction before solving, on small worked cases."""

import json

from regionweave.operators import adapters as ad
from regionweave.operators import reduce as rd
from regionweave.operators import solve as sv
from regionweave.sources import codec as cd


def test_text_is_canonical_and_defaults_are_filled(spark):
    given = {
        "regions": [{"id": "a"}, {"id": "b", "semantic_type": "hall \"1\"", "declared_origin": False, "prov": {"origin": "lift"}}],
        "constraints": [{"src": "a", "dst": "b", "rcc8_mask": 6}],
        "witnesses": [{"id": "w", "intended_contact_dimension": 1, "incident_regions": ["b", "a"]}],
        "overlays": [{"id": "o", "members": ["b", "a"]}],
        "groundings": [{"id": "g", "target": "c"}],
    }
    docs = spark.createDataFrame([("s", json.dumps(given)), ("e", "{}")], "spec string, doc string")
    t = cd.read_specs(docs)
    assert t["faults"].isEmpty() and {r.spec: r.schema_version for r in t["specs"].collect()} == {"s": "0.0.1", "e": "0.0.1"}
    c, w, g = (t[k].first() for k in ("constraints", "witnesses", "groundings"))
    assert (c.status, c.id, c.rcc8_mask) == ("delegated", "", 6) and (w.epistemic, w.boundary_role, w.incident_regions) == ("asserted", "shared_boundary", ["b", "a"])
    assert (g.actor, g.reversibility) == ("designer", "high") and sorted(t["observations"].first().kinds) == sorted(cd.OBSERVED)
    again = {r.spec: r.doc for r in cd.write_specs(t["specs"], t).collect()}
    for text in again.values():
        assert json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == text
    full = json.loads(again["s"])
    assert full["overlays"][0]["members"] == ["a", "b"] and full["constraints"][0]["rcc8_names"] == ["EC", "PO"] and [r["id"] for r in full["regions"]] == ["a", "b"]
    assert cd.write_specs(t["specs"], cd.read_specs(spark.createDataFrame(list(again.items()), "spec string, doc string"))).exceptAll(cd.write_specs(t["specs"], t)).isEmpty()


def test_bad_documents_are_rows(spark):
    bad = {"cut": "{", "null": None, "list": "[1]", "mask": '{"constraints":[{"src":"a","dst":"b"}]}', "status": '{"constraints":[{"src":"a","dst":"b","rcc8_mask":1,"status":"x"}]}', "range": '{"constraints":[{"src":"a","dst":"b","rcc8_mask":256}]}', "fine": '{"extra":1}'}
    t = cd.read_specs(spark.createDataFrame(list(bad.items()), "spec string, doc string"))
    assert {r.spec for r in t["faults"].collect()} == set(bad) - {"fine"} and t["constraints"].isEmpty()
    errors = {r.spec: json.loads(r.doc)["error"]["message"] for r in cd.error_documents(t["faults"]).collect()}
    assert errors["mask"] == "constraints: rcc8_mask is missing" and errors["range"] == "constraints: mask out of range"
    assert cd.write_specs(t["specs"].limit(0), t).isEmpty()


def test_realizations_take_exact_fractions_alone(spark):
    half = '{"id":"r","boxes":[{"region_id":"a","lo":[{"num":1,"den":2}],"hi":[{"num":%s,"den":%s}]}],"status":"%s"}'
    docs = spark.createDataFrame([("ok", half % (3, 4, "unknown")), ("float", half % (0.5, 1, "unknown")), ("zero", half % (1, 0, "unknown")), ("rung", half % (1, 1, "done"))], "real string, doc string")
    real, boxes, faults = cd.read_realizations(docs)
    assert [r.real for r in real.collect()] == ["ok"] and boxes.first().hi[0].num == 3
    assert {r.real for r in faults.collect()} == {"float", "zero", "rung"}
    text = cd.write_realizations(real, boxes).first().doc
    assert json.loads(text)["boxes"][0]["lo"] == [{"den": 2, "num": 1}] and json.loads(text)["schema_version"] == "0.0.1"


def test_small_records(spark):
    loss = cd.write_records(spark.createDataFrame([("x", "relspec", "rdf", ["a"], ["b"])], "k string, source_kind string, target_kind string, preserved array<string>, dropped array<string>"), "losses")
    bad = spark.createDataFrame([("twice", '{"source_kind":"a","target_kind":"b","preserved":["x"],"dropped":["x"]}'), ("empty", '{"source_kind":"a","target_kind":"b","reversible":true}'), ("no", "nothing")], "k string, doc string")
    got = {r.k: r for r in cd.read_records(loss.select("k", "doc").unionByName(bad), "losses").collect()}
    assert got["x"].fault is None and got["x"].preserved == ["a"] and got["x"].reversible is False
    assert (got["twice"].fault, got["empty"].fault, got["no"].fault) == ("an aspect has two fates", "reversible without preserved aspects", "not a record")
    contract = cd.read_records(spark.createDataFrame([("{}",)], "doc string"), "contracts").first()
    assert (contract.domain, contract.timeout_ms, contract.objectives) == ("aabb_2d", 10000, [])
    assert cd.read_records(cd.write_records(spark.createDataFrame([("f", 2)], "id string, dim int"), "cells").select("doc"), "cells").first().dim == 2


def test_reduction(spark):
    regions = spark.createDataFrame([("s", x, i) for i, x in enumerate("zyxwv")], "spec string, id string, ord int")
    rows = [("c1", "x", "z", 128), ("c2", "y", "x", 24), ("c3", "w", "y", 16), ("c4", "z", "x", 4), ("c5", "v", "y", 9), ("c6", "z", "x", 128 | 2)]
    c = spark.createDataFrame([("s", *r) for r in rows], "spec string, id string, src string, dst string, mask int")
    bounds = spark.createDataFrame([("s", "z", "x", 0, None), ("s", "x", "x", None, 10), ("s", "y", "x", 4, 20), ("s", "w", "x", None, 4)], "spec string, region string, axis string, lo int, hi int")
    w = spark.createDataFrame([("s", "w1", ["x", "y", "z"]), ("s", "w0", [])], "spec string, id string, regions array<string>")
    t = rd.presolved(regions, c, bounds, w, w.withColumnRenamed("regions", "members"))
    assert [(r.id, r.rep) for r in t["substitutions"].collect()] == [("x", "z")] and {r.id for r in t["regions"].collect()} == set("zywv")
    assert {r.region: (r.lo, r.hi) for r in t["bounds"].collect()} == {"z": (0, 10), "y": (4, 10), "w": (4, 4)}
    assert {r.id for r in t["dropped"].collect()} == {"c1", "c6"}
    assert {(r.code, r.a) for r in t["contradictions"].collect()} == {("self_relation", "c4"), ("empty_domain", "w"), }
    assert {r.id: r.regions for r in t["witnesses"].collect()} == {"w1": ["z", "y"], "w0": []} and {r.id: r.members for r in t["overlays"].collect()} == {"w1": ["y", "z"], "w0": []}
    none = rd.presolved(regions.limit(0), c.limit(0), bounds.limit(0))
    assert none["bounds"].isEmpty() and none["contradictions"].isEmpty()


def test_turtle_of_a_whole_document(spark):
    given = {"regions": [{"id": "a/b.", "declared_origin": False}], "constraints": [{"src": "a/b.", "dst": "c*", "rcc8_mask": 16}, {"src": "x", "dst": "y", "rcc8_mask": 0, "id": "q"}], "witnesses": [{"id": "w", "intended_contact_dimension": 1, "incident_regions": ["x"]}], "groundings": [{"id": "g", "target": "q", "rationale": 'so "it" is\n'}], "overlays": [{"id": "o"}]}
    t = cd.read_specs(spark.createDataFrame([("s", json.dumps(given)), ("e", "{}")], "spec string, doc string"))
    text = {r.spec: r.turtle for r in cd.spec_turtle(t).collect()}
    assert text["e"] == cd.PREFIXES and "ex:c%2A bot:containsZone ex:a%2Fb%2E ." in text["s"] and 't:rationale "so \\"it\\" is\\n" .' in text["s"] and 't:rcc8 "EMPTY" .' in text["s"]
    assert {(r.category, r.subject) for r in cd.spec_losses(t).collect()} == {("field_origin", "a/b."), ("disjunction", "q"), ("delegated_freedom", "q"), ("delegated_freedom", "constraint/a/b.--c*"), ("contact_dimension", "w"), ("overlay_atom", "o")}


BOX = "spec string, region string, pos int, x0 long, x1 long, y0 long, y1 long"


def test_lift_and_solve_documents(spark):
    b = spark.createDataFrame([("s", "b", 0, 0, 4, 0, 4), ("s", "a", 1, 4, 6, 0, 4), ("s", "c", 2, 1, 2, 1, 2)], BOX)
    t = ad.lift(b)
    docs = cd.write_specs(t["specs"], t)
    read = cd.read_specs(docs)
    assert [(r.id, r.rcc8_mask) for r in read["constraints"].orderBy("pos").collect()] == [("lift:b->a", 2), ("lift:b->c", 64), ("lift:a->c", 1)]
    assert read["witnesses"].first().id == "w:b-a:d1:c0" and read["regions"].first().prov.note == "observed_tolerant;tolerance=0"
    bad = spark.createDataFrame([("bad", "{"), ("own", '{"constraints":[{"src":"a","dst":"a","rcc8_mask":1}]}'), ("none", "{}"), ("no", '{"constraints":[{"src":"a","dst":"b","rcc8_mask":1,"id":"p"},{"src":"b","dst":"a","rcc8_mask":2,"id":"q"}]}')], "spec string, doc string")
    out = {r.spec: json.loads(r.doc) for r in ad.solve_documents(docs.unionByName(bad)).collect()}
    assert out["bad"]["error"]["message"] == "not a specification" and out["own"]["error"]["type"] == "PipelineError"
    assert out["no"]["status"] == "inconsistent" and out["no"]["violated"] == ["p", "q"] and out["none"]["boxes"] == []
    got = out["s"]
    assert got["status"] == "realized_in_selected_domain_D" and len(got["satisfied"]) == 3
    ends = {x["region_id"]: [(lo["num"] / lo["den"], hi["num"] / hi["den"]) for lo, hi in zip(x["lo"], x["hi"], strict=True)] for x in got["boxes"]}
    assert sv.relation(ends["b"], ends["a"]) == 2 and sv.relation(ends["b"], ends["c"]) == 64 and sv.relation(ends["a"], ends["c"]) == 1


def test_witness_requests_and_regions(spark):
    held = spark.createDataFrame([("s", "w:a-b:d1:c0", 1), ("s", "w:a-c:d2:c0", 0)], "spec string, id string, intended_contact_dimension int")
    asked = spark.createDataFrame([("s", "a", "b", " Edge "), ("s", "a", "b", "1"), ("s", "a", "c", "face"), ("s", "b", "c", "0"), ("s", "b", "c", "round"), ("s", "b", "c", None)], "spec string, a string, b string, dim string")
    assert sorted((r.a + r.b, r.outcome) for r in ad.add_witnesses(held, asked).collect()) == [("ab", "present"), ("ac", "conflict"), ("bc", "added"), ("bc", "bad_contact_dim")]
    r = spark.createDataFrame([("s", "a", False)], "spec string, id string, declared_origin boolean")
    named = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "b"), ("s", None)], "spec string, id string")
    assert {x.id: x.declared_origin for x in ad.with_regions(r, named).collect()} == {"a": False, "b": True}


def test_guard(spark):
    c = spark.createDataFrame([("s", "i", 1, "invariant"), ("s", "j", 2, "invariant"), ("s", "k", 4, "delegated")], "spec string, id string, mask int, status string")
    core = ad.invariants(c, spark.createDataFrame([("s", "k")], "spec string, id string"))
    log = spark.createDataFrame([("s", 0, "g")], "spec string, pos int, id string")
    after = spark.createDataFrame([("s", "i", 1, "invariant"), ("s", "j", 1, "invariant")], "spec string, id string, mask int, status string")
    assert {(r.code, r.id) for r in ad.guard(c, after, core, log, log).collect()} == {("altered_invariant", "j"), ("dropped_invariant", "k")}
    assert [r.code for r in ad.guard(c, c, ad.invariants(c, log.limit(0)), log, log.limit(0)).collect()] == ["ledger_changed"]
    assert {r.id for r in ad.decided(c).collect()} == {"i", "j"}
