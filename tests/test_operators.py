"""Boxes, networks, structures, specifications and the solver on small worked cases."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from regionweave.functions import rational as rt
from regionweave.functions.algebra import RCC8, RCC8_BASE, RCC8_TABLE, rcc8_of_rect
from regionweave.operators import boundary as bd
from regionweave.operators import boxes as bx
from regionweave.operators import field as fd
from regionweave.operators import flow as fl
from regionweave.operators import graphs as gr
from regionweave.operators import network as nw
from regionweave.operators import overlay as ov
from regionweave.operators import solve as sv
from regionweave.operators import spec as sp
from regionweave.sources import codec as cd

BOX = "region long, x0 long, x1 long, y0 long, y1 long"


def test_every_pair_has_one_relation_and_all_routes_agree(spark):
    ends = [(a, b) for a in range(-1, 5) for b in range(a + 1, 6)]
    rows = [(i, *x, *y) for i, (x, y) in enumerate(product(ends, repeat=2))]
    one = spark.createDataFrame([(-1, 0, 3, 0, 3)], BOX)
    pairs = bx.all_pairs(one.unionByName(spark.createDataFrame(rows, BOX))).filter("a = -1")
    got = bx.de9im(bx.rectangles(bx.relations(pairs))).select("mask", rcc8_of_rect(F.col("ax"), F.col("ay")).alias("rect"), bx.rcc8_of_de9im().alias("nine"), "contact").collect()
    assert len(got) == len(rows) and {r.mask for r in got} == {1 << i for i in range(8)}
    for r in got:
        assert r.mask == r.rect == r.nine and (r.contact is None) == (r.mask != 2)


def test_buckets_find_the_same_pairs(spark):
    import random

    r = random.Random(1)
    rows = [(i, x, x + r.randint(1, 40), y, y + r.randint(1, 40)) for i, (x, y) in enumerate((r.randint(-60, 60), r.randint(-60, 60)) for _ in range(120))]
    b = spark.createDataFrame(rows, BOX)
    slow = bx.relations(bx.all_pairs(b)).filter("mask <> 1").select("a", "b", "mask")
    fast = bx.relations(bx.touching_pairs(b, cell=7)).select("a", "b", "mask")
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))


def test_degenerate_boxes_and_snapping(spark):
    b = spark.createDataFrame([(1, 0.0, 2.02, 0.0, 1.0)], "region long, x0 double, x1 double, y0 double, y1 double")
    assert bx.snapped(b, 0.5).first().x1 == 2.0
    with pytest.raises(Exception, match="degenerate"):
        bx.snapped(b, 5).collect()


def test_groups():
    assert bx.coarser("euclidean", "affine") == "affine" and bx.finer("affine", "projective") == "affine"
    assert bx.lost("euclidean") == [] and "betweenness" not in bx.lost("homeomorphism")


def test_closure(spark):
    arcs = spark.createDataFrame([("n", "a", "b", 16), ("n", "b", "c", 16), ("m", "a", "b", 8), ("m", "b", "c", 8), ("m", "a", "c", 1)], "net string, i string, j string, mask int")
    closed = nw.closure(arcs)
    got = {(r.net, r.i, r.j): r["mask"] for r in closed.collect()}
    assert got["n", "a", "c"] == 16
    status = {r.net: r.status for r in nw.status(arcs, closed).collect()}
    assert status == {"n": "consistent", "m": "inconsistent"}
    core = nw.unsat_cores(arcs, nw.status(arcs, closed).filter("status = 'inconsistent'")).collect()
    assert len(core) == 3
    with pytest.raises(Exception, match="itself"):
        nw.from_edges(spark.createDataFrame([("n", "a", "a", 1)], arcs.schema)).collect()


def test_solver_agrees_with_the_composition_table():
    for i, j, k in product(range(8), repeat=3):
        found, _ = sv.search("ABC", [("A", "B", 1 << i, None), ("B", "C", 1 << j, None), ("A", "C", 1 << k, None)], 2)
        assert (found == "sat") == bool(RCC8_TABLE[i][j] >> k & 1)


@pytest.mark.parametrize("axes", [2, 3])
def test_solver_round_trip(axes):
    for i, _ in enumerate(RCC8_BASE):
        found, b = sv.search("AB", [("A", "B", 1 << i, None)], axes, (0, 20))
        assert found == "sat" and sv.relation(b["A"], b["B"]) == 1 << i
    for k in range(3):
        found, b = sv.search("AB", [("A", "B", 2, k)], 3)
        assert sum(x[0] < y[1] and y[0] < x[1] for x, y in zip(b["A"], b["B"], strict=True)) == k


def test_ladder():
    assert sv.ladder([("c1", "A", "B", 2), ("c2", "A", "B", 1)])["status"] == "inconsistent"
    assert sv.ladder([("c", "A", "B", 1)], [("w", "A", "B", 2)])["ids"] == ["c"]
    assert sv.ladder([], [("w", "A", "B", 1), ("v", "B", "A", 0)])["status"] == "inconsistent"
    done = sv.ladder([], [("w", "A", "B", 1)])
    assert done["status"] == "realized_in_selected_domain_D" and done["ids"] == ["witness:w"]
    assert sv.ladder([("c", "A", "B", 16)], bounds=(0, 1), min_size=1) == {"status": "unknown", "ids": ["c"], "boxes": {}}
    assert sv.ladder([("c", "A", "B", 2)], narrowed={"c": 1})["status"] == "unknown"
    assert sv.ladder([("c", "A", "B", 2)], realize=False)["status"] == "rcc_consistent"


def test_overlay(spark):
    pts = spark.createDataFrame([(1, "R1"), (2, "R1"), (2, "R2"), (3, "R2"), (3, "R1"), (4, "R1"), (4, "R3"), (5, None)], "point int, region string")
    atoms = ov.build(pts)
    assert {tuple(r.members) for r in atoms.collect()} == {("R1",), ("R1", "R2"), ("R1", "R3")}
    assert ov.covering(atoms).count() == 2 and ov.closure_defects(atoms).count() == 0
    defect = ov.closure_defects(atoms.filter("size(members) > 1")).collect()
    assert [r.shared for r in defect] == [["R1"]]
    with pytest.raises(Exception, match="unknown region"):
        ov.build(pts, spark.createDataFrame([("R1",)], "id string")).collect()


def test_fields(spark):
    line = spark.createDataFrame([(0, j, v) for j, v in enumerate((1, 3, 5, 3, 1))], "i0 int, i1 int, value int")
    assert {r.i1 for r in fd.threshold(line, 5, 2).collect()} == {1, 2, 3} and {r.i1 for r in fd.threshold(line, 4, 1).collect()} == {2}
    parts = fd.components(spark.createDataFrame([(0, 0), (0, 1), (1, 1), (4, 4), (3, 3)], "i0 int, i1 int"))
    assert sorted((r.component, r.i0, r.i1) for r in parts.collect()) == [(0, 0, 0), (0, 0, 1), (0, 1, 1), (1, 3, 3), (2, 4, 4)]
    assert fd.components(parts.limit(0)).count() == 0
    walls, eye = spark.createDataFrame([(1.0, 3.0, 1.0, 3.0)], "x0 double, x1 double, y0 double, y1 double"), spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0)], "id int, px double, py double")
    got = {r.id: r for r in fd.isovist(eye, walls, (0.0, 5.0, 0.0, 5.0)).collect()}
    clear = fd.isovist(eye, walls.limit(0).unionByName(spark.createDataFrame([(9.0, 9.5, 9.0, 9.5)], walls.schema)), (0.0, 5.0, 0.0, 5.0)).collect()
    assert got[2].area == 0 and got[2].occlusivity == 1 and 0 < got[1].area < {r.id: r for r in clear}[1].area


def test_flows(spark):
    v, e, f = fl.grid(spark, 2, 2)
    unit = spark.createDataFrame([("eh:0:0", 1), ("eh:1:0", 1), ("ev:2:0", 1), ("ev:2:1", 1)], "cell string, value int")
    div = {r.vertex: r.value for r in fl.divergence(unit, e, v).collect() if r.value}
    assert div == {"v:0:0": 1, "v:2:2": -1}
    assert fl.manifold_guard(f).count() == 0 and v.count() == 9 and e.count() == 12


def test_graphs(spark):
    path = spark.createDataFrame([(0, 0, 1, True), (0, 1, 2, True)], "g int, u int, v int, passable boolean")
    d = gr.depths(path, gr.nodes_of(path).select("g", F.col("node").alias("root")))
    ra = {r.root: r.ra_num / r.ra_den for r in gr.integration(d).collect()}
    assert ra == {0: 1.0, 1: 0.0, 2: 1.0}
    assert {r.node: r.choice for r in gr.choice(path).collect()} == {0: 0.0, 1: 1.0, 2: 0.0}
    star = spark.createDataFrame([(0, "a", "b"), (0, "b", "c"), (1, "a", "b"), (1, "b", "a"), (2, "a", "b"), (2, "a", "b"), (2, "b", "a"), (2, "b", "c")], "g int, u string, v string")
    blocks = {(r.g, r.node): r.block for r in gr.dm_blocks(star).collect()}
    assert blocks == {(0, "a"): "under", (0, "b"): "under", (0, "c"): "under", (1, "a"): "well", (1, "b"): "well", (2, "a"): "over", (2, "b"): "over", (2, "c"): "well"}


def test_spec_edits(spark):
    c = spark.createDataFrame([("s", "c1", "a", "b", 2, "delegated"), ("s", "c2", "b", "c", 1, "invariant")], "spec string, id string, src string, dst string, mask int, status string")
    d = spark.createDataFrame([("s", "g1", "c1"), ("s", "g2", "c2"), ("s", "g3", "no")], "spec string, id string, target string")
    assert {r.id: r.outcome for r in sp.ground(c, d).collect()} == {"g1": "grounded", "g2": "refused_invariant", "g3": "unknown_target"}
    chain = spark.range(1).select(sp.effect_faults(F.array(*map(F.lit, ("path_consistency", "solve", "affine_map", "distance", "fly")))).alias("f")).first().f
    assert [(f["index"], f["kind"]) for f in chain] == [(3, "missing-requirement"), (4, "unknown-operation")]


def test_codec(spark):
    c = spark.createDataFrame([("s", "c1", "a b", "b", 6, "delegated")], "spec string, id string, src string, dst string, mask int, status string")
    r = spark.createDataFrame([("s", "a b"), ("s", "b")], "spec string, id string")
    doc = cd.spec_documents(c, r)
    assert '"rcc8_names":["EC","PO"]' in doc.first().doc
    assert [tuple(x) for x in cd.read_documents(doc).select("id", "src", "dst", "mask").collect()] == [("c1", "a b", "b", 6)]
    assert cd.turtle(c.withColumn("mask", F.lit(2))).first().turtle.endswith("ex:a%20b bot:adjacentZone ex:b .\n")


def test_rationals(spark):
    one = spark.range(1)
    x, y = rt.rat(F.lit(2), F.lit(-4)), rt.parse(F.lit("0.25"))
    got = one.select(x.alias("x"), y.alias("y"), rt.add(x, y).alias("z"), rt.less(x, y).alias("l"), rt.parse(F.lit("x")).alias("n")).first()
    assert (tuple(got.x), tuple(got.y), tuple(got.z), got.l, got.n) == ((-1, 2), (1, 4), (-1, 4), True, None)


def test_entry_without_training_data():
    import os
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'rcc8_hist' in q and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert done.returncode == 0, done.stderr


def test_streamed_specifications(spark, tmp_path):
    from regionweave.streaming.specs import run_stream

    schema = "spec string, scenario string, kind string, id string, a string, b string, value int"
    rows = spark.createDataFrame([("s", "s0", "c", "c1", "A", "B", 2), ("t", "s0", "c", "c1", "A", "B", 1), ("t", "s0", "c", "c2", "A", "B", 2)], schema)
    rows.write.parquet(str(tmp_path / "in"))
    got = {}
    q = run_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda df, n: got.update({r.spec: r.status for r in df.collect()}), str(tmp_path / "checkpoint"))
    q.awaitTermination(120)
    assert got == {"s": "realized_in_selected_domain_D", "t": "inconsistent"}


def test_shared_wall_keeps_its_identity_when_regrounded(spark):
    asked = spark.createDataFrame([(1, "A", "B", "F17", 2), (1, "A", "A", "F18", 2), (1, "A", "B", "", 2), (1, "A", "B", "F19", 3)], "spec int, a string, b string, cell string, dim int")
    w = bd.shared_boundary(asked)
    assert sorted((r.id or "", r.a, r.b, r.reason) for r in w.collect()) == [("", "A", "A", "same_region"), ("", "A", "B", "bad_contact_dim"), ("", "A", "B", "no_cell"), ("w:F17:A", "A", "B", ""), ("w:F17:B", "B", "A", "")]
    w = w.filter("reason = ''")
    assert [tuple(r) for r in bd.id_stability(w, w).collect()] == [(1, "F17", True)]
    assert [r.stable for r in bd.id_stability(w, w.limit(0)).collect()] == [False]
    cells = spark.createDataFrame([(1, "F17", "A"), (1, "F17", "B")], "spec int, cell string, region string")
    for status, ledger, outcome in [("delegated", [], "grounded"), ("grounded", [(1, "old", "wall")], "regrounded"), ("grounded", [], "unbacked"), ("invariant", [], "refused_invariant"), ("delegated", [(1, "d1", "x")], "duplicate_decision")]:
        c = spark.createDataFrame([(1, "wall", "A", "B", 2, status)], "spec int, id string, src string, dst string, mask int, status string")
        held = spark.createDataFrame(ledger, "spec int, id string, target string")
        d = spark.createDataFrame([(1, "d1", "F17")], "spec int, id string, cell string")
        assert bd.reground(cells, c, held, d).first().outcome == outcome
    face, line = (spark.createDataFrame([(1, "w", ["F1"], "A", "B", d)], "spec int, id string, cells array<string>, a string, b string, dim int") for d in (2, 1))
    (view,) = bd.witness_views(face.unionByName(line), ["spec"]).collect()
    assert view.collapses and view.distinguishable
    complex_ = spark.createDataFrame([(1, "F1", 2)], "spec int, id string, dim int")
    assert bd.cell_faults(face, complex_).count() == 0 and bd.cell_faults(line, complex_).first().code == "dim_mismatch"
    assert bd.cell_faults(face, complex_.limit(0)).first().code == "unknown_cell"
