"""Queries of overlays, fields, flows and graphs, with the SQL that expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import field as fd
from ..operators import flow as fl
from ..operators import graphs as gr
from ..operators import overlay as ov
from ..sources import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- overlays ---

_ATOMS = f"""{fx.POINTS_SQL}, atoms AS (SELECT DISTINCT members FROM (SELECT point, list_sort(list_distinct(list(region))) AS members FROM points GROUP BY point))"""
_J = "array_to_string({x}, ',')"
_SUB = "len(a.members) < len(b.members) AND list_has_all(b.members, a.members)"
_ORDER = f"{_ATOMS}, ord AS (SELECT a.members AS a, b.members AS b FROM atoms a JOIN atoms b ON {_SUB})"


def _atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ov.build(fx.points(spark, sf_dir))


def _flat(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.array_join(n, ",").alias(n) if n in names else F.col(n) for n in df.columns])


@query(f"WITH {_ATOMS} SELECT {_J.format(x='members')} AS members, 'o:' || array_to_string(list_transform(members, lambda m: len(m) || '~' || m), ';') AS id FROM atoms")
def overlay_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_atoms(spark, sf_dir).select("members", "id"), "members")


@query(f"WITH {_ORDER} SELECT {_J.format(x='a')} AS a, {_J.format(x='b')} AS b FROM ord")
def overlay_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(ov.order(_atoms(spark, sf_dir)), "a", "b")


@query(f"WITH {_ORDER} SELECT {_J.format(x='a')} AS a, {_J.format(x='b')} AS b FROM ord o WHERE NOT EXISTS (SELECT 1 FROM ord x JOIN ord y ON x.b = y.a WHERE x.a = o.a AND y.b = o.b)")
def overlay_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(ov.covering(_atoms(spark, sf_dir)), "a", "b")


_OPAIRS = f"""{_ATOMS}, keyed AS (SELECT members, 'o:' || array_to_string(list_transform(members, lambda m: len(m) || '~' || m), ';') AS id FROM atoms),
op AS (SELECT a.members AS a, b.members AS b, list_sort(list_intersect(a.members, b.members)) AS shared FROM keyed a JOIN keyed b ON a.id < b.id AND list_has_any(a.members, b.members))"""


_EVEN = f"""{_ATOMS}, held AS (SELECT members, 'o:' || array_to_string(list_transform(members, lambda m: len(m) || '~' || m), ';') AS id FROM atoms WHERE len(members) % 2 = 0),
op AS (SELECT a.members AS a, b.members AS b, list_sort(list_intersect(a.members, b.members)) AS shared FROM held a JOIN held b ON a.id < b.id AND list_has_any(a.members, b.members))"""


def _even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of which those with an odd number of regions are said to be empty, so that meets are missing and ambiguous."""
    return _atoms(spark, sf_dir).withColumn("nonempty", F.size("members") % 2 == 0)


@query(f"WITH {_EVEN} SELECT {_J.format(x='a')} AS a, {_J.format(x='b')} AS b, {_J.format(x='shared')} AS shared FROM op WHERE shared NOT IN (SELECT members FROM held)")
def closure_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(ov.closure_defects(_even(spark, sf_dir)), "a", "b", "shared")


@query(f"""WITH {_EVEN}, low AS (SELECT a, b, m.members AS l FROM op JOIN held m ON list_has_all(op.shared, m.members)),
top AS (SELECT a, b, count(*) AS n FROM low x WHERE NOT EXISTS (SELECT 1 FROM low y WHERE y.a = x.a AND y.b = x.b AND len(y.l) > len(x.l) AND list_has_all(y.l, x.l)) GROUP BY a, b)
SELECT {_J.format(x='op.a')} AS a, {_J.format(x='op.b')} AS b, CAST(coalesce(n, 0) AS INT) AS n FROM op LEFT JOIN top ON op.a = top.a AND op.b = top.b WHERE coalesce(n, 0) <> 1""")
def meet_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(ov.meet_defects(_even(spark, sf_dir)).select("a", "b", "n"), "a", "b")


@query(f"""WITH {_ATOMS}, rules AS (SELECT members, 'empty' AS must FROM atoms WHERE len(members) = 2 UNION ALL SELECT ['no such region'], 'nonempty')
SELECT {_J.format(x='members')} AS members, CASE WHEN must = 'empty' THEN 'forbidden_nonempty' ELSE 'required_nonempty_but_empty' END AS code FROM rules""")
def overlay_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = _atoms(spark, sf_dir)
    rules = atoms.filter(F.size("members") == 2).select("members", F.lit("empty").alias("must")).unionByName(spark.range(1).select(F.array(F.lit("no such region")).alias("members"), F.lit("nonempty").alias("must")))
    return _flat(ov.forbidden(atoms, rules), "members")


@query(f"""WITH {_ATOMS} SELECT {_J.format(x='members')} AS members, 'bad' AS id, 'id_not_canonical' AS code FROM atoms WHERE len(members) = 1
UNION ALL SELECT {_J.format(x='members')}, 'bad', 'duplicate_signature' FROM atoms WHERE len(members) = 1""")
def overlay_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of one region are repeated under a wrong id; both faults are found."""
    atoms = _atoms(spark, sf_dir)
    wrong = atoms.filter(F.size("members") == 1).withColumn("id", F.lit("bad"))
    return _flat(ov.axiom_violations(atoms.unionByName(wrong)), "members")


# --- fields ---


@query(f"WITH {fx.FIELD_SQL} SELECT i0, i1 FROM field WHERE value * 2 >= (SELECT CAST(2 * avg(value) AS BIGINT) FROM field)")
def field_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.field(spark, sf_dir)
    num = f.agg(F.expr("cast(round(2 * avg(value)) as bigint)")).first()[0]
    return fd.threshold(f, num, 2)


def _members(f: DataFrame) -> DataFrame:
    """Three memberships over one grid: the value, its neighbour's reach and their least."""
    three = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(n).alias("region"), v.alias("value")) for o, n, v in ((0, "warm", F.col("value") % 7), (1, "mild", (F.col("value") * 3) % 7), (2, "cool", (F.col("value") * 5) % 7))])
    return f.select("i0", "i1", F.explode(three).alias("m")).select("i0", "i1", "m.ord", "m.region", "m.value")


@query(f"WITH {fx.FIELD_SQL} SELECT i0, i1, CASE WHEN value % 7 >= greatest(value * 3 % 7, value * 5 % 7) THEN 'warm' WHEN value * 3 % 7 >= value * 5 % 7 THEN 'mild' ELSE 'cool' END AS region FROM field")
def field_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.argmax(_members(fx.field(spark, sf_dir)))


@query(f"WITH {fx.FIELD_SQL} SELECT bool_or(CAST(value % 7 = 1 AS INT) + CAST(value * 3 % 7 = 1 AS INT) + CAST(value * 5 % 7 = 1 AS INT) <> 1 OR value % 7 > 1 OR value * 3 % 7 > 1 OR value * 5 % 7 > 1) AS ungrounded FROM field")
def field_ungrounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.ungrounded(_members(fx.field(spark, sf_dir)))


@query(f"WITH {fx.FIELD_SQL} SELECT i0, i1, CASE WHEN value % 3 = 0 THEN 1 ELSE 0 END AS value FROM field")
def field_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.indicator(fx.field(spark, sf_dir).filter("value % 3 = 0"), fd.cells(spark, 15, 24))


_COMPONENTS = f"""RECURSIVE {fx.FIELD_SQL}, own AS (SELECT i0, i1, i0 * 24 + i1 AS c FROM field WHERE value % 2 = 0),
near AS (SELECT a.c AS a, b.c AS b FROM own a JOIN own b ON abs(a.i0 - b.i0) + abs(a.i1 - b.i1) = 1),
reach AS (SELECT c, c AS r FROM own UNION SELECT reach.c, near.b FROM reach JOIN near ON reach.r = near.a),
label AS (SELECT c, min(r) AS label FROM reach GROUP BY c),
comp AS (SELECT CAST(c // 24 AS INT) AS i0, CAST(c % 24 AS INT) AS i1, dense_rank() OVER (ORDER BY label) - 1 AS component FROM label)"""


@query(f"WITH {_COMPONENTS} SELECT i0, i1, component FROM comp")
def field_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.components(fx.field(spark, sf_dir).filter("value % 2 = 0"))


@query(f"WITH {_COMPONENTS} SELECT component, count(*) AS n_cells, substr(sha1(string_agg(i0 || ',' || i1, ';' ORDER BY i0, i1)), 1, 12) AS digest FROM comp GROUP BY component")
def field_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.signatures(fd.components(fx.field(spark, sf_dir).filter("value % 2 = 0"))).select("component", "n_cells", "digest")


def _drawing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    walls = fx.read(spark, sf_dir, "nation").selectExpr("(n_nationkey * 7) % 23 as x0", "(n_nationkey * 7) % 23 + 1 + n_regionkey % 2 as x1", "(n_nationkey * 11) % 23 as y0", "(n_nationkey * 11) % 23 + 1 as y1")
    return fx.read(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_custkey % 24 + 0.5d as px", "(c_custkey div 24) % 24 + 0.5d as py"), walls


_RAYS = ", ".join(f"({k}, {dx}::DOUBLE, {dy}::DOUBLE)" for k, (dx, dy) in enumerate(fd.directions(8)))
_SLAB = """CASE WHEN {d} = 0 THEN CASE WHEN {p} >= {lo} AND {p} <= {hi} THEN {s}'inf'::DOUBLE ELSE {t}'inf'::DOUBLE END ELSE ((CASE WHEN {d} > 0 THEN {a} ELSE {b} END) - {p}) / (CASE WHEN {d} = 0 THEN 1 ELSE {d} END) END"""
_IN = lambda p, d, lo, hi: _SLAB.format(p=p, d=d, lo=lo, hi=hi, a=lo, b=hi, s="-", t="")
_OUT = lambda p, d, lo, hi: _SLAB.format(p=p, d=d, lo=lo, hi=hi, a=hi, b=lo, s="", t="-")


@query(f"""WITH p AS (SELECT c_custkey AS id, c_custkey % 24 + 0.5::DOUBLE AS px, (c_custkey // 24) % 24 + 0.5::DOUBLE AS py FROM customer),
o AS (SELECT (n_nationkey * 7) % 23 AS x0, (n_nationkey * 7) % 23 + 1 + n_regionkey % 2 AS x1, (n_nationkey * 11) % 23 AS y0, (n_nationkey * 11) % 23 + 1 AS y1 FROM nation),
r(k, dx, dy) AS (VALUES {_RAYS}),
hit AS (SELECT id, k, min(CASE WHEN lo <= hi AND hi >= 0 THEN greatest(lo, 0) END) AS t FROM (
  SELECT id, k, greatest({_IN('px', 'dx', 'x0', 'x1')}, {_IN('py', 'dy', 'y0', 'y1')}) AS lo, least({_OUT('px', 'dx', 'x0', 'x1')}, {_OUT('py', 'dy', 'y0', 'y1')}) AS hi FROM p, r, o) GROUP BY id, k),
seen AS (SELECT id, k, coalesce(t, 'inf'::DOUBLE) AS t, least({_OUT('px', 'dx', '0.0', '24.0')}, {_OUT('py', 'dy', '0.0', '24.0')}) AS leave, px, py, dx, dy FROM hit JOIN p USING (id) JOIN r USING (k)),
pt AS (SELECT id, k, px + least(t, leave) * dx AS x, py + least(t, leave) * dy AS y, CAST(t < leave AS INT) AS stopped FROM seen),
ring AS (SELECT a.id, a.x * b.y - b.x * a.y AS c, a.stopped FROM pt a JOIN pt b ON a.id = b.id AND b.k = (a.k + 1) % 8),
ins AS (SELECT DISTINCT id FROM p JOIN o ON px >= x0 AND px <= x1 AND py >= y0 AND py <= y1)
SELECT r.id, round(CASE WHEN ins.id IS NOT NULL THEN 0 ELSE abs(sum(c)) / 2 END, 6) AS area, CASE WHEN ins.id IS NOT NULL THEN 1.0::DOUBLE ELSE sum(stopped) / 8 END AS occlusivity FROM ring r LEFT JOIN ins ON r.id = ins.id GROUP BY r.id, ins.id""")
def isovist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every customer's place sees past the walls of a drawing of 25 obstacles."""
    points, walls = _drawing(spark, sf_dir)
    return fd.isovist(points, walls, (0.0, 24.0, 0.0, 24.0)).select("id", F.round("area", 6).alias("area"), "occlusivity")


# --- flows ---

_FACES = "faces AS (SELECT tail * 40 + head AS edge, 'f' || unnest([(tail + head) % 50, (tail * 3 + head) % 50, (tail + 2 * head) % 50]) AS face, CASE WHEN head % 2 = 0 THEN 1 ELSE -1 END AS sign FROM flows)"


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = fx.flows(spark, sf_dir)
    vertices = spark.range(40).select(F.col("id").alias("vertex"))
    return f.select("edge", "tail", "head"), f.select(F.col("edge").alias("cell"), F.col("weight").alias("value")), vertices


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.flows(spark, sf_dir)
    return f.selectExpr("edge", "explode(transform(array((tail + head) % 50, (tail * 3 + head) % 50, (tail + 2 * head) % 50), k -> concat('f', k))) as face", "case when head % 2 = 0 then 1 else -1 end as sign")


_DIV = f"""{fx.FLOWS_SQL}, div AS (SELECT v.range AS vertex, CAST(coalesce(sum(w), 0) AS BIGINT) AS value FROM range(40) v
  LEFT JOIN (SELECT tail AS vertex, weight AS w FROM flows UNION ALL SELECT head, -weight FROM flows) e ON e.vertex = v.range GROUP BY 1)"""


@query(f"WITH {_DIV} SELECT vertex, value FROM div")
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c, v = _edges(spark, sf_dir)
    return fl.divergence(c, e, v)


@query(f"WITH {_DIV} SELECT vertex, value, CASE WHEN vertex % 4 = 0 THEN value ELSE 0 END AS prescribed FROM div WHERE value <> CASE WHEN vertex % 4 = 0 THEN value ELSE 0 END")
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c, v = _edges(spark, sf_dir)
    d = fl.divergence(c, e, v)
    return fl.conservation(d, d.filter("vertex % 4 = 0"))


@query(f"WITH {_DIV} SELECT vertex, value, CASE WHEN value > 0 THEN 'source' ELSE 'sink' END AS kind FROM div WHERE value <> 0")
def sources_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c, v = _edges(spark, sf_dir)
    return fl.sources_sinks(fl.divergence(c, e, v))


@query(f"WITH {fx.FLOWS_SQL} SELECT edge AS cell, (CASE WHEN head % 3 = 0 THEN 0 ELSE head * head END) - (CASE WHEN tail % 3 = 0 THEN 0 ELSE tail * tail END) AS value FROM flows")
def coboundary_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _, v = _edges(spark, sf_dir)
    return fl.d0(v.filter("vertex % 3 <> 0").selectExpr("vertex as cell", "vertex * vertex as value"), e)


@query(f"WITH {fx.FLOWS_SQL}, {_FACES} SELECT face AS cell, CAST(sum(sign * weight) AS BIGINT) AS value FROM faces JOIN flows USING (edge) GROUP BY face")
def coboundary_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c, _ = _edges(spark, sf_dir)
    return fl.d1(c, _faces(spark, sf_dir))


@query("""WITH v AS (SELECT i, j, (i * i * 7 + j * 13 + i * j) % 101 AS x FROM range(31) a(i), range(21) b(j))
SELECT 'eh:' || a.i || ':' || a.j AS cell, b.x - a.x AS value FROM v a JOIN v b ON b.i = a.i + 1 AND b.j = a.j UNION ALL SELECT 'ev:' || a.i || ':' || a.j, b.x - a.x FROM v a JOIN v b ON b.i = a.i AND b.j = a.j + 1
UNION ALL SELECT 'f:' || i || ':' || j, 0 FROM v WHERE i < 30 AND j < 20""")
def coboundary_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coboundary of values on the vertices of a grid, and the coboundary of that, which is zero on every face."""
    v, e, f = fl.grid(spark, 30, 20)
    at = lambda k: F.split("vertex", ":")[k].cast("long")
    one = fl.d0(v.select(F.col("vertex").alias("cell"), ((at(1) * at(1) * 7 + at(2) * 13 + at(1) * at(2)) % 101).alias("value")), e)
    return one.unionByName(fl.d1(one, f))


@query(f"WITH {fx.FLOWS_SQL}, {_FACES} SELECT edge, count(DISTINCT face) AS faces FROM faces GROUP BY edge HAVING count(DISTINCT face) >= 3")
def manifold_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.manifold_guard(_faces(spark, sf_dir))


@query(f"""WITH {fx.FLOWS_SQL} SELECT u, v, CAST(sum(abs(weight)) AS BIGINT) AS weight, string_agg(edge || ':' || weight, ',' ORDER BY edge) AS parts
FROM (SELECT CASE WHEN weight > 0 THEN tail ELSE head END AS u, CASE WHEN weight > 0 THEN head ELSE tail END AS v, edge, weight FROM flows WHERE weight <> 0) GROUP BY u, v""")
def flow_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c, _ = _edges(spark, sf_dir)
    parts = F.array_join(F.transform("parts", lambda p: F.concat(p["edge"].cast("string"), F.lit(":"), p["w"].cast("string"))), ",")
    return fl.flow_graph(c, e).select("u", "v", "weight", parts.alias("parts"))


@query()
def flow_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c, _ = _edges(spark, sf_dir)
    g = fl.flow_graph(c, e).select(F.lit(0).alias("g"), "u", "v", "weight")
    return gr.flow_betweenness(g, weighted=True).select("u", "v", F.round("score", 9).alias("score"))


@query(f"""WITH {fx.FLOWS_SQL} SELECT 'zeros left out' AS other, true AS equal UNION ALL SELECT 'heavy edges', bool_and(abs(weight) > 1 OR weight = 0) FROM flows
UNION ALL SELECT 'least edge raised', false UNION ALL SELECT 'nothing', bool_and(weight = 0) FROM flows""")
def cochain_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow against itself with cells of value 0 left out and added, against its heavy edges, against itself with one value changed, and against nothing."""
    _, c, _ = _edges(spark, sf_dir)
    zeros = spark.range(1600, 1650).select(F.col("id").cast(c.schema["cell"].dataType).alias("cell"), F.lit(0).cast(c.schema["value"].dataType).alias("value"))
    least = c.agg(F.min("cell").alias("least"))
    raised = c.join(F.broadcast(least), F.col("cell") == F.col("least"), "left").select("cell", (F.col("value") + F.col("least").isNotNull().cast("int")).alias("value"))
    others = {"zeros left out": c.filter("value <> 0").unionByName(zeros), "heavy edges": c.filter("abs(value) > 1"), "least edge raised": raised, "nothing": c.limit(0)}
    out = None
    for name, other in others.items():
        one = fl.equal(c, other).select(F.lit(name).alias("other"), "equal")
        out = one if out is None else out.unionByName(one)
    return out


# --- graphs ---

_DEPTHS = f"""RECURSIVE {fx.CONTACTS_SQL}, e AS (SELECT g, u, v FROM contacts WHERE passable UNION SELECT g, v, u FROM contacts WHERE passable),
nodes AS (SELECT DISTINCT g, unnest([u, v]) AS node FROM contacts),
walk AS (SELECT g, node AS root, node, 0 AS depth FROM nodes UNION SELECT w.g, w.root, e.v, w.depth + 1 FROM walk w JOIN e ON e.g = w.g AND e.u = w.node WHERE w.depth < 12),
depths AS (SELECT g, root, node, min(depth) AS depth FROM walk GROUP BY g, root, node),
per AS (SELECT g, root, count(*) AS n, CAST(sum(depth) AS BIGINT) AS total FROM depths GROUP BY g, root)"""


def _depths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = fx.contacts(spark, sf_dir)
    return e, gr.depths(e, gr.nodes_of(e).select("g", F.col("node").alias("root")))


@query(f"WITH {_DEPTHS} SELECT g, root, node, depth FROM depths")
def step_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depths(spark, sf_dir)[1]


@query(f"WITH {_DEPTHS} SELECT g, root, n, total, CASE WHEN n >= 2 THEN n - 1 END AS md_den FROM per")
def mean_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.mean_depth(_depths(spark, sf_dir)[1])


@query(f"""WITH {_DEPTHS} SELECT g, root, n, total, CASE WHEN n >= 3 THEN 2 * (total - n + 1) END AS ra_num, CASE WHEN n >= 3 THEN (n - 1) * (n - 2) END AS ra_den,
  round(CASE WHEN n >= 3 THEN 2.0::DOUBLE * (total - n + 1) / ((n - 1) * (n - 2)) / (2 * (n * (log2((n + 2)::DOUBLE / 3) - 1) + 1) / ((n - 1) * (n - 2))) END, 9) AS rra FROM per""")
def integration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.integration(_depths(spark, sf_dir)[1]).withColumn("rra", F.round("rra", 9))


@query(f"""WITH {_DEPTHS} SELECT a.g, a.root, c.u, c.v, a.depth AS u_depth, b.depth AS v_depth FROM contacts c
JOIN depths a ON a.g = c.g AND a.node = c.u JOIN depths b ON b.g = c.g AND b.node = c.v AND b.root = a.root WHERE c.passable""")
def justified_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = _depths(spark, sf_dir)
    return gr.justified(e, d)


@query(f"""WITH {_DEPTHS}, paths AS (SELECT g, root, node, depth, 1.0::DOUBLE AS sigma FROM depths WHERE depth = 0),
{", ".join(f"s{k} AS (SELECT d.g, d.root, d.node, d.depth, sum(p.sigma) AS sigma FROM depths d JOIN e ON e.g = d.g AND e.v = d.node JOIN {'paths' if k == 1 else f's{k - 1}'} p ON p.g = d.g AND p.root = d.root AND p.node = e.u WHERE d.depth = {k} GROUP BY 1, 2, 3, 4)" for k in range(1, 12))},
sig AS (SELECT * FROM paths {" ".join(f"UNION ALL SELECT * FROM s{k}" for k in range(1, 12))}),
size AS (SELECT g, count(*) AS n FROM nodes GROUP BY g),
btw AS (SELECT s.g, m.node, sum(a.sigma * b.sigma / s.sigma) AS score FROM sig s JOIN sig a ON a.g = s.g AND a.root = s.root JOIN sig b ON b.g = s.g AND b.root = a.node AND b.node = s.node
  JOIN nodes m ON m.g = s.g AND m.node = a.node WHERE a.node <> s.root AND a.node <> s.node AND a.depth + b.depth = s.depth GROUP BY 1, 2)
SELECT n.g, n.node, round(CASE WHEN z.n > 2 THEN coalesce(score, 0) / ((z.n - 1) * (z.n - 2)) ELSE 0 END, 9) AS choice FROM nodes n JOIN size z ON z.g = n.g LEFT JOIN btw ON btw.g = n.g AND btw.node = n.node""")
def choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.choice(fx.contacts(spark, sf_dir)).withColumn("choice", F.round("choice", 9))


@query(f"""WITH {fx.ARCS_SQL} SELECT net AS g, CAST(i AS BIGINT) AS u, j AS v, CAST(mask AS INT) AS rcc8, mask & 249 = 0 AS contact_certain, (i + j) % 2 = 0 AS passable, i % 3 = 0 AS grounding_decided FROM arcs WHERE mask & 6 <> 0""")
def access_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact edges of the networks' constraints; every second one is listed as passable."""
    a = fx.arcs(spark, sf_dir).selectExpr("net as g", "concat(i, '-', j) as id", "i as src", "j as dst", "mask", "case when i % 3 = 0 then 'grounded' else 'delegated' end as status")
    return gr.access_graph(a, a.filter("(src + dst) % 2 = 0").select("id"))


_EQS = "eqs AS (SELECT c_custkey // 8 AS g, c_custkey AS u, c_custkey // 8 * 8 + (c_custkey * 3 + c_nationkey) % 8 AS v FROM customer)"


@query(f"""WITH RECURSIVE {_EQS}, e AS (SELECT * FROM eqs WHERE u <> v),
reach AS (SELECT g, u AS node, u AS r FROM e UNION SELECT g, v, v FROM e UNION SELECT reach.g, reach.node, x.b FROM reach JOIN (SELECT g, u AS a, v AS b FROM e UNION SELECT g, v, u FROM e) x ON x.g = reach.g AND x.a = reach.r),
label AS (SELECT g, node, min(r) AS label FROM reach GROUP BY g, node),
size AS (SELECT g, label, count(*) AS regions FROM label GROUP BY g, label),
ties AS (SELECT e.g, label, count(*) AS ties FROM e JOIN label ON label.g = e.g AND label.node = e.u GROUP BY e.g, label),
peel AS (SELECT 0 AS k, g, u, v FROM e JOIN label USING (g) JOIN size USING (g, label) JOIN ties USING (g, label) WHERE label.node = e.u AND ties > regions),
{", ".join(f"p{k} AS (SELECT g, u, v FROM {'peel' if k == 1 else f'p{k - 1}'} x WHERE NOT EXISTS (SELECT 1 FROM (SELECT g, n FROM (SELECT g, u AS n FROM {'peel' if k == 1 else f'p{k - 1}'} UNION ALL SELECT g, v FROM {'peel' if k == 1 else f'p{k - 1}'}) GROUP BY g, n HAVING count(*) = 1) l WHERE l.g = x.g AND l.n IN (x.u, x.v)))" for k in range(1, 9))},
core AS (SELECT g, u AS node FROM p8 UNION SELECT g, v FROM p8)
SELECT label.g, label.node, CASE WHEN ties < regions THEN 'under' WHEN ties = regions OR core.node IS NULL THEN 'well' ELSE 'over' END AS block, regions, ties
FROM label JOIN size USING (g, label) JOIN ties USING (g, label) LEFT JOIN core ON core.g = label.g AND core.node = label.node""")
def dm_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.dm_blocks(fx.read(spark, sf_dir, "customer").selectExpr("c_custkey div 8 as g", "c_custkey as u", "c_custkey div 8 * 8 + (c_custkey * 3 + c_nationkey) % 8 as v"))
