"""Queries of documents and of reduction before solving, with the SQL that expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rational as rt
from ..functions.durable import durable
from ..operators import adapters as ad
from ..operators import boxes as bx
from ..operators import reduce as rd
from ..operators import spec as sp
from ..sources import codec as cd
from ..sources import fixtures as fx
from .specs import _C, _P, _constraints

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_NOTE = 'say "so" \\ é'


def _ends(c: DataFrame) -> DataFrame:
    return c.select("spec", F.explode(F.array("src", "dst")).alias("id")).distinct()


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with every kind of record, made once for all tables that are read from them."""
    c = _constraints(spark, sf_dir)
    s = c.selectExpr("spec", "id", "cast(src as string) as src", "cast(dst as string) as dst", "mask as rcc8_mask", "status", "dst % 4 as k", "src % 3 as n")
    prov = F.when(F.col("n") == 0, F.struct(F.lit("ground").alias("activity"), F.lit("designer").alias("actor"), F.array("id").alias("inputs"), F.lit(_NOTE).alias("note"), F.lit("asserted").alias("origin")))
    tables = {
        "constraints": s.select("spec", "id", "src", "dst", "rcc8_mask", "status", prov.alias("prov")),
        "regions": _ends(c).selectExpr("spec", "cast(id as string) as id", "concat('k', id % 3) as semantic_type", "id % 2 = 0 as declared_origin"),
        "witnesses": s.filter("k < 3").selectExpr("spec", "concat('w', id) as id", "array(concat('F', n)) as cell_ids", "array(src, dst) as incident_regions", "cast(k as int) as intended_contact_dimension", "case when n = 1 then 'observed_tolerant' end as epistemic"),
        "overlays": s.filter("rcc8_mask & 4 <> 0").selectExpr("spec", "concat('o', id) as id", "array(dst, src, dst) as members", "n <> 2 as nonempty"),
        "groundings": s.filter("status = 'grounded'").selectExpr("spec", "concat('g', id) as id", "id as target", "'EC' as fixed_value_or_domain").withColumn("rationale", F.lit(_NOTE)),
        "invariants": c.groupBy("spec").agg(F.collect_list(F.when(F.col("status") == "invariant", F.col("id"))).alias("relation_invariants"), F.collect_list(F.when(F.col("dst") % 4 == 0, F.concat(F.lit("w"), "id"))).alias("witness_invariants")),
        "observations": c.filter("spec % 2 = 0").select("spec", F.array(F.lit("rcc8"), F.lit("contact_dimension")).alias("kinds")).distinct(),
    }
    return durable(cd.write_specs(c.select("spec").distinct(), tables))


def _value(*columns) -> object:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) if isinstance(c, str) else c for c in columns]).alias("value")


@query(f"""WITH {_C}, s AS (SELECT *, dst % 4 AS k, src % 3 AS n FROM c), r AS (SELECT DISTINCT spec, unnest([src, dst]) AS id FROM c)
SELECT spec, 'constraints' AS kind, id, concat_ws('|', src, dst, CAST(mask AS INT), status, CASE WHEN n = 0 THEN 'ground|designer|' || id || '|{_NOTE}|asserted' ELSE '-' END) AS value FROM s
UNION ALL SELECT spec, 'regions', id || '', concat_ws('|', 'k' || id % 3, id % 2 = 0) FROM r
UNION ALL SELECT spec, 'witnesses', 'w' || id, concat_ws('|', 'F' || n, src || ',' || dst, k, CASE WHEN n = 1 THEN 'observed_tolerant' ELSE 'asserted' END, 0, 'shared_boundary') FROM s WHERE k < 3
UNION ALL SELECT spec, 'overlays', 'o' || id, concat_ws('|', array_to_string(list_sort([src || '', dst || '']), ','), n <> 2) FROM s WHERE CAST(mask AS INT) & 4 <> 0
UNION ALL SELECT spec, 'groundings', 'g' || id, concat_ws('|', id, 'EC', 'designer', '{_NOTE}', 'high') FROM s WHERE status = 'grounded'
UNION ALL SELECT spec, 'invariants', '', concat_ws('|', coalesce(array_to_string(list_sort(list(id) FILTER (status = 'invariant')), ','), ''), coalesce(array_to_string(list_sort(list('w' || id) FILTER (k = 0)), ','), '')) FROM s GROUP BY spec
UNION ALL SELECT DISTINCT spec, 'observations', '', CASE WHEN spec % 2 = 0 THEN 'contact_dimension,rcc8' ELSE 'atom_occupancy,cell_identity,contact_dimension,rcc8' END FROM s""")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of record written to documents and read again."""
    t = cd.read_specs(_full(spark, sf_dir))
    joined = lambda c: F.array_join(c, ",")
    prov = F.when(F.col("prov").isNull(), "-").otherwise(F.concat_ws("|", "prov.activity", "prov.actor", joined(F.col("prov.inputs")), "prov.note", "prov.origin"))
    shown = {
        "constraints": _value("src", "dst", "rcc8_mask", "status", prov),
        "regions": _value("semantic_type", "declared_origin"),
        "witnesses": _value(joined("cell_ids"), joined("incident_regions"), "intended_contact_dimension", "epistemic", "component_index", "boundary_role"),
        "overlays": _value(joined("members"), "nonempty"),
        "groundings": _value("target", "fixed_value_or_domain", "actor", "rationale", "reversibility"),
        "invariants": _value(joined("relation_invariants"), joined("witness_invariants")),
        "observations": _value(joined("kinds")),
    }
    out = None
    for kind, value in shown.items():
        one = t[kind].select("spec", F.lit(kind).alias("kind"), (F.col("id") if "id" in t[kind].columns else F.lit("")).alias("id"), value)
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_C} SELECT spec, id, src || '' AS src, dst || '' AS dst, CAST(mask AS INT) AS mask, status FROM c")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints written as documents and read again."""
    c = _constraints(spark, sf_dir)
    return cd.read_documents(cd.spec_documents(c, _ends(c)))


_BASES = ("DC", "EC", "PO", "TPP", "NTPP", "TPPi", "NTPPi", "EQ")
_NAMES = f"""'["' || array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN CAST(mask AS INT) & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(_BASES))}], lambda x: x IS NOT NULL)), '","') || '"]'"""


@query(f"""WITH {_C}, n AS (SELECT spec, string_agg('{{"dst":"' || dst || '","id":"' || id || '","prov":null,"rcc8_mask":' || CAST(mask AS INT) || ',"rcc8_names":' || {_NAMES} || ',"src":"' || src || '","status":"' || status || '"}}', ',' ORDER BY id) AS cs FROM c GROUP BY spec),
r AS (SELECT spec, string_agg('{{"declared_origin":true,"id":"' || id || '","prov":null,"semantic_type":""}}', ',' ORDER BY id) AS rs FROM (SELECT DISTINCT spec, unnest([src, dst]) || '' AS id FROM c) GROUP BY spec)
SELECT spec, sha256('{{"constraints":[' || cs || '],"groundings":[],"invariant":{{"relation_invariants":[],"witness_invariants":[]}},"observation":{{"kinds":["atom_occupancy","cell_identity","contact_dimension","rcc8"]}},"overlays":[],"regions":[' || rs || '],"schema_version":"0.0.1","witnesses":[]}}') AS sha256 FROM n JOIN r USING (spec)""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's text."""
    c = _constraints(spark, sf_dir)
    return cd.spec_documents(c, _ends(c)).select("spec", cd.content_hash(F.col("doc")).alias("sha256"))


@query(f"""WITH {_C}, f AS (SELECT spec, CASE spec % 6 WHEN 0 THEN 'not a specification' WHEN 1 THEN 'constraints: unknown status' WHEN 2 THEN 'constraints: rcc8_mask is missing' WHEN 3 THEN 'not a specification' END AS m FROM (SELECT DISTINCT spec FROM c))
SELECT spec, CASE WHEN m IS NULL THEN 'read' ELSE '{{"error":{{"message":"' || m || '","type":"ValueError"}}}}' END AS result FROM f""")
def json_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which two in three are damaged in one of four ways: error documents for these, and the others read."""
    d = _full(spark, sf_dir)
    k = F.col("spec") % 6
    doc = F.when(k == 0, F.lit("{")).when(k == 1, F.regexp_replace("doc", '"status":"[a-z]+"', '"status":"maybe"')).when(k == 2, F.regexp_replace("doc", '"rcc8_mask":', '"mask":')).when(k == 3, F.regexp_replace("doc", r'"rcc8_mask":(\d+)', r'"rcc8_mask":$1.5')).otherwise(F.col("doc"))
    t = cd.read_specs(d.select("spec", doc.alias("doc")))
    return cd.error_documents(t["faults"]).select("spec", F.col("doc").alias("result")).unionByName(t["specs"].select("spec", F.lit("read").alias("result")))


@query(f"""WITH {fx.BOXES_SQL}, e AS (SELECT region // 8 AS real, region || '' AS region, v, d // CASE WHEN v = 0 THEN d ELSE gcd(abs(v), d) END AS den, v // CASE WHEN v = 0 THEN d ELSE gcd(abs(v), d) END AS num, o FROM
  (SELECT region, unnest([x0, y0, x1, y1]) AS v, unnest([1, 2, 3, 4]) AS o, 1 + region % 6 AS d FROM boxes))
SELECT real, region, string_agg(num || '/' || den, ',' ORDER BY o) AS ends, CASE real % 2 WHEN 0 THEN 'unknown' ELSE 'rcc_consistent' END AS status, 'c' || real AS satisfied FROM e GROUP BY real, region""")
def realization_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with fractions for ends, written as realizations of eight boxes and read again."""
    cut = lambda c: rt.rat(F.col(c), F.lit(1) + F.col("region") % 6)
    b = fx.boxes(spark, sf_dir).select(F.expr("region div 8").alias("real"), F.col("region").cast("string").alias("region_id"), F.array(*[F.struct(cut(c)["den"].alias("den"), cut(c)["num"].alias("num")) for c in ("x0", "y0")]).alias("lo"), F.array(*[F.struct(cut(c)["den"].alias("den"), cut(c)["num"].alias("num")) for c in ("x1", "y1")]).alias("hi"))
    r = b.select("real").distinct().selectExpr("real", "concat('r', real) as id", "case when real % 2 = 1 then 'rcc_consistent' end as status", "array(concat('c', real)) as satisfied")
    real, boxes, _ = cd.read_realizations(durable(cd.write_realizations(r, b)))
    ends = F.array_join(F.transform(F.concat("lo", "hi"), lambda x: F.concat_ws("/", x["num"].cast("string"), x["den"].cast("string"))), ",")
    return boxes.join(real.select("real", "status", F.array_join("satisfied", ",").alias("satisfied")), "real").select("real", F.col("region_id").alias("region"), ends.alias("ends"), "status", "satisfied")


# --- reduction before solving ---

_ORD = "(id % 8) * 5 % 8"
_REDUCED = f"""{_P}, reg AS (SELECT spec, id, {_ORD} AS ord FROM (SELECT DISTINCT spec, unnest([src, dst]) AS id FROM q)), e AS (SELECT spec, src AS u, dst AS v FROM q WHERE mask = 128 AND src <> dst),
reach AS (SELECT spec, u AS n, u AS r FROM e UNION SELECT spec, v, v FROM e UNION SELECT reach.spec, n, x.b FROM reach JOIN (SELECT spec, u AS a, v AS b FROM e UNION SELECT spec, v, u FROM e) x ON x.spec = reach.spec AND x.a = reach.r),
l AS (SELECT reach.spec, n, arg_min(r, ord) AS rep FROM reach JOIN reg ON reg.spec = reach.spec AND reg.id = r GROUP BY 1, 2),
m AS (SELECT q.spec, q.id, coalesce(x.rep, q.src) AS src, coalesce(y.rep, q.dst) AS dst, mask FROM (SELECT q.*, src || '-' || dst AS id FROM q) q LEFT JOIN l x ON x.spec = q.spec AND x.n = q.src LEFT JOIN l y ON y.spec = q.spec AND y.n = q.dst),
k AS (SELECT * FROM m WHERE src <> dst OR mask & 128 = 0),
b AS (SELECT spec, id AS region, 'x' AS axis, id % 10 AS lo, CASE WHEN id % 5 <> 0 THEN id % 10 + 3 + id % 7 END AS hi FROM reg WHERE id % 4 <> 3 UNION ALL SELECT spec, id, 'y', id % 6, id % 9 + 2 FROM reg WHERE id % 4 <> 3),
s AS (SELECT b.spec, coalesce(rep, region) AS region, axis, max(lo) AS lo, min(hi) AS hi FROM b LEFT JOIN l ON l.spec = b.spec AND l.n = region GROUP BY 1, 2, 3),
sub AS (SELECT spec, src AS i, dst AS o FROM k WHERE mask <> 0 AND mask & 103 = 0 AND src <> dst UNION SELECT spec, dst, src FROM k WHERE mask <> 0 AND mask & 31 = 0 AND src <> dst),
up AS (SELECT spec, i, o FROM sub UNION SELECT up.spec, up.i, sub.o FROM up JOIN sub ON sub.spec = up.spec AND sub.i = up.o),
t AS (SELECT spec, region, axis, max(lo) AS lo, min(hi) AS hi FROM (SELECT * FROM s UNION ALL SELECT up.spec, i, axis, lo, hi FROM up JOIN s ON s.spec = up.spec AND s.region = o) GROUP BY 1, 2, 3)"""


def _reduced(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    c = _constraints(spark, sf_dir).withColumn("mask", F.expr("case when (src * 3 + dst) % 7 = 0 then 128 else mask end"))
    r = _ends(c).withColumn("ord", F.expr(_ORD))
    b = r.filter("id % 4 <> 3")
    x = b.selectExpr("spec", "id as region", "'x' as axis", "id % 10 as lo", "case when id % 5 <> 0 then id % 10 + 3 + id % 7 end as hi")
    y = b.selectExpr("spec", "id as region", "'y' as axis", "id % 6 as lo", "id % 9 + 2 as hi")
    w = c.filter("dst % 2 = 0").selectExpr("spec", "concat('w', id) as id", "array(dst, src) as regions")
    o = c.filter("src % 2 = 0").selectExpr("spec", "concat('o', id) as id", "array(dst, src) as members")
    return rd.presolved(r, c, x.unionByName(y), w, o)


@query(f"WITH RECURSIVE {_REDUCED} SELECT spec, region, axis, lo, hi FROM t")
def presolve_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of regions after equal ones are one and containment has handed bounds inwards."""
    return _reduced(spark, sf_dir)["bounds"]


@query(f"""WITH RECURSIVE {_REDUCED}, p AS (SELECT spec, least(src, dst) AS x, greatest(src, dst) AS y, bit_and(CAST(CASE WHEN src <= dst THEN mask ELSE (mask & 135) | ((mask & 24) << 2) | ((mask & 96) >> 2) END AS INT)) AS m FROM k GROUP BY 1, 2, 3)
SELECT spec, 'self_relation' AS code, id AS a, src || '' AS b FROM k WHERE src = dst UNION ALL SELECT spec, 'empty_mask', id, '' FROM m WHERE mask = 0
UNION ALL SELECT spec, 'empty_pair', x || '', y || '' FROM p WHERE m = 0 UNION ALL SELECT spec, 'empty_domain', region || '', axis FROM t WHERE lo >= hi""")
def presolve_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reduced(spark, sf_dir)["contradictions"]


@query(f"""WITH RECURSIVE {_REDUCED}, w AS (SELECT q.spec, src || '-' || dst AS id, src AS s0, dst AS d0, coalesce(x.rep, q.src) AS s, coalesce(y.rep, q.dst) AS d FROM q LEFT JOIN l x ON x.spec = q.spec AND x.n = q.src LEFT JOIN l y ON y.spec = q.spec AND y.n = q.dst)
SELECT spec, 'witness' AS kind, 'w' || id AS id, CASE WHEN s = d THEN d || '' ELSE d || ',' || s END AS value FROM w WHERE d0 % 2 = 0 UNION ALL SELECT spec, 'overlay', 'o' || id, CASE WHEN s = d THEN d || '' ELSE least(s, d) || ',' || greatest(s, d) END FROM w WHERE s0 % 2 = 0
UNION ALL SELECT spec, 'dropped', id, '' FROM m WHERE src = dst AND mask & 128 <> 0 UNION ALL SELECT spec, 'substitution', n || '', rep || '' FROM l WHERE n <> rep UNION ALL SELECT reg.spec, 'region', id || '', '' FROM reg ANTI JOIN (SELECT spec, n AS id FROM l WHERE n <> rep) z USING (spec, id)""")
def presolve_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of witnesses, overlays, regions and constraints."""
    t = _reduced(spark, sf_dir)
    text = lambda c: F.array_join(F.transform(c, lambda r: r.cast("string")), ",")
    row = lambda name, kind, value: t[name].select("spec", F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), value.alias("value"))
    out = row("witnesses", "witness", text("regions")).unionByName(row("overlays", "overlay", text("members"))).unionByName(row("dropped", "dropped", F.lit("")))
    return out.unionByName(row("substitutions", "substitution", F.col("rep").cast("string"))).unionByName(row("regions", "region", F.lit("")))


# --- from documents to documents ---


def _lifted(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    b = fx.boxes(spark, sf_dir).selectExpr("region div 8 as spec", "region", "region as pos", "x0", "x1", "y0", "y1")
    t = ad.lift(b)
    return cd.read_specs(durable(cd.write_specs(t["specs"], t)))


_LIFT = f"""WITH {fx.BOXES_SQL}, p AS (SELECT a.region // 8 AS spec, a.region AS a, b.region AS b, {fx.RCC8_CASE} AS mask, CAST(a.x0 < b.x1 AND b.x0 < a.x1 AS INT) + CAST(a.y0 < b.y1 AND b.y0 < a.y1 AS INT) AS dim
FROM boxes a JOIN boxes b ON a.region // 8 = b.region // 8 AND a.region < b.region), n AS (SELECT region // 8 AS spec, array_to_string(list_sort(list(region || '')), ',') AS inputs FROM boxes GROUP BY 1)"""


@query(f"""{_LIFT} SELECT spec, 'constraint' AS kind, 'lift:' || a || '->' || b AS id, CAST(mask AS INT) AS value, 'delegated' AS state, inputs FROM p JOIN n USING (spec)
UNION ALL SELECT spec, 'witness', 'w:' || a || '-' || b || ':d' || dim || ':c0', dim, 'observed_tolerant', inputs FROM p JOIN n USING (spec) WHERE mask = 2""")
def lift_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications that the boxes of every eight parts show, written and read as documents."""
    t = _lifted(spark, sf_dir)
    inputs = F.array_join("prov.inputs", ",").alias("inputs")
    c = t["constraints"].select("spec", F.lit("constraint").alias("kind"), "id", F.col("rcc8_mask").alias("value"), F.col("status").alias("state"), inputs)
    return c.unionByName(t["witnesses"].select("spec", F.lit("witness").alias("kind"), "id", F.col("intended_contact_dimension").alias("value"), F.col("epistemic").alias("state"), inputs))


@query(f"""WITH {_C}, r AS (SELECT spec, src AS a, dst AS b, ['point', 'Edge', 'face', '1', 'corner'][1 + (src + dst) % 5] AS dim FROM c), d AS (SELECT spec, a, b, CASE dim WHEN 'point' THEN 0 WHEN 'Edge' THEN 1 WHEN '1' THEN 1 WHEN 'face' THEN 2 END AS dim FROM r),
h AS (SELECT spec, 'w:' || src || '-' || dst || ':d1:c0' AS id, CAST(1 + dst % 2 AS INT) AS h FROM c WHERE src % 2 = 0), w AS (SELECT *, 'w:' || a || '-' || b || ':d' || dim || ':c0' AS id FROM d)
SELECT spec, id, a, b, dim, CASE WHEN dim IS NULL THEN 'bad_contact_dim' WHEN h IS NULL THEN 'added' WHEN h = dim THEN 'present' ELSE 'conflict' END AS outcome FROM w LEFT JOIN h USING (spec, id)""")
def witness_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts asked for by name or number, some of them there already."""
    c = _constraints(spark, sf_dir)
    asked = c.selectExpr("spec", "src as a", "dst as b", "element_at(array('point', 'Edge', 'face', '1', 'corner'), cast((src + dst) % 5 + 1 as int)) as dim")
    held = c.filter("src % 2 = 0").selectExpr("spec", "concat('w:', src, '-', dst, ':d1:c0') as id", "cast(1 + dst % 2 as int) as intended_contact_dimension")
    return ad.add_witnesses(held, asked)


@query(f"""WITH {_P}, s AS (SELECT q.*, src || '-' || dst AS id, ['delegated', 'grounded', 'invariant'][1 + (src + dst) % 3] AS status FROM q), seen AS (SELECT a.region // 8 AS spec, a.region AS src, b.region AS dst, {fx.RCC8_CASE} AS seen FROM boxes a JOIN boxes b ON a.region // 8 = b.region // 8 AND a.region < b.region)
SELECT spec, id, CAST(CASE WHEN status = 'delegated' THEN seen ELSE mask END AS INT) AS mask, status, status <> 'delegated' AND mask & seen = 0 AS conflict FROM s JOIN seen USING (spec, src, dst)""")
def observe_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading of the boxes back into constraints: delegated ones take what is seen, decided ones that it contradicts are conflicts."""
    c = _constraints(spark, sf_dir).withColumn("mask", F.expr("case when (src * 3 + dst) % 7 = 0 then 128 else mask end"))
    b = fx.boxes(spark, sf_dir).withColumn("net", F.expr("region div 8"))
    seen = bx.relations(bx.all_pairs(b, ["net"])).select("net", F.col("a").alias("i"), F.col("b").alias("j"), "mask")
    return sp.observed_masks(c, seen).select("spec", "id", "mask", "status", "conflict")


@query(f"""WITH {_C}, after AS (SELECT spec, id, CASE WHEN dst % 7 = 0 THEN 1 ELSE mask END AS mask, CASE WHEN dst % 5 = 0 THEN 'delegated' ELSE status END AS status FROM c WHERE src % 6 <> 0),
core AS (SELECT spec, id FROM c WHERE status = 'invariant' UNION SELECT spec, id FROM c WHERE src % 8 = 1), g AS (SELECT spec, list('g' || id ORDER BY id) AS l FROM c WHERE status = 'grounded' GROUP BY 1), h AS (SELECT spec, list('g' || id ORDER BY id) AS l FROM c WHERE status = 'grounded' AND NOT (spec % 4 = 0 AND src % 8 = 2) GROUP BY 1)
SELECT coalesce(g.spec, h.spec) AS spec, 'ledger_changed' AS code, '' AS id FROM g FULL JOIN h ON g.spec = h.spec WHERE g.l IS DISTINCT FROM h.l
UNION ALL SELECT core.spec, CASE WHEN a.id IS NULL THEN 'dropped_invariant' ELSE 'altered_invariant' END, core.id FROM core LEFT JOIN c b ON b.spec = core.spec AND b.id = core.id LEFT JOIN after a ON a.spec = core.spec AND a.id = core.id WHERE a.id IS NULL OR a.status <> 'invariant' OR a.mask <> b.mask""")
def session_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole specifications put in place of others: what of the invariant core and the decisions they would move."""
    c = _constraints(spark, sf_dir)
    after = c.filter("src % 6 <> 0").selectExpr("spec", "id", "case when dst % 7 = 0 then 1 else mask end as mask", "case when dst % 5 = 0 then 'delegated' else status end as status")
    core = ad.invariants(c, c.filter("src % 8 = 1"))
    ledger = c.filter("status = 'grounded'").selectExpr("spec", "id as pos", "concat('g', id) as id", "src")
    return ad.guard(c, after, core, ledger, ledger.filter("not (spec % 4 = 0 and src % 8 = 2)"))


@query()
def solve_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realization documents of the lifted specifications: status and number of boxes."""
    b = fx.boxes(spark, sf_dir).selectExpr("region div 8 as spec", "region", "region as pos", "x0", "x1", "y0", "y1")
    t = ad.lift(b)
    real, boxes, _ = cd.read_realizations(durable(ad.solve_documents(durable(cd.write_specs(t["specs"], t)), bounds=(0, 400))).withColumnRenamed("spec", "real"))
    return real.join(boxes.groupBy("real").agg(F.count(F.lit(1)).alias("boxes")), "real", "left").select(F.col("real").alias("spec"), "status", "boxes")


# --- Turtle of whole documents ---

_QUOTED = '"' + _NOTE.replace("\\", "\\\\").replace('"', '\\"') + '"'
_SOURCE = f"{_C}, s AS (SELECT *, dst % 4 AS k, src % 3 AS n FROM c), r AS (SELECT DISTINCT spec, unnest([src, dst]) AS id FROM c)"
_JOINED = _NAMES.replace("'[\"' || ", "").replace(" || '\"]'", "").replace("list_sort(", "(").replace("'\",\"'", "'|'")


@query(f"""WITH {_SOURCE}, u AS (SELECT spec, 'ex:' || id AS s, unnest([{{'p': 'a', 'o': 'bot:Space'}}, {{'p': 'rdfs:label', 'o': '"k' || id % 3 || '"'}}, {{'p': 't:semanticType', 'o': '"k' || id % 3 || '"'}}, {{'p': 't:declaredOrigin', 'o': CAST(id % 2 = 0 AS VARCHAR)}}]) AS t FROM r
UNION ALL SELECT spec, 'ex:' || id, unnest([{{'p': 'a', 'o': 't:RelationConstraint'}}, {{'p': 't:source', 'o': 'ex:' || src}}, {{'p': 't:target', 'o': 'ex:' || dst}}, {{'p': 't:rcc8', 'o': '"' || {_JOINED} || '"'}}, {{'p': 't:editStatus', 'o': '"' || status || '"'}}]) FROM s
UNION ALL SELECT spec, 'ex:w' || id, unnest([{{'p': 'a', 'o': 'bot:Interface'}}, {{'p': 't:contactDimension', 'o': ['"point"', '"line"', '"face"'][1 + k]}}, {{'p': 'bot:interfaceOf', 'o': 'ex:' || src}}, {{'p': 'bot:interfaceOf', 'o': 'ex:' || dst}}]) FROM s WHERE k < 3
UNION ALL SELECT spec, 'ex:g' || id, unnest([{{'p': 'a', 'o': 'prov:Activity'}}, {{'p': 'prov:wasAssociatedWith', 'o': 'ex:agent%2Fdesigner'}}, {{'p': 'prov:generated', 'o': 'ex:' || id}}, {{'p': 't:fixedValue', 'o': '"EC"'}}, {{'p': 't:rationale', 'o': '{_QUOTED}'}}, {{'p': 't:reversibility', 'o': '"high"'}}]) FROM s WHERE status = 'grounded'
UNION ALL SELECT DISTINCT spec, 'ex:agent%2Fdesigner', unnest([{{'p': 'a', 'o': 'prov:Agent'}}, {{'p': 'rdfs:label', 'o': '"designer"'}}]) FROM s WHERE status = 'grounded')
SELECT DISTINCT spec, s, t.p AS p, t.o AS o FROM u UNION SELECT spec, 'ex:' || CASE WHEN mask IN (8, 16) THEN dst ELSE src END, CASE WHEN mask IN (2, 4) THEN 'bot:adjacentZone' ELSE 'bot:containsZone' END, 'ex:' || CASE WHEN mask IN (8, 16) THEN src ELSE dst END FROM s WHERE mask IN (2, 4, 8, 16, 32, 64)""")
def rdf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All triples of documents with every kind of record."""
    return cd.spec_triples(cd.read_specs(_full(spark, sf_dir)))


@query(f"""WITH {_SOURCE} SELECT spec, 'disjunction' AS category, id AS subject FROM s WHERE bit_count(CAST(mask AS INT)) <> 1 UNION ALL SELECT spec, 'partial_overlap', id FROM s WHERE mask = 4 UNION ALL SELECT spec, 'equality', id FROM s WHERE mask = 128
UNION ALL SELECT spec, 'delegated_freedom', id FROM s WHERE status = 'delegated' UNION ALL SELECT spec, 'contact_dimension', 'w' || id FROM s WHERE k < 2 UNION ALL SELECT spec, 'overlay_atom', 'o' || id FROM s WHERE CAST(mask AS INT) & 4 <> 0 UNION ALL SELECT spec, 'field_origin', id || '' FROM r WHERE id % 2 = 1""")
def rdf_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What standard terms do not say of documents with every kind of record."""
    return cd.spec_losses(cd.read_specs(_full(spark, sf_dir)))
