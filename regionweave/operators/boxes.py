"""Pairwise classification of boxes: RCC-8, Allen pairs, contact dimension, DE-9IM, snapping, verification against a specification, and observations under coarser and coarser groups of transformations.

Boxes are rows with a region and two columns per axis (x0, x1, y0, y1 and z0, z1). Pairs that touch are found by an equi-join on grid buckets of closed intervals, each pair once, in the bucket of its greater lower ends; a pair that shares no bucket is disconnected. Regions with equal boxes are one class, and classes are joined.
"""

from __future__ import annotations

from functools import cache
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions.algebra import ALLEN, RCC8, allen_name
from ..functions.durable import spread

AXES = {2: ("x", "y"), 3: ("x", "y", "z")}


def spans(side: str, dims: int = 2) -> list[iv.Span]:
    """The axes of one side of a pair."""
    return [(F.col(f"{side}_{d}0"), F.col(f"{side}_{d}1")) for d in AXES[dims]]


def checked(boxes: DataFrame, dims: int = 2) -> DataFrame:
    """The boxes; one without room on an axis fails the query."""
    ok = iv.valid(*[(F.col(f"{d}0"), F.col(f"{d}1")) for d in AXES[dims]])
    return boxes.withColumn("region", F.when(ok, F.col("region")).otherwise(F.raise_error(F.concat(F.lit("degenerate box "), F.col("region").cast("string"))).cast(boxes.schema["region"].dataType)))


def _side(boxes: DataFrame, side: str, by: list[str], dims: int) -> DataFrame:
    return boxes.select(*by, F.col("region").alias(side), *[F.col(f"{d}{e}").alias(f"{side}_{d}{e}") for d in AXES[dims] for e in (0, 1)])


def all_pairs(boxes: DataFrame, by: list[str] | None = None, dims: int = 2) -> DataFrame:
    """Every pair a < b within each realization `by`; for small realizations, where disconnected pairs are wanted as rows."""
    by = by or []
    a, b = (_side(boxes, s, by, dims) for s in "ab")
    return (a.join(b, by) if by else a.crossJoin(b)).filter("a < b")


BLOCK, SALTS = 4096, 4


def touching_classes(boxes: DataFrame, by: list[str] | None = None, dims: int = 2, cell: int = 16) -> DataFrame:
    """Pairs of classes whose closed boxes meet, by grid buckets of `cell` units on the first two axes. A class is the regions of one box; a row's `a` and `b` are arrays of regions, and it stands for every pair a < b of their members. What is said of two boxes is said once a class here, before `expanded` lists the pairs.

    A class of more than BLOCK regions is several rows. Every bucket is dealt to SALTS tasks by its left side, so that one full bucket is not one task's work.
    """
    by = by or []
    keys = [*by, "u", "w", "salt"]
    ends = [f"{d}{e}" for d in AXES[dims] for e in (0, 1)]
    members = boxes.groupBy(*by, *ends).agg(F.sort_array(F.collect_list("region")).alias("all_")).filter("size(all_) > 0")
    blocks = members.withColumn("at_", F.explode(F.expr(f"sequence(1, size(all_), {BLOCK})"))).withColumn("region", F.expr(f"slice(all_, at_, {BLOCK})"))
    bucket = lambda d: F.explode(F.sequence(F.floor(F.col(f"{d}0") / cell), F.floor(F.col(f"{d}1") / cell)))
    placed = blocks.withColumn("u", bucket("x")).withColumn("w", bucket("y"))
    left = placed.withColumn("salt", F.pmod(F.xxhash64(*ends, "at_"), F.lit(SALTS)).cast("int"))
    right = placed.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    # few bytes make many pairs, so tasks are not coalesced by size
    a, b = (spread(_side(x, s, keys, dims), *keys) for s, x in (("a", left), ("b", right)))
    joined = a.join(b.hint("merge"), keys)
    for x, y in zip(spans("a", dims), spans("b", dims), strict=True):
        joined = joined.filter(iv.meet(x, y))
    home = [F.col(k) == F.floor(F.greatest(f"a_{d}0", f"b_{d}0") / cell) for k, d in (("u", "x"), ("w", "y"))]
    some = F.get("a", F.lit(0)) < F.element_at("b", -1)
    return joined.filter(home[0] & home[1] & some).drop("u", "w", "salt")


def expanded(classes: DataFrame) -> DataFrame:
    """The pairs a < b of regions that rows of `touching_classes` stand for, with all other columns."""
    return classes.withColumn("a", F.explode("a")).withColumn("b", F.explode("b")).filter("a < b")


def touching_pairs(boxes: DataFrame, by: list[str] | None = None, dims: int = 2, cell: int = 16) -> DataFrame:
    """Pairs a < b whose closed boxes meet, each once."""
    return expanded(touching_classes(boxes, by, dims, cell))


def relations(pairs: DataFrame, dims: int = 2) -> DataFrame:
    """Pairs with their RCC-8 mask and contact dimension."""
    return pairs.withColumn("mask", iv.rcc8(spans("a", dims), spans("b", dims))).withColumn("contact", iv.contact_dimension(spans("a", dims), spans("b", dims)))


def rectangles(pairs: DataFrame) -> DataFrame:
    """Pairs with the Allen masks of both axes."""
    a, b = spans("a"), spans("b")
    return pairs.withColumn("ax", iv.allen(a[0], b[0])).withColumn("ay", iv.allen(a[1], b[1]))


DE9IM = ("II", "IB", "IE", "BI", "BB", "BE", "EI", "EB", "EE")


@cache
def _allen_cells() -> dict[int, frozenset]:
    """Per Allen bit, what two intervals in that relation make of a line: (dimension, place in a, place in b) of every point and every gap of a small ruler; places are 0 inside, 1 on an end, 2 outside."""
    spans = [(lo, hi) for hi in range(1, 6) for lo in range(1, hi)]
    place = lambda t, s: 0 if 2 * s[0] < t < 2 * s[1] else 1 if t in (2 * s[0], 2 * s[1]) else 2
    # even marks of the ruler are points, odd ones the gaps between them
    return {ALLEN.bit(allen_name(*a, *b)): frozenset((t % 2, place(t, a), place(t, b)) for t in range(13)) for a in spans for b in spans}


@cache
def de9im_rows(dims: int = 2) -> tuple:
    """The nine dimensions of every combination of Allen bits of the axes (-1 where empty): (bits, dimensions)."""
    rows = []
    for bits in product(_allen_cells(), repeat=dims):
        most = dict.fromkeys(product(range(3), repeat=2), -1)
        for cell in product(*(_allen_cells()[b] for b in bits)):
            at = max(c[1] for c in cell), max(c[2] for c in cell)
            most[at] = max(most[at], sum(c[0] for c in cell))
        rows.append((*bits, *most.values()))
    return tuple(rows)


def de9im(pairs: DataFrame, dims: int = 2) -> DataFrame:
    """Pairs with the nine dimensions of their intersections (-1 where empty) and their text form. They follow from the Allen relations of the axes alone, so pairs meet a table of 13 ** dims rows."""
    bits = [f"allen_{d}_" for d in AXES[dims]]
    known = pairs.sparkSession.createDataFrame([(*r,) for r in de9im_rows(dims)], ", ".join(f"{n} int" for n in (*bits, *DE9IM)))
    text = F.concat(*[F.when(F.col(n) < 0, "F").otherwise(F.col(n).cast("string")) for n in DE9IM])
    own = pairs.withColumns({n: iv.allen(x, y) for n, x, y in zip(bits, spans("a", dims), spans("b", dims), strict=True)})
    return own.join(F.broadcast(known.withColumn("de9im", text)), bits).drop(*bits)


def rcc8_of_de9im() -> Column:
    """RCC-8 bit from the columns of `de9im`, by which intersections are empty."""
    full = lambda n: F.col(n) >= 0
    return (
        F.when(~full("II") & ~full("BB"), 1)
        .when(~full("II"), 2)
        .when(~full("IB") & ~full("BI") & ~full("IE") & ~full("EI"), 128)
        .when(~full("IE") & ~full("BE"), F.when(full("BB"), 8).otherwise(16))
        .when(~full("EI") & ~full("EB"), F.when(full("BB"), 32).otherwise(64))
        .otherwise(4)
    )


def snapped(boxes: DataFrame, tolerance: float | int, dims: int = 2) -> DataFrame:
    """Boxes with every end rounded half up to the grid of `tolerance` (0 leaves them); a box that loses its room fails the query."""
    if tolerance:
        for d in AXES[dims]:
            for e in (0, 1):
                boxes = boxes.withColumn(f"{d}{e}", F.floor(F.col(f"{d}{e}") / tolerance + 0.5) * tolerance)
    return checked(boxes, dims)


def verdict(mask: Column, observed: Column, missing: str = "undecided") -> Column:
    """What an observed relation makes of a stated mask; `missing` where none was observed."""
    return F.when(observed.isNull(), missing).when(mask.bitwiseAND(observed) != 0, "satisfied").otherwise("violated")


def verdicts(constraints: DataFrame, boxes: DataFrame, missing: str = "undecided") -> DataFrame:
    """Constraints (id, src, dst, mask) with the observed relation and a verdict: satisfied, violated, or `missing` where a box is."""
    a, b = (_side(boxes, s, [], 2) for s in "ab")
    joined = constraints.join(a, F.col("src") == F.col("a"), "left").join(b, F.col("dst") == F.col("b"), "left")
    seen = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), iv.rcc8(spans("a"), spans("b")))
    return joined.withColumn("observed", seen).withColumn("verdict", verdict(F.col("mask"), F.col("observed"), missing)).select(*constraints.columns, "observed", "verdict")


def witness_code(mask: Column, contact: Column, dim: Column) -> Column:
    """Why boxes with this relation and contact dimension contradict a witness of dimension `dim`; NULL where they do not."""
    return F.when(mask != 2, "not_externally_connected").when(contact != dim, "contact_dim_mismatch")


def witness_verdicts(witnesses: DataFrame, boxes: DataFrame) -> DataFrame:
    """Witnessed pairs (witness, a, b, dim) that the boxes contradict, with a code: missing_region, not_externally_connected, contact_dim_mismatch."""
    a, b = (_side(boxes, s, [], 2).withColumnRenamed(s, f"{s}_") for s in "ab")
    joined = witnesses.join(a, F.col("a") == F.col("a_"), "left").join(b, F.col("b") == F.col("b_"), "left")
    seen = witness_code(iv.rcc8(spans("a"), spans("b")), iv.contact_dimension(spans("a"), spans("b")), F.col("dim"))
    code = F.when(F.col("a_").isNull() | F.col("b_").isNull(), "missing_region").otherwise(seen)
    return joined.withColumn("code", code).filter("code is not null").select(*witnesses.columns, "code")


# --- what stays observable under ever larger groups of transformations ---

GROUPS = ("euclidean", "similarity", "affine", "projective", "homeomorphism")
# Categories of information that each group retains, in the order in which losses are listed.
RETAINED = {
    "euclidean": ("absolute_coordinates", "metric", "ratios", "angles", "parallelism", "collinearity", "incidence", "cross_ratio", "orientation", "linking", "contact"),
    "similarity": ("ratios", "angles", "parallelism", "collinearity", "incidence", "cross_ratio", "orientation", "linking", "contact"),
    "affine": ("parallelism", "betweenness", "collinearity", "incidence", "cross_ratio", "orientation", "linking", "contact"),
    "projective": ("collinearity", "incidence", "cross_ratio", "orientation", "linking", "contact"),
    "homeomorphism": ("contact",),
}


def lost(group: str) -> list[str]:
    """Categories that a finer group retains and this one does not, in the order of the finest group's list."""
    return [k for k in RETAINED["euclidean"] if k not in RETAINED[group] and group != "euclidean"]


def losses(spark: SparkSession) -> DataFrame:
    """What every group retains and drops: group, rank (0 is the finest), retained, dropped."""
    return spark.createDataFrame([(g, i, list(RETAINED[g]), lost(g)) for i, g in enumerate(GROUPS)], "`group` string, rank int, retained array<string>, dropped array<string>")


def coarser(a: str, b: str) -> str:
    return max(a, b, key=GROUPS.index)


def finer(a: str, b: str) -> str:
    return min(a, b, key=GROUPS.index)


def observe_euclidean(pairs: DataFrame) -> DataFrame:
    """Per pair: doubled centroids' squared distance (4 times the true one) and side lengths."""
    a, b = spans("a"), spans("b")
    gap = [(x[0] + x[1]) - (y[0] + y[1]) for x, y in zip(a, b, strict=True)]
    return pairs.select("a", "b", (gap[0] * gap[0] + gap[1] * gap[1]).alias("distance4"), *[(x[1] - x[0]).alias(n) for n, x in (("a_w", a[0]), ("a_h", a[1]), ("b_w", b[0]), ("b_h", b[1]))])


def ratio(n: Column, d: Column) -> tuple[Column, Column]:
    """A fraction in lowest terms with a positive denominator, as (num, den)."""
    from ..functions.rational import gcd

    g = gcd(n, d)
    sign = F.when(d < 0, -1).otherwise(1)
    return (sign * n / g).cast("long"), (sign * d / g).cast("long")


def observe_similarity(pairs: DataFrame) -> DataFrame:
    """Per pair: the first box's aspect and the ratio of the boxes' sizes on the first axis, in lowest terms."""
    a, b = spans("a"), spans("b")
    aspect, size = ratio(a[1][1] - a[1][0], a[0][1] - a[0][0]), ratio(a[0][1] - a[0][0], b[0][1] - b[0][0])
    return pairs.select("a", "b", aspect[0].alias("aspect_num"), aspect[1].alias("aspect_den"), size[0].alias("size_num"), size[1].alias("size_den"))


def ordinal(a: iv.Span, b: iv.Span) -> Column:
    """How two intervals lie, without measure."""
    return F.when(iv.apart(a, b), "separated").when(iv.touch(a, b), "meets").when(iv.same(a, b), "equal").when(iv.within(a, b), "a_inside_b").when(iv.within(b, a), "b_inside_a").otherwise("overlaps")


def observe_affine(pairs: DataFrame) -> DataFrame:
    a, b = spans("a"), spans("b")
    return pairs.select("a", "b", ordinal(a[0], b[0]).alias("order_x"), ordinal(a[1], b[1]).alias("order_y"))


def corners(boxes: DataFrame) -> DataFrame:
    """The corners of every box: region, px, py."""
    four = F.array(*[F.struct(F.col(f"x{i}").alias("px"), F.col(f"y{j}").alias("py")) for i, j in product((0, 1), repeat=2)])
    return boxes.select("region", F.explode(four).alias("p")).select("region", "p.px", "p.py")


def shared_corners(boxes: DataFrame) -> DataFrame:
    """Points that are corners of two regions or more, with their number."""
    return corners(boxes).groupBy("px", "py").agg(F.count_distinct("region").alias("regions")).filter("regions >= 2")


def collinear_sets(boxes: DataFrame) -> DataFrame:
    """Lines along an axis that hold three corners or more at different places: axis, line (the other coordinate), places (sorted)."""
    c = corners(boxes).distinct()
    along = [c.select(F.lit(d).alias("axis"), F.col(line).alias("line"), F.col(place).alias("place")) for d, line, place in ((0, "py", "px"), (1, "px", "py"))]
    return along[0].unionByName(along[1]).groupBy("axis", "line").agg(F.array_sort(F.collect_set("place")).alias("places")).filter(F.size("places") >= 3)


def rect_converse(ax: Column, ay: Column) -> tuple[Column, Column]:
    """Allen masks of both axes with the boxes exchanged."""
    return ALLEN.converse(ax), ALLEN.converse(ay)


def rect_compose(one: tuple[Column, Column], two: tuple[Column, Column]) -> tuple[Column, Column]:
    """Allen masks of both axes for a and c, from those of a and b and of b and c: the axes are independent."""
    return ALLEN.compose(one[0], two[0]), ALLEN.compose(one[1], two[1])


def cross_ratios(boxes: DataFrame) -> DataFrame:
    """Cross ratios of every four neighbouring corners on a horizontal line, in lowest terms."""
    from pyspark.sql import Window as W

    line = W.partitionBy("py").orderBy("px")
    t = corners(boxes).select("px", "py").distinct()
    t = t.select("py", F.col("px").alias("t0"), *[F.lead("px", k).over(line).alias(f"t{k}") for k in (1, 2, 3)]).filter("t3 is not null")
    n, d = (F.col("t2") - F.col("t0")) * (F.col("t3") - F.col("t1")), (F.col("t2") - F.col("t1")) * (F.col("t3") - F.col("t0"))
    r = ratio(n, d)
    return t.select("py", "t0", "t1", "t2", "t3", r[0].alias("num"), r[1].alias("den"))


def observe_homeomorphism(pairs: DataFrame) -> DataFrame:
    return relations(pairs).select("a", "b", "mask", RCC8.text_of(F.col("mask")).alias("names"))
