"""Grid fields: thresholds, memberships, components and visibility.

A field is a long table (i0, i1, value) over a whole grid; memberships add a region and its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.durable import durable, spread


def cells(spark: SparkSession, n0: int, n1: int) -> DataFrame:
    """All cells of a grid, row by row."""
    if n0 <= 0 or n1 <= 0:
        raise ValueError("a grid needs at least one cell on each axis")
    return spark.range(n0 * n1).selectExpr(f"cast(id div {n1} as int) as i0", f"cast(id % {n1} as int) as i1")


def flat_index(i0: Column, i1: Column, n1: int) -> Column:
    return i0 * n1 + i1


def center(i: Column, origin: float, spacing: float) -> Column:
    return origin + i * spacing


def threshold(field: DataFrame, num: int, den: int = 1) -> DataFrame:
    """Cells whose value is at least num/den, compared in whole numbers."""
    return field.filter(F.col("value") * den >= num).select("i0", "i1")


def threshold_decision(field: DataFrame, num: int, den: int, region: str, actor: str = "designer") -> DataFrame:
    """The decision that a threshold stands for: one row with the number of cells it takes."""
    n = threshold(field, num, den).agg(F.count(F.lit(1)).alias("n_cells"))
    return n.select(F.lit(f"threshold:{region}:{num}/{den}").alias("id"), F.lit(region).alias("target"), F.format_string(f"tau={num}/{den} cells=%d", "n_cells").alias("fixed_value_or_domain"), F.lit(actor).alias("actor"), "n_cells")


def argmax(members: DataFrame) -> DataFrame:
    """The region of greatest membership of every cell; the earliest region among equals."""
    best = F.max_by("region", F.struct(F.col("value"), -F.col("ord")))
    return members.groupBy("i0", "i1").agg(best.alias("region"))


def indicator(own: DataFrame, grid: DataFrame) -> DataFrame:
    """1 on the given cells and 0 elsewhere on the grid; a cell outside the grid fails the query."""
    marked = own.select("i0", "i1").distinct().withColumn("in_", F.lit(1))
    known = grid.withColumn("grid_", F.lit(1))
    out = F.when(F.col("grid_").isNull(), F.raise_error(F.lit("cell outside the grid")).cast("int")).otherwise(F.coalesce("in_", F.lit(0)))
    return known.join(marked, ["i0", "i1"], "full").select("i0", "i1", out.alias("value"))


def ungrounded(members: DataFrame) -> DataFrame:
    """One row: whether any cell is not wholly in exactly one region."""
    per = members.groupBy("i0", "i1").agg(F.count_if(F.col("value") == 1).alias("ones"), F.count_if(~F.col("value").isin(0, 1)).alias("others"))
    return per.agg(F.coalesce(F.bool_or((F.col("ones") != 1) | (F.col("others") > 0)), F.lit(False)).alias("ungrounded"))


def components(own: DataFrame) -> DataFrame:
    """Cells with the number of their component (0 for the one with the least cell), cells meeting at faces. Rounds take least labels from neighbours, hand them on to labels' own cells, and then follow labels, so they grow with the logarithm of a component's size."""
    cell = lambda i, j: F.shiftleft(F.col(i).cast("long"), 32) + F.col(j).cast("long")
    c = durable(own.select("i0", "i1").distinct().withColumn("cell", cell("i0", "i1")))
    step = F.explode(F.array(*[F.struct((F.col("i0") + d).alias("j0"), (F.col("i1") + e).alias("j1")) for d, e in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    beside = c.select("cell", step.alias("n")).select("cell", F.col("n.j0").alias("j0"), F.col("n.j1").alias("j1")).select("cell", cell("j0", "j1").alias("other"))
    near = durable(beside.join(c.select(F.col("cell").alias("other")), "other"))
    now = durable(c.select("cell", F.col("cell").alias("label")))
    while True:
        low = near.join(now.select(F.col("cell").alias("other"), "label"), "other").groupBy("cell").agg(F.min("label").alias("low"))
        told = now.join(low, "cell")  # a cell's best news goes to the cell and to the one that its label names
        best = told.select("cell", "low").unionByName(told.select(F.col("label").alias("cell"), "low")).groupBy("cell").agg(F.min("low").alias("low"))
        moved = durable(now.join(best, "cell", "left").select("cell", F.col("label").alias("was"), F.least("label", F.coalesce("low", "label")).alias("label")))
        up = moved.select(F.col("cell").alias("label"), F.col("label").alias("higher"))
        new = durable(moved.join(up, "label").select("cell", "was", F.least("label", "higher").alias("label")))
        now = new.select("cell", "label")
        if new.filter("label <> was").isEmpty():
            break
    numbers = now.select("label").distinct().select("label", (F.row_number().over(W.orderBy("label")) - 1).alias("component"))  # one row a component
    return now.join(numbers, "label").join(c, "cell").select("i0", "i1", "component")


def signatures(labelled: DataFrame) -> DataFrame:
    """Per component: its size, least cell, and a short digest of its cells in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i0", "i1"))), lambda c: F.concat(c["i0"].cast("string"), F.lit(","), c["i1"].cast("string"))), ";")
    return labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n_cells"), F.min(F.struct("i0", "i1")).alias("least"), text.alias("text")).select("component", "n_cells", F.col("least.i0").alias("i0"), F.col("least.i1").alias("i1"), F.substring(F.sha1("text"), 1, 12).alias("digest"))


def threshold_regions(field: DataFrame, num: int, den: int, region: str) -> DataFrame:
    """Threshold, components, and one decision for each."""
    s = signatures(components(threshold(field, num, den)))
    return s.select(F.format_string(f"{region}#c%d", "component").alias("target"), "n_cells", "digest")


def directions(n: int) -> list[tuple[float, float]]:
    """n rays to evenly spaced points of the square around a point, against the clock from its right side."""
    if n < 3:
        raise ValueError("at least three directions are needed")
    out = []
    for k in range(n):
        s = 8 * k / n
        out.append((1.0, s) if s < 1 else (2 - s, 1.0) if s < 3 else (-1.0, 4 - s) if s < 5 else (s - 6, -1.0) if s < 7 else (1.0, s - 8))
    return out


def isovist(points: DataFrame, obstacles: DataFrame, domain: tuple[float, float, float, float], n: int = 8) -> DataFrame:
    """Per vantage (id, px, py): area seen, share of rays that an obstacle stops before the domain's edge, and perimeter.

    `obstacles` (x0, x1, y0, y1) is a small drawing: its rows are counted and broadcast as one array. A vantage in or on an obstacle sees nothing: area 0, occlusivity 1, perimeter 0. Rays are an array per vantage; vantages alone are dealt to tasks.
    """
    if (count := obstacles.count()) > 100_000:
        raise ValueError(f"{count} obstacles: cut the drawing into tiles first")
    drawn = obstacles.agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1")])).alias("boxes_"))
    p = spread(points, "id").crossJoin(F.broadcast(drawn))  # one row
    px, py, (lx, hx, ly, hy) = F.col("px").cast("double"), F.col("py").cast("double"), domain
    rays = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in directions(n)])
    far = F.lit(float("inf"))

    def axis(p, d, lo, hi):
        a, b = F.when(d == 0, F.when((p >= lo) & (p <= hi), -far).otherwise(far)).otherwise((F.when(d > 0, lo).otherwise(hi) - p) / F.when(d == 0, 1.0).otherwise(d)), F.when(d == 0, F.when((p >= lo) & (p <= hi), far).otherwise(-far)).otherwise((F.when(d > 0, hi).otherwise(lo) - p) / F.when(d == 0, 1.0).otherwise(d))
        return a, b

    def enter(r):
        def of(b):
            (ax, bx), (ay, by) = axis(px, r["dx"], b["x0"], b["x1"]), axis(py, r["dy"], b["y0"], b["y1"])
            lo, hi = F.greatest(ax, ay), F.least(bx, by)
            return F.when((lo <= hi) & (hi >= 0), F.greatest(lo, F.lit(0.0)))

        return of

    def cast(r):
        leave = F.least(axis(px, r["dx"], F.lit(lx), F.lit(hx))[1], axis(py, r["dy"], F.lit(ly), F.lit(hy))[1])
        hit = F.coalesce(F.array_min(F.transform("boxes_", enter(r))), far)
        t = F.least(hit, leave)
        return F.struct((px + t * r["dx"]).alias("x"), (py + t * r["dy"]).alias("y"), (hit < leave).cast("int").alias("stopped"))

    inside = F.exists("boxes_", lambda b: (px >= b["x0"]) & (px <= b["x1"]) & (py >= b["y0"]) & (py <= b["y1"]))
    p = p.withColumn("inside_", inside).withColumn("hits_", F.transform(rays, cast))
    after = F.concat(F.slice("hits_", 2, n), F.slice("hits_", 1, 1))
    turns = F.zip_with("hits_", after, lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("c"), F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2).alias("l")))
    total = lambda f: F.aggregate(turns, F.lit(0.0), lambda acc, t: acc + t[f])
    stopped = F.aggregate("hits_", F.lit(0), lambda acc, h: acc + h["stopped"])
    return p.select("id", F.when(F.col("inside_"), 0.0).otherwise(F.abs(total("c")) / 2).alias("area"), F.when(F.col("inside_"), 1.0).otherwise(stopped / n).alias("occlusivity"), F.when(F.col("inside_"), 0.0).otherwise(total("l")).alias("perimeter"))
