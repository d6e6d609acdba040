"""Measures on many contact graphs at once (edges g, u, v): depths, asymmetry, integration, betweenness, and the structure of equality constraints.

Searches run from all roots of all graphs together, a level a round; betweenness of many small graphs runs a graph a group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import RCC8
from ..functions.durable import durable, spread

#: Relations in which two regions touch or overlap.
CONTACT = RCC8.mask("EC", "PO")


def access_graph(constraints: DataFrame, passable: DataFrame | None = None) -> DataFrame:
    """Undirected contact edges of constraints (g, id, src, dst, mask, status) that may touch: parallel ones merged; an edge is passable only where a constraint's id is listed."""
    c = constraints.filter(F.col("mask").bitwiseAND(F.lit(CONTACT)) != 0)
    listed = F.lit(False)
    if passable is not None:
        c = c.join(passable.select(F.col("id").alias("p_")).distinct(), F.col("id") == F.col("p_"), "left")
        listed = F.col("p_").isNotNull()
    certain = F.col("mask").bitwiseAND(F.lit(~CONTACT & 255)) == 0
    return c.groupBy("g", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.bit_or("mask").alias("rcc8"), F.bool_and(certain).alias("contact_certain"), F.bool_or(listed).alias("passable"), F.bool_or(F.col("status") != "delegated").alias("grounding_decided"))


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.filter(F.coalesce("passable", F.lit(True))) if "passable" in edges.columns else edges
    return e.select("g", "u", "v").unionByName(e.select("g", F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select("g", F.explode(F.array("u", "v")).alias("node")).distinct()


def depths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Steps from every root (g, root) to the nodes it reaches over passable edges: g, root, node, depth. A round a level."""
    e = durable(both_ways(edges))
    seen = durable(roots.select("g", "root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    last, level = seen, 0
    while True:
        level += 1
        step = last.select("g", "root", F.col("node").alias("u")).join(e, ["g", "u"]).select("g", "root", F.col("v").alias("node")).distinct()
        last = durable(step.join(seen, ["g", "root", "node"], "left_anti").withColumn("depth", F.lit(level)))
        if last.isEmpty():
            return seen
        seen = durable(seen.unionByName(last))


def justified(edges: DataFrame, depth: DataFrame) -> DataFrame:
    """Edges among the nodes that a root reaches, with both depths."""
    e = edges.filter(F.coalesce("passable", F.lit(True))) if "passable" in edges.columns else edges
    one = depth.select("g", "root", F.col("node").alias("u"), F.col("depth").alias("u_depth"))
    two = depth.select("g", "root", F.col("node").alias("v"), F.col("depth").alias("v_depth"))
    return e.join(one, ["g", "u"]).join(two, ["g", "root", "v"]).select("g", "root", "u", "v", "u_depth", "v_depth")


def mean_depth(depth: DataFrame) -> DataFrame:
    """Per root: the number of nodes it reaches (itself too), the sum of depths, and the mean depth as total/(n - 1); NULL alone."""
    per = depth.groupBy("g", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("total"))
    return per.withColumn("md_den", F.when(F.col("n") >= 2, F.col("n") - 1))


def d_value(n: Column) -> Column:
    """Asymmetry of a diamond of n nodes; NULL below 3."""
    return F.when(n >= 3, 2 * (n * (F.log2((n + 2) / 3) - 1) + 1) / ((n - 1) * (n - 2)))


def integration(depth: DataFrame) -> DataFrame:
    """Per root: relative asymmetry as a fraction 2(md - 1)/(n - 2), and divided by that of a diamond; NULL below 3 nodes. Lower is more integrated."""
    per = mean_depth(depth)
    big = F.col("n") >= 3
    num, den = F.when(big, 2 * (F.col("total") - F.col("n") + 1)), F.when(big, (F.col("n") - 1) * (F.col("n") - 2))
    return per.select("g", "root", "n", "total", num.alias("ra_num"), den.alias("ra_den")).withColumn("rra", F.col("ra_num") / F.col("ra_den") / d_value(F.col("n")))


def _brandes(nodes: list, nbrs: dict, weight: dict | None = None) -> tuple[dict, dict]:
    """Betweenness of nodes and of directed edges in one graph, shortest paths counted by hops or by weight."""
    import heapq

    node_score, edge_score = dict.fromkeys(nodes, 0.0), {}
    for s in nodes:
        dist, count, order, before = {s: 0}, {s: 1}, [], {s: []}
        heap, done = [(0, 0, s)], set()
        tick = 0
        while heap:
            d, _, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            order.append(x)
            for y in nbrs.get(x, ()):
                nd = d + (weight[x, y] if weight else 1)
                if y not in dist or nd < dist[y]:
                    dist[y], count[y], before[y] = nd, count[x], [x]
                    tick += 1
                    heapq.heappush(heap, (nd, tick, y))
                elif nd == dist[y] and y not in done:
                    count[y] += count[x]
                    before[y].append(x)
        gain = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in before[y]:
                part = count[x] / count[y] * (1 + gain[y])
                edge_score[x, y] = edge_score.get((x, y), 0.0) + part
                gain[x] += part
            if y != s:
                node_score[y] += gain[y]
    return node_score, edge_score


def choice(edges: DataFrame, normalized: bool = True) -> DataFrame:
    """Betweenness of the nodes of every graph over passable edges: g, node, choice. Normalised by the number of pairs of other nodes, else halved for undirected paths."""
    kept = edges.withColumn("open_", F.coalesce("passable", F.lit(True)) if "passable" in edges.columns else F.lit(True)).select("g", "u", "v", "open_")

    def work(group: pd.DataFrame) -> pd.DataFrame:
        nodes, nbrs = sorted({*group["u"], *group["v"]}), {}
        for u, v, ok in zip(group["u"], group["v"], group["open_"], strict=True):
            if ok and u != v:
                nbrs.setdefault(u, set()).add(v)
                nbrs.setdefault(v, set()).add(u)
        score, _ = _brandes(nodes, {k: sorted(v) for k, v in nbrs.items()})
        n = len(nodes)
        scale = (1 / ((n - 1) * (n - 2)) if n > 2 else 0.0) if normalized else 0.5
        return pd.DataFrame({"g": group["g"].iloc[0], "node": nodes, "choice": [score[x] * scale for x in nodes]})

    return spread(kept, "g").groupBy("g").applyInPandas(work, f"g {edges.schema['g'].dataType.simpleString()}, node {edges.schema['u'].dataType.simpleString()}, choice double")


def flow_betweenness(arcs: DataFrame, weighted: bool = False, normalized: bool = True) -> DataFrame:
    """Betweenness of directed arcs (g, u, v, weight) of every graph: g, u, v, score. Normalised by the number of ordered pairs."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        nodes, nbrs, weight = sorted({*group["u"], *group["v"]}), {}, {}
        for u, v, w in zip(group["u"], group["v"], group["weight"], strict=True):
            nbrs.setdefault(u, []).append(v)
            weight[u, v] = w
        _, score = _brandes(nodes, {k: sorted(v) for k, v in nbrs.items()}, weight if weighted else None)
        n = len(nodes)
        scale = (1 / (n * (n - 1)) if n > 1 else 0.0) if normalized else 1.0
        return pd.DataFrame({"g": group["g"], "u": group["u"], "v": group["v"], "score": [score.get((u, v), 0.0) * scale for u, v in zip(group["u"], group["v"], strict=True)]})

    k = arcs.schema
    return spread(arcs.select("g", "u", "v", "weight"), "g").groupBy("g").applyInPandas(work, f"g {k['g'].dataType.simpleString()}, u {k['u'].dataType.simpleString()}, v {k['v'].dataType.simpleString()}, score double")


def component_labels(edges: DataFrame) -> DataFrame:
    """Per node of every graph: the least node of its component (g, node, label)."""
    e = durable(edges.select("g", "u", "v").unionByName(edges.select("g", F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    now = durable(e.groupBy("g", F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")))
    while True:
        low = e.join(now.withColumnRenamed("node", "v"), ["g", "v"]).groupBy("g", F.col("u").alias("node")).agg(F.min("label").alias("low"))
        told = now.join(low, ["g", "node"])  # a node's best news goes to the node and to the one that its label names
        best = told.select("g", "node", "low").unionByName(told.select("g", F.col("label").alias("node"), "low")).groupBy("g", "node").agg(F.min("low").alias("low"))
        moved = durable(now.join(best, ["g", "node"]).select("g", "node", F.col("label").alias("was"), F.least("label", "low").alias("label")))
        up = moved.select("g", F.col("node").alias("label"), F.col("label").alias("higher"))
        new = durable(moved.join(up, ["g", "label"]).select("g", "node", "was", F.least("label", "higher").alias("label")))
        now = new.select("g", "node", "label")
        if new.filter("label <> was").isEmpty():
            return now


def dm_blocks(equalities: DataFrame) -> DataFrame:
    """Dulmage-Mendelsohn blocks of equalities between regions (g, u, v; parallel rows count, rows from a region to itself do not): per region its block.

    Each equality ties two unknowns, so a component with fewer equalities than regions is under-determined, one with as many is well determined, and one with more is over-determined; the trees that hang off an over-determined component's cycles are well determined and are peeled leaf by leaf.
    """
    e = durable(equalities.select("g", "u", "v").filter("u <> v"))
    label = durable(component_labels(e))
    size = label.groupBy("g", "label").agg(F.count(F.lit(1)).alias("regions"))
    ties = e.join(label.withColumnRenamed("node", "u"), ["g", "u"]).groupBy("g", "label").agg(F.count(F.lit(1)).alias("ties"))
    kind = F.when(F.col("ties") < F.col("regions"), "under").when(F.col("ties") == F.col("regions"), "well").otherwise("over")
    named = durable(label.join(size, ["g", "label"]).join(ties, ["g", "label"]).withColumn("block", kind))
    left = durable(e.join(named.filter("block = 'over'").select("g", F.col("node").alias("u")), ["g", "u"], "left_semi"))
    while True:
        ends = left.select("g", F.col("u").alias("node")).unionByName(left.select("g", F.col("v").alias("node")))
        leaves = durable(ends.groupBy("g", "node").count().filter("count = 1").select("g", "node"))
        if leaves.isEmpty():
            break
        left = durable(left.join(leaves.withColumnRenamed("node", "u"), ["g", "u"], "left_anti").join(leaves.withColumnRenamed("node", "v"), ["g", "v"], "left_anti"))
    core = left.select("g", F.col("u").alias("node")).unionByName(left.select("g", F.col("v").alias("node"))).distinct().withColumn("core_", F.lit(True))
    block = F.when((F.col("block") == "over") & F.col("core_").isNull(), "well").otherwise(F.col("block"))
    return named.join(core, ["g", "node"], "left").select("g", "node", block.alias("block"), "regions", "ties")
