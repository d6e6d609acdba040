"""Connected components of a table of links, by least labels with shortcuts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of links that form a spanning forest of the links (a, b)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, dtype=np.int64)


def _thin(batches):
    for batch in batches:
        if batch.num_rows:
            yield batch.take(pa.array(spanning(*(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))))


def components(links: DataFrame) -> DataFrame:
    """Per node of `links` (a long, b long): node and label, the least node of its component.

    Links are first thinned to forests within each batch. A round gives every node, and the node that its label names, the least label of its neighbours, and then every node its label's label, so rounds grow with the logarithm of a component's size; each round's labels are kept durably. Null ends are ignored. The result is kept (`release` frees it) and has a further column, was.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    links = links.mapInArrow(_thin, "a long, b long")
    both = durable(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        told = durable(labels.join(near, "node"))  # a node's best news goes to the node and to the one that its label names
        best = told.select("node", "low").unionByName(told.select(F.col("label").alias("node"), "low")).groupBy("node").agg(F.min("low").alias("low"))
        moved = durable(labels.join(best, "node").select("node", F.col("label").alias("was"), F.least("label", "low").alias("label")))
        up = moved.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        new = durable(moved.join(up, "label", "left").select("node", F.least("label", F.coalesce("higher", "label")).alias("label"), "was"))
        settled = new.filter("label <> was").isEmpty()
        release(told, moved, labels)
        labels = new
        if settled:
            release(both)
            return labels
