"""Bounded samples of labelled rows and a small logistic regression, shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 0 modulo 5 (a null id is never learnt from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> list[tuple[str, int]]:
    """At most `most` (text, label) pairs of each class, from rows that may be learnt from, chosen by a hash of the id.

    The choice is made on the slim labels first; only its texts come to the driver.
    """
    own = labels.select(F.col("doc_id").alias("id_"), F.col(label).cast("int").alias("y_")).filter(F.col("id_").isNotNull() & F.col("y_").isin(0, 1) & ~held_out(F.col("id_"))).distinct()
    chosen = [own.filter(F.col("y_") == y).orderBy(F.xxhash64("id_"), "id_").limit(most) for y in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * most slim rows
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(picked, F.col("doc_id") == F.col("id_"))
    return sorted((r[0], r[1]) for r in rows.select("text", "y_").toLocalIterator())


class Logistic:
    """Logistic regression on standardised features with a ridge, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        w = np.ones(len(x)) if weight is None else weight
        self.beta = np.zeros(z.shape[1])
        penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            gradient = z.T @ (w * (y - p)) - penalty @ self.beta
            step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(self.beta)), gradient)
            self.beta += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.beta[0] + ((x - self.mean) / self.scale) @ self.beta[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
