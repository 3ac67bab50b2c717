"""Bounded samples of labelled rows, for the operators that learn."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, folds: int, fold: int) -> F.Column:
    """Whether the row's fold, by the crc32 of its id as text, is the one kept from learning; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, eligible: F.Column, per_class: int | tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y, place) of at most ``per_class`` labelled rows of either class, or of 0 and of 1.

    The ids with the smallest hashes are taken, so the sample doesn't depend on
    how rows are partitioned.  Their list is bounded by these numbers and so
    may be broadcast; the texts come from one scan of ``docs``.
    """
    known = labels.select(F.col(id_col).cast("long").alias(id_col), F.col(label).cast("int").alias("y")).where(eligible & F.col(id_col).isNotNull() & F.col("y").isin(0, 1))
    known = known.groupBy(id_col).agg(F.max("y").alias("y")).withColumn("place", F.xxhash64(F.lit(label), id_col))
    picked = None
    sizes = per_class if isinstance(per_class, tuple) else (per_class, per_class)
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy("place").limit(sizes[y])
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), id_col).select(F.col(id_col).alias("id"), "text", "y", "place")


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, offset and mean log-loss of a logistic in one variable, by damped Newton steps."""
    scale = x.std() or 1.0
    X = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        grad = X.T @ (p - y) / len(y) + 1e-4 * w
        hess = (X * (p * (1 - p))[:, None]).T @ X / len(y) + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(X @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return float(w[0] / scale), float(w[1]), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
