"""Small classifiers fitted with numpy on bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    """Fold 0, and rows without an id (never learnt from)."""
    return F.coalesce(fold(doc_id) == 0, F.lit(True))


def labelled_sample(labels: DataFrame, label: str, bound: int, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, label) of at most ``bound`` labelled ids outside fold 0, by
    the order of a hash. An id with contradicting labels is left out."""
    one = (labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(doc_id)))
           .groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("other"))
           .where("label = other").select("doc_id", F.col("label").cast("int").alias("label")))
    return one.orderBy(F.md5(F.concat(F.lit("sample"), F.col("doc_id").cast("string")))).limit(bound)


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray | None = None, ridge: float = 1.0,
             weight: np.ndarray | None = None, rounds: int = 40,
             more: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Ridge logistic regression towards ``prior`` by Newton steps; the last
    coefficient is the constant. Soft labels are allowed. ``more``: further rows by
    the gradient and Hessian of their loss at some coefficients (at, g, h)."""
    a = np.column_stack([x, np.ones(len(x))])
    prior = np.zeros(a.shape[1]) if prior is None else np.asarray(prior, float)
    pen = np.full(a.shape[1], ridge)
    pen[-1] = 1e-6
    weight = np.ones(len(a)) if weight is None else weight
    b = prior.copy()

    def loss(c):
        z = a @ c
        own = (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (pen * (c - prior) ** 2).sum()
        return own if more is None else own + more[1] @ (c - more[0]) + 0.5 * (c - more[0]) @ more[2] @ (c - more[0])

    if not len(a):
        return b
    now = loss(b)
    for _ in range(rounds):
        p = sigmoid(a @ b)
        g = a.T @ (weight * (p - y)) + pen * (b - prior)
        h = (a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(pen)
        if more is not None:
            g, h = g + more[1] + more[2] @ (b - more[0]), h + more[2]
        step, t = np.linalg.solve(h, g), 1.0
        while t > 1e-4 and (new := loss(b - t * step)) > now:
            t /= 2
        if t <= 1e-4:
            break
        b, done, now = b - t * step, now - new < 1e-9 * max(1.0, abs(now)), new
        if done:
            break
    return b


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
