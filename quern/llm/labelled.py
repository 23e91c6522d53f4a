"""Labelled samples for fitting classifiers, folds, and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, write_table

#: A classifier is fitted on so many labelled documents at most, each of at most so many characters, and all of so many.
SAMPLE_ROWS = 8_000
SAMPLE_CHARS = 32_768
SAMPLE_TOTAL = 50_000_000


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, total: int = SAMPLE_TOTAL) -> tuple[list[str], np.ndarray]:
    """Texts and labels (0 or 1) of the first `rows` labelled documents by hash of their id, none of the held-out fold.

    Null ids and labels are passed over; of several labels for a document the largest counts. Longer
    texts than `chars` are left out, and what follows once all hold `total` characters: the driver
    holds no more than that.
    """
    fold = fold_of(F.col("doc_id"), folds)
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold != held_out)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    chosen = chosen.withColumn("_order", F.xxhash64("doc_id")).orderBy("_order", "doc_id").limit(rows)
    found = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(chosen), "doc_id").withColumn("_chars", F.coalesce(F.length("_text"), F.lit(0))).where(F.col("_chars") <= chars)
    found = write_table(found, "labelled-sample")
    held, last = 0, None
    for r in found.select("_order", "doc_id", "_chars").orderBy("_order", "doc_id").toLocalIterator():
        held += r["_chars"]
        if held > total:
            last = (r["_order"], r["doc_id"])
            break
    if last is not None:
        found = found.where((F.col("_order") < last[0]) | ((F.col("_order") == last[0]) & (F.col("doc_id") < last[1])))
    got = sorted((r["doc_id"], r["_text"] or "", r["_label"]) for r in found.collect())
    drop_table(found)
    return [t for _, t, _ in got], np.array([y for *_, y in got], dtype=np.float64)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights, the last of them the intercept, by Newton's method on the ridge-penalised likelihood of soft labels y."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge * max(1, len(x)))
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(a @ w)
        grad = a.T @ (p - y) + penalty * w
        curve = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(curve, grad)
        step *= min(1.0, 4.0 / max(1e-12, float(np.abs(a @ step).max(initial=0.0))))
        w -= step
        if np.abs(step).max(initial=0.0) < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
