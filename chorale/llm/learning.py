"""What the two classifiers share: labelled rows to learn from, and a one-dimensional logistic fit."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks that share the bounded sample.
LEARNERS = 16


def labelled(docs: DataFrame, labels: DataFrame, column: str, learn: Column, most: int) -> DataFrame:
    """doc_id, text, label (0/1) of at most about `most` labelled rows that `learn` admits: an even sample by hash of the id.

    Equal texts are taken once, with the label of the smallest id; rows that share that id take the larger label. The choice depends on ids and texts
    alone, so a task that runs again learns from the same rows. `most` bounds what the fit reads, whatever the size of the table.
    """
    # one label for each document; where labels of a document differ, the larger
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & learn).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    n = marks.count()
    if n > most:  # the same rows every time; four deviations below `most`, so that the sample does not exceed it
        marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int((most - 4 * most**0.5) / n * (1 << 20)))
    texts = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(marks, "doc_id")
    first = texts.groupBy("text").agg(F.min(F.struct("doc_id", "label")).alias("d"))
    return first.select("d.doc_id", "text", "d.label").repartition(LEARNERS, "doc_id")


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Intercept and slope with a small ridge."""
    a, b = 0.0, 0.0
    data = np.column_stack((np.ones(len(x)), x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(data @ (a, b), -30, 30)))
        gradient = data.T @ (p - y) + 0.01 * np.array((a, b))
        hessian = (data * (p * (1 - p))[:, None]).T @ data + np.eye(2) * 0.01
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)
