"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text is counted in terms that describe its writing: sequences of three character classes (letters by case, digits, white space, each
ASCII sign, others), hashed to a fixed width, and binned rates (repeated neighbouring words, distinct words, word length, capitals, signs, repeated lines).
Counts are damped, weighted by inverse document frequency and normalised. A singular value decomposition of at most `MOST` labelled texts gives `RANK` latent
dimensions; their vectors are broadcast (`MOST` x `RANK` doubles at most, whatever the input). Every document meets all of them in blocked
cosine products; the `NEIGHBOURS` nearest vote with a power of their similarity as weight.

Whole texts are read; nothing else of a row counts. Null and empty texts are scored like any other (no terms: the share of label 1). Without any
labelled row the score is 0.5. Repeated rows get equal scores.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import filtered, raw
from chorale.llm.learning import labelled

#: Labelled texts to learn from at most, latent dimensions, votes, power of the similarity.
MOST, RANK, NEIGHBOURS, POWER = 4000, 32, 15, 8
WIDTH, BINS = 1024, 8
RATES = 6


def classes() -> np.ndarray:
    """Class of each byte: small letters, capitals, digits, white space, each sign by itself, controls, bytes of other letters."""
    out = np.zeros(256, np.uint32)
    signs = 6
    for b in range(256):
        if 97 <= b <= 122:
            out[b] = 0
        elif 65 <= b <= 90:
            out[b] = 1
        elif 48 <= b <= 57:
            out[b] = 2
        elif b in (9, 10, 11, 12, 13, 32):
            out[b] = 3
        elif b < 32 or b == 127:
            out[b] = 4
        elif b >= 128:
            out[b] = 5
        else:
            out[b] = signs
            signs += 1
    return out


CLASS = classes()


def terms(body: bytes) -> np.ndarray:
    """Counts of the hashed class sequences, then one-hot bins of the rates scaled to the text's length."""
    out = np.zeros(WIDTH + RATES * BINS)
    if not body:
        return out
    kinds = CLASS[np.frombuffer(body, np.uint8)]
    if len(kinds) > 2:
        code = (kinds[:-2] * np.uint32(1600) + kinds[1:-1] * np.uint32(40) + kinds[2:]) * np.uint32(2654435761) >> np.uint32(22)
        out[:WIDTH] = np.bincount(code, minlength=WIDTH)
    words = body.split()
    n = max(1, len(words))
    lines = [x for x in body.split(b"\n") if x.strip()]
    letters = max(1, int((kinds <= 1).sum()))
    rates = (
        sum(map(bytes.__eq__, words, words[1:])) / n * 4,
        1 - (len(set(words)) / n) ** 0.5,
        len(body) / n / 24,
        int((kinds == 1).sum()) / letters * 1.5,
        int((kinds > 5).sum()) / len(kinds) * 3,
        1 - len(set(lines)) / max(1, len(lines)),
    )
    for i, rate in enumerate(rates):
        out[WIDTH + i * BINS + min(BINS - 1, int(rate * BINS))] = n
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """Latent vectors of labelled texts."""

    def __init__(self, counts: np.ndarray, y: np.ndarray):
        self.y, self.base = y.astype(np.float64), (float(y.mean()) if len(y) else 0.5)
        if not len(y):
            return
        self.idf = np.log((1 + len(y)) / (1 + (counts > 0).sum(axis=0))) + 0.1
        x = weigh(counts, self.idf)
        values, vectors = np.linalg.eigh(x.T @ x)
        self.axes = vectors[:, np.argsort(values)[::-1][:RANK]]
        self.vectors = self.latent(x)

    def latent(self, x: np.ndarray) -> np.ndarray:
        v = x @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.y):
            return np.full(len(counts), 0.5)
        near = self.latent(weigh(counts, self.idf)) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.y))
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(near, best, axis=1), 1e-9) ** POWER
        score = (vote * self.y[best]).sum(axis=1) / vote.sum(axis=1)
        return np.where(counts.any(axis=1), np.clip(score, 0, 1), self.base)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MOST) -> Model:
    """`learn` picks the label rows to learn from. The terms of at most `most` texts come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([terms(t).astype("<f4").tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["label", "terms"])

    rows = labelled(docs, labels, "quality", learn, most).select("label", raw().alias("body")).mapInArrow(run, "label int, terms binary").collect()
    counts = np.array([np.frombuffer(r["terms"], "<f4") for r in rows], np.float64).reshape(len(rows), WIDTH + RATES * BINS)
    by = np.lexsort((counts.sum(axis=1), [r["label"] for r in rows])) if rows else []
    return Model(counts[by], np.array([r["label"] for r in rows])[by] if rows else np.zeros(0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = batch.column(0), batch.column(1).to_pylist()
            parts = [shared.value.score(np.array([terms(t) for t in bodies[at : at + 500]])) for at in range(0, len(bodies), 500)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw().alias("body")).mapInArrow(run, "doc_id bigint, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are predicted good, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list) -> list[bool]:
        bodies = [(t or "").encode() for t in texts]
        return [bool(g) for at in range(0, len(bodies), 500) for g in shared.value.score(np.array([terms(t) for t in bodies[at : at + 500]])) >= 0.5]

    return filtered(docs, keep)
