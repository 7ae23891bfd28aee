"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

On a bounded sample (`SAMPLE` distinct vectors, by hash) principal directions and a rotation for balanced binary codes are learned; every vector gets a
code of `BITS` bits. The code is cut into `TABLES` substrings; vectors with equal label and equal substring share a bucket of that table, and inside a
bucket the original vectors decide by cosine in double precision. A pair is counted in the first table that brings it together. Buckets hand on link
counts and a spanning forest, no pairs; large buckets are cut into units.

Null, zero or non-finite vectors and those with null components link with nothing; so do null labels. Vectors of different length never link; each length in the
table is a pass with a rotation of its own. Equal vectors of one label are one point with a weight. Rows with null vec_id are returned, kept false if linked. Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.buckets import forest, units
from chorale.llm.common import cut_lineage
from chorale.llm.components import components

SAMPLE, BITS, TABLES, LIMIT, ROUNDS, SEED = 4096, 64, 8, 0.93, 30, 7


def fit_itq(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) whose signs are the code."""
    mean = x.mean(axis=0)
    _, _, directions = np.linalg.svd(x - mean, full_matrices=True)
    rng = np.random.default_rng(seed)
    blocks = []
    for at in range(0, bits, x.shape[1]):  # more bits than dimensions: further rotations of the same directions
        d = directions[: min(bits - at, x.shape[1])].T
        v = (x - mean) @ d
        r = np.linalg.qr(rng.standard_normal((d.shape[1], d.shape[1])))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        blocks.append(d @ r)
    return mean, np.concatenate(blocks, axis=1)


def usable(column: str = "embedding"):
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def coded(points: DataFrame, length: int, mean: np.ndarray, projection: np.ndarray, tables: int) -> DataFrame:
    """A row per table: label, tab, key, code, node, weight, embedding."""
    shared = points.sparkSession.sparkContext.broadcast((mean, projection))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, p = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.array(batch.column("embedding").to_pylist(), np.float64)
            x /= np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) * np.abs(x).max(axis=1, keepdims=True)
            bits = np.packbits((x - m) @ p >= 0, axis=1)
            width = bits.shape[1] // tables
            for t in range(tables):
                key = np.zeros(n, np.int64)
                for k in range(width):
                    key = key * 256 + bits[:, t * width + k]
                code = pa.array([r.tobytes() for r in bits], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(np.full(n, t, np.int32)), pa.array(key), code, batch.column("node"), batch.column("weight"), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "tab", "key", "code", "node", "weight", "unit_vector"])

    return points.where(F.size("embedding") == length).select("label", "node", "weight", "embedding").mapInArrow(run, "label string, tab int, key bigint, code binary, node bigint, weight bigint, unit_vector binary")


def settle(limit: float, tables: int):
    """Per unit: node, links (weight of what it links to, counted here), root (smallest node of its component in this unit)."""

    def run(table: pa.Table) -> pa.Table:
        n, tab = table.num_rows, table.column("tab")[0].as_py()
        u, v = table.column("u")[0].as_py(), table.column("v")[0].as_py()
        node, weight, part = (table.column(c).to_numpy() for c in ("node", "weight", "part"))
        by = np.argsort(node)
        node, weight, part = node[by], weight[by], part[by]
        x = np.frombuffer(b"".join(table.column("unit_vector").to_pylist())).reshape(n, -1)[by]
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(n, tables, -1)[by]
        links = np.zeros(n, np.int64)

        def pairs():
            for lo in range(0, n, 512):
                hit = x[lo : lo + 512] @ x[lo:].T >= limit
                a, b = np.nonzero(hit)
                a, b = a[a < b] + lo, b[a < b] + lo
                yield a, b
                fresh = ~(code[a, :tab] == code[b, :tab]).all(axis=2).any(axis=1)  # no earlier table has the pair
                if u != v:
                    fresh &= part[a] != part[b]  # pairs of one part are counted in its own unit
                np.add.at(links, a[fresh], weight[b[fresh]])
                np.add.at(links, b[fresh], weight[a[fresh]])

        root = np.array(forest(n, pairs()))
        some = (links > 0) | (root != np.arange(n))
        return pa.Table.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[root[some]])], names=["node", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, limit: float = LIMIT, tables: int = TABLES, bits: int = BITS) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    rows = rows.withColumn("use", usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # equal vectors of one label are one point; -0.0 and 0.0 are one number
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    points = cut_lineage(rows.where("use").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.min("use").alias("use")).drop("use"))
    found = None
    for length in [r[0] for r in points.select(F.size("embedding")).distinct().collect()]:
        own = points.where(F.size("embedding") == length)
        n = own.count()
        chosen = own.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(min(1.0, 2 * SAMPLE / n) * (1 << 20)) + 1).select("embedding").limit(SAMPLE)
        x = np.array([r[0] for r in chosen.collect()], np.float64).reshape(-1, length)
        x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else np.eye(length)
        mean, projection = fit_itq(x, bits)
        dealt = units(coded(own, length, mean, projection, tables), ["label", "tab", "key"], "node")
        some = dealt.groupBy("label", "tab", "key", "u", "v").applyInArrow(settle(limit, tables), "node bigint, links bigint, root bigint")
        found = some if found is None else found.union(some)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut_lineage(found)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("a"), "root")
    named = points.join(counts, "node", "left").join(roots, points["node"] == roots["a"], "left")
    named = named.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    out = rows.where("use").join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.col("use")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
