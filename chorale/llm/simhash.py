"""SimHash near-dedup with anchor-point covering.

Fingerprints: texts are lower-cased (A-Z), cut into words `[^\\x20\\x09-\\x0D]+` and 3-word shingles (fewer words: the whole sequence;
none: fingerprint zero). A bit is 1 if it is set in over half of the shingles' XXH64 values (seed 42).

Linking: two fingerprints within 3 bits differ in at most one bit of one 32-bit half. The anchors of a half are the words of the
[31,26] Hamming code (a perfect covering code of radius 1) with the 32nd bit beside it: every half lies within 1 of an anchor. A
fingerprint is copied to every anchor within covering radius plus the half's threshold, 1 + 1 = 2 bits, so both fingerprints of a pair are at the nearest
anchor of either. Whole fingerprints are compared per anchor; a bucket hands on a spanning forest of its links, never all pairs.

Null or empty text: fingerprint zero, linked like any other. Equal fingerprints are one point, however many documents share it. Null
doc_id: the row is returned with its fingerprint and the component of it. Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.llm.buckets import forest, units
from chorale.llm.common import cut_lineage, raw
from chorale.llm.components import components

SHINGLE, BITS, LIMIT, SEED = 3, 64, 3, 42
HALF = 32
#: Column i of the check matrix of the [31,26] Hamming code is the number i + 1.
SYNDROME = np.arange(1, HALF)


def fingerprint(body: bytes) -> int:
    words = body.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        text, digest, starts, at = b" ".join(words), xxhash.xxh64_intdigest, [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        ends = [*starts[SHINGLE:], at]
        hashes = [digest(text[a : b - 1], SEED) for a, b in zip(starts, ends, strict=False)]
    bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[at : at + (1 << 16)], ">u8")
        bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, keys: Sequence[Column] = ()) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long; then `keys`, longs, as key0, key1 and so on."""
    names = [f"key{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *batch.columns[2:]], names=["doc_id", "fp", *names])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw().alias("body"), *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    return read.mapInArrow(run, ", ".join(f"{n} bigint" for n in ("doc_id", "fp", *names)))


def anchors_of(half: np.ndarray) -> np.ndarray:
    """All anchors within 2 bits of each half, one row each; equal anchors are left in (a half that is an anchor itself has one alone)."""
    code, beside = half & np.uint64(0x7FFFFFFF), half & np.uint64(0x80000000)
    s = np.zeros(len(half), np.int64)
    for i in range(HALF - 1):
        s ^= np.where((code >> np.uint64(i)) & np.uint64(1), SYNDROME[i], 0)
    one = lambda k: np.where(k > 0, np.uint64(1) << np.maximum(k - 1, 0).astype(np.uint64), np.uint64(0))
    out = [code ^ one(s)]  # the nearest anchor
    for i in SYNDROME:  # two flips i and j cancel the syndrome if i ^ j = s
        j = s ^ i
        pair = code ^ one(np.full(len(half), i)) ^ one(j)
        out.append(np.where((s > 0) & (j > i), pair, out[0]))
    near = np.stack(out, axis=1)
    # the 32nd bit is an anchor coordinate by itself: it may be the flipped one
    return np.concatenate((near | beside[:, None], (near[:, :1] | (beside ^ np.uint64(0x80000000))[:, None])), axis=1)


def covered(points: DataFrame) -> DataFrame:
    """fp, half (0 or 1), anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            bits = fp.view(np.uint64)
            for number, half in enumerate((bits & np.uint64(0xFFFFFFFF), bits >> np.uint64(32))):
                anchors = np.sort(anchors_of(half), axis=1)
                fresh = np.ones(anchors.shape, bool)
                fresh[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
                row, _ = np.nonzero(fresh)
                yield pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(np.full(len(row), number, np.int32)), pa.array(anchors[fresh].view(np.int64))], names=["fp", "half", "anchor"])

    return points.select("fp").mapInArrow(run, "fp bigint, half int, anchor bigint")


def within(fp: np.ndarray, limit: int = LIMIT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints at `limit` or fewer differing bits, in blocks."""
    for lo in range(0, len(fp), 512):
        far = np.bitwise_count(fp[lo : lo + 512, None] ^ fp[None, lo:])
        a, b = np.nonzero(far <= limit)
        yield a[a < b] + lo, b[a < b] + lo


def link_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit: the links of a spanning forest of each unit."""
    held: list[np.ndarray] = []
    last = None

    def settle() -> pa.RecordBatch | None:
        fp = np.unique(np.concatenate(held))
        if len(fp) < 2:
            return None
        root = np.array(forest(len(fp), within(fp.view(np.uint64))))
        child = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[root[child]])], names=["a", "b"]) if len(child) else None

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in ("half", "anchor", "u", "v")], axis=1)
        fp = batch.column("fp").to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(fp)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[lo].tolist())
            if key != last and held:
                if len(held) > 1 or len(held[0]) > 1:
                    if (out := settle()) is not None:
                        yield out
                held = []
            last = key
            held.append(fp[lo:hi])
    if held and (out := settle()) is not None:
        yield out


def rooted(points: DataFrame) -> DataFrame:
    """`points` (one row of each fingerprint fp) with root, the smallest fingerprint reachable over links."""
    dealt = units(covered(points), ["half", "anchor"], "fp").where("u is not null")
    keys = ["half", "anchor", "u", "v"]
    links = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(link_units, "a bigint, b bigint")
    roots = components(links)
    return points.join(roots, points["fp"] == roots["node"], "left").select(*points.columns, F.coalesce("root", "fp").alias("root"))


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links, itself included)."""
    prints = cut_lineage(fingerprints(docs))
    placed = rooted(cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("low"))))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def text_keys(body: Column) -> list[Column]:
    """128 bits that name a text; null differs from empty."""
    return [F.xxhash64(body), F.xxhash64(F.lit(1), body)]


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every component: the one with the smallest id, null ids last; of unlike texts with that id in the component the one with the
    smallest text key; of rows equal in id and text any one. An id that leads two components is kept for both."""
    prints = fingerprints(docs, text_keys(F.col("text").cast("binary"))).groupBy("fp", "doc_id", "key0", "key1").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key0", "key1", "rows"))
    placed = rooted(cut_lineage(prints.groupBy("fp").agg(first.alias("low"))))
    lead = cut_lineage(placed.groupBy("root").agg(F.min("low").alias("low")).select("low.doc_id", "low.key0", "low.key1", "low.rows"))

    def of(some: DataFrame) -> DataFrame:
        # the ids are the side to hash; sorting would drag the texts along
        body = docs["text"].cast("binary")
        same = docs["doc_id"].cast("long").eqNullSafe(some["doc_id"]) & (text_keys(body)[0] == some["key0"]) & (text_keys(body)[1] == some["key1"])
        return docs.join(some.hint("shuffle_hash"), same, "left_semi")

    return of(lead.where("rows = 1")).union(of(lead.where("rows > 1")).dropDuplicates(["doc_id", "text"]))


def keep_first(docs: DataFrame) -> DataFrame:
    """`keep_one` for callers that need ids to be keys: rows without an id are left out, of equal ids one row stays. The pipeline does not use it."""
    return keep_one(docs).where("doc_id is not null").dropDuplicates(["doc_id"])
