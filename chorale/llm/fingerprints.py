"""One-permutation MinHash fingerprints of documents, and how alike a document, its edited text and the next document are.

The five-word shingles of a text (words `[^\\x20\\x09-\\x0D]+`, unchanged; fewer than five words: one shingle of all) are hashed once.
The high bits of a hash name one of BINS bins, the least of the other bits stays. Empty bins are filled by optimal densification:
bin i asks bins h(i, 1), h(i, 2), ... until one is filled, the same sequence for every text. The low BITS bits of each bin are stored,
packed, as hex. Of two fingerprints that agree in a share m of the bins the likeness is (m - c) / (1 - c), c = 2 ** -BITS, at least 0:
bins that agree by chance are taken out.

The edited text of a document has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document
in descending doc_id; after the last comes the first. Documents are dealt by ranges of that order, packed; the first document of
a range travels to the range before as well, so no task sees more than a range.

Null or empty text: no shingle, every stored bit 0; likeness 1 to another text without words, 0 to any other. Null doc_id: after all
others. Rows with one id follow in descending order of their text's 64-bit hash, then of the text; equal rows follow one another and are
worked out once. One row: it is its own next document. An empty table gives no rows. Other columns are ignored.
"""
from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, BINS, BITS = 5, 512, 6
#: Bytes of text meant for one range; sampled keys a range, of which every such is a border.
RANGE_BYTES, SAMPLED = 6 << 20, 8
#: Bytes of text whose words are hashed together, and the most texts among them.
BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 512
MIX = np.uint64(0x9E3779B97F4A7C15)
FIELDS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle."""
    split = [t.split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for s in split for w in s), np.uint64, int(sizes.sum()))
    owner, first = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    parts, owners = [], []
    if len(h) >= SHINGLE:
        got = mix(h[: len(h) - SHINGLE + 1] + np.uint64(1))
        for k in range(1, SHINGLE):
            got = mix(got + h[k : len(h) - SHINGLE + 1 + k])
        whole = owner[: len(got)] == owner[SHINGLE - 1 :]
        parts.append(got[whole])
        owners.append(owner[: len(got)][whole])
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        one = np.zeros(len(short), np.uint64)
        for n, i in enumerate(short.tolist()):
            x = np.uint64(sizes[i] + 100)
            for w in h[first[i] : first[i] + sizes[i]]:
                x = mix(np.array([x]) + w)[0]
            one[n] = x
        parts.append(one)
        owners.append(short)
    return (np.concatenate(parts), np.concatenate(owners)) if parts else (h[:0], owner[:0])


def densify(table: np.ndarray, empty: np.uint64) -> None:
    """Fill the empty bins of every row that has a full one."""
    row, bin_ = np.nonzero((table == empty) & (table != empty).any(axis=1)[:, None])
    filled, step = table.copy(), 0
    while len(row):
        step += 1
        ask = (mix(bin_.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(step)) % np.uint64(BINS)).astype(np.int64)
        got = filled[row, ask]
        full = got != empty
        table[row[full], bin_[full]] = got[full]
        row, bin_ = row[~full], bin_[~full]


def fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Stored bits (a row of BINS small numbers for every text) and whether the text has any shingle."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    table = np.full((len(texts), BINS), empty)
    h, owner = shingle_hashes(texts)
    bins = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    np.minimum.at(table.reshape(-1), owner * BINS + bins, h & np.uint64((1 << (64 - BINS.bit_length() + 1)) - 1))
    some = (table != empty).any(axis=1)
    densify(table, empty)
    low = (table & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    low[~some] = 0
    return low, some


def packed_hex(low: np.ndarray) -> list[str]:
    bits = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - BITS :].reshape(len(low), -1)
    return [row.tobytes().hex() for row in np.packbits(bits, axis=1)]


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    chance = 2.0**-BITS
    near = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, near, (some_a == some_b).astype(float))


def place(doc: int | None, tie: int) -> tuple:
    """Sorts in the order of the documents: descending id, then descending hash of the text."""
    return (1, 0, -tie) if doc is None else (0, -doc, -tie)


def borders(docs: DataFrame) -> tuple[list[tuple], int]:
    """Keys of the documents that open a range, in order, and the number of ranges; SAMPLED keys a range come to the driver."""
    size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    ranges = max(64, int((size[1] or 0) / RANGE_BYTES) + 1)
    every = max(1, size[0] // (SAMPLED * ranges))
    picked = docs.select("doc_id", F.xxhash64("text").alias("tie")).where(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(every)) == 0).distinct()
    first = docs.agg(F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", F.xxhash64("text").alias("tie")))).first()[0]
    if first is None:
        return [], 1
    keys = sorted(place(r.doc_id, r.tie) for r in picked.collect())
    top = place(first["doc_id"], first["tie"])
    step = max(1, math.ceil(len(keys) / ranges))
    return sorted({top, *keys[step::step]}), ranges


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    opening, _ = borders(rows)
    number = {key: i for i, key in enumerate(opening)}
    shared = rows.sparkSession.sparkContext.broadcast((opening, number))  # one key a range
    schema = to_arrow_schema(_parse_datatype_string(FIELDS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers = shared.value
        held: dict[int, list] = {}
        size, squeeze = 0, zstandard.ZstdCompressor(level=6)

        def flush() -> pa.RecordBatch:
            values = []
            for some in held.values():
                ids, ties, own, bodies = zip(*some, strict=True)
                head = np.array([len(some), *(d is None for d in ids), *(d or 0 for d in ids), *ties, *own, *map(len, bodies)], np.int64)
                values.append(squeeze.compress(head.tobytes() + b"".join(bodies)))
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(values, pa.binary())], names=["part", "packed"])

        for batch in batches:
            for doc, tie, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                key, body = place(doc, tie), text.encode()
                i = numbers.get(key)
                part = i if i is not None else bisect_left(keys, key) - 1
                held.setdefault(part, []).append((doc, tie, 1, body))
                if i is not None:  # it opens a range: the range before ends with it
                    held.setdefault((i - 1) % len(keys), []).append((doc, tie, 0, body))
                size += len(body)
                if size >= 4 * BLOCK_BYTES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    def settle(table: pa.Table) -> pa.Table:
        keys, _ = shared.value
        part, own, after = table.column("part")[0].as_py(), {}, None
        for value in table.column("packed").to_pylist():
            for doc, tie, mine, body in unpack(value):
                if mine:
                    at = (place(doc, tie), doc, body)
                    own[at] = own.get(at, 0) + 1
                else:
                    after = max(after or body, body)
        order = sorted(own, key=lambda x: x[2], reverse=True)
        order.sort(key=lambda x: x[0])
        columns: list[list] = [[] for _ in schema]
        begin = 0
        while begin < len(order):
            end, size = begin, 0
            while end < len(order) and (end == begin or size < BLOCK_BYTES and end - begin < BLOCK_ROWS):
                size += len(order[end][2])
                end += 1
            bodies = [x[2] for x in order[begin:end]]
            following = order[end][2] if end < len(order) else after
            rows_of(order[begin:end], [own[x] for x in order[begin:end]], [*bodies, following], columns)
            begin = end
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    dealt = rows.select("doc_id", F.xxhash64("text"), "text").mapInArrow(deal, "part bigint, packed binary")
    return dealt.groupBy("part").applyInArrow(settle, FIELDS)


def unpack(value: bytes) -> Iterator[tuple[int | None, int, int, bytes]]:
    data = zstandard.ZstdDecompressor().decompress(value)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    null, docs, ties, own, sizes = np.frombuffer(data, np.int64, 5 * n, 8).reshape(5, n).tolist()
    at = 8 + 40 * n
    for none, doc, tie, mine, size in zip(null, docs, ties, own, sizes, strict=True):
        yield None if none else doc, tie, mine, data[at : at + size]
        at += size


def rows_of(order: list[tuple], counts: list[int], bodies: list[bytes], columns: list[list]) -> None:
    """Append the output of a block of documents; `bodies` has one more text than the block, the one that follows it."""
    texts = [b.decode() for b in bodies]
    # what stands next to a document, and next to the other rows that repeat it
    pairs = [(i, i + 1) for i in range(len(order))] + [(i, i) for i, n in enumerate(counts) if n > 1]
    edited = []
    for i, j in pairs:
        cut = len(texts[i]) // 3
        edited.append((texts[i][: len(texts[i]) - cut] + texts[j][:cut]).encode())
    left, right = np.array(pairs).T
    bits, some = fingerprints(bodies)
    edited_bits, edited_some = fingerprints(edited)
    near_edited, near_next = likeness(bits[left], some[left], edited_bits, edited_some), likeness(bits[left], some[left], bits[right], some[right])
    names, edited_names = packed_hex(bits), packed_hex(edited_bits)
    for k, (i, j) in enumerate(pairs):
        row = (order[i][1], len(texts[i]), hashlib.sha256(edited[k]).hexdigest(), names[i], edited_names[k], float(near_edited[k]), float(near_next[k]))
        for _ in range(1 if i != j else counts[i] - 1):
            for column, value in zip(columns, row, strict=True):
                column.append(value)
