"""Best-fit packing of tokenized documents into sequences by large-item matching.

A document is its token ids and an end mark; only longer ones than a sequence are cut. Placement depends on lengths alone, so it
is planned on the histogram of lengths (at most `capacity` rows, whatever the input): pieces above a third of the capacity pair
at most twice per sequence, the longest with the longest that fits; shorter pieces, longest first, go where the gap left is
smallest. The plan is a bounded list of (length, rank range, sequence range, offset); each piece finds its place by its rank among
the pieces of its length. Ranks are counted in salted groups, so a length that many pieces share is no single task.

Null or empty text: one piece with the end mark alone. Repeated rows and repeated or null ids are packed as rows of their own.
"""
from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.chunks import IdTable, packed, table_of
from chorale.llm.common import cut_lineage

CAPACITY, END = 4096, 1
#: Pieces that one salted group ranks.
RANKED = 100_000


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, offset), one for each range of sequences filled alike."""
    left = dict(counts)
    rows, sequences = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges (first sequence, how many)
    free: list[int] = []
    used = dict.fromkeys(counts, 0)

    def put(length: int, n: int, first: int, offset: int) -> None:
        rows.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(free, gap)
            gaps[gap].append((first, n))

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    rising = large[::-1]
    for a in large:
        while left[a]:
            i = bisect_left(rising, min(a, capacity - a) + 1) - 1
            while i >= 0 and not left[rising[i]]:
                i -= 1
            b = rising[i] if i >= 0 else 0
            if b == a and left[a] == 1:
                while i >= 0 and (rising[i] == a or not left[rising[i]]):
                    i -= 1
                b = rising[i] if i >= 0 else 0
            n = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, sequences, 0)
            if b:
                put(b, n, sequences, a)
            leave(capacity - a - b, sequences, n)
            sequences += n
    for s in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[s]:
            i = bisect_left(free, s)
            if i == len(free):  # a new sequence: it fills up with the same length
                each = capacity // s
                n = left[s] // each
                leave(capacity, sequences, max(n, 1))
                sequences += max(n, 1)
                continue
            gap = free[i]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], free[i]
            take = min(n, left[s])
            put(s, take, first, capacity - gap)
            leave(gap - s, first, take)
            leave(gap, first + take, n - take)
    return np.array(rows, np.int64).reshape(-1, 5)


#: Letters and then ASCII punctuation up to the end of a word: the tokenizer cuts between the two. Apostrophes, underscores and marks are left to it.
TAIL = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-^`{-~]+)")
#: White space for Python, letters for the tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")


def pieces_in(text: str) -> list[str]:
    """The words between white space; the tokenizer's own words never reach over white space."""
    return [text] if SEPARATORS.search(text) else text.split()


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def encoder_of(path: str) -> IdTable:
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    model = made.model
    letters = dict(enumerate(byte_letters()))

    def encode(known: IdTable, p: str) -> bytes:
        if p.isalpha() and max(p) < "\u0250" and (low := p.lower()).isalpha():  # one word of composed Latin letters: straight to the model
            return packed([t.id for t in model.tokenize(low if p.isascii() else low.encode().decode("latin-1").translate(letters))])
        if (cut := TAIL.fullmatch(p)) and "<|" not in p and cut[1].lower().isalpha():  # a letter that becomes letter and mark holds on to a sign
            return known[cut[1]] + known[cut[2]]
        return packed(made.encode(p, add_special_tokens=False).ids)

    return IdTable(encode_one=encode)


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. The tokenizer drops white space before it looks at words, so the ids of a text are those of its words."""
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        known = table_of(("words", path), lambda: encoder_of(path))
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), known.ids([pieces_in(t or "") for t in batch.column(1).to_pylist()]), strict=True):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    some = ids[at : at + 4 * capacity]
                    rows.append((doc, n, at // 4, len(some) // 4, zlib.crc32(some)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut_lineage(pieces_of(docs, path, capacity))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    placed = plan(counts, capacity)
    placed = placed[np.lexsort((placed[:, 1], placed[:, 0]))] if len(placed) else placed
    lengths = np.array(sorted(counts), np.int64)
    base = np.searchsorted(placed[:, 0], lengths) if len(placed) else lengths
    most = max(counts.values(), default=0)
    begin = placed[:, 0] * (most + 1) + placed[:, 1] if len(placed) else lengths  # sorted by length, then rank
    shared = pieces.sparkSession.sparkContext.broadcast((placed, begin, most, base))

    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(16, sum(counts.values()) // RANKED)))
    salted = pieces.withColumn("salt", salt)
    group = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(group), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.join(sizes, ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, begins, top, _ = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(begins, length * (top + 1) + rank, side="right") - 1
            sequence, offset = rows[at, 3] + rank - rows[at, 1], rows[at, 4]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
