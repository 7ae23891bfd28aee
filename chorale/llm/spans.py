"""Exact removal of strings that occur in a document with a smaller id: what substring and suffix-array dedup share.

A *window* is `width` consecutive units (words or bytes). Consecutive windows of a document that share a minimiser form a
run, and the run's text travels once, packed, to the bucket of its minimiser; equal windows have equal minimisers and so
meet in one bucket. Before the shuffle each task combines equal runs: the copy with the smallest id stands for all, and
the copies in other documents are marked at once, so a passage in a third of all documents sends one string per task.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import raw

#: Bytes of text that a task holds before it ships its runs, and packed bytes that a bucket is meant to hold.
FLUSH_BYTES, BUCKET_BYTES = 4 << 20, 6 << 20
#: Bytes of runs that one minimiser may bring together before they are cut again by longer grams, and bytes of text that tell which do.
COMMON_BYTES, SAMPLE_BYTES = 2 * BUCKET_BYTES, 16 << 20
#: Level of the zstandard compression of what is packed.
LEVEL = 6
MARKS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
#: What a task ships: runs to a bucket, marks to a part; `kind` tells them apart.
SHIPPED = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("packed", pa.binary())])
DEALT = pa.schema([("part", pa.int64()), ("packed", pa.binary())])
RUNS, OWN_MARKS = 0, 1
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


#: Bits of an order value that hold the position; the others are the hash, so that of equal hashes the leftmost is least.
PLACE_BITS = np.uint64(32)


def ordered(hashes: np.ndarray) -> np.ndarray:
    """Values that order grams by hash, then position (at most 2 ** 32 grams at a time)."""
    return (hashes >> PLACE_BITS << PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)


def sliding_least(order: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        order = np.minimum(order[:-step], order[step:])
        have += step
    return order


def runs_of(least: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of every maximal run of valid windows with one minimiser."""
    windows = np.flatnonzero(valid)
    if not len(windows):
        return windows, windows
    new = np.ones(len(windows), bool)
    new[1:] = (np.diff(windows) != 1) | (np.diff(least[windows]) != 0)
    starts = np.flatnonzero(new)
    return windows[starts], windows[np.append(starts[1:], len(windows)) - 1]


def cut_again(units: np.ndarray, first: np.ndarray, last: np.ndarray, key: np.ndarray, common: np.ndarray, grams: Callable, gram: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs whose key is in `common` (sorted) as runs of a longer gram's minimiser, the others as they are, all in order of place.

    `common` is the same for all tasks, so whether a window is cut again and by what follows from the window alone: equal windows still meet.
    """
    again = common[np.minimum(np.searchsorted(common, key), len(common) - 1)] == key if len(common) else np.zeros(len(key), bool)
    if not again.any():
        return first, last, key
    n = (last - first)[again] + width
    index = np.repeat(first[again] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    owner = np.repeat(np.arange(len(n)), n)
    least = sliding_least(ordered(grams(units[index])), width - gram + 1)
    a, b = runs_of(least, owner[: len(least)] == owner[width - 1 :])
    first, last, key = np.append(first[~again], index[a]), np.append(last[~again], index[b]), np.append(key[~again], least[a] >> PLACE_BITS)
    by = np.argsort(first)
    return first[by], last[by], key[by]


def true_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and exclusive end of every run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


def planes(values: np.ndarray, width: int = 4) -> bytes:
    """Numbers byte by byte: the high bytes, mostly zero, lie together and cost nothing when compressed."""
    return np.ascontiguousarray(values, f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def from_planes(data: bytes, at: int, n: int, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, width * n, at).reshape(width, n).T).view(f"<i{width}").ravel()


def pack(docs: np.ndarray, keys: np.ndarray, owner: np.ndarray, string: np.ndarray, place: np.ndarray, windows: np.ndarray, texts: list[bytes], squeeze: zstandard.ZstdCompressor) -> bytes:
    """Strings with their windows and smallest document, and where the strings stand in that document, in one packed value."""
    used, owner = np.unique(owner, return_inverse=True)
    head = np.array([len(used), len(texts), len(place)], np.int64)
    numbers = [np.diff(owner, prepend=0), windows, np.fromiter(map(len, texts), np.int64, len(texts)), np.diff(string, prepend=0), place]
    return squeeze.compress(b"".join([head.tobytes(), planes(np.diff(docs[used], prepend=0), 8), planes(keys[used].astype("<u4").view("<i4")), *map(planes, numbers), *texts]))


def unpack(value: bytes) -> tuple[np.ndarray, ...]:
    data = zstandard.ZstdDecompressor().decompress(value)
    n_docs, n_texts, n_places = np.frombuffer(data, np.int64, 3).tolist()
    at = 24 + 12 * n_docs
    out = [np.cumsum(from_planes(data, 24, n_docs, 8)), from_planes(data, 24 + 8 * n_docs, n_docs).view("<u4").astype(np.int64)]
    for n in (n_texts, n_texts, n_texts, n_places, n_places):
        out.append(from_planes(data, at, n))
        at += 4 * n
    out[2], out[5] = np.cumsum(out[2]), np.cumsum(out[5])
    return *out, data[at:]


def part_of(doc: np.ndarray, key: np.ndarray, parts: int) -> np.ndarray:
    """The part of documents that a row belongs to."""
    return (mix(mix(doc.astype(np.uint64)) + key.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def pack_marks(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray, parts: int) -> tuple[list[int], list[bytes]]:
    """Marks by part, packed."""
    part, squeeze, values = part_of(doc, key, parts), zstandard.ZstdCompressor(level=1), []
    by = np.lexsort((start, key, doc, part))
    part, doc, key, start, length = part[by], doc[by], key[by], start[by], (end - start)[by]
    cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        some = slice(lo, hi)
        values.append(squeeze.compress(planes(np.diff(doc[some], prepend=0), 8) + planes(key[some].astype("<u4").view("<i4")) + planes(start[some]) + planes(length[some])))
    return part[cuts[:-1]].tolist(), values


def unpack_marks(value: bytes) -> tuple[np.ndarray, ...]:
    data = zstandard.ZstdDecompressor().decompress(value)
    n = len(data) // 20
    start, length = from_planes(data, 12 * n, n), from_planes(data, 16 * n, n)
    return np.cumsum(from_planes(data, 0, n, 8)), from_planes(data, 8 * n, n).view("<u4").astype(np.int64), start, start + length


def shipper(cut: Callable, buckets: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Map side. `cut(texts)` gives one joined text and, for every run: first and last byte, document, first unit, windows, key."""

    def flush(held: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda x: x[:2])
        docs, keys = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
        joined, first_byte, last_byte, doc, place, windows, key = cut([x[2] for x in held])
        if not len(doc):
            return
        seen: dict[bytes, int] = {}
        number = np.fromiter((seen.setdefault(joined[a:b], len(seen)) for a, b in zip(first_byte.tolist(), last_byte.tolist(), strict=True)), np.int64, len(doc))
        strings, head = list(seen), np.unique(number, return_index=True)[1]
        del seen
        lead = head[number]
        later = docs[doc] > docs[doc[lead]]  # a smaller document of this task has the same run
        twin = np.flatnonzero(~later & (doc != doc[lead]))  # another row with the same id: it travels by itself
        if len(twin):
            strings += [strings[i] for i in number[twin].tolist()]
            number[twin], head = len(head) + np.arange(len(twin)), np.append(head, twin)
        if later.any():
            at = doc[later]
            yield batch_of(*pack_marks(docs[at], keys[at], place[later], place[later] + windows[later], parts), OWN_MARKS)
        bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
        rows = np.flatnonzero(~later)
        rows = rows[np.argsort(bucket[rows], kind="stable")]
        cuts = np.flatnonzero(np.diff(bucket[rows], prepend=-1)).tolist() + [len(rows)]
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        numbers, values = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            some = rows[lo:hi]
            ids, string = np.unique(number[some], return_inverse=True)
            heads = head[ids]
            numbers.append(int(bucket[some[0]]))
            values.append(pack(docs, keys, doc[heads], string, place[some], windows[heads], [strings[i] for i in ids.tolist()], squeeze))
            if len(values) == 256:
                yield batch_of(numbers, values)
                numbers, values = [], []
        if values:
            yield batch_of(numbers, values)

    def batch_of(numbers: list[int], values: list[bytes], kind: int = RUNS) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(values), pa.int32()), pa.array(numbers, pa.int64()), pa.array(values, pa.binary())], schema=SHIPPED)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, key, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text_key", "body")), strict=True):
                held.append((doc, key, text))
                size += len(text)
                if size >= FLUSH_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return ship


def gather(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Reduce side: the distinct strings of a bucket and every document and place where each stands."""
    docs, keys, counts, sizes, strings, places, bodies, owners, base = [], [], [], [], [], [], [], [], 0
    for value in table.column("packed").to_pylist():
        d, k, owner, windows, length, string, place, body = unpack(value)
        docs.append(d[owner])
        keys.append(k[owner])
        counts.append(windows)
        sizes.append(length)
        bodies.append(body)
        strings.append(string + base)
        places.append(place)
        base += len(owner)
    join = np.concatenate
    doc, key, windows, length, string, place, text = join(docs), join(keys), join(counts), join(sizes), join(strings), join(places), b"".join(bodies)
    ends = np.cumsum(length, dtype=np.int64)
    seen: dict[bytes, int] = {}
    number = np.fromiter((seen.setdefault(text[b - n : b], len(seen)) for b, n in zip(ends.tolist(), length.tolist(), strict=True)), np.int64, len(length))
    heads = np.unique(number, return_index=True)[1] if len(number) else number
    least = np.full(len(heads), np.iinfo(np.int64).max)
    np.minimum.at(least, number, doc)
    return list(seen), windows[heads].astype(np.int64), least, number[string], doc[string], key[string], place.astype(np.int64)


def marks_of(windows: np.ndarray, least: np.ndarray, string: np.ndarray, doc: np.ndarray, key: np.ndarray, place: np.ndarray) -> pa.Table:
    """Runs of windows whose smallest document (`least`, window by window in string order) is smaller than the own one."""
    offset = np.concatenate(([0], np.cumsum(windows)))
    start_of = least.copy()
    low = np.minimum.reduceat(start_of, offset[:-1]) if len(windows) else start_of
    touched = np.flatnonzero(low[string] < doc)  # only these places can lose a window
    string, doc, key, place = string[touched], doc[touched], key[touched], place[touched]
    n = windows[string]
    row = np.repeat(np.arange(len(string)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    gone = least[offset[string][row] + inside] < doc[row]
    split = np.zeros(len(gone) + len(string), bool)
    split[np.arange(len(gone)) + row] = gone  # a gap after each place keeps its runs apart
    a, b = true_runs(split)
    index = np.searchsorted(np.cumsum(n + 1), a, side="right")
    shift = place[index] - (np.cumsum(n + 1) - (n + 1))[index]
    return pa.Table.from_arrays([pa.array(doc[index]), pa.array(key[index]), pa.array((a + shift).astype(np.int32)), pa.array((b + shift).astype(np.int32))], schema=MARKS)


def sizes_of(docs: DataFrame, copies: float) -> tuple[int, int]:
    """Buckets of packed runs and parts of documents; both follow the size of the input."""
    size = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    return max(64, int(size * copies / BUCKET_BYTES) + 1), max(64, int(size / BUCKET_BYTES) + 1)


def common_keys(docs: DataFrame, cut: Callable, parts: int, limit: int = COMMON_BYTES, sample: int = SAMPLE_BYTES) -> np.ndarray:
    """The keys that about `limit` bytes of unlike runs share, sorted; they only tell where runs travel.

    Counted on the documents that a hash deals to one of several classes, so that about `sample` bytes are cut.
    """
    every = max(1, parts * BUCKET_BYTES // sample)

    def counted(texts: list[bytes]) -> pa.RecordBatch:
        joined, first, last, *_, key = cut(texts)
        seen = {joined[a:b]: k for a, b, k in zip(first.tolist(), last.tolist(), key.tolist(), strict=True)}
        columns = list(seen.values()), [xxhash.xxh3_64_intdigest(x) >> 1 for x in seen], list(map(len, seen))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "run", "size"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column("body").to_pylist():
                held.append(text)
                size += len(text)
                if size >= FLUSH_BYTES:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    some = docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(every)) == 0))
    runs = some.mapInArrow(count, "key bigint, run bigint, size bigint").groupBy("key", "run").agg(F.max("size").alias("size"))
    found = runs.groupBy("key").agg(F.sum("size").alias("size")).where(F.col("size") * every > limit)
    return np.sort(np.array([r.key for r in found.select("key").collect()], np.uint64))


def repeated_spans(docs: DataFrame, cut: Callable, settle: Callable[[pa.Table], pa.Table], buckets: int, parts: int) -> DataFrame:
    """Rows (part, packed marks): windows start <= i < end of a document stand in one with a smaller id too."""
    shipped = docs.where("doc_id is not null").mapInArrow(shipper(cut, buckets, parts), "kind int, part bigint, packed binary")

    def both(table: pa.Table) -> pa.Table:
        own, runs = (table.filter(pc.equal(table.column("kind"), k)) for k in (OWN_MARKS, RUNS))
        numbers, values = own.column("part").to_pylist(), own.column("packed").to_pylist()  # marks that a task found by itself pass on
        if runs.num_rows:
            more = pack_marks(*(c.to_numpy().astype(np.int64) for c in settle(runs).columns), parts)
            numbers, values = numbers + more[0], values + more[1]
        return pa.Table.from_arrays([pa.array(numbers, pa.int64()), pa.array(values, pa.binary())], schema=DEALT)

    return shipped.groupBy("kind", "part").applyInArrow(both, "part bigint, packed binary")


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, body (bytes), text_key. Rows are told apart by id and text, so that ids may repeat."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw().alias("body"), text_key().alias("text_key"))


def text_key() -> Column:
    """32 bits of the text's hash: they tell rows with one id apart."""
    return F.xxhash64(raw()).bitwiseAND(F.lit(0xFFFFFFFF))


def deal_documents(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents packed by the part that their spans go to."""

    def flush(held: dict[int, list]) -> pa.RecordBatch:
        squeeze, numbers, values = zstandard.ZstdCompressor(level=LEVEL), list(held), []
        for rows in held.values():
            docs, keys, bodies = zip(*rows, strict=True)
            head = np.array([len(rows), *(d is None for d in docs), *(d or 0 for d in docs), *keys, *map(len, bodies)], np.int64)
            values.append(squeeze.compress(head.tobytes() + b"".join(bodies)))
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(values, pa.binary())], schema=DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            for part, *row in zip(part_of(ids, batch.column("text_key").to_numpy(), parts).tolist(), *(batch.column(n).to_pylist() for n in ("doc_id", "text_key", "body")), strict=True):
                held.setdefault(part, []).append(row)
                size += len(row[2])
                if size >= 2 * FLUSH_BYTES:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    return run


def documents_in(value: bytes) -> Iterator[tuple[int | None, int, bytes]]:
    data = zstandard.ZstdDecompressor().decompress(value)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    null, docs, keys, sizes = np.frombuffer(data, np.int64, 4 * n, 8).reshape(4, n).tolist()
    at = 8 + 32 * n
    for none, doc, key, size in zip(null, docs, keys, sizes, strict=True):
        yield None if none else doc, key, data[at : at + size]
        at += size


def spans_by_row(values: list[bytes]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of the marks of each (doc_id, text_key)."""
    columns = [unpack_marks(value) for value in values]
    if not columns:
        return {}
    doc, key, start, end = (np.concatenate(c) for c in zip(*columns, strict=True))
    by = np.lexsort((key, doc))
    doc, key, start, end = doc[by], key[by], start[by], end[by]
    cuts = [0, *(np.flatnonzero((doc[1:] != doc[:-1]) | (key[1:] != key[:-1])) + 1).tolist(), len(doc)] if len(doc) else [0]
    return {(int(doc[lo]), int(key[lo])): (start[lo:hi], end[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)}


def without_spans(docs: DataFrame, marks: DataFrame, strip: Callable, schema: str, parts: int) -> DataFrame:
    """Bring each document together with its spans and apply `strip(body, starts, ends)`, which returns the output columns after doc_id.

    Both sides come packed by part, a hash of id and text; a part holds a few megabytes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))
    dealt = docs.mapInArrow(deal_documents(parts), "part bigint, packed binary")

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        found = spans_by_row(right.column("packed").to_pylist())
        rows = [(d, *strip(body, *found.get((d, k), (None, None)))) for value in left.column("packed").to_pylist() for d, k, body in documents_in(value)]
        columns = zip(*rows, strict=True) if rows else [()] * len(arrow_schema)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow_schema.types, strict=True)], schema=arrow_schema)

    return dealt.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(settle, schema)


def deal_rows(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole rows (row, doc_id, text_key, size), packed by the part that their spans go to."""

    def flush(held: dict[int, list[pa.RecordBatch]]) -> pa.RecordBatch:
        squeeze, values = zstandard.ZstdCompressor(level=LEVEL), []
        for batches in held.values():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batches[0].schema) as out:
                out.write_table(pa.Table.from_batches(batches).combine_chunks())
            values.append(squeeze.compress(sink.getvalue()))
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(values, pa.binary())], schema=DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        size = 0
        for batch in batches:
            part = part_of(batch.column("doc_id").fill_null(0).to_numpy(), batch.column("text_key").to_numpy(), parts)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1)).tolist() + [len(order)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                held.setdefault(int(part[order[lo]]), []).append(batch.select([0, 1, 2]).take(pa.array(order[lo:hi])))
            size += pc.sum(batch.column("size")).as_py() or 0
            if size >= 2 * FLUSH_BYTES:
                yield flush(held)
                held, size = {}, 0
        if held:
            yield flush(held)

    return run


def rows_without_spans(docs: DataFrame, marks: DataFrame, strip: Callable[[bytes, np.ndarray, np.ndarray], str], parts: int) -> DataFrame:
    """The rows of `docs` with `strip(body, starts, ends)` as the text of those that have spans, and n_chars, if there is one, after it."""
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(docs.schema).empty_table()
    dealt = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.octet_length(raw()).alias("size")).mapInArrow(deal_rows(parts), "part bigint, packed binary")

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        found = spans_by_row(right.column("packed").to_pylist())
        tables = []
        for value in left.column("packed").to_pylist():
            some = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(value)).read_all().combine_chunks()
            table = pa.Table.from_struct_array(some.column("row").combine_chunks())
            text, numbers = table.column("text").to_pylist(), {}
            for i, at in enumerate(zip(some.column("doc_id").to_pylist(), some.column("text_key").to_pylist(), strict=True)):
                if at in found:
                    text[i] = strip(text[i].encode(), *found[at])
                    numbers[i] = len(text[i])
            if numbers:
                table = table.set_column(table.column_names.index("text"), "text", pa.array(text, table.schema.field("text").type))
                if "n_chars" in table.column_names:
                    own = table.column("n_chars").to_pylist()
                    table = table.set_column(table.column_names.index("n_chars"), "n_chars", pa.array([numbers.get(i, n) for i, n in enumerate(own)], table.schema.field("n_chars").type))
            tables.append(table)
        return pa.concat_tables(tables) if tables else empty

    return dealt.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(settle, docs.schema)


def covered(n: int, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Flags of the units that removed windows cover."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends + width - 1, -1)
    return np.cumsum(step[:-1]) > 0


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
