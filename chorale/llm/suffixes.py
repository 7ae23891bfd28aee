"""Suffix-array dedup over 50-byte strings.

Windows are dealt to shards by their minimiser (an 8-byte gram), so that equal windows share a shard and only their contexts
are shuffled, not 50 bytes for each position. In a shard, equal contexts collapse first; strings that share a window with
another string (found by a 64-bit hash, which can only add strings, never miss one) go into a suffix array: Larsson-Sadakane
refinement in numpy (every round sorts only the groups that are still tied, by the rank of the suffix one step on), then
common prefixes of neighbours by Kasai's rule (a pair that is the shift of the pair before has one byte less). A minimiser that many
unlike strings share would be one bucket that grows with the input: its runs are cut again by minimisers of 16 bytes. Shards are
bounded: a bucket with more than `SHARD_BYTES` is cut into several shards, whose sorted windows are merged by binary search.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id; strings never cross documents and
are judged on the input. Null or empty text: nothing to remove. Null doc_id: the row is returned, takes and gives nothing. Rows with
equal doc_id do not act on each other. Other columns are ignored.
"""
from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chorale.llm.spans import COMMON_BYTES, PLACE_BITS, common_keys, covered, cut_again, gather, marks_of, mix, ordered, repeated_spans, runs_of, sha, sizes_of, sliding_least, true_runs, with_key, without_spans

WINDOW, GRAM, SHARD_BYTES = 50, 8, 8 << 20
#: Bytes of the grams that cut the runs of a common minimiser again.
LONG_GRAM = 16
#: What nothing shares.
NONE = np.zeros(0, np.uint64)
#: Packed bytes per byte of text: a run has (WINDOW - GRAM + 2) / 2 windows on average and WINDOW - 1 bytes more.
COPIES = 3.2
#: Bytes whose minimisers are computed at a time.
CHUNK_BYTES = 2 << 20
NO_DOC = np.iinfo(np.int64).max


def words_at(text: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes from every position as one number; `text` ends in at least eight bytes of padding."""
    return np.ndarray((len(text) - 7,), order, text, strides=(1,))


def long_grams(text: np.ndarray) -> np.ndarray:
    """Hashes of the `LONG_GRAM` bytes from every position."""
    load = words_at(text)
    return mix(mix(mix(load[:-8]) + load[8:]))


def cut_bytes(texts: list[bytes], common: np.ndarray = NONE):
    """Runs of all texts; the minimisers of a few megabytes are computed at a time. Runs of a minimiser in `common` are cut again."""
    out, base, at = [], 0, 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (size < CHUNK_BYTES or stop == at):
            size += len(texts[stop])
            stop += 1
        sizes = np.array([len(t) for t in texts[at:stop]], np.int64)
        if size >= WINDOW:
            text = np.frombuffer(b"".join(texts[at:stop]), np.uint8)
            least = sliding_least(ordered(mix(mix(words_at(text)))), WINDOW - GRAM + 1)
            doc = np.repeat(np.arange(at, stop, dtype=np.int32), sizes)
            a, b = runs_of(least, doc[: len(least)] == doc[WINDOW - 1 :])
            a, b, key = cut_again(text, a, b, least[a] >> PLACE_BITS, common, long_grams, LONG_GRAM, WINDOW)
            local = doc[a].astype(np.int64)
            out.append((a + base, b + WINDOW + base, local, a - (np.cumsum(sizes) - sizes)[local - at], b - a + 1, key))
        base += size
        at = stop
    if not out:
        none = np.zeros(0, np.int64)
        return b"", none, none, none, none, none, none.astype(np.uint64)
    return b"".join(texts), *(np.concatenate(c) for c in zip(*out, strict=True))


def suffix_array(text: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Suffixes in the order of their first `depth` bytes. `text`: uint8; what follows its end counts as zero bytes."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    first = words_at(padded, ">u8")[:n].astype(np.uint64)
    order = np.argsort(first, kind="stable")
    new = np.ones(n, bool)
    new[1:] = first[order][1:] != first[order][:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    known = 8
    while known < depth:
        step = min(known, depth - known)
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        some = order[tied]
        here, there = rank[some], rank[np.minimum(some + step, n)]
        by = np.lexsort((there, here))
        some, here, there = some[by], here[by], there[by]
        order[tied] = some
        starts = np.ones(len(some), bool)
        starts[1:] = (here[1:] != here[:-1]) | (there[1:] != there[:-1])
        new[tied] = starts
        rank[some] = np.maximum.accumulate(np.where(starts, tied, 0))
        known += step
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """For each rank the bytes shared with the suffix before it, counted to `depth`."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    limit = 4 * depth
    load = words_at(np.concatenate((text, np.zeros(limit + 16, np.uint8))))

    def compare(at: np.ndarray) -> np.ndarray:
        shared, live = np.zeros(len(at), np.int64), np.flatnonzero(before[at] >= 0)
        while len(live):
            here, other = at[live] + shared[live], before[at[live]] + shared[live]
            differ = load[here] ^ load[other]
            whole = differ == 0
            low = differ & (~differ + np.uint64(1))
            shared[live] += np.where(whole, 8, np.log2(np.where(whole, 1, low).astype(np.float64)).astype(np.int64) // 8)
            live = live[whole & (shared[live] < limit)]
        return np.minimum(np.minimum(shared, n - at), np.where(before[at] >= 0, n - before[at], 0))

    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (before[1:] > 0)
    heads = np.flatnonzero(~follows)
    value = compare(heads)
    head_of = np.cumsum(~follows) - 1
    plcp = value[head_of] - (np.arange(n) - heads[head_of])
    unsure = np.flatnonzero(follows & (plcp < depth) & ((value[head_of] >= limit) | (plcp < 0)))
    plcp[unsure] = compare(unsure)
    return np.minimum(plcp, depth)[order]


def shard_windows(text: np.ndarray, valid: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of one shard: its distinct valid windows in order, the smallest document of each, and the class of each valid start."""
    order = suffix_array(text)
    same = common_prefixes(text, order) >= WINDOW
    group = np.cumsum(~same) - 1
    keep = valid[order]
    start, group = order[keep], group[keep]
    used, group = np.unique(group, return_inverse=True)
    low = np.full(len(used), NO_DOC)
    np.minimum.at(low, group, doc[start])
    head = np.empty(len(used), np.int64)
    head[group] = start
    views = np.lib.stride_tricks.sliding_window_view(text, WINDOW)[head]
    classes = np.full(len(text), -1, np.int64)
    classes[start] = group
    return np.ascontiguousarray(views).view(f"S{WINDOW}").ravel(), low, classes


def merge(keys: np.ndarray, low: np.ndarray, more: np.ndarray, more_low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of windows as one; binary search finds the places."""
    if not len(keys):
        return more, more_low
    at = np.searchsorted(keys, more)
    known = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == more)
    low = low.copy()
    np.minimum.at(low, at[known], more_low[known])
    return np.insert(keys, at[~known], more[~known]), np.insert(low, at[~known], more_low[~known])


def lookup(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The smallest document of each valid start over all shards."""
    if len(shards) == 1:
        return [np.append(shards[0][1], NO_DOC)[shards[0][2]]]
    keys, low = np.zeros(0, f"S{WINDOW}"), np.zeros(0, np.int64)
    for own, own_low, _ in shards:
        keys, low = merge(keys, low, own, own_low)
    return [np.append(low[np.searchsorted(keys, own)], NO_DOC)[classes] for own, _, classes in shards]


def settle_bytes(table: pa.Table, shard_bytes: int = SHARD_BYTES) -> pa.Table:
    texts, windows, least, string, doc, key, place = gather(table)
    total = int(windows.sum())
    owner = np.repeat(np.arange(len(texts)), windows)
    each = least[owner]
    inside = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
    size = windows + WINDOW - 1
    first = (np.cumsum(size) - size)[owner] + inside
    text = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    load, h = words_at(text), np.zeros(total, np.uint64)
    for offset in (*range(0, WINDOW - 7, 8), WINDOW - 8):
        h = mix(h + load[first + offset])
    by = np.argsort(h)
    twins = np.zeros(total, bool)
    near = np.flatnonzero(h[by][1:] == h[by][:-1])
    twins[by[near]] = twins[by[near + 1]] = True
    # of a string with twins only the stretches around them matter; a stretch of windows a..b covers the bytes a..b + WINDOW - 1
    flagged = np.zeros(total + len(texts), bool)
    flagged[np.flatnonzero(twins) + owner[twins]] = True
    a, b = true_runs(flagged)
    if len(a):
        gaps = np.searchsorted(np.cumsum(windows + 1), a, side="right")
        a, b = a - gaps, b - gaps
        smallest = each.copy()
        lengths = b - a + WINDOW - 1
        shard = np.cumsum(lengths) // shard_bytes
        built, spots = [], []
        for s in np.unique(shard):
            mine = np.flatnonzero(shard == s)
            n, lead = lengths[mine], np.cumsum(lengths[mine]) - lengths[mine]
            index = np.repeat(first[a[mine]] - lead, n) + np.arange(n.sum())
            count = b[mine] - a[mine]
            window = np.repeat(a[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            spot = np.repeat(lead - (np.cumsum(count) - count), count) + np.arange(count.sum())
            valid, owned = np.zeros(n.sum(), bool), np.full(n.sum(), NO_DOC)
            valid[spot] = True
            owned[spot] = each[window]
            built.append(shard_windows(text[index], valid, owned))
            spots.append((window, spot))
        for (window, spot), low in zip(spots, lookup(built), strict=True):
            smallest[window] = low[spot]
        each = smallest
    return marks_of(windows, each, string, doc, key, place)


def strip_bytes(body: bytes, starts, ends) -> tuple:
    if starts is None:
        return len(body), 0, 0, sha(body)
    gone = covered(len(body), starts, ends, WINDOW)
    return len(body), int(gone.sum()), len(true_runs(gone)[0]), sha(np.frombuffer(body, np.uint8)[~gone].tobytes())


def dedup_suffixes(docs: DataFrame, common_bytes: int = COMMON_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = with_key(docs)
    buckets, parts = sizes_of(rows, COPIES)
    common = common_keys(rows, cut_bytes, parts, common_bytes)
    marks = repeated_spans(rows, partial(cut_bytes, common=common), settle_bytes, buckets, parts)
    return without_spans(rows, marks, strip_bytes, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", parts)
