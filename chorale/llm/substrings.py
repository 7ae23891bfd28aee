"""Substring dedup over 13-word windows by super-k-mer partitioning.

Words are `[^\\x20\\x09-\\x0D]+` of the whole text. A window is 13 consecutive words; its minimiser is the 3-word gram with the
smallest hash. Consecutive windows sharing a minimiser travel as one packed string to the minimiser's bucket, where sorting
brings equal windows together; words are compared, not only hashes. A word goes if a window that covers it also starts in a
document with a smaller id; all windows are judged on the input.

Null or empty text: no words, nothing removed. Fewer than 13 words: nothing removed. Null doc_id: the row is returned, takes
and gives nothing. Rows with equal doc_id do not act on each other. Other columns are ignored.
"""
from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from chorale.llm.spans import PLACE_BITS, covered, gather, marks_of, mix, ordered, repeated_spans, rows_without_spans, runs_of, sha, sizes_of, sliding_least, with_key, without_spans

WINDOW, GRAM = 13, 3
#: Packed bytes per byte of text: a run has (WINDOW - GRAM + 2) / 2 windows on average and WINDOW - 1 words more.
COPIES = 3.0


def cut_words(texts: list[bytes]):
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    words = [w for s in split for w in s]
    del split
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    doc = np.repeat(np.arange(len(texts)), sizes)
    if len(words) < WINDOW:
        none = np.zeros(0, np.int64)
        return joined, none, none, none, none, none, none.astype(np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    least = sliding_least(ordered(mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])), WINDOW - GRAM + 1)
    a, b = runs_of(least, doc[: len(least)] == doc[WINDOW - 1 :])
    return joined, starts[a], ends[b + WINDOW - 1], doc[a], a - np.repeat(np.cumsum(sizes) - sizes, sizes)[a], b - a + 1, least[a] >> PLACE_BITS


def settle_words(table: pa.Table) -> pa.Table:
    texts, windows, least, string, doc, key, place = gather(table)
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    words = b" ".join(texts).split(b" ")
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    first = np.repeat(np.cumsum(windows + WINDOW - 1) - (windows + WINDOW - 1), windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    h = np.zeros(len(first), np.uint64)
    for k in range(WINDOW):
        h = mix(h + ids[first + k].astype(np.uint64) + np.uint64(1))
    order = np.argsort(h)
    near = h[order][1:] == h[order][:-1]
    left, right = first[order[:-1][near]], first[order[1:][near]]
    same = np.ones(len(left), bool)
    for k in range(WINDOW):
        same &= ids[left + k] == ids[right + k]
    if not same.all():  # two windows with one hash: sort by the words themselves
        order = np.lexsort([ids[first + k] for k in range(WINDOW)])
        near = np.ones(len(order) - 1, bool)
        for k in range(WINDOW):
            near &= ids[first[order[1:]] + k] == ids[first[order[:-1]] + k]
    group = np.concatenate(([0], np.cumsum(~near)))
    low = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    each = np.repeat(least, windows)
    np.minimum.at(low, group, each[order])
    smallest = np.empty(len(order), np.int64)
    smallest[order] = low[group]
    return marks_of(windows, smallest, string, doc, key, place)


def strip_words(body: bytes, starts, ends) -> tuple:
    words = body.split()
    if starts is None:
        return len(words), 0, sha(b" ".join(words)), None
    gone = covered(len(words), starts, ends, WINDOW)
    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
    return len(words), int(gone.sum()), sha(kept), kept.decode("utf-8", "replace")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the text left, null where nothing was removed)."""
    rows = with_key(docs)
    buckets, parts = sizes_of(rows, COPIES)
    marks = repeated_spans(rows, cut_words, settle_words, buckets, parts)
    return without_spans(rows, marks, strip_words, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string", parts)


WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def left_text(body: bytes, starts: np.ndarray, ends: np.ndarray) -> str:
    """The text without the words that removed windows cover; every word takes the white space after it along."""
    pieces = WORD.findall(body)
    gone = covered(len(pieces), starts, ends, WINDOW).tolist()
    lead = body[: len(body) - sum(map(len, pieces))]
    return (lead + b"".join([p for p, g in zip(pieces, gone, strict=True) if not g])).decode("utf-8", "replace")


def rewrite_documents(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut out; the other words keep their white space, texts without any passage stay as they are.

    Same columns, whatever their names; n_chars, if there is one, follows the text. Marks and rows stay packed and meet by part.
    """
    rows = with_key(docs)
    buckets, parts = sizes_of(rows, COPIES)
    return rows_without_spans(docs, repeated_spans(rows, cut_words, settle_words, buckets, parts), left_text, parts)
