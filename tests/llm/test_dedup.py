"""Substring, suffix-array, SimHash and embedding dedup against brute force."""
import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from chorale.llm import simhash, spans, substrings, suffixes, vectors

rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]


def words(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus():
    shared, other = words(30), words(60)
    rows = [(1, words(80)), (2, words(20) + " " + shared + "\n" + words(9)), (3, shared), (5, words(5) + "\t" + shared + " " + words(4) + " " + other), (4, other), (7, None), (8, ""), (9, "  \n"),
            (10, "a " * 200), (11, "a " * 100), (12, "x" * 400), (13, "y" + "x" * 120), (14, words(12)), (None, shared), (None, None), (15, shared), (15, shared + " end"), (15, shared), (16, other.replace(" ", "  ")), (17, words(3000)), (18, "é" * 60), (20, "é" * 70)]
    return rows


def frame(spark, rows):
    # extra columns whose names the operators use inside
    data = [(d, t, 1, "k", b"x") for d, t in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, part int, text_key string, body binary")


def brute(rows, units, width, join):
    least, found = {}, []
    split = [(d, units(t or "")) for d, t in rows]
    for d, u in split:
        for i in range(len(u) - width + 1) if d is not None else ():
            k = tuple(u[i : i + width])
            least[k] = min(least.get(k, d), d)
    for d, u in split:
        gone = [False] * len(u)
        for i in range(len(u) - width + 1) if d is not None else ():
            if least[tuple(u[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        found.append((d, len(u), sum(gone), runs, hashlib.sha256(join([x for x, g in zip(u, gone) if not g])).hexdigest()))
    return sorted(found, key=str)


def test_substrings(spark):
    rows = corpus()
    got = substrings.dedup_substrings(frame(spark, rows)).collect()
    want = brute(rows, lambda t: t.encode().split(), 13, b" ".join)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == sorted(((d, n, g, s) for d, n, g, _, s in want), key=str)


def test_suffixes(spark):
    rows = corpus()
    got = suffixes.dedup_suffixes(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, lambda t: t.encode(), 50, bytes)


@pytest.mark.parametrize("build", [substrings.dedup_substrings, suffixes.dedup_suffixes, substrings.rewrite_documents, simhash.cluster, simhash.keep_first])
def test_empty_table(spark, build):
    assert build(frame(spark, [])).collect() == []


def test_rewrite_keeps_columns(spark):
    docs = frame(spark, corpus()).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(1 AS BIGINT) AS n_chars")
    out = substrings.rewrite_documents(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[4] is not None and text[7] is None and "end" in text[15] or text[15] == "" or text[15]


def test_rewrite_by_hand(spark):
    """Words go as in the operator's own result; the others keep the white space after them; other columns and clashing names pass through."""
    rows = corpus() + [(30, "  lead\n" + words(20) + "\n\n" + words(6) + "\ttail "), (31, words(3))]
    rows += [(32, "  new\n" + rows[-2][1][7:] + "\nend\n")]
    data = [(d, t, 7, "k", b"x", 1.5, None, 3, 4) for d, t in rows]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, n_chars int, text_key string, packed binary, size double, part string, span_start int, row int")
    least, want = {}, []
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - 12) if d is not None else ():
            k = tuple(w[i : i + 13])
            least[k] = min(least.get(k, d), d)
    for d, t in rows:
        pieces = [] if t is None else re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t)
        w, gone = (t or "").encode().split(), set()
        for i in range(len(w) - 12) if d is not None else ():
            if least[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        kept = t if t is None or not gone else t[: len(t) - len("".join(pieces))] + "".join(p for i, p in enumerate(pieces) if i not in gone)
        want.append((d, kept, len(kept) if gone else 7, "k", b"x", 1.5, None, 3, 4))
    out = substrings.rewrite_documents(docs)
    assert out.schema == docs.schema and sorted((tuple(r) for r in out.collect()), key=str) == sorted(want, key=str)
    assert any("\n" in (k[1] or "") and k[2] != 7 for k in want)


@pytest.mark.parametrize("text", [b"banana" * 30, bytes(range(256)) * 3, b"a" * 300, os.urandom(500), b"", b"xy"])
def test_suffix_array_and_prefixes(text):
    data = np.frombuffer(text, np.uint8)
    order = suffixes.suffix_array(data, 50)
    cut = [text[i : i + 50].ljust(50, b"\0") for i in order]
    assert sorted(order.tolist()) == list(range(len(text))) and cut == sorted(cut)
    if len(text):
        shared = suffixes.common_prefixes(data, order, 50)
        for k in range(1, len(text)):
            a, b = text[order[k - 1] : order[k - 1] + 50], text[order[k] : order[k] + 50]
            assert shared[k] == len(os.path.commonprefix([a, b]))


def test_many_small_shards_merge_to_the_same_marks():
    texts = [(d, words(40).encode() if d % 3 else (words(3) + " " + VOCABULARY[0] * 30 + words(3)).encode()) for d in range(30)]
    texts += [(40, texts[1][1][5:150]), (41, texts[2][1][:90] + texts[4][1])]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in texts], pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array([t for _, t in texts], pa.binary())], names=["doc_id", "text_key", "body"])
    packed = []
    for one in range(0, len(texts), 5):  # small tasks: nothing is settled before the bucket
        packed += [b for b in spans.shipper(suffixes.cut_bytes, 1, 1)(iter([batch.slice(one, 5)]))]
    table = pa.Table.from_batches(packed)
    runs = table.filter(pa.compute.equal(table.column("kind"), spans.RUNS))
    results = [sorted(zip(*(c.to_pylist() for c in suffixes.settle_bytes(runs, size).columns))) for size in (1 << 20, 200, 60)]
    assert results[0] and results[0] == results[1] == results[2]


def test_a_common_gram_is_no_bucket_of_its_own(spark):
    """Unlike texts around one gram of eight bytes that is the minimiser of most windows: before, they all went to one bucket."""
    r = random.Random(11)
    grams = [bytes(r.choice(b"abcdef") for _ in range(8)) for _ in range(2000)]
    hashes = spans.mix(spans.mix(suffixes.words_at(np.frombuffer(b"".join(grams), np.uint8))[::8]))
    common = grams[int(np.argmin(hashes))].decode()
    rows = [(d, "".join("".join(r.choice("uvwxyz") for _ in range(30)) + common for _ in range(20))) for d in range(60)]
    rows += [(60 + i, rows[i][1][40 : 40 + 60 * i]) for i in range(9)]
    docs = spans.with_key(frame(spark, rows))
    found = spans.common_keys(docs, suffixes.cut_bytes, 1, 20_000)
    assert len(found) == 1 and not len(spans.common_keys(docs, suffixes.cut_bytes, 1, 10_000_000))
    texts = [t.encode() for _, t in rows]
    largest, windows = [], []
    for keys in (suffixes.NONE, found):
        joined, first, last, doc, place, n, key = suffixes.cut_bytes(texts, keys)
        sizes = np.bincount(np.unique(key, return_inverse=True)[1], last - first)
        largest.append(int(sizes.max()))
        at = [(int(d), p) for d, a, k in zip(doc, place.tolist(), n.tolist()) for p in range(a, a + k)]
        of = {joined[a + i : a + i + 50]: set() for a, k in zip(first.tolist(), n.tolist()) for i in range(k)}
        for a, k, x in zip(first.tolist(), n.tolist(), key.tolist()):
            for i in range(k):
                of[joined[a + i : a + i + 50]].add(x)
        assert len(at) == len(set(at)) and at == sorted(at) and all(len(x) == 1 for x in of.values())  # each window once, equal windows to one bucket
        windows.append(at)
    assert windows[0] == windows[1] and largest[1] < largest[0] / 20
    got = suffixes.dedup_suffixes(frame(spark, rows), 20_000).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows, lambda t: t.encode(), 50, bytes) and sum(x.n_removed for x in got) > 1000


def test_packed_runs_and_marks_round_trip():
    doc, key = np.array([5, -3, 5, 9]), np.array([1, 2**32 - 1, 7, 0])
    parts, values = spans.pack_marks(doc, key, np.array([4, 0, 2, 1]), np.array([9, 3, 5, 2]), 3)
    back = sorted(t for v in values for t in zip(*(c.tolist() for c in spans.unpack_marks(v))))
    assert back == [(-3, 2**32 - 1, 0, 3), (5, 1, 4, 9), (5, 7, 2, 5), (9, 0, 1, 2)] and parts == sorted(parts)


def naive_components(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def naive_print(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    base = [words(rng.randint(1, 60)) for _ in range(25)]
    rows = [(i, rng.choice(base) + rng.choice(["", "", " x", " a b"])) for i in range(150)] + [(200, None), (201, ""), (202, "A b"), (203, "a B"), (None, base[0]), (5, base[1])]
    got = simhash.cluster(frame(spark, rows)).collect()
    prints = [naive_print(t or "") for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    root, low = naive_components(len(rows), pairs), {}
    for (d, _), r in zip(rows, root):
        low[r] = min(x for x in (low.get(r), d) if x is not None) if d is not None or r in low and low[r] is not None else None
    want = sorted(((d, p, low[r]) for (d, _), p, r in zip(rows, prints, root)), key=str)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == want
    kept = simhash.keep_first(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted({x for x in low.values() if x is not None})


def test_pipeline_stage_keeps_one_row_of_every_component(spark):
    from corpus_pipeline import simhash_stage

    one, two, three, four, five = ("lone %s here " % w * 3 + words(40) for w in ("first", "second", "third", "fourth", "fifth"))
    rows = [(None, one), (None, one), (None, two), (4, two), (7, three), (7, four), (9, four), (7, four), (2, five), (7, five), (None, five)]
    got = sorted(((r.doc_id, r.text) for r in simhash_stage(spark, frame(spark, rows), "").collect()), key=str)
    assert got == sorted([(None, one), (4, two), (7, three), (7, four), (2, five)], key=str)
    assert simhash_stage(spark, frame(spark, []), "").collect() == []


def test_anchors_cover_every_pair():
    gen = np.random.default_rng(1)
    half = gen.integers(0, 1 << 32, 400).astype(np.uint64)
    flipped = half ^ (np.uint64(1) << gen.integers(0, 32, 400).astype(np.uint64))
    for a, b in zip(simhash.anchors_of(half).tolist(), simhash.anchors_of(flipped).tolist()):
        assert set(a) & set(b)


def test_large_buckets_are_cut_into_units(spark, monkeypatch):
    from chorale.llm import buckets

    members = spark.range(100).selectExpr("CAST(id % 2 AS INT) AS k", "id")
    rows = buckets.units(members, ["k"], "id", 8).collect()
    meet = {(r.k, r.u, r.v): set() for r in rows}
    for r in rows:
        meet[r.k, r.u, r.v].add(r.id)
    for a in range(0, 100, 2):
        assert all(any({a, b} <= m for m in meet.values()) for b in range(0, 100, 2))
    assert max(map(len, meet.values())) < 50


def test_vectors(spark):
    gen = np.random.default_rng(3)
    centre = gen.standard_normal((20, 16))
    x = np.repeat(centre, 15, axis=0) + gen.standard_normal((300, 16)) * 0.22
    rows = [(i, v.tolist(), int(i // 15 % 3)) for i, v in enumerate(x)]
    rows += [(300, x[0].tolist(), 0), (301, None, 0), (302, [0.0] * 16, 0), (303, [float("nan")] * 16, 0), (304, [None] * 16, 1), (305, x[0].tolist(), None), (306, [], 1), (307, x[0].tolist()[:8], 0), (308, (x[0] * 5).tolist(), 0)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    good = [(i, np.array(v), y) for i, v, y in rows if v and y is not None and None not in v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    links = {i: 0 for i, _, _ in rows}
    pairs = []
    for a, (i, v, y) in enumerate(good):
        for j, w, z in good[:a]:
            if y == z and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i], links[j] = links[i] + 1, links[j] + 1
                pairs.append((i, j))
    assert len(got) == len(rows) and all(got[i].n_links <= n for i, n in links.items())
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(links.values()) > 0
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (301, 302, 303, 304, 305, 306))
    roots = naive_components(309, pairs)
    assert sum(got[i].component_id == roots[i] for i in got) >= 0.9 * len(got)


def test_vectors_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
