"""Prefix trie, fingerprints and filter audit against brute force."""
import hashlib
import itertools
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from chorale.llm import audit, fingerprints, prefixes

rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdeéX") for _ in range(rng.randint(1, 6))) for _ in range(300)]


def words(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


# ---- prefix trie -------------------------------------------------------------------------------------------------------------


def turn_key(role, text):
    return hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), turn_key(role, text), len(text or "")))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    members, ends, chars = defaultdict(list), defaultdict(list), {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        turns = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            key = tuple(t for t, _ in turns[:d])
            members[key].append(c)
            chars[key] = turns[d - 1][1] if d else 0
        ends[tuple(t for t, _ in turns)].append(c)
    children = defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, m in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(m) - 1) * chars[key]
    return sorted(
        ((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items()), key=str
    )


def talk():
    rows, lines = [], [words(rng.randint(0, 8)) for _ in range(6)]
    for c in [*range(60), *range(100, 180), 205, 207, -150, -3, 10**15 + 7]:
        for turn in range(rng.randint(1, 8)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(lines[:2] if turn < 3 else lines)))
    rows += [(300, None, None, None), (300, 1, "", "x"), (300, 1, "", "x"), (300, None, "user", "é"), (None, 1, "user", "lost"), (301, 0, "user", "only")]
    rows += [(c, t, "user", f"long {t}") for c in (400, 401, 402) for t in range(300 + c % 3)]
    rows += [(c, 0, "user", "the same") for c in range(500, 900)]
    rows.sort(key=lambda r: rng.random())
    return rows


def trie_of(spark, rows):
    data = [(c, t, r, x, 1, b"y", "z") for c, t, r, x in rows]
    found = prefixes.trie(spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, depth int, ids binary, base string"))
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found.collect()), key=str)


def test_trie(spark):
    rows = talk()
    assert trie_of(spark, rows) == trie_by_hand(rows)
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(7, None, None, None)]) == trie_by_hand([(7, None, None, None)])


@pytest.mark.parametrize("size", [1, 2, 7, 50, 10_000])
def test_trie_shards_of_any_size(spark, size):
    """The partial nodes of shards of any size add up to the same nodes."""
    rows = talk()
    built = sorted(((r.ids, r.conv_id, r.chars) for r in prefixes.rebuild(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()), key=lambda r: ([bytes(x) for x in r[0]], r[1]))
    total, least = defaultdict(lambda: np.zeros(4, np.int64)), {}
    count = 0

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    for lo in range(0, len(built), size):
        part = built[lo : lo + size]
        ids = np.array([x for r in part for x in r[0]], "S16")
        before = common(built[lo - 1][0], part[0][0]) if lo else -1
        after = common(part[-1][0], built[lo + size][0]) if lo + size < len(built) else -1
        out = prefixes.nodes_of(0, np.array([r[1] for r in part]), ids, np.array([c for r in part for c in r[2]], np.int64), np.array([len(r[0]) for r in part]), before, after).to_pylist()
        for r in out:
            key = r["node"] if r["side"] else ("closed", lo, count)
            count += 1
            total[key] += [r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]]
            least[key] = min(least.get(key, (10**18,)), (r["conv_id"], r["depth"]))
    assert sorted((*least[k], *v.tolist()) for k, v in total.items()) == sorted((r[0], r[1], r[3], r[4], r[5], r[6]) for r in trie_by_hand(rows))


# ---- fingerprints ------------------------------------------------------------------------------------------------------------


def shingles(text):
    w = text.encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def compared(spark, rows):
    return fingerprints.compare(spark.createDataFrame([(d, t, 1, b"x") for d, t in rows], "doc_id bigint, text string, part int, packed binary")).collect()


@pytest.mark.parametrize("range_bytes", [200, 1 << 20])
def test_fingerprints(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", range_bytes)
    base = words(400)
    rows = [(i, words(rng.randint(0, 300))) for i in range(80)] + [(100, base), (101, base), (102, base + " " + words(40)), (103, ""), (104, None), (105, " \n"), (106, "one"), (107, "é" * 5000), (108, words(20_000)), (2**62, words(9)), (-4, words(50))]
    got = {r.doc_id: r for r in compared(spark, rows)}
    assert len(got) == len(rows)
    order = sorted(((d, t or "") for d, t in rows), reverse=True)
    prints = {}
    for k, (d, text) in enumerate(order):
        after, cut, r = order[(k + 1) % len(order)][1], len(text) // 3, got[d]
        edited = text[: len(text) - cut] + after[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            assert abs(near - jaccard(text, other)) < 0.12
            if not shingles(text) ^ shingles(other):
                assert near == 1.0
        for t, f in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(t, f) == f and len(f) == fingerprints.BINS * fingerprints.BITS // 4
    assert got[103].fingerprint == "0" * len(got[103].fingerprint) == got[105].fingerprint


def test_fingerprints_of_odd_tables(spark):
    assert compared(spark, []) == []
    (one,) = compared(spark, [(5, "abc def")])
    assert one.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest() and one.near_next == 1.0
    rows = [(None, "n " * 30)] * 3 + [(7, "same " * 20)] * 50 + [(7, "other " * 20), (8, None)]
    got = compared(spark, rows)
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 3
    same = [r for r in got if r.n_chars == 100]
    assert len(same) == 50 and sum(r.near_next == 1.0 for r in same) >= 49 and len({r.fingerprint for r in same}) == 1


def test_likeness_is_unbiased():
    """Over many pairs of known likeness the estimate is neither high nor low, for short and for long texts."""
    for size in (12, 60, 600):
        errors = []
        for _ in range(40):
            a = [f"w{rng.random()}" for _ in range(size)]
            k = rng.randint(0, size)
            b = a[:k] + [f"v{rng.random()}" for _ in range(size - k)]
            left, right = " ".join(a), " ".join(b)
            bits, some = fingerprints.fingerprints([left.encode(), right.encode()])
            errors.append(fingerprints.likeness(bits[:1], some[:1], bits[1:], some[1:])[0] - jaccard(left, right))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


# ---- filter audit ------------------------------------------------------------------------------------------------------------


def audit_by_hand(docs, labels):
    fails, parts, counts = [], defaultdict(list), {}
    ids = defaultdict(list)
    for d, t, _ in docs:
        ids[t or ""].append(d)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    for d, t, s in docs:
        t = t or ""
        w = t.encode().split()
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and any(o is not None and o < d for o in ids[t])}
        fails.append(f)
        parts[s or ""].append((f, d in good, d in toxic))
    for part, rows in parts.items():
        shapley = defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = list(rows)
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if r[0][letter]]
                left = [r for r in left if not r[0][letter]]
                counts[part, "".join(order), step] = (
                    len(left), len(gone), sum(r[0][letter] for r in rows) - len(gone), sum(r[0][letter] and sum(r[0].values()) == 1 for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)
                )
                shapley[letter] += len(gone)
        for (p, order, step), c in list(counts.items()):
            if p == part:
                counts[p, order, step] = (*c[:6], shapley[order[step - 1]])
    return counts


def test_audit(spark):
    docs = []
    for i in range(60):
        text = words(rng.choice([0, 10, 49, 50, 80])) + rng.choice(["", " #", " |x", "A" * 60, " same" * 90])
        docs.append((i, text, rng.choice(["web", "book", None, ""])))
    copy = words(70)
    docs += [(i, copy, s) for i, s in ((90, "web"), (91, "web"), (92, "book"), (90, "web"), (None, "web"), (None, None))] + [(93, None, "web"), (94, "", "web"), (-5, "", None), (95, copy + " ", "book"), (96, "É" * 9, "book")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 95, 2)] + [(90, 1, 0), (90, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "m", 2) for d in docs], "doc_id bigint, text string, source string, mask int, part string, n int")
    marks = spark.createDataFrame([(*m, "e") for m in labels], "doc_id bigint, quality int, toxic int, source string")
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in audit.audit(frame, marks).collect()}
    assert got == audit_by_hand(docs, labels)
    assert audit.audit(frame.limit(0), marks.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables not present")
@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_filter_audit"])
def test_new_query_agrees_with_sql(spark, name):
    from chorale.llm.queries import LLM_ORACLES, LLM_QUERIES
    from oracle import duck, rows_of

    root = "/root/testdata/sf0.001"
    got, want = LLM_QUERIES[name](spark, root), duck(root).sql(LLM_ORACLES[name])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())
