"""The token diff against a plain table, its blocks, and every protection check."""
import random
import time

import pytest

from chorale.operators import corpus, protect, token_diff as td


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("limit", [1, 7, 64, 1 << 27])
def test_alignment_is_a_longest_one(limit):
    rng = random.Random(limit)
    for _ in range(150):
        k = rng.choice([2, 4, 30])
        a, b = ([rng.randrange(k) for _ in range(rng.randint(0, 40))] for _ in range(2))
        pairs = td.aligned(a, b, limit)
        assert all(a[i] == b[j] for i, j in pairs) and all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        assert len(pairs) == longest(a, b)


def test_counts_by_hand():
    # Um, on's hyphen parts and the last comma's place change; API, V and OK differ in case only where the letters do
    got = td.Diff("Um the API v1.2 is on-line ,ok", "The API V1.2 is online, OK!").counts()
    assert got == {"tokens": 13, "kept": 9, "removed": 3, "added": 1, "signs_removed": 1, "signs_added": 1, "case_changed": 3, "spacing_changed": 1}
    assert td.Diff("", "").counts()["tokens"] == 0 and td.Diff("a b", "").counts()["removed"] == 2 and td.Diff("", "a!").counts()["signs_added"] == 1


CASES = [
    ("order ACME-100 went", "order ACME-100 went", []),
    ("file 482911/2019 shut", "file 482,911/2019 shut", ["exact"]),
    ("dose 9.5 mg given", "dose 9.5mg given", ["exact"]),
    ("take v1.2.3 now", "take V1.2.3 now", ["exact"]),
    ("take v1.2.3 now", "take now", ["removed"]),
    ("the NASA team", "the Nasa team", ["case"]),
    ("on 2024-09-15 we", "on 2024/09/15 we", ["exact"]),
    ("see foo.bar there", "see foo/bar there", ["structure"]),
    ("the NASA-TV team", "the NASA.TV team", ["structure"]),
    ("in Q3-24 it", "in Q3 - 24 it", ["spacing"]),
    ("in Q3-24 it", "in q3-24 it", ["case"]),
    ("the NASA team", "the N A S A team", ["spacing"]),
    ("the NASA team", "the other team", ["removed"]),
    ("about 1,200 people", "about 1,2-00 people", ["punctuation", "structure"]),
    ("see ABC DEF", "see ABC, DEF", []),
]


@pytest.mark.parametrize("original,changed,checks", CASES)
def test_checks_of_protected_spans(original, changed, checks):
    found = td.Diff(original, changed).violations()
    assert sorted({v[4] for v in found}) == checks


def test_severities():
    assert td.inserted_signs("AB1", "A-B1") == "moderate" and td.inserted_signs("A-B", "A-B") is None and td.inserted_signs("a.b", "a.b.") is None
    assert (td.changed_spaces("a b", "ab"), td.changed_spaces("ab c", "a bc"), td.changed_spaces("a", "a")) == ("moderate", "minor", None)
    assert (td.changed_case("A1", "a1"), td.changed_case("AB", "ab"), td.changed_case("a", "b")) == ("critical", "moderate", None)
    assert (td.changed_structure("a-b", "a.b"), td.changed_structure("a-b", "x-y")) == ("critical", None)


def test_rows_and_protected_profiles(spark):
    rng = random.Random(8)
    words = "um uh the the very 2 and but API v1.2.3 9.5 mg 2024-09-15 No. 12345 ok. you know x@y.zz “so” monday".split(" ")
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(99, None), (98, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    for profile in corpus.PROFILES:
        pairs = protect.normalize_protected(df, profile).selectExpr("id", "text AS original", "normalized")
        assert td.protection_checks(pairs, ["id"]).count() == 0  # nothing protected changes when only the gaps are rewritten
    plain = corpus.normalize_corpus(df, "executive").selectExpr("id", "text AS original", "normalized", "1 AS tokens_before")
    assert td.protection_checks(plain, ["id"]).count() > 0
    counts = {r.id: r for r in td.token_diff(plain).collect()}
    assert len(counts) == len(rows) and counts[99].tokens == 0
    by_id = {r.id: r for r in plain.collect()}
    for i, c in counts.items():
        d = td.Diff(by_id[i].original or "", by_id[i].normalized or "")
        assert c.kept == longest([d.original[slice(*s)].casefold() for s in d.left], [d.changed[slice(*s)].casefold() for s in d.right])
        assert c.kept + c.removed + c.signs_removed == c.tokens


def test_long_texts():
    rng = random.Random(1)
    a = [rng.randrange(3000) for _ in range(40_000)]
    b = [x for x in a if rng.random() > 0.1]
    began = time.process_time()
    assert len(td.aligned(a, b)) == len(b) and time.process_time() - began < 60
