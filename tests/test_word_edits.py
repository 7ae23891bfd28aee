"""Edit counts against a plain table of (edits, substitutions), and long pairs."""
import random
import time

import pytest

from chorale.operators import evaluate as ev


def by_table(a, b):
    row = [(j, 0) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [(i, 0)]
        for j, y in enumerate(b, 1):
            c, s = row[j - 1]
            new.append(min((c, s) if x == y else (c + 1, s + 1), (row[j][0] + 1, row[j][1]), (new[j - 1][0] + 1, new[j - 1][1])))
        row = new
    c, s = row[-1]
    d = (c - s + len(a) - len(b)) // 2
    return len(a) - s - d, s, d, c - s - d


@pytest.mark.parametrize("words", [2, 5, 50])
def test_counts(words):
    rng = random.Random(words)
    for _ in range(300):
        a, b = ([str(rng.randrange(words)) for _ in range(rng.randint(0, 25))] for _ in range(2))
        assert ev.edit_counts(a, b) == by_table(a, b)


def test_twenty_thousand_words():
    rng = random.Random(4)
    a = [str(rng.randrange(5000)) for _ in range(20_000)]
    b = [w for w in a if rng.random() > 0.02]
    gone = len(a) - len(b)
    began = time.process_time()
    assert ev.edit_counts(a, b) == (len(b), 0, gone, 0) and ev.edit_counts(b, a) == (len(b), 0, 0, gone)
    assert time.process_time() - began < 60


def test_equal_and_empty_texts(spark):
    rows = [(1, "a b c", "a b c"), (2, "", ""), (3, "a", ""), (4, "", "a b"), (5, None, "a"), (6, " A, b ", "a  b"), (7, "a b c d", "a x c")]
    got = {r.id: (r.hits, r.subs, r.dels, r.ins) for r in ev.wer(spark.createDataFrame(rows, "id int, ref string, hyp string")).collect()}
    assert got == {1: (3, 0, 0, 0), 2: (0, 0, 0, 0), 3: (0, 0, 1, 0), 4: (0, 0, 0, 2), 5: (0, 0, 0, 1), 6: (2, 0, 0, 0), 7: (2, 1, 1, 0)}
