"""Smoothing by change points against the grid of ticks it stands for."""
import math
import random
from collections import Counter

import pytest

from chorale.operators import turns as tn


def by_ticks(turns, tick, size=5, ratio=0.6):
    out = []
    for s in sorted({t[0] for t in turns}):
        own = [t for t in turns if t[0] == s]
        origin = min(t[3] for t in own)
        grid = {}
        for _, i, who, a, b, c in own:
            for k in range(math.ceil((a - origin) / tick), math.floor((b - origin) / tick) + 1):
                key = (-c, a, i)
                if k not in grid or key < grid[k][0]:
                    grid[k] = (key, who)
        ticks = sorted(grid)
        said = [grid[k][1] for k in ticks]
        half = size // 2
        new = []
        for n in range(len(said)):
            votes = said[max(0, n - half) : n + half + 1]
            best = [w for w, k in Counter(votes).items() if k / len(votes) >= ratio]
            new.append(best[0] if best else said[n])
        at = 0
        run = 0
        while at < len(new):
            end = at
            while end + 1 < len(new) and new[end + 1] == new[at]:
                end += 1
            run += 1
            stop = ticks[end + 1] if end + 1 < len(ticks) else ticks[end]
            out.append((s, run, new[at], origin + ticks[at] * tick, origin + stop * tick, end - at + 1))
            at = end + 1
    return sorted(out)


@pytest.mark.parametrize("tick,bucket", [(10, 100_000), (10, 3), (250, 100_000)])
def test_smoothing(spark, tick, bucket):
    rng = random.Random(tick + bucket)
    turns, k = [], 0
    for s in range(12):
        at = rng.randint(-50, 500)
        for _ in range(rng.randint(1, 25)):
            k += 1
            a = at + rng.randint(-80, 120)
            turns.append((s, k, rng.choice("abc"), a, a + rng.choice([0, 5, 15, 25, 45, 60, 130, 700]), rng.choice([0.5, 0.6, 0.7])))
            at = max(at, a + rng.randint(0, 200))
    df = spark.createDataFrame(turns, "session_id long, id long, speaker string, start long, end long, confidence double")
    got = sorted((r.session_id, r.id, r.speaker, r.start, r.end, r.ticks) for r in tn.smooth_turns(df, tick, 200.0, per_bucket=bucket).collect())
    assert got == by_ticks(turns, tick)
