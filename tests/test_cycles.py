"""Cycles of artifact graphs against reachability by hand."""
import random

from chorale.operators import ops


def by_hand(edges):
    nodes = {x for e in edges for x in ((e[0], e[1]), (e[0], e[2]))}
    reach = {n: set() for n in nodes}
    for g, a, b in edges:
        reach[g, a].add((g, b))
    for k in nodes:
        for n in nodes:
            if k in reach[n]:
                reach[n] |= reach[k]
    out = []
    for n in nodes:
        group = {m for m in reach[n] if n in reach[m]}
        if group:
            out.append((*n, min(m[1] for m in group), len(group)))
    return sorted(out)


def found(spark, edges):
    df = spark.createDataFrame([(g, a, b, "x") for g, a, b in edges], "run_id int, name string, input string, c string")
    return sorted(tuple(r) for r in ops.cycles(df, ["run_id"]).collect())


def test_cycles(spark):
    rng = random.Random(2)
    edges = [(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "c", "d"), (1, "d", "e"), (1, "e", "d"), (1, "x", "a"), (1, "e", "z"), (2, "a", "a"), (2, "a", "b"), (2, "b", "c"), (3, "a", "b"), (3, "a", "b")]
    edges += [(4, f"n{rng.randrange(14):02}", f"n{rng.randrange(14):02}") for _ in range(18)] + [(5, f"c{i:02}", f"c{(i + 1) % 20:02}") for i in range(20)] + [(6, f"p{i:02}", f"p{i + 1:02}") for i in range(12)]
    assert found(spark, edges) == by_hand(edges)


def test_no_cycle_and_no_edge(spark):
    assert found(spark, [(1, "a", "b"), (1, "b", "c"), (1, None, "c"), (1, "c", None)]) == [] == found(spark, [])
