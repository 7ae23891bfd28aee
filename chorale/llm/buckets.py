"""Compare the members of each bucket without emitting pairs; large buckets are cut into units that other tasks share."""
from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of one half of a unit. A bucket of more members is cut into k parts and every two parts meet in one unit.
UNIT = 2048


def units(members: DataFrame, key: list[str], member: str, unit: int = UNIT) -> DataFrame:
    """`members` with columns u, v, part: a row goes to each unit (key, u, v) its part has a share in, u <= v.

    A bucket of up to `unit` members is the one unit (0, 0). In a larger one a row is copied once per part, so the copies grow with
    the number of parts and every unit stays bounded.
    """
    sizes = members.groupBy(*key).agg(F.count("*").alias("members"))
    large = sizes.where(F.col("members") > unit)
    parts = members.join(large, key, "left").withColumn("parts", F.coalesce(F.ceil(F.col("members") / unit), F.lit(1)).cast("int")).drop("members")
    parts = parts.withColumn("part", F.pmod(F.xxhash64(member), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    return parts.select("*", other).select(*members.columns, "part", F.least("part", "other").alias("u"), F.greatest("part", "other").alias("v"))


def find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(n: int, pairs: Iterator[tuple[Any, Any]]) -> list[int]:
    """Smallest member index of each member's component."""
    parent = list(range(n))
    for left, right in pairs:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            a, b = find(parent, a), find(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [find(parent, i) for i in range(n)]
