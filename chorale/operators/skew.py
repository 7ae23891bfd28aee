"""Group statistics, ordered scans and joins that stay parallel when one key holds much of the data.

``Window.partitionBy(key)`` puts a whole key into one task.  The helpers below keep the same results:

* ``attach``     unordered statistics: map-side combined ``groupBy`` joined back (AQE splits a hot key);
* ``scan_over``  lag / lead / running values: windows run inside (key, bucket), and only one summary row per
                 bucket takes part in the per-key window that carries values across bucket edges;
* ``top_n``      a rank filter, which Spark turns into a group limit before the shuffle;
* ``interval_join`` equi-join on (key, time bucket) with the exact residual.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

RUNNING = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give row-wise CPU-heavy work to every core when the scan has fewer tasks than the cluster has cores.

    Large inputs already have more scan tasks than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def attach(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Add whole-group aggregates as columns."""
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(stats, list(keys))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One row per key: the row with the least order tuple (a partial aggregate, no sort)."""
    best = F.min_by(F.struct(*columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def scan_over(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    lag: dict[str, Column] | None = None,
    lead: dict[str, Column] | None = None,
    before: dict[str, tuple[str, Column]] | None = None,
    upto: dict[str, tuple[str, Column]] | None = None,
    last_upto: dict[str, Column] | None = None,
    next_from: dict[str, Column] | None = None,
) -> DataFrame:
    """Ordered per-key values without a per-key task.

    ``bucket`` must not decrease along ``order``.  ``lag``/``lead`` give neighbouring values, ``before`` and
    ``upto`` running aggregates excluding / including the row, ``last_upto`` the latest non-null value up to the
    row and ``next_from`` the earliest non-null value from the row on.
    """
    lag, lead, before, upto = lag or {}, lead or {}, before or {}, upto or {}
    last_upto, next_from = last_upto or {}, next_from or {}
    keys = list(keys)
    d = df.withColumn("_b", bucket)
    pos = F.struct(*order)
    in_bucket = Window.partitionBy(*keys, "_b").orderBy(*order)
    over_buckets = Window.partitionBy(*keys).orderBy("_b")
    earlier = over_buckets.rowsBetween(Window.unboundedPreceding, -1)
    later = over_buckets.rowsBetween(1, Window.unboundedFollowing)

    summary, carry, local, final = [], [], [], {}
    if lag:
        summary.append(F.max_by(F.struct(*[c.alias(n) for n, c in lag.items()]), pos).alias("_last"))
        carry.append(F.lag("_last").over(over_buckets).alias("_prev"))
        local.append(F.lag(F.struct(*[c.alias(n) for n, c in lag.items()])).over(in_bucket).alias("_lag"))
        for n in lag:
            final[n] = F.coalesce(F.col("_lag"), F.col("_prev")).getField(n)
    if lead:
        summary.append(F.min_by(F.struct(*[c.alias(n) for n, c in lead.items()]), pos).alias("_first"))
        carry.append(F.lead("_first").over(over_buckets).alias("_next"))
        local.append(F.lead(F.struct(*[c.alias(n) for n, c in lead.items()])).over(in_bucket).alias("_lead"))
        for n in lead:
            final[n] = F.coalesce(F.col("_lead"), F.col("_next")).getField(n)
    for kind, spec in (("before", before), ("upto", upto)):
        stop = -1 if kind == "before" else 0
        frame = in_bucket.rowsBetween(Window.unboundedPreceding, stop)
        for n, (how, c) in spec.items():
            agg, join = RUNNING[how]
            summary.append(agg(c).alias(f"_s_{n}"))
            carry.append(agg(F.col(f"_s_{n}")).over(earlier).alias(f"_c_{n}"))
            local.append(agg(c).over(frame).alias(f"_l_{n}"))
            final[n] = join(F.col(f"_c_{n}"), F.col(f"_l_{n}"))
    for n, c in last_upto.items():
        known = F.when(c.isNotNull(), F.struct(c.alias("v")))
        summary.append(F.max_by(known, F.when(c.isNotNull(), pos)).alias(f"_s_{n}"))
        carry.append(F.last(f"_s_{n}", True).over(earlier).alias(f"_c_{n}"))
        local.append(F.last(known, True).over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_l_{n}"))
        final[n] = F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")).getField("v")
    for n, c in next_from.items():
        known = F.when(c.isNotNull(), F.struct(c.alias("v")))
        summary.append(F.min_by(known, F.when(c.isNotNull(), pos)).alias(f"_s_{n}"))
        carry.append(F.first(f"_s_{n}", True).over(later).alias(f"_c_{n}"))
        local.append(F.first(known, True).over(in_bucket.rowsBetween(0, Window.unboundedFollowing)).alias(f"_l_{n}"))
        final[n] = F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")).getField("v")

    edges = d.groupBy(*keys, "_b").agg(*summary).select(*keys, "_b", *carry)
    scanned = d.select("*", *local).join(edges, keys + ["_b"])
    kept = [c for c in df.columns if c not in final]
    return scanned.select(*kept, *[c.alias(n) for n, c in final.items()])


def islands(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, starts: Column, name: str = "island"
) -> DataFrame:
    """Number the runs of rows per key; ``starts`` is true on the first row of a run."""
    return scan_over(df, keys, order, bucket, upto={name: ("sum", F.when(starts, 1).otherwise(0).cast("bigint"))})


def overlap_islands(
    df: DataFrame, keys: Sequence[str], start: str, end: str, ties: Sequence[str], width: float, gap: float = 0
) -> DataFrame:
    """Runs of intervals whose distance to everything before them is at most ``gap``."""
    order = [start, *ties]
    bucket = F.floor(F.col(start) / F.lit(width))
    d = scan_over(df, keys, order, bucket, before={"_reach": ("max", F.col(end))})
    fresh = F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + F.lit(gap))
    return islands(d, keys, order, bucket, fresh).drop("_reach")


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    l: tuple[str, str],
    r: tuple[str, str],
    width: float,
    tol: float = 0,
) -> DataFrame:
    """Pairs whose closed intervals come within ``tol``; all non-key column names must differ.

    Each side is repeated once per time bucket it touches and a pair is kept only in the bucket of the later
    start, so no ``distinct`` is needed and a hot key is spread over its buckets.
    """
    ls, le = F.col(l[0]) - F.lit(tol), F.col(l[1]) + F.lit(tol)
    rs, re = F.col(r[0]), F.col(r[1])

    def spread(d: DataFrame, a: Column, b: Column) -> DataFrame:
        first, last = F.floor(a / F.lit(width)), F.floor(b / F.lit(width))
        return d.where(b >= a).withColumn("_k", F.explode(F.sequence(first, last)))

    pairs = spread(left, ls, le).join(spread(right, rs, re), [*keys, "_k"])
    return pairs.where(
        (ls <= re) & (le >= rs) & (F.col("_k") == F.floor(F.greatest(ls, rs) / F.lit(width)))
    ).drop("_k")
