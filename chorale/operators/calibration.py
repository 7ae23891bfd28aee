"""Score calibration over batches, the score registry, and the calibration plug-in table."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from chorale.dims import CALIBRATION_RANGES, DIMENSIONS, DOMAIN_FACTORS
from chorale.functions.numeric import clip
from chorale.operators.skew import attach

CALIBRATIONS: dict[str, Callable[[str], Column]] = {}


def register_calibration(name: str, method: Callable[[str], Column]) -> None:
    """Add a method: dimension name in, calibrated column out.

    The input frame carries ``<dim>_mean``, ``<dim>_std``, ``<dim>_min``, ``<dim>_max`` and ``batch`` (rows) of the
    session, and ``target_<dim>_mean`` / ``target_<dim>_std`` where a registry was joined.
    """
    CALIBRATIONS[name] = method


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def _raw(d: str) -> Column:
    return clip(F.col(d), 0.0, 1.0)


def _absolute(d: str) -> Column:
    low, high = CALIBRATION_RANGES[d]
    return sigmoid(6.0 * ((F.col(d) - low) / (high - low) - 0.5))


def _relative(d: str) -> Column:
    span = F.col(f"{d}_max") - F.col(f"{d}_min")
    return F.when(span == 0, F.lit(0.5)).otherwise(
        clip(0.5 + 0.8 * ((F.col(d) - F.col(f"{d}_min")) / span - 0.5), 0.0, 1.0))


def _logistic(d: str) -> Column:
    return clip(sigmoid((F.col(d) - F.col(f"{d}_mean")) / (F.col(f"{d}_std") + 0.01)), 0.01, 0.99)


def _registry(d: str) -> Column:
    mean, std = F.col(f"target_{d}_mean"), F.greatest(F.col(f"target_{d}_std"), F.lit(0.01))
    spread = F.when(F.col("batch") > 1, F.col(f"{d}_std")).otherwise(std)
    moved = (F.col(d) - F.col(f"{d}_mean")) / spread * std + mean
    z = clip((moved - mean) / (std * 2), -10, 10)
    known = F.when(spread > 0.001, sigmoid(z)).otherwise(clip(mean, 0.0, 1.0))
    return F.when(mean.isNull(), _absolute(d)).otherwise(known)


for _name, _method in {"raw": _raw, "absolute": _absolute, "relative": _relative, "logistic": _logistic,
                       "registry": _registry}.items():
    register_calibration(_name, _method)


def calibrate(candidates: DataFrame, method: str = "absolute", registry: DataFrame | None = None) -> DataFrame:
    """Calibrate the five dimensions inside each session's batch."""
    aggs = {"batch": F.count("*")}
    for d in DIMENSIONS:
        aggs |= {f"{d}_mean": F.avg(d), f"{d}_std": F.stddev_pop(d), f"{d}_min": F.min(d), f"{d}_max": F.max(d)}
    if method in ("raw", "absolute"):
        base = candidates
    else:
        base = attach(candidates, ["session_id"], **aggs)
    if method == "registry":
        if registry is None:
            base = base.select("*", *[F.lit(None).cast("double").alias(f"target_{d}_{s}")
                                      for d in DIMENSIONS for s in ("mean", "std")])
        else:
            base = base.crossJoin(F.broadcast(global_targets(registry)))  # one row
    keep = [c for c in candidates.columns if c not in DIMENSIONS]
    return base.select(*keep, *[CALIBRATIONS[method](d).alias(d) for d in DIMENSIONS])


def adjust_domain(candidates: DataFrame, domain: str = "domain") -> DataFrame:
    """Per-domain factor with a soft cap above 1 and a soft floor below 0."""
    def factor(d: str) -> Column:
        known = reduce(lambda w, kv: w.when(F.col(domain) == kv[0], F.lit(kv[1][d])), DOMAIN_FACTORS.items(), F)
        return known.otherwise(F.lit(1.0))

    def soft(d: str) -> Column:
        x = F.col(d) * factor(d)
        return F.when(x > 1.0, 0.95 + 0.05 * (1.0 / (1.0 + (x - 1.0)))) \
            .when(x < 0.0, 0.05 * (1.0 - 1.0 / (1.0 + F.abs(x)))).otherwise(x)

    keep = [c for c in candidates.columns if c not in DIMENSIONS]
    return candidates.select(*keep, *[soft(d).alias(d) for d in DIMENSIONS])


CONTEXT = ["domain", "speaker_range", "noise"]


def score_statistics(scores: DataFrame) -> DataFrame:
    """(n, mean, m2, min, max) per dimension and context, plus one global row per dimension.

    The wide table is aggregated once; unpivoting and the global roll-up touch only the aggregates.
    """
    wide = scores.groupBy(*CONTEXT).agg(F.count("*").alias("n"), *[
        f(d).alias(f"{d}_{s}") for d in DIMENSIONS
        for s, f in [("mean", F.avg), ("var", F.var_pop), ("min", F.min), ("max", F.max)]])
    rows = wide.select(*CONTEXT, "n", F.inline(F.array(*[
        F.struct(F.lit(d).alias("dim"), F.col(f"{d}_mean").alias("mean"), (F.col(f"{d}_var") * F.col("n")).alias("m2"),
                 F.col(f"{d}_min").alias("min"), F.col(f"{d}_max").alias("max")) for d in DIMENSIONS])))
    everywhere = merge_moments(rows.select("dim", "n", "mean", "m2", "min", "max"), ["dim"]).select(
        *[F.lit("*").alias(c) for c in CONTEXT], "n", "dim", "mean", "m2", "min", "max")
    return rows.unionByName(everywhere)


def merge_moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Exact merge of partial means and squared deviations."""
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    return rows.groupBy(*keys).agg(
        n.alias("n"), mean.alias("mean"),
        (F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")) - n * mean * mean).alias("m2"),
        F.min("min").alias("min"), F.max("max").alias("max"))


def update_registry(registry: DataFrame, scores: DataFrame) -> DataFrame:
    return merge_moments(registry.unionByName(score_statistics(scores)), [*CONTEXT, "dim"])


def with_std(registry: DataFrame) -> DataFrame:
    return registry.withColumn(
        "std", F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / (F.col("n") - 1))).otherwise(0.1))


def global_targets(registry: DataFrame) -> DataFrame:
    g = with_std(registry).where(F.col("domain") == "*")
    return g.agg(*[F.max(F.when(F.col("dim") == d, F.col(s))).alias(f"target_{d}_{s}")
                   for d in DIMENSIONS for s in ("mean", "std")])


def lookup_registry(contexts: DataFrame, registry: DataFrame, minimum: int = 1) -> DataFrame:
    """Statistics of each asked-for context, the global row where the context is unknown."""
    full = with_std(registry)
    known = full.where((F.col("domain") != "*") & (F.col("n") >= minimum))
    glob = full.where(F.col("domain") == "*").select(
        "dim", *[F.col(c).alias(f"g_{c}") for c in ("n", "mean", "std")])
    asked = contexts.select(*CONTEXT).distinct()
    hit = asked.join(known.select(*CONTEXT, "dim", "n", "mean", "std"), CONTEXT)
    miss = asked.join(known, CONTEXT, "left_anti").crossJoin(F.broadcast(glob)).select(  # five global rows
        *CONTEXT, "dim", F.col("g_n").alias("n"), F.col("g_mean").alias("mean"), F.col("g_std").alias("std"))
    return hit.withColumn("source", F.lit("context")).unionByName(miss.withColumn("source", F.lit("global")))
