"""Dense vector columns (arrays) and their means by group."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def mean_vector(df: DataFrame, keys: list[str], vector: str, weight: Column | None = None, name: str = "centroid") -> DataFrame:
    """Weighted mean vector per key: positions are summed map-side, so a key of any size shuffles 64 numbers per task."""
    w = weight if weight is not None else F.lit(1.0)
    d = df.select(*keys, w.alias("_w"), F.posexplode(vector).alias("_p", "_x"))
    s = d.groupBy(*keys, "_p").agg((F.sum(F.col("_w") * F.col("_x").cast("double")) / F.sum("_w")).alias("_m"))
    return s.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_p", "_m")))["_m"].alias(name))
