"""Small numeric column helpers."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def r6(c: Column | str) -> Column:
    """Doubles leave an operator query rounded to six places, ties upwards despite the order of a sum."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-10, 6)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def lit_or(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))
