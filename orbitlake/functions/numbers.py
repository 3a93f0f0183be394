"""Scalar expressions shared by the operators.  NaN becomes null where data come in, so that aggregates skip it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import EPS


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """``c`` where it is a finite number, else null."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def guarded(num: Column, den: Column, eps: float = EPS) -> Column:
    return num / (den + F.lit(eps))


def confidence(rank: Column, direction: str) -> Column:
    """Confidence of a rule from the percentile rank of what it looks at."""
    return clip(1 - rank if direction == "lower" else 0.5 + (rank - 0.5), 0.0, 1.0)


def level_threshold(level: int, base: float, step: float, most: float) -> float:
    return min(most, base + level * step)


def cluster_size(n: int) -> int:
    """Smallest cluster for n rows."""
    return max(8, min(500, n // 30))


def core_size(smallest: int) -> int:
    return max(3, smallest // 4)
