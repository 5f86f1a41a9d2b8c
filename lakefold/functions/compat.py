"""Named helpers where another null or numeric behaviour than ANSI SQL's is wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same(a: Column, b: Column) -> Column:
    """Null-safe equality: two nulls are equal."""
    return a.eqNullSafe(b)


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality: a null differs from any value."""
    return ~a.eqNullSafe(b)


def times(a: Column, b: Column | float) -> Column:
    """Product, always double."""
    return a.cast("double") * (b.cast("double") if isinstance(b, Column) else F.lit(float(b)))


def sum_or_zero(x: Column) -> Column:
    """Double sum of the non-null values; 0.0 without any."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def avg_or_zero(x: Column) -> Column:
    """Mean of the non-null values; 0.0 without any."""
    return F.coalesce(F.avg(x.cast("double")), F.lit(0.0))


def join_null_safe(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match null keys; <=> stays a hashable key for Spark."""
    cond = F.lit(True)
    for a, b in on:
        cond = cond & left[a].eqNullSafe(right[b])
    return left.join(right, cond, how)
