"""Three-valued logic in which AND and OR are unknown as soon as one side is (so ``false AND unknown`` is unknown)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weak_not(a: Column) -> Column:
    return ~a


def weak_and(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), a & b)


def weak_or(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), a | b)


def is_true(a: Column) -> Column:
    return a.eqNullSafe(F.lit(True))


def is_false(a: Column) -> Column:
    return a.eqNullSafe(F.lit(False))


def is_unknown(a: Column) -> Column:
    return a.isNull()
