"""Distances of dense vectors (arrays) and of bit vectors (arrays of BIGINT words)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _paired(a: Column, b: Column, f) -> Column:  # noqa: ANN001
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return _sum(_paired(a, b, lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(_paired(a, b, lambda x, y: (x - y) * (x - y)))


def l1(a: Column, b: Column) -> Column:
    return _sum(_paired(a, b, lambda x, y: F.abs(x - y)))


def linf(a: Column, b: Column) -> Column:
    """The largest difference; 0 for empty vectors."""
    return F.coalesce(F.array_max(_paired(a, b, lambda x, y: F.abs(x - y))), F.lit(0.0))


def popcount(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + F.bit_count(x))


def _bits(a: Column, b: Column, f) -> Column:  # noqa: ANN001
    return popcount(F.zip_with(a, b, f))


def and_popcount(a: Column, b: Column) -> Column:
    return _bits(a, b, lambda x, y: x.bitwiseAND(y))


def or_popcount(a: Column, b: Column) -> Column:
    return _bits(a, b, lambda x, y: x.bitwiseOR(y))


def xor_popcount(a: Column, b: Column) -> Column:
    return _bits(a, b, lambda x, y: x.bitwiseXOR(y))


def jaccard_distance(a: Column, b: Column) -> Column:
    """(union - intersection) / union, 1 where both are empty."""
    union = or_popcount(a, b)
    return F.when(union == 0, 1.0).otherwise((union - and_popcount(a, b)) / union)
