"""Scalar functions: comparisons, bounds in sorted arrays, prefixes, encodings, size classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compare(a: Column, b: Column) -> Column:
    """lt, eq, gt or unordered; NaN equals NaN and is unordered with all else."""
    return F.when(F.isnan(a) & F.isnan(b), "eq").when(F.isnan(a) | F.isnan(b), "unordered").when(a < b, "lt").when(a > b, "gt").otherwise("eq")


def lower_bound(array: str, key: Column) -> Column:
    """The first place of a sorted array whose item is at or above a key."""
    return F.size(F.filter(array, lambda x: x < key))


def upper_bound(array: str, key: Column) -> Column:
    return F.size(F.filter(array, lambda x: x <= key))


def common_bytes(a: Column, b: Column) -> Column:
    """Length in bytes of the longest common prefix of two strings."""
    x, y = F.encode(a, "utf-8"), F.encode(b, "utf-8")
    most = F.least(F.octet_length(x), F.octet_length(y))
    same = lambda i: F.substring(x, F.lit(1), i) == F.substring(y, F.lit(1), i)
    return F.when(most == 0, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), same)))


def big_endian(value: Column) -> Column:
    """16 hex digits of a number that is not negative; they sort like the numbers."""
    return F.lpad(F.hex(value), 16, "0")


def size_class(size: Column, base: int, least: int, most: int = 20) -> Column:
    """How often a size is divided by ``base``, rounding up, until it is ``least`` or less."""
    out, rest = F.lit(most), size
    steps = []
    for i in range(most):
        steps.append((i, rest))
        rest = F.call_function("div", rest + F.lit(base - 1), F.lit(base))
    for i, r in reversed(steps):
        out = F.when(r <= least, i).otherwise(out)
    return out
