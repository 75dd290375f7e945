"""Scalar expressions of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def cents(amount: Column) -> Column:
    """PRJ5: whole cents, halves to even."""
    return F.rint(amount * 100).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b where b > 0, else null."""
    return F.when(b > 0, a / b)


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def trailing_zeros(amount: Column, most: int = 6) -> Column:
    """Trailing decimal zeros of the whole part, most at most; 0 for 0."""
    whole = F.floor(F.abs(amount))
    return F.when(whole > 0, sum(((whole % 10**k) == 0).cast("int") for k in range(1, most + 1))).otherwise(0)


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """EV16: the Wilson score interval within [0, 1]; null for n = 0."""
    p = successes / F.when(n > 0, n)
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    guarded = lambda x: F.when(n > 0, x)
    return guarded(F.greatest(F.lit(0.0), middle - half)), guarded(F.least(F.lit(1.0), middle + half))


def alphabet_mask(code: Column) -> Column:
    """The bit of a value of a small alphabet (64 values at most), by its code."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), code.cast("int"))


def mask_size(mask: Column) -> Column:
    """How many values a mask, made by bitwise or of their bits, has."""
    return F.bit_count(mask)
