"""Column expressions that have no single built-in counterpart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_zero(v: Column) -> Column:
    """NaN and infinities become 0; null stays null."""
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)


def is_finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != float("inf"))


def linspace(start: float, stop: float, n: int) -> Column:
    """An array of n values, both ends included."""
    if n < 2:
        return F.array_repeat(F.lit(float(start)), n)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + i * F.lit(stop - start) / (n - 1))


def spaced(start: Column, stop: Column, n: int) -> Column:
    """An array of n evenly spaced values from one column to another."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + i * (stop - start) / max(1, n - 1))


def part_bound(length: Column, parts: Column | int, part: Column) -> Column:
    """Where part number ``part`` of an axis begins (halves to the even number)."""
    return F.bround(length / parts * part).cast("int")


def stretch_to_byte(v: Column, low: Column, high: Column) -> Column:
    """Clip to [low, high] and scale to 0..255; 0 between equal limits, null without limits."""
    clipped = F.least(F.greatest(v, low), high)
    return F.when(high == low, 0).otherwise(F.floor(255 * (clipped - low) / (high - low))).cast("int")


def safe_ratio(a: Column, b: Column, floor: float = 1e-6) -> Column:
    """a / b, with a denominator closer to 0 than ``floor`` replaced by ``floor``."""
    return a / F.when(F.abs(b) < floor, F.lit(floor)).otherwise(b)
