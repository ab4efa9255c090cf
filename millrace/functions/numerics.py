"""Numeric functions with the warehouse's rounding and overflow rules (Column to Column; ANSI mode raises)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUOTIENT_SCALE = 6


def quotient(a: Column, b: Column) -> Column:
    """Exact quotient of exact numbers: scale 6, rounded half away from zero; division by zero raises."""
    wide = lambda c: c.cast("decimal(19,6)")
    return F.round(wide(a) / wide(b), QUOTIENT_SCALE).cast(f"decimal(19,{QUOTIENT_SCALE})")


def int_div(a: Column, b: Column) -> Column:
    """Truncating integer division."""
    return F.call_function("div", a, b)


def to_integer(x: Column, kind: str = "int") -> Column:
    """Cast to an integer that rounds half away from zero."""
    return F.round(x, 0).cast(kind)


def mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; zero divisor raises."""
    return a % b


def _positive(x: Column, name: str) -> Column:
    return F.when(x <= 0, F.raise_error(F.lit(f"2201E: {name} of a number that is not positive"))).otherwise(x)


def ln(x: Column) -> Column:
    return F.log(_positive(x, "LN"))


def log10(x: Column) -> Column:
    return F.log10(_positive(x, "LOG10"))


def rand_between(low: int, high: int, seed: int | None = None) -> Column:
    """Random integer; both ends have half the weight of the others."""
    return (F.lit(low) + F.round(F.rand(seed) * (high - low))).cast("int")


def reinterpret(x: Column, scale: int) -> Column:
    """A decimal as its unscaled 64-bit integer."""
    return F.round(x * (10**scale), 0).cast("bigint")
