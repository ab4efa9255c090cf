"""Aggregates whose results keep the type of their argument, as the warehouse defines them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def ref_avg(x: Column, kind: str) -> Column:
    """Mean cast back to the argument's type."""
    return F.avg(x).cast(kind)


def ref_sum(x: Column, kind: str) -> Column:
    return F.sum(x).cast(kind)


def sum0(x: Column) -> Column:
    """Sum that is 0 for no rows."""
    return F.coalesce(F.sum(x), F.lit(0))


def single_value(df: DataFrame, column: str) -> Column:
    """The only value of a column, as an aggregate: raises for more than one row."""
    return F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("21000: more than one row"))).otherwise(F.first(df[column]))


def full_frame(x: Column, window, rows: int) -> Column:
    """A windowed value only where the frame holds `rows` rows (DISALLOW PARTIAL)."""
    return F.when(F.count(F.lit(1)).over(window) >= rows, x.over(window))


def frame(window: WindowSpec, low: int, high: int, kind: str = "rows") -> WindowSpec:
    """A ROWS or RANGE frame from `low` to `high`, negative before the current row; one that ends before it begins raises."""
    if low > high:
        raise ValueError("42601: the frame ends before it begins")
    return window.rowsBetween(low, high) if kind == "rows" else window.rangeBetween(low, high)
