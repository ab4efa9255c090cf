"""Multiset operators on arrays. A multiset keeps repeats and has no order; results are sorted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _times(a: Column, x: Column) -> Column:
    return F.size(F.filter(a, lambda y: y.eqNullSafe(x)))


def union_all(a: Column, b: Column) -> Column:
    return F.sort_array(F.concat(a, b))


def union_distinct(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def _combine(a: Column, b: Column, times) -> Column:
    kinds = F.array_distinct(a)
    return F.sort_array(F.flatten(F.transform(kinds, lambda x: F.array_repeat(x, times(_times(a, x), _times(b, x))))))


def intersect_all(a: Column, b: Column) -> Column:
    return _combine(a, b, F.least)


def except_all(a: Column, b: Column) -> Column:
    return _combine(a, b, lambda m, n: F.greatest(m - n, F.lit(0)))


def intersect_distinct(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_intersect(a, b))


def except_distinct(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_except(a, b))


def member_of(x: Column, a: Column) -> Column:
    return F.array_contains(a, x)


def is_a_set(a: Column) -> Column:
    return F.size(a) == F.size(F.array_distinct(a))


def submultiset_of(a: Column, b: Column) -> Column:
    return F.forall(F.array_distinct(a), lambda x: _times(a, x) <= _times(b, x))


def element(a: Column) -> Column:
    """The only element; null for none; raises for more."""
    return F.when(F.size(a) > 1, F.raise_error(F.lit("21000: more than one element"))).otherwise(F.try_element_at(a, F.lit(1)))
