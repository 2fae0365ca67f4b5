"""Arrays of numbers: sorting and intersection with repetitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sort_floats(values: Column) -> Column:
    """Ascending; null for null."""
    return F.array_sort(values)


def multiset_intersect(a: Column, b: Column) -> Column:
    """The values that both arrays hold, each as often as in the one that holds it less often, ascending; null if either is null."""
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.array_sort(F.flatten(F.transform(F.array_intersect(a, b), lambda x: F.array_repeat(x, F.least(times(a, x), times(b, x))))))
