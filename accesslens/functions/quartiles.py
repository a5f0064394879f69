"""Exact quartiles by halves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quartiles(values: Column) -> Column:
    """``struct(q1, q2, q3, max)`` of a non-empty sorted array.

    The median is the mean of the two middle elements (of one twice); the outer
    quartiles are the medians of the lower and the upper half, without the
    middle element where the count is odd.
    """
    n = F.size(values)
    half = F.floor(n / 2).cast("int")
    quarter = F.floor(half / 2).cast("int")
    mean = lambda i, j: (F.get(values, i) + F.get(values, j)) / 2.0
    q2 = mean(half, n - 1 - half)
    q1 = F.when(n == 1, q2).otherwise(mean(quarter, half - 1 - quarter))
    q3 = F.when(n == 1, q2).otherwise(mean(n - half + quarter, n - 1 - quarter))
    return F.struct(q1.alias("q1"), q2.alias("q2"), q3.alias("q3"), F.get(values, n - 1).alias("max"))
