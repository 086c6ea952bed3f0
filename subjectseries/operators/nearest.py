"""Choosing the candidate closest to an instant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_of_neighbours(ideal_us: Column, tolerance_us: int, neighbour: Column) -> Column:
    """Closest instant within ``ideal ± tolerance``; a tie goes to the earlier one.

    ``neighbour`` is the latest observation not after ``ideal`` with its successor
    (``us``, ``next_us``): no other observation can be closer.
    """
    before, after = neighbour["us"], neighbour["next_us"]
    left = ideal_us - before
    right = after - ideal_us
    left = F.when(left <= tolerance_us, left)
    right = F.when(right <= tolerance_us, right)
    return (
        F.when(left.isNull() & right.isNull(), F.lit(None).cast("bigint"))
        .when(right.isNull(), before)
        .when(left.isNull(), after)
        .when(left <= right, before)
        .otherwise(after)
    )


def nearest(ts: Column | str, offset: Column) -> Column:
    """Aggregate: the candidate with the smallest offset, ties to the earlier time."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.min_by(ts, F.struct(F.abs(offset), ts))
