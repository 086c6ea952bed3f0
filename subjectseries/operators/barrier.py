"""Keeping computed columns computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Select through a one-element ``explode``.

    A filter on the result is evaluated on the computed columns. Through a plain
    projection the optimizer would push it down towards the scan and, on the way, write
    the whole computation once more into its condition.
    """
    return df.select(F.explode(F.array(F.struct(*columns))).alias("_row")).select("_row.*")
