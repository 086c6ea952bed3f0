"""Grouped aggregations used by the queries and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subjectseries.functions.scalars import (
    RESOLUTION_SECONDS,
    US_PER_SECOND,
    as_col,
    bucket_start_us,
    epoch_us,
    exact_mean,
    from_us,
    local_date,
)
from subjectseries.operators.distribution import frequency_median


def extent(df: DataFrame, kind: str, time: str, keys: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Count and first/last time of one category per subject."""
    return df.groupBy(*keys).agg(
        F.lit(kind).alias("kind"),
        F.count(F.lit(1)).alias("count"),
        F.min(time).alias("first_at"),
        F.max(time).alias("last_at"),
    )


def rollup(df: DataFrame, time: str, value: str, resolution: str) -> DataFrame:
    """Count, min, max and mean per subject and fixed UTC bucket; empty buckets are absent."""
    width = RESOLUTION_SECONDS[resolution] * US_PER_SECOND
    start = bucket_start_us(epoch_us(time), width)
    return (
        df.groupBy("subject_id", start.alias("_bucket"))
        .agg(
            F.count(F.lit(1)).alias("sample_count"),
            F.min(value).alias("min_value"),
            F.max(value).alias("max_value"),
            exact_mean(value).alias("mean_value"),
            F.max(time).alias("_fresh"),
        )
        .select(
            "subject_id",
            from_us("_bucket").alias("bucket_start"),
            from_us(F.col("_bucket") + F.lit(width)).alias("bucket_end"),
            "sample_count",
            "min_value",
            "max_value",
            "mean_value",
            "_fresh",
        )
    )


def rollup_parts(df: DataFrame, time: str, value: str, resolution: str) -> DataFrame:
    """What :func:`rollup` needs of some of the rows: parts of one bucket add up."""
    width = RESOLUTION_SECONDS[resolution] * US_PER_SECOND
    return (
        df.groupBy("subject_id", bucket_start_us(epoch_us(time), width).alias("_bucket"))
        .agg(
            F.count(F.lit(1)).alias("sample_count"),
            F.count(value).alias("_values"),
            F.sum(value).cast("decimal(20,3)").alias("_sum"),
            F.min(value).cast("decimal(10,3)").alias("min_value"),
            F.max(value).cast("decimal(10,3)").alias("max_value"),
            F.max(time).alias("_fresh"),
        )
        .select("subject_id", from_us("_bucket").alias("bucket_start"), "sample_count", "_values", "_sum", "min_value", "max_value", "_fresh")
    )


def merge_parts(parts: DataFrame) -> DataFrame:
    """One part per bucket; the order in which parts came does not matter."""
    sums = [F.sum(c).alias(c) for c in ("sample_count", "_values")]
    total = F.sum("_sum").cast("decimal(20,3)").alias("_sum")
    ends = [F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.max("_fresh").alias("_fresh")]
    return parts.groupBy("subject_id", "bucket_start").agg(*sums, total, *ends)


def finished_rollup(parts: DataFrame, resolution: str) -> DataFrame:
    """The columns of :func:`rollup` from merged parts."""
    width = RESOLUTION_SECONDS[resolution] * US_PER_SECOND
    return parts.select(
        "subject_id",
        "bucket_start",
        from_us(epoch_us("bucket_start") + F.lit(width)).alias("bucket_end"),
        "sample_count",
        "min_value",
        "max_value",
        (F.col("_sum") / F.col("_values")).alias("mean_value"),
        "_fresh",
    )


def with_totals(buckets: DataFrame, count: str = "sample_count", fresh: str = "_fresh") -> DataFrame:
    """Attach the subject's totals to each bucket (after aggregation, so few rows)."""
    whole = Window.partitionBy("subject_id")
    return buckets.withColumns(
        {
            "source_record_count": F.sum(count).over(whole),
            "data_fresh_through": F.max(fresh).over(whole),
            "point_count": F.count(F.lit(1)).over(whole),
        }
    )


def summary(df: DataFrame, keys: Sequence[str | Column], time: str, value: str) -> DataFrame:
    """Count, first, last, min, max, mean and exact median per group."""
    keyed = df
    names: list[str] = []
    for position, key in enumerate(keys):
        if isinstance(key, str):
            names.append(key)
        else:
            names.append(f"_k{position}")
            keyed = keyed.withColumn(f"_k{position}", key)
    stats = keyed.groupBy(*names).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.min(time).alias("first_at"),
        F.max(time).alias("last_at"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        exact_mean(value).alias("mean_value"),
    )
    return stats.join(frequency_median(keyed, names, value), names).withColumnRenamed(
        "median", "median_value"
    )


def daily_summary(df: DataFrame, time: str, value: str, tz: str) -> DataFrame:
    with_day = df.withColumn("local_date", local_date(time, tz))
    return summary(with_day, ["subject_id", "local_date"], time, value)


def duplicate_count(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows minus distinct rows, per ``keys``; copies are merged before they are counted."""
    return (
        df.groupBy(*keys, *columns)
        .agg((F.count(F.lit(1)) - 1).alias("extra"))
        .groupBy(*keys)
        .agg(F.sum("extra").alias("duplicates"))
    )


def code_counts(df: DataFrame, codes: str, weight: str | None = None) -> DataFrame:
    """Rows per code of an array column; a code counts once per row."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    exploded = df.select(
        F.explode(F.array_distinct(codes)).alias("code"), *([weight] if weight else [])
    )
    return exploded.groupBy("code").agg(n.alias("n"))


def freshness(df: DataFrame, time: str, keys: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Newest instant contributing to a result."""
    return df.groupBy(*keys).agg(F.max(time).alias("data_fresh_through"))


def sources_overlapping(df: DataFrame, keys: Sequence[str], source: str, start: str, end: str) -> DataFrame:
    """Count, earliest start, latest end and the sorted distinct sources."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.min(start).alias("first_start_time"),
        F.max(end).alias("last_end_time"),
        F.array_sort(F.collect_set(as_col(source))).alias("sources"),
    )
