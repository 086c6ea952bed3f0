"""Data-quality reports over snapshot tables (``schemas.SNAPSHOT``), per subject."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subjectseries.functions.predicates import in_range, not_inside, overlaps, ts_lit
from subjectseries.functions.scalars import (
    US_PER_MINUTE,
    elapsed_minutes,
    epoch_us,
    expected_samples,
    from_us,
    gap_class,
    local_date,
    local_dates_touched,
    minutes_to_us,
    offset_seconds,
    rate,
)
from subjectseries.operators.aggregates import duplicate_count
from subjectseries.operators.bands import BandPlan
from subjectseries.operators.chunks import halo_width, observations, with_chunk, with_halo
from subjectseries.operators.distribution import distribution, frequency_median
from subjectseries.operators.gaps import gap_weights, out_of_order, segments, time_gaps
from subjectseries.operators.nearest import nearest_of_neighbours
from subjectseries.plans.policies import DiagnosticsPolicy
from subjectseries.schemas import ID_COLUMNS, INTERVAL_TABLES, POINT_TABLES, READINESS_STATUSES
from subjectseries.sources.snapshot import sort_key

MIN_SPLIT_OBSERVATIONS = 100
MIN_SPLIT_SEGMENTS = 2
LONG = "bigint"


def _zero() -> Column:
    return F.lit(0).cast(LONG)


# --- structure -------------------------------------------------------------------
def point_structure(df: DataFrame, category: str, start: datetime, end: datetime) -> DataFrame:
    """Rows, extremes, rows in and out of the window, repeated ids (glucose: times)."""
    inside = in_range("timestamp", ts_lit(start), ts_lit(end))
    base = df.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("timestamp").alias("earliest"),
        F.max("timestamp").alias("latest"),
        F.count_if(inside).alias("in_window"),
        F.count_if(~inside).alias("out_of_window"),
    )
    what = "timestamp" if category == "glucose" else ID_COLUMNS[category]
    extra = duplicate_count(df, [what], ["subject_id"])
    return (
        base.join(extra, "subject_id", "left")
        .withColumn("category", F.lit(category))
        .withColumn("duplicates", F.coalesce("duplicates", _zero()))
    )


def interval_structure(df: DataFrame, category: str, start: datetime, end: datetime) -> DataFrame:
    """The same for intervals, with overlap counts; durations are in the next report."""
    lo, hi = ts_lit(start), ts_lit(end)
    meets = overlaps("start", "end", lo, hi)
    base = df.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("start").alias("earliest"),
        F.max("end").alias("latest"),
        F.count_if(meets).alias("overlapping"),
        F.count_if(~meets).alias("non_overlapping"),
        F.count_if(not_inside("start", "end", lo, hi)).alias("extends_beyond"),
    )
    extra = duplicate_count(df, [ID_COLUMNS[category]], ["subject_id"])
    return (
        base.join(extra, "subject_id", "left")
        .withColumn("category", F.lit(category))
        .withColumn("duplicates", F.coalesce("duplicates", _zero()))
    )


def interval_durations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distribution of interval lengths in minutes, with the mean."""
    lengths = df.withColumn("us", epoch_us("end") - epoch_us("start"))
    return distribution(lengths, keys, "us", scale=float(US_PER_MINUTE), include_mean=True)


def structural_summary(tables: dict[str, DataFrame], start: datetime, end: datetime) -> DataFrame:
    """One row per subject and category with rows."""
    parts = [point_structure(tables[c], c, start, end) for c in POINT_TABLES]
    parts += [interval_structure(tables[c], c, start, end) for c in INTERVAL_TABLES]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def sort_status(df: DataFrame, category: str, sequence: str) -> DataFrame:
    """Whether the rows arrived in canonical order; ``sequence`` is the ingest order."""
    late = out_of_order(df, sequence, sort_key(category))
    return late.select(
        "subject_id",
        F.when(F.col("out_of_order_pairs") == 0, "already_sorted")
        .otherwise("sorted_for_analysis")
        .alias("sort_status"),
    )


# --- glucose -----------------------------------------------------------------------
def glucose_observations(glucose: DataFrame) -> DataFrame:
    return observations(glucose, "timestamp", "glucose_mg_dl")


def value_summary(glucose: DataFrame, places: int = 3) -> DataFrame:
    """Min, max, mean and median of the values; exact in thousandths."""
    exact = glucose.withColumn("v", F.col("glucose_mg_dl").cast(f"decimal(18,{places})"))
    unit = 10**places

    def units(total: Column) -> Column:
        return (total * unit).cast("double")

    stats = exact.groupBy("subject_id").agg(
        F.min("v").cast("double").alias("min"),
        F.max("v").cast("double").alias("max"),
        (units(F.sum("v")) / (F.count("v") * unit)).alias("mean"),
    )
    return stats.join(frequency_median(exact, ["subject_id"], "v", places), "subject_id")


def gaps(obs: DataFrame, policy: DiagnosticsPolicy) -> DataFrame:
    """Every adjacent gap between distinct instants, classified."""
    minutes = F.col("gap_us") / F.lit(float(US_PER_MINUTE))
    return (
        time_gaps(obs)
        .withColumn("elapsed_minutes", minutes)
        .withColumn(
            "classification",
            gap_class("elapsed_minutes", policy.gap_warning_minutes, policy.gap_major_minutes),
        )
    )


def gap_table(obs: DataFrame, policy: DiagnosticsPolicy) -> DataFrame:
    """Warning and major gaps, as written out."""
    return (
        gaps(obs, policy)
        .filter(F.col("classification") != "normal")
        .select(
            "subject_id",
            from_us("prev_us").alias("previous_timestamp_utc"),
            from_us("next_us").alias("next_timestamp_utc"),
            "elapsed_minutes",
            "classification",
        )
    )


def sampling_summary(obs: DataFrame, policy: DiagnosticsPolicy) -> DataFrame:
    """Counts and total minutes by gap class, repeated instants, and sample count.

    Sums are taken in whole microseconds, so they do not depend on row order.
    """
    kind, us = F.col("classification"), F.col("gap_us")
    by_gap = gaps(obs, policy).groupBy("subject_id").agg(
        F.count_if(kind == "warning").alias("warning_gap_count"),
        F.count_if(kind == "major").alias("major_gap_count"),
        F.sum(F.when(kind == "warning", us)).alias("_warning_us"),
        F.sum(F.when(kind == "major", us)).alias("_major_us"),
    )
    minutes = lambda c: F.coalesce(F.col(c), _zero()) / F.lit(float(US_PER_MINUTE))
    base = obs.groupBy("subject_id").agg(
        F.sum("n").alias("observed_record_count"),
        F.sum(F.col("n") - 1).alias("duplicate_timestamp_count"),
    )
    return base.join(by_gap, "subject_id", "left").select(
        "subject_id",
        "observed_record_count",
        "duplicate_timestamp_count",
        F.coalesce("warning_gap_count", _zero()).alias("warning_gap_count"),
        F.coalesce("major_gap_count", _zero()).alias("major_gap_count"),
        minutes("_warning_us").alias("warning_gap_minutes"),
        minutes("_major_us").alias("major_gap_minutes"),
        (F.col("observed_record_count") >= 2).alias("interval_distribution_available"),
    )


def interval_distribution(obs: DataFrame) -> DataFrame:
    """Distribution of sampling intervals in minutes, repeats counting as zero."""
    return distribution(
        gap_weights(obs), ["subject_id"], "gap_us", "n", scale=float(US_PER_MINUTE)
    )


def source_order(glucose: DataFrame, sequence: str) -> DataFrame:
    """Adjacent rows in ingest order whose time decreases."""
    return out_of_order(glucose, sequence, F.col("timestamp"))


def contiguous_segments(obs: DataFrame, policy: DiagnosticsPolicy) -> DataFrame:
    return segments(obs, policy.gap_major_minutes).select(
        "subject_id",
        from_us("start_us").alias("start_timestamp_utc"),
        from_us("end_us").alias("end_timestamp_utc"),
        F.col("n").alias("observation_count"),
        elapsed_minutes(from_us("start_us"), from_us("end_us")).alias("elapsed_minutes"),
    )


def split_boundaries(
    obs: DataFrame,
    policy: DiagnosticsPolicy,
    min_observations: int = MIN_SPLIT_OBSERVATIONS,
    min_segments: int = MIN_SPLIT_SEGMENTS,
) -> DataFrame:
    """Starts of all segments but a subject's first, where volume makes a split sensible."""
    found = segments(obs, policy.gap_major_minutes)
    totals = found.groupBy("subject_id").agg(
        F.sum("n").alias("observations"),
        F.count(F.lit(1)).alias("segment_count"),
        F.min("start_us").alias("first_us"),
    )
    enough = (F.col("observations") >= min_observations) & (
        F.col("segment_count") >= min_segments
    )
    return (
        found.select("subject_id", "start_us")
        .join(totals.filter(enough), "subject_id")
        .filter(F.col("start_us") > F.col("first_us"))
        .select("subject_id", from_us("start_us").alias("boundary_utc"))
    )


def _clipped_days(start: Column, end: Column, lo: datetime, hi: datetime, tz: str) -> Column:
    """Local days of ``[start, end)`` that the window ``[lo, hi)`` touches as well."""
    first = local_date(ts_lit(lo), tz)
    last = local_date(ts_lit(hi - timedelta(microseconds=1)), tz)
    from_day = F.greatest(local_date(start, tz), first)
    to_day = F.least(local_date(F.timestamp_micros(F.unix_micros(end) - 1), tz), last)
    return F.when((end > start) & (from_day <= to_day), F.sequence(from_day, to_day)).otherwise(
        F.array().cast("array<date>")
    )


def days_with_major_gaps(
    obs: DataFrame, policy: DiagnosticsPolicy, start: datetime, end: datetime
) -> DataFrame:
    """Number of window days a major gap touches."""
    major = gaps(obs, policy).filter(F.col("classification") == "major")
    days = _clipped_days(from_us("prev_us"), from_us("next_us"), start, end, policy.timezone)
    return (
        major.select("subject_id", F.explode(days).alias("day"))
        .distinct()
        .groupBy("subject_id")
        .agg(F.count(F.lit(1)).alias("major_gap_days"))
    )


# --- daily coverage ------------------------------------------------------------------
DAY_COUNTS = {
    "glucose": "glucose_observed_count",
    "meals": "meal_count",
    "workouts": "workout_overlap_count",
    "sleep": "raw_sleep_interval_overlap_count",
    "weight": "weight_count",
}


def daily_coverage(
    tables: dict[str, DataFrame], start: datetime, end: datetime, policy: DiagnosticsPolicy
) -> DataFrame:
    """One row per subject and local day of the window, days without records included.

    Each table is first counted by day on its own, then the small counts and the day
    spine are added up in one aggregation. An interval counts on each day it touches.
    """
    tz = policy.timezone
    lo, hi = ts_lit(start), ts_lit(end)
    parts: list[DataFrame] = []
    for name, df in tables.items():
        if name in POINT_TABLES:
            days = df.select("subject_id", local_date("timestamp", tz).alias("local_date"))
        else:
            touched = _clipped_days(F.col("start"), F.col("end"), start, end, tz)
            days = df.select("subject_id", F.explode(touched).alias("local_date"))
        parts.append(
            days.groupBy("subject_id", "local_date")
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("what", F.lit(name))
        )
    subjects = reduce(
        DataFrame.unionByName, [df.select("subject_id") for df in tables.values()]
    ).distinct()
    spine = subjects.select(
        "subject_id",
        F.explode(local_dates_touched(lo, hi, tz)).alias("local_date"),
        _zero().alias("n"),
        F.lit("day").alias("what"),
    )
    merged = reduce(DataFrame.unionByName, [*parts, spine])
    counted = merged.groupBy("subject_id", "local_date").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), _zero()).alias(column)
            for name, column in DAY_COUNTS.items()
        ],
        F.bool_or(F.col("what") == "day").alias("_in_window"),
    )
    expected = expected_samples("local_date", tz, policy.cadence_minutes)
    return (
        counted.filter("_in_window")
        .withColumn("glucose_expected_count_estimate", expected.cast(LONG))
        .withColumn(
            "glucose_coverage_ratio_estimate",
            rate("glucose_observed_count", "glucose_expected_count_estimate"),
        )
        .select(
            "subject_id",
            "local_date",
            "glucose_observed_count",
            "glucose_expected_count_estimate",
            "glucose_coverage_ratio_estimate",
            "meal_count",
            "workout_overlap_count",
            "raw_sleep_interval_overlap_count",
            "weight_count",
        )
    )


# --- forecast readiness ------------------------------------------------------------------
# Reasons stated with a readiness status.
REASONS = {
    "insufficient_history": "no observed glucose timestamp at or before the configured minimum-history instant",
    "missing_target": "no observed glucose timestamp within the configured target-tolerance band",
    "eligible_ambiguous": "multiple observed glucose timestamps within the configured target-tolerance band",
}


def first_seen(obs: DataFrame, width_us: int) -> DataFrame:
    """Earliest instant of the subject, repeated per (subject, chunk) that has rows."""
    edges = with_chunk(obs, "us", width_us).groupBy("subject_id", "chunk").agg(
        F.min("us").alias("us")
    )
    return edges.select(
        "subject_id",
        "chunk",
        F.min("us").over(Window.partitionBy("subject_id")).alias("first_us"),
    )


def readiness_by_instant(obs: DataFrame, policy: DiagnosticsPolicy) -> DataFrame:
    """Per distinct instant and horizon: candidates, nearest, status; ``n`` copies each.

    The subject's first instant is joined on (subject, chunk), the partitioning the
    band window needs anyway.
    """
    tolerance = minutes_to_us(policy.target_tolerance_minutes)
    history = minutes_to_us(policy.minimum_history_minutes)
    horizons = {h: minutes_to_us(h) for h in policy.horizons_minutes}
    after = max(horizons.values()) + tolerance
    width = halo_width(0, after)
    plan = BandPlan()
    entries = []
    for minutes, us in horizons.items():
        count = plan.count(us - tolerance, us + tolerance)
        closest = nearest_of_neighbours(F.col("us") + F.lit(us), tolerance, plan.neighbours(us))
        entries.append(
            F.struct(
                F.lit(minutes).cast(LONG).alias("horizon_minutes"),
                (F.col("us") + F.lit(us)).alias("ideal_us"),
                count.alias("candidate_observation_count"),
                closest.alias("nearest_us"),
            )
        )
    rows = with_halo(obs, width, 0, after).join(
        first_seen(obs, width), ["subject_id", "chunk"]
    )
    banded = plan.apply(rows).filter("owned")
    status = (
        F.when(F.col("first_us") > F.col("us") - F.lit(history), "insufficient_history")
        .when(F.col("candidate_observation_count") == 0, "missing_target")
        .when(F.col("candidate_observation_count") == 1, "eligible_unique")
        .otherwise("eligible_ambiguous")
    )
    return (
        banded.select(
            "subject_id", "us", "n", "first_us", F.explode(F.array(*entries)).alias("h")
        )
        .select("subject_id", "us", "n", "first_us", "h.*")
        .withColumn("status", status)
        .drop("first_us")
    )


def forecast_readiness(obs: DataFrame, policy: DiagnosticsPolicy) -> DataFrame:
    """The readiness table: one row per distinct instant and horizon, ``copies`` of it."""
    reason = F.create_map(*[x for k, v in REASONS.items() for x in (F.lit(k), F.lit(v))])
    return readiness_by_instant(obs, policy).select(
        "subject_id",
        "us",
        "n",
        from_us("us").alias("anchor_timestamp_utc"),
        "horizon_minutes",
        from_us("ideal_us").alias("ideal_target_timestamp_utc"),
        "candidate_observation_count",
        from_us("nearest_us").alias("nearest_observation_timestamp_utc"),
        offset_seconds("nearest_us", "ideal_us").alias("nearest_offset_seconds"),
        "status",
        F.try_element_at(reason, F.col("status")).alias("reason"),
    )


def readiness_summary(readiness: DataFrame, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Counts and rates per horizon; copies of an instant count one by one."""
    by_status = {
        name: F.sum(F.when(F.col("status") == name, F.col("n")).otherwise(_zero()))
        for name in READINESS_STATUSES
    }
    counted = readiness.groupBy(*keys, "horizon_minutes").agg(
        F.sum("n").alias("anchor_count"),
        *[c.alias(f"{name}_count") for name, c in by_status.items()],
    )
    anyhow = F.col("eligible_unique_count") + F.col("eligible_ambiguous_count")
    return counted.withColumns(
        {
            "eligible_any_count": anyhow,
            "eligible_unique_rate": rate("eligible_unique_count", "anchor_count"),
            "eligible_any_rate": rate(anyhow, "anchor_count"),
        }
    )


def readiness_offsets(readiness: DataFrame, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Distribution of nearest-target offsets in seconds, of all rows with a candidate."""
    rows = readiness.filter(F.col("candidate_observation_count") > 0).withColumn(
        "offset_us", F.col("nearest_us") - F.col("ideal_us")
    )
    return distribution(rows, [*keys, "horizon_minutes"], "offset_us", "n", scale=1_000_000.0)


# --- ranges and warnings ---------------------------------------------------------------
def observed_ranges(tables: dict[str, DataFrame]) -> DataFrame:
    """Earliest and latest observation per subject and category."""
    parts = []
    for name, df in tables.items():
        low, high = ("timestamp", "timestamp") if name in POINT_TABLES else ("start", "end")
        parts.append(
            df.groupBy("subject_id").agg(
                F.lit(name).alias("category"), F.min(low).alias("earliest"), F.max(high).alias("latest")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def warnings(
    structural: DataFrame, sampling: DataFrame, order: DataFrame, subjects: DataFrame
) -> DataFrame:
    """Rule rows derived from the reports: ``subject_id, category, code, n``."""
    categories = F.array(*[F.lit(c) for c in (*POINT_TABLES, *INTERVAL_TABLES)])
    spine = subjects.select("subject_id", F.explode(categories).alias("category"))
    full = spine.join(structural, ["subject_id", "category"], "left")

    def entry(count: Column, code: str) -> Column:
        return F.when(count > 0, F.struct(F.lit(code).alias("code"), count.cast(LONG).alias("n")))

    none = F.when(F.col("row_count").isNull(), 1).otherwise(0)
    ids = F.when(F.col("category") != "glucose", F.col("duplicates"))
    by_category = full.select(
        "subject_id",
        "category",
        F.explode(
            F.array_compact(
                F.array(
                    entry(none, "zero_rows"),
                    entry(ids, "duplicate_identifiers"),
                    entry(F.col("extends_beyond"), "extends_beyond_window"),
                    entry(F.col("non_overlapping"), "outside_window"),
                    entry(F.col("out_of_window"), "outside_window"),
                )
            )
        ).alias("w"),
    )
    few = F.when(F.col("interval_distribution_available"), 0).otherwise(1)
    of_glucose = (
        subjects.join(sampling, "subject_id", "left")
        .join(order, "subject_id", "left")
        .select(
            "subject_id",
            F.lit("glucose").alias("category"),
            F.explode(
                F.array_compact(
                    F.array(
                        entry(F.col("duplicate_timestamp_count"), "duplicate_timestamps"),
                        entry(F.col("out_of_order_pairs"), "source_out_of_order"),
                        entry(F.col("warning_gap_count"), "warning_gaps"),
                        entry(F.col("major_gap_count"), "major_gaps"),
                        entry(few, "too_few_observations"),
                    )
                )
            ).alias("w"),
        )
    )
    return by_category.unionByName(of_glucose).select("subject_id", "category", "w.code", "w.n")

