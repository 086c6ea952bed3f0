"""The ten bounded queries, each over many subjects or a DataFrame of anchors.

Inputs are the stored tables (``schemas.STORED``). With one subject a result is the
single-subject answer. Limits carry their service defaults and accept ``None``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjectseries.functions.predicates import (
    RequestError,
    in_closed,
    in_range,
    live,
    overlaps,
    positive_lookback,
    span_at_most,
    time_range,
    ts_lit,
    zone,
)
from subjectseries.functions.scalars import (
    DEFAULT_TIMEZONE,
    RESOLUTION_SECONDS,
    US_PER_DAY,
    US_PER_HOUR,
    US_PER_MINUTE,
    duration_minutes,
    epoch_us,
    normalized_foods,
    round1,
)
from subjectseries.operators import aggregates, paging, ranges
from subjectseries.operators.asof import Lookup, asof_join, asof_lookups, latest_at

# Contract limits.
MAX_POINTS = 10_000
MAX_SPAN_DAYS = {"raw": 7, "5m": 31, "15m": 90, "hourly": 365}
MAX_LIST_DAYS = {"workouts": 365, "sleep": 90, "weight": 365}
MAX_TIMELINE_HOURS = 72
MAX_TIMELINE_EVENTS = 2_000
MEAL_LOOKBACK_DAYS = 30
WORKOUT_LOOKBACK_DAYS = 14
WEIGHT_LOOKBACK_DAYS = 30
SLEEP_LOOKBACK_HOURS, MAX_SLEEP_LOOKBACK_HOURS = 24, 36
GLUCOSE_LOOKBACK_HOURS, MAX_GLUCOSE_LOOKBACK_HOURS = 24, 48

DEFAULT = object()


@dataclass(frozen=True)
class SubjectTables:
    """The five stored tables."""

    glucose: DataFrame
    meals: DataFrame
    workouts: DataFrame
    sleep: DataFrame
    weight: DataFrame


def _span(days: dict[str, int], key: str, limit) -> timedelta | None:
    if limit is DEFAULT:
        return timedelta(days=days[key])
    return limit


# --- public item shapes ----------------------------------------------------
def meal_items(df: DataFrame) -> DataFrame:
    return df.select(
        "subject_id",
        F.col("source_sample_id").alias("id"),
        "meal_completed_at",
        normalized_foods("foods").alias("foods"),
        "source",
    )


def workout_items(df: DataFrame) -> DataFrame:
    return df.select(
        "subject_id",
        F.col("source_sample_id").alias("id"),
        "start_time",
        "end_time",
        "sport",
        "distance_meters",
        duration_minutes("start_time", "end_time").alias("duration_minutes"),
        "source",
    )


def sleep_items(df: DataFrame) -> DataFrame:
    return df.select(
        "subject_id",
        F.col("source_sample_id").alias("id"),
        "start_time",
        "end_time",
        duration_minutes("start_time", "end_time").alias("duration_minutes"),
        "stage",
        "source",
    )


def weight_items(df: DataFrame) -> DataFrame:
    return df.select(
        "subject_id",
        F.col("source_sample_id").alias("id"),
        "measured_at",
        "value_kg",
        "source",
    )


def _points(df: DataFrame, time: str, start: datetime, end: datetime) -> DataFrame:
    return live(df).filter(in_range(time, ts_lit(start), ts_lit(end)))


def _intervals(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return live(df).filter(overlaps("start_time", "end_time", ts_lit(start), ts_lit(end)))


# --- coverage ----------------------------------------------------------------
# Categories of data.
CATEGORIES = ("glucose", "meals", "workouts", "sleep_intervals", "weight_measurements")


def coverage(
    tables: SubjectTables, start: datetime, end: datetime, subjects: DataFrame | None = None
) -> DataFrame:
    """Five rows per subject seen in the window: category, count, first and last time.

    With ``subjects`` (column subject_id), five rows for each of those instead, also for
    subjects without any row in the window.

    All categories share one aggregation. Intervals count when they overlap, and
    report their start times. A category without rows keeps count 0 and nulls.
    """
    start, end = time_range(start, end)
    parts = [
        _points(tables.glucose, "sample_time", start, end).select(
            "subject_id", F.lit("glucose").alias("kind"), F.col("sample_time").alias("at")
        ),
        _points(tables.meals, "meal_completed_at", start, end).select(
            "subject_id", F.lit("meals").alias("kind"), F.col("meal_completed_at").alias("at")
        ),
        _intervals(tables.workouts, start, end).select(
            "subject_id", F.lit("workouts").alias("kind"), F.col("start_time").alias("at")
        ),
        _intervals(tables.sleep, start, end).select(
            "subject_id", F.lit("sleep_intervals").alias("kind"), F.col("start_time").alias("at")
        ),
        _points(tables.weight, "measured_at", start, end).select(
            "subject_id",
            F.lit("weight_measurements").alias("kind"),
            F.col("measured_at").alias("at"),
        ),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    found = rows.groupBy("subject_id", "kind").agg(
        F.count(F.lit(1)).alias("count"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )
    # Complete the five categories: one small row per subject, exploded to five.
    per_subject = found.groupBy("subject_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct("kind", F.struct("count", "first_at", "last_at")))
        ).alias("by_kind")
    )
    if subjects is not None:
        per_subject = subjects.select("subject_id").distinct().join(per_subject, "subject_id", "left")
    kinds = F.array(*[F.lit(kind) for kind in CATEGORIES])
    return (
        per_subject.withColumn("kind", F.explode(kinds))
        .withColumn("c", F.try_element_at("by_kind", F.col("kind")))
        .select(
            "subject_id",
            "kind",
            F.coalesce("c.count", F.lit(0)).alias("count"),
            F.col("c.first_at").alias("first_at"),
            F.col("c.last_at").alias("last_at"),
        )
    )


# --- glucose -----------------------------------------------------------------
def glucose_series(
    glucose: DataFrame,
    start: datetime,
    end: datetime,
    resolution: str = "15m",
    *,
    max_span=DEFAULT,
    max_points: int | None = MAX_POINTS,
) -> DataFrame:
    """Raw samples or fixed UTC buckets of one resolution, with the subject's totals."""
    start, end = time_range(start, end)
    if resolution != "raw" and resolution not in RESOLUTION_SECONDS:
        raise RequestError("INVALID_RESOLUTION", f"unknown resolution {resolution!r}")
    span_at_most(start, end, _span(MAX_SPAN_DAYS, resolution, max_span), f"{resolution} series")
    rows = _points(glucose, "sample_time", start, end)
    if resolution == "raw":
        points = rows.select(
            "subject_id",
            F.col("sample_time").alias("timestamp"),
            round1("value_mg_dl").alias("value_mg_dl"),
        )
        capped = paging.enforce_cap(points, max_points, "raw series", order=["timestamp"])
        return capped.orderBy("subject_id", "timestamp")
    buckets = aggregates.with_totals(
        aggregates.rollup(rows, "sample_time", "value_mg_dl", resolution)
    )
    buckets = paging.within_cap(buckets, F.col("point_count"), max_points, f"{resolution} series")
    return buckets.select(
        "subject_id",
        F.col("bucket_start").alias("start"),
        F.col("bucket_end").alias("end"),
        round1(F.col("mean_value")).alias("mean_mg_dl"),
        round1("min_value").alias("min_mg_dl"),
        round1("max_value").alias("max_mg_dl"),
        "sample_count",
        "source_record_count",
        "data_fresh_through",
    )


def glucose_summary(
    glucose: DataFrame,
    start: datetime,
    end: datetime,
    bucket: str = "overall",
    tz: str = DEFAULT_TIMEZONE,
    subjects: DataFrame | None = None,
) -> DataFrame:
    """Statistics per subject, over the whole window or per local day with data.

    With ``subjects`` (column subject_id), the whole window has a row for each of those,
    with count 0 for subjects without samples.
    """
    start, end = time_range(start, end)
    tz = zone(tz)
    rows = _points(glucose, "sample_time", start, end)
    if bucket == "overall":
        stats = aggregates.summary(rows, ["subject_id"], "sample_time", "value_mg_dl")
        if subjects is not None:
            return complete_summary(_named_stats(stats), subjects.select("subject_id").distinct())
    elif bucket == "daily":
        stats = aggregates.daily_summary(rows, "sample_time", "value_mg_dl", tz)
    else:
        raise RequestError("INVALID_BUCKET", f"unknown bucket {bucket!r}")
    return _named_stats(stats)


def _named_stats(stats: DataFrame) -> DataFrame:
    for name in ("min", "max", "mean", "median"):
        stats = stats.withColumn(f"{name}_mg_dl", round1(f"{name}_value")).drop(f"{name}_value")
    return stats


def complete_summary(stats: DataFrame, subjects: DataFrame) -> DataFrame:
    """Add the subjects without samples: count 0, everything else null."""
    return subjects.join(stats, "subject_id", "left").withColumn(
        "sample_count", F.coalesce("sample_count", F.lit(0))
    )


# --- lists -------------------------------------------------------------------
def meals(meals_df, start, end, *, limit=paging.DEFAULT_PAGE, after=None) -> DataFrame:
    start, end = time_range(start, end)
    items = meal_items(_points(meals_df, "meal_completed_at", start, end))
    return paging.page(items, "meal_completed_at", "id", limit, after)


def workouts(
    workouts_df, start, end, *, limit=paging.DEFAULT_PAGE, after=None, max_span=DEFAULT
) -> DataFrame:
    start, end = time_range(start, end)
    span_at_most(start, end, _span(MAX_LIST_DAYS, "workouts", max_span), "workout list")
    items = workout_items(_intervals(workouts_df, start, end))
    return paging.page(items, "start_time", "id", limit, after)


def sleep_intervals(
    sleep_df, start, end, *, limit=paging.DEFAULT_PAGE, after=None, max_span=DEFAULT
) -> DataFrame:
    start, end = time_range(start, end)
    span_at_most(start, end, _span(MAX_LIST_DAYS, "sleep", max_span), "sleep list")
    items = sleep_items(_intervals(sleep_df, start, end))
    return paging.page(items, "start_time", "id", limit, after)


def weight_measurements(
    weight_df, start, end, *, limit=paging.DEFAULT_PAGE, after=None, max_span=DEFAULT
) -> DataFrame:
    start, end = time_range(start, end)
    span_at_most(start, end, _span(MAX_LIST_DAYS, "weight", max_span), "weight list")
    items = weight_items(_points(weight_df, "measured_at", start, end))
    return paging.page(items, "measured_at", "id", limit, after)


# --- lookups at anchors --------------------------------------------------------
def last_logged_meal(
    meals_df: DataFrame, anchors: DataFrame, lookback_days: int = MEAL_LOOKBACK_DAYS
) -> DataFrame:
    """Latest meal at or before each anchor (``subject_id, anchor``) and minutes since."""
    positive_lookback(lookback_days, MEAL_LOOKBACK_DAYS, "lookback_days")
    found = asof_join(
        anchors,
        meal_items(live(meals_df)),
        anchor_time="anchor",
        event_time="meal_completed_at",
        event_id="id",
        columns=["foods", "source"],
        lookback_us=lookback_days * US_PER_DAY,
        name="meal",
    )
    return found.withColumn("minutes_since_last_logged_meal", minutes_since("anchor", "meal"))


def minutes_since(anchor: str, event: str) -> Column:
    elapsed = (epoch_us(anchor) - F.col(f"{event}.us")) / F.lit(float(US_PER_MINUTE))
    return F.round(elapsed, 1)


def last_logged_meal_at(
    meals_df: DataFrame, anchor: datetime, lookback_days: int = MEAL_LOOKBACK_DAYS
) -> DataFrame:
    """The same for one instant, for every subject that has a meal: a plain aggregate."""
    positive_lookback(lookback_days, MEAL_LOOKBACK_DAYS, "lookback_days")
    low = ts_lit(anchor - timedelta(days=lookback_days))
    rows = meal_items(live(meals_df)).filter(in_closed("meal_completed_at", low, ts_lit(anchor)))
    return latest_at(rows, "meal_completed_at", "id", ["foods", "source"], "meal").select(
        "subject_id",
        "meal",
        duration_minutes(F.col("meal.meal_completed_at"), ts_lit(anchor)).alias(
            "minutes_since_last_logged_meal"
        ),
    )


def context_snapshot(
    tables: SubjectTables,
    anchors: DataFrame,
    *,
    meal_lookback_days: int = MEAL_LOOKBACK_DAYS,
    sleep_lookback_hours: int = SLEEP_LOOKBACK_HOURS,
    glucose_lookback_hours: int = GLUCOSE_LOOKBACK_HOURS,
) -> DataFrame:
    """What is known at each anchor (``subject_id, anchor``), and what is missing.

    The three lookups are one as-of scan; sleep and glucose are range joins followed by
    aggregates. Parts are put together on the anchor key, which is unique per part.
    """
    positive_lookback(meal_lookback_days, MEAL_LOOKBACK_DAYS, "meal_lookback_days")
    positive_lookback(sleep_lookback_hours, MAX_SLEEP_LOOKBACK_HOURS, "sleep_lookback_hours")
    positive_lookback(
        glucose_lookback_hours, MAX_GLUCOSE_LOOKBACK_HOURS, "glucose_lookback_hours"
    )
    key = ["subject_id", "anchor"]
    distinct_anchors = anchors.select(*key).distinct()
    lookups = asof_lookups(
        distinct_anchors,
        [
            Lookup(
                meal_items(live(tables.meals)),
                "meal_completed_at",
                "id",
                ["foods", "source"],
                meal_lookback_days * US_PER_DAY,
                "last_logged_meal",
            ),
            Lookup(
                workout_items(live(tables.workouts)),
                "end_time",
                "id",
                ["start_time", "end_time", "sport", "distance_meters", "duration_minutes", "source"],
                WORKOUT_LOOKBACK_DAYS * US_PER_DAY,
                "most_recent_workout",
            ),
            Lookup(
                weight_items(live(tables.weight)),
                "measured_at",
                "id",
                ["value_kg", "source"],
                WEIGHT_LOOKBACK_DAYS * US_PER_DAY,
                "most_recent_weight_measurement",
            ),
        ],
        anchor_time="anchor",
    )
    keyed = distinct_anchors.withColumn("anchor_us", epoch_us("anchor"))
    sleep_us = sleep_lookback_hours * US_PER_HOUR
    sleep_pairs = ranges.interval_overlap(
        keyed,
        live(tables.sleep).select("subject_id", "start_time", "end_time", "source"),
        low=F.col("anchor_us") - F.lit(sleep_us),
        high=F.col("anchor_us"),
        start_us=epoch_us("start_time"),
        end_us=epoch_us("end_time"),
        width_us=sleep_us,
    )
    slept = aggregates.sources_overlapping(sleep_pairs, key, "source", "start_time", "end_time")
    glucose_stats = glucose_before(tables.glucose, keyed, glucose_lookback_hours)

    result = lookups.join(
        slept.withColumnsRenamed(
            {
                "record_count": "sleep_record_count",
                "first_start_time": "sleep_first_start_time",
                "last_end_time": "sleep_last_end_time",
                "sources": "sleep_sources",
            }
        ),
        key,
        "left",
    ).join(glucose_stats, key, "left")
    result = result.withColumns(
        {
            "sleep_record_count": F.coalesce("sleep_record_count", F.lit(0)),
            "sample_count": F.coalesce("sample_count", F.lit(0)),
            "sleep_sources": F.coalesce("sleep_sources", F.array().cast("array<string>")),
            "minutes_since_last_logged_meal": minutes_since("anchor", "last_logged_meal"),
        }
    )
    return result.withColumn("unavailable", _unavailable())


def glucose_before(glucose: DataFrame, keyed: DataFrame, lookback_hours: int) -> DataFrame:
    """Summary of the samples in ``[anchor - lookback, anchor)`` per anchor.

    Buckets of a quarter of the lookback keep the join groups small; the median
    is taken over value counts.
    """
    span = lookback_hours * US_PER_HOUR
    pairs = ranges.point_in_window(
        keyed.select("subject_id", "anchor", "anchor_us"),
        live(glucose).select("subject_id", "sample_time", "value_mg_dl"),
        low=F.col("anchor_us") - F.lit(span),
        high=F.col("anchor_us"),
        us=epoch_us("sample_time"),
        width_us=span // 4,
        closed_high=False,
    )
    key = ["subject_id", "anchor"]
    unit = 1000
    counted = pairs.groupBy(*key, "value_mg_dl").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("sample_time").alias("first_at"),
        F.max("sample_time").alias("last_at"),
    )
    stats = counted.groupBy(*key).agg(
        F.sum("n").alias("sample_count"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.min("value_mg_dl").alias("min_value"),
        F.max("value_mg_dl").alias("max_value"),
        (F.sum(F.col("value_mg_dl") * F.col("n")) / F.sum("n")).alias("mean_value"),
        (
            F.percentile((F.col("value_mg_dl") * unit).cast("bigint"), 0.5, F.col("n"))
            / F.lit(float(unit))
        ).alias("median_value"),
    )
    return _named_stats(stats)


def _unavailable() -> Column:
    def entry(missing: Column, category: str, reason: str) -> Column:
        return F.when(
            missing, F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"))
        )

    # Reasons and categories of what is missing.
    none = "no_record_in_lookback"
    empty = "no_samples_in_window"
    return F.array_compact(
        F.array(
            entry(F.col("last_logged_meal").isNull(), "last_logged_meal", none),
            entry(F.col("most_recent_workout").isNull(), "most_recent_workout", none),
            entry(F.col("sleep_record_count") == 0, "recent_sleep_intervals", none),
            entry(
                F.col("most_recent_weight_measurement").isNull(),
                "most_recent_weight_measurement",
                none,
            ),
            entry(F.col("sample_count") == 0, "glucose_coverage", empty),
            entry(F.col("sample_count") == 0, "glucose_summary", empty),
        )
    )


# --- timeline ------------------------------------------------------------------
def personal_timeline(
    tables: SubjectTables,
    start: datetime,
    end: datetime,
    *,
    max_span=DEFAULT,
    max_events: int | None = MAX_TIMELINE_EVENTS,
    max_points: int | None = MAX_POINTS,
) -> dict[str, DataFrame]:
    """Four event lists, the 15-minute series and the coverage of one window."""
    start, end = time_range(start, end)
    limit = timedelta(hours=MAX_TIMELINE_HOURS) if max_span is DEFAULT else max_span
    span_at_most(start, end, limit, "timeline")
    lists = {
        "meals": meal_items(_points(tables.meals, "meal_completed_at", start, end)),
        "workouts": workout_items(_intervals(tables.workouts, start, end)),
        "sleep_intervals": sleep_items(_intervals(tables.sleep, start, end)),
        "weight_measurements": weight_items(_points(tables.weight, "measured_at", start, end)),
    }
    checked = {
        name: paging.enforce_cap(df, max_events, f"timeline {name}") for name, df in lists.items()
    }
    return {
        **checked,
        "glucose": glucose_series(
            tables.glucose, start, end, "15m", max_span=None, max_points=max_points
        ),
        "coverage": coverage(tables, start, end),
    }


def timeline_events(parts: dict[str, DataFrame]) -> DataFrame:
    """The four lists as one event table; columns a type lacks are null."""
    meals_df = parts["meals"].withColumns(
        {"event_type": F.lit("meal"), "at": F.col("meal_completed_at")}
    ).drop("meal_completed_at")
    workouts_df = parts["workouts"].withColumns(
        {"event_type": F.lit("workout"), "at": F.col("start_time")}
    )
    sleep_df = parts["sleep_intervals"].withColumns(
        {"event_type": F.lit("sleep_interval"), "at": F.col("start_time")}
    )
    weight_df = parts["weight_measurements"].withColumns(
        {"event_type": F.lit("weight"), "at": F.col("measured_at")}
    ).drop("measured_at")
    out = meals_df
    for df in (workouts_df, sleep_df, weight_df):
        out = out.unionByName(df, allowMissingColumns=True)
    return out
