"""Q1-Q12 and the paging and cap operators."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from subjectseries_queries.base import END, START, ZONE, query, us
from subjectseries.operators import aggregates, paging
from subjectseries.plans import queries as Q

ANCHOR = datetime(2024, 1, 20, 12, tzinfo=timezone.utc)
SQL_ANCHOR = "epoch_us(TIMESTAMP '2024-01-20 12:00:00')"
DAY = 86_400_000_000
HOUR = 3_600_000_000

MEDIAN = "quantile_cont(CAST(v * 1000 AS BIGINT)::DOUBLE, 0.5) / 1000"


def r1(value: str) -> str:
    """SQL: a decimal with three places, rounded to one in integers (halves up)."""
    return f"((CAST({value} * 1000 AS BIGINT) + 50) // 100) / 10.0"


def r1_minutes(us_expr: str) -> str:
    return f"(({us_expr} + 3000000) // 6000000) / 10.0"


def r1_mean(value: str, n: str) -> str:
    return f"((CAST(sum({value}) * 1000 AS BIGINT) * 2 + {n} * 100) // nullif({n} * 200, 0)) / 10.0"


def r1_median(value: str) -> str:
    halves = f"CAST(quantile_cont(CAST({value} * 1000 AS BIGINT)::DOUBLE, 0.5) * 2 AS BIGINT)"
    return f"(({halves} + 100) // 200) / 10.0"


STATS = f"""count(*) AS sample_count, min(us) AS first_at, max(us) AS last_at,
  {r1('min(v)')} AS min_mg_dl, {r1('max(v)')} AS max_mg_dl,
  {r1_mean('v', 'count(*)')} AS mean_mg_dl, {r1_median('v')} AS median_mg_dl"""


COVERAGE_SQL = """WITH hits AS (
  SELECT subject_id, 'glucose' AS kind, us AS tm FROM glucose, bounds WHERE us >= lo AND us < hi
  UNION ALL SELECT subject_id, 'meals', us FROM meals, bounds WHERE us >= lo AND us < hi
  UNION ALL SELECT subject_id, 'workouts', s FROM workouts, bounds WHERE s < hi AND e > lo
  UNION ALL SELECT subject_id, 'sleep_intervals', s FROM sleep, bounds WHERE s < hi AND e > lo
  UNION ALL SELECT subject_id, 'weight_measurements', us FROM weight, bounds WHERE us >= lo AND us < hi),
spine AS (SELECT subject_id, kind FROM (SELECT DISTINCT subject_id FROM hits),
  (SELECT unnest(['glucose','meals','workouts','sleep_intervals','weight_measurements']) AS kind))
SELECT subject_id, kind, count(tm) AS count, min(tm) AS first_at, max(tm) AS last_at
FROM spine LEFT JOIN hits USING (subject_id, kind) GROUP BY ALL"""


@query("q1_coverage", COVERAGE_SQL)
def coverage(t):
    return Q.coverage(t.stored, START, END).select(
        "subject_id", "kind", "count", us("first_at"), us("last_at")
    )


def _with_silent(t):
    """All subjects, and one without any row."""
    silent = t.stored.glucose.sparkSession.createDataFrame([("silent",)], "subject_id string")
    return t.stored.glucose.select("subject_id").distinct().unionByName(silent)


@query(
    "q1_coverage_silent_subjects",
    COVERAGE_SQL.replace(
        "(SELECT DISTINCT subject_id FROM hits)",
        "(SELECT DISTINCT subject_id FROM glucose UNION ALL SELECT 'silent')",
    ),
)
def coverage_silent(t):
    return Q.coverage(t.stored, START, END, _with_silent(t)).select(
        "subject_id", "kind", "count", us("first_at"), us("last_at")
    )


@query(
    "q2_glucose_series_raw",
    f"""SELECT subject_id, us AS timestamp, {r1('v')} AS value_mg_dl
FROM glucose, bounds WHERE us >= lo AND us < hi""",
)
def series_raw(t):
    out = Q.glucose_series(t.stored.glucose, START, END, "raw", max_span=None, max_points=None)
    return out.select("subject_id", us("timestamp"), "value_mg_dl")


def _series_sql(seconds: int) -> str:
    width = seconds * 1_000_000
    return f"""WITH b AS (
  SELECT subject_id, us - us % {width} AS start, count(*) AS sample_count,
    {r1_mean('v', 'count(*)')} AS mean_mg_dl,
    {r1('min(v)')} AS min_mg_dl, {r1('max(v)')} AS max_mg_dl,
    max(us) AS fresh
  FROM glucose, bounds WHERE us >= lo AND us < hi GROUP BY 1, 2)
SELECT subject_id, start, start + {width} AS "end", mean_mg_dl, min_mg_dl, max_mg_dl, sample_count,
  CAST(sum(sample_count) OVER (PARTITION BY subject_id) AS BIGINT) AS source_record_count,
  max(fresh) OVER (PARTITION BY subject_id) AS data_fresh_through FROM b"""


def _series(resolution: str):
    def run(t):
        out = Q.glucose_series(t.stored.glucose, START, END, resolution, max_span=None)
        return out.withColumns(
            {c: F.unix_micros(c) for c in ("start", "end", "data_fresh_through")}
        )

    return run


for _name, _seconds in (("5m", 300), ("15m", 900), ("hourly", 3600)):
    query(f"q3_glucose_series_{_name}", _series_sql(_seconds))(_series(_name))


@query(
    "q4_glucose_summary_overall",
    f"SELECT subject_id, {STATS} FROM glucose, bounds WHERE us >= lo AND us < hi GROUP BY 1",
)
def summary_overall(t):
    out = Q.glucose_summary(t.stored.glucose, START, END)
    return out.withColumns({c: F.unix_micros(c) for c in ("first_at", "last_at")})


@query(
    "q4_glucose_summary_silent_subjects",
    f"""WITH stats AS (SELECT subject_id, {STATS} FROM glucose, bounds WHERE us >= lo AND us < hi GROUP BY 1)
SELECT subject_id, coalesce(sample_count, 0) AS sample_count, first_at, last_at,
  min_mg_dl, max_mg_dl, mean_mg_dl, median_mg_dl
FROM (SELECT DISTINCT subject_id FROM glucose UNION ALL SELECT 'silent') LEFT JOIN stats USING (subject_id)""",
)
def summary_silent(t):
    out = Q.glucose_summary(t.stored.glucose, START, END, subjects=_with_silent(t))
    return out.withColumns({c: F.unix_micros(c) for c in ("first_at", "last_at")})


@query(
    "q5_glucose_summary_daily",
    f"""SELECT subject_id, day AS local_date, {STATS}
FROM glucose, bounds WHERE us >= lo AND us < hi GROUP BY 1, 2""",
)
def summary_daily(t):
    out = Q.glucose_summary(t.stored.glucose, START, END, "daily", ZONE)
    return out.withColumns({c: F.unix_micros(c) for c in ("first_at", "last_at")})


def _page_sql(table: str, columns: str, where: str, limit: int, time: str = "us") -> str:
    return f"""WITH r AS (
  SELECT subject_id, id, {columns}, row_number() OVER (PARTITION BY subject_id ORDER BY {time}, id) AS rn,
    count(*) OVER (PARTITION BY subject_id) AS total
  FROM {table}, bounds WHERE {where})
SELECT * EXCLUDE (rn, total), total > {limit} AS truncated FROM r WHERE rn <= {limit}"""


POINT_WHERE = "us >= lo AND us < hi"
SPAN_WHERE = "s < hi AND e > lo"
MINUTES = r1_minutes("(e - s)") + " AS duration_minutes"


@query(
    "q6_meals_page",
    _page_sql("meals", "us AS meal_completed_at, event_type AS foods, src AS source", POINT_WHERE, 5),
)
def meals_page(t):
    out = Q.meals(t.stored.meals, START, END, limit=5)
    return out.withColumns(
        {"meal_completed_at": F.unix_micros("meal_completed_at"), "foods": F.array_join("foods", ",")}
    )


@query(
    "q7_workouts_page",
    _page_sql(
        "workouts",
        f"s AS start_time, e AS end_time, 'running' AS sport, CAST(v AS DOUBLE) AS distance_meters, {MINUTES}, src AS source",
        SPAN_WHERE,
        5,
        "s",
    ),
)
def workouts_page(t):
    out = Q.workouts(t.stored.workouts, START, END, limit=5)
    return out.withColumns(
        {
            "start_time": F.unix_micros("start_time"),
            "end_time": F.unix_micros("end_time"),
            "distance_meters": F.col("distance_meters").cast("double"),
        }
    )


@query(
    "q8_sleep_page",
    _page_sql(
        "sleep", f"s AS start_time, e AS end_time, {MINUTES}, 'core' AS stage, src AS source", SPAN_WHERE, 5, "s"
    ),
)
def sleep_page(t):
    out = Q.sleep_intervals(t.stored.sleep, START, END, limit=5)
    return out.withColumns(
        {"start_time": F.unix_micros("start_time"), "end_time": F.unix_micros("end_time")}
    )


@query(
    "q9_weight_page",
    _page_sql("weight", "us AS measured_at, CAST(v AS DOUBLE) AS value_kg, src AS source", POINT_WHERE, 5),
)
def weight_page(t):
    out = Q.weight_measurements(t.stored.weight, START, END, limit=5)
    return out.withColumns(
        {"measured_at": F.unix_micros("measured_at"), "value_kg": F.col("value_kg").cast("double")}
    )


def _asof_sql(table: str, time: str, days: int, prefix: str) -> str:
    return f"""SELECT a.subject_id, a.anchor, max_by(m.id, (m.{time}, m.id)) AS {prefix}_id,
  max(m.{time}) AS {prefix}_at
FROM anchors a LEFT JOIN {table} m ON m.subject_id = a.subject_id
  AND m.{time} <= a.anchor AND m.{time} >= a.anchor - {days * DAY}
GROUP BY 1, 2"""


@query(
    "q10_last_logged_meal",
    f"""WITH f AS ({_asof_sql('meals', 'us', 7, 'meal')})
SELECT *, {r1_minutes('(anchor - meal_at)')} AS minutes_since FROM f""",
)
def last_meal(t):
    out = Q.last_logged_meal(t.stored.meals, t.anchors, lookback_days=7)
    return out.select(
        "subject_id",
        us("anchor"),
        F.col("meal.id").alias("meal_id"),
        F.col("meal.us").alias("meal_at"),
        F.col("minutes_since_last_logged_meal").alias("minutes_since"),
    )


@query(
    "q10_last_logged_meal_single_anchor",
    f"""SELECT subject_id, max_by(id, (us, id)) AS meal_id, max(us) AS meal_at,
  {r1_minutes(f'({SQL_ANCHOR} - max(us))')} AS minutes_since
FROM meals WHERE us <= {SQL_ANCHOR} AND us >= {SQL_ANCHOR} - {30 * DAY} GROUP BY 1""",
)
def last_meal_single(t):
    out = Q.last_logged_meal_at(t.stored.meals, ANCHOR)
    return out.select(
        "subject_id",
        F.col("meal.id").alias("meal_id"),
        us(F.col("meal.meal_completed_at"), "meal_at"),
        F.col("minutes_since_last_logged_meal").alias("minutes_since"),
    )


@query(
    "q11_context_snapshot",
    f"""WITH m AS ({_asof_sql('meals', 'us', 30, 'meal')}),
w AS ({_asof_sql('workouts', 'e', 14, 'workout')}),
k AS ({_asof_sql('weight', 'us', 30, 'weight')}),
z AS (SELECT a.subject_id, a.anchor, count(x.id) AS sleep_count, min(x.s) AS sleep_first, max(x.e) AS sleep_last,
    coalesce(array_to_string(list_sort(list(DISTINCT x.src) FILTER (x.src IS NOT NULL)), ','), '') AS sleep_sources
  FROM anchors a LEFT JOIN sleep x ON x.subject_id = a.subject_id AND x.s < a.anchor AND x.e > a.anchor - {24 * HOUR}
  GROUP BY 1, 2),
g AS (SELECT a.subject_id, a.anchor, count(x.us) AS sample_count, min(x.us) AS first_at, max(x.us) AS last_at,
    {r1('min(x.v)')} AS min_mg_dl, {r1('max(x.v)')} AS max_mg_dl,
    {r1_mean('x.v', 'count(x.us)')} AS mean_mg_dl, {r1_median('x.v')} AS median_mg_dl
  FROM anchors a LEFT JOIN glucose x ON x.subject_id = a.subject_id AND x.us >= a.anchor - {24 * HOUR} AND x.us < a.anchor
  GROUP BY 1, 2)
SELECT *, {r1_minutes('(anchor - meal_at)')} AS minutes_since,
  concat_ws(',', CASE WHEN meal_id IS NULL THEN 'last_logged_meal' END,
    CASE WHEN workout_id IS NULL THEN 'most_recent_workout' END,
    CASE WHEN sleep_count = 0 THEN 'recent_sleep_intervals' END,
    CASE WHEN weight_id IS NULL THEN 'most_recent_weight_measurement' END,
    CASE WHEN sample_count = 0 THEN 'glucose_coverage' END,
    CASE WHEN sample_count = 0 THEN 'glucose_summary' END) AS unavailable
FROM m JOIN w USING (subject_id, anchor) JOIN k USING (subject_id, anchor)
  JOIN z USING (subject_id, anchor) JOIN g USING (subject_id, anchor)""",
)
def context_snapshot(t):
    out = Q.context_snapshot(t.stored, t.anchors)
    return out.select(
        "subject_id",
        us("anchor"),
        F.col("last_logged_meal.id").alias("meal_id"),
        F.col("last_logged_meal.us").alias("meal_at"),
        F.col("most_recent_workout.id").alias("workout_id"),
        F.col("most_recent_workout.us").alias("workout_at"),
        F.col("most_recent_weight_measurement.id").alias("weight_id"),
        F.col("most_recent_weight_measurement.us").alias("weight_at"),
        F.col("sleep_record_count").alias("sleep_count"),
        us("sleep_first_start_time", "sleep_first"),
        us("sleep_last_end_time", "sleep_last"),
        F.array_join("sleep_sources", ",").alias("sleep_sources"),
        "sample_count",
        us("first_at"),
        us("last_at"),
        "min_mg_dl",
        "max_mg_dl",
        "mean_mg_dl",
        "median_mg_dl",
        F.col("minutes_since_last_logged_meal").alias("minutes_since"),
        F.array_join(F.transform("unavailable", lambda u: u["category"]), ",").alias("unavailable"),
    )


@query(
    "q12_personal_timeline",
    f"""SELECT subject_id, 'meal' AS event_type, id, us AS at, NULL AS until, NULL AS minutes
FROM meals, bounds WHERE us >= lo AND us < hi
UNION ALL SELECT subject_id, 'workout', id, s, e, {r1_minutes('(e - s)')} FROM workouts, bounds WHERE s < hi AND e > lo
UNION ALL SELECT subject_id, 'sleep_interval', id, s, e, {r1_minutes('(e - s)')} FROM sleep, bounds WHERE s < hi AND e > lo
UNION ALL SELECT subject_id, 'weight', id, us, NULL, NULL FROM weight, bounds WHERE us >= lo AND us < hi""",
)
def timeline(t):
    parts = Q.personal_timeline(
        t.stored, START, END, max_span=None, max_events=None, max_points=None
    )
    return Q.timeline_events(parts).select(
        "subject_id",
        "event_type",
        "id",
        us("at"),
        us("end_time", "until"),
        F.col("duration_minutes").alias("minutes"),
    )


# --- paging -------------------------------------------------------------------
CURSOR = datetime(2024, 1, 10, tzinfo=timezone.utc)
SQL_CURSOR = "epoch_us(TIMESTAMP '2024-01-10 00:00:00')"


@query(
    "f8_keyset_after",
    f"SELECT subject_id, id, us FROM glucose WHERE us > {SQL_CURSOR} OR (us = {SQL_CURSOR} AND id > '5')",
)
def keyset_after(t):
    from subjectseries.functions.predicates import after_key, ts_lit

    rows = t.stored.glucose.filter(
        after_key("sample_time", "source_sample_id", ts_lit(CURSOR), F.lit("5"))
    )
    return rows.select(
        "subject_id", F.col("source_sample_id").alias("id"), us("sample_time", "us")
    )


@query("f9_public_projection", "SELECT subject_id, id, us AS at, 'purchase' AS foods, src AS source FROM meals")
def projection(t):
    items = Q.meal_items(t.stored.meals)
    return items.select(
        "subject_id",
        "id",
        us("meal_completed_at", "at"),
        F.array_join("foods", ",").alias("foods"),
        "source",
    )


@query("t1_list_order", "SELECT subject_id, id, us FROM meals ORDER BY us, id")
def list_order(t):
    items = paging.list_order(Q.meal_items(t.stored.meals), "meal_completed_at", "id")
    return items.select("subject_id", "id", us("meal_completed_at", "us"))


@query(
    "t2_keyset_page_continuation",
    f"""WITH r AS (
  SELECT subject_id, id, us, row_number() OVER (PARTITION BY subject_id ORDER BY us, id) AS rn,
    count(*) OVER (PARTITION BY subject_id) AS total
  FROM glucose WHERE us > {SQL_CURSOR} OR (us = {SQL_CURSOR} AND id > '5'))
SELECT subject_id, id, us FROM r WHERE rn = 10 AND total > 10""",
)
def page_continuation(t):
    rows = t.stored.glucose.select(
        "subject_id", F.col("source_sample_id").alias("id"), F.col("sample_time").alias("at")
    )
    page = paging.page(rows, "at", "id", 10, after=(CURSOR, "5"))
    return paging.continuation(page, "at", "id").select("subject_id", "id", us("at", "us"))


@query(
    "t3_top1_at_anchor",
    f"""SELECT subject_id, arg_max(id, (us, id)) AS id, max(us) AS us FROM weight
WHERE us BETWEEN {SQL_ANCHOR} - {30 * DAY} AND {SQL_ANCHOR} GROUP BY 1""",
)
def top1(t):
    from datetime import timedelta

    from subjectseries.functions.predicates import in_closed, ts_lit
    from subjectseries.operators.asof import latest_at

    low, high = ts_lit(ANCHOR - timedelta(days=30)), ts_lit(ANCHOR)
    rows = t.stored.weight.filter(in_closed("measured_at", low, high))
    return latest_at(rows, "measured_at", "source_sample_id", [], "k").select(
        "subject_id", F.col("k.source_sample_id").alias("id"), us(F.col("k.measured_at"), "us")
    )


@query(
    "t4_cap_check",
    "SELECT subject_id, count(*) AS n, count(*) > 50 AS over_cap FROM glucose GROUP BY 1",
)
def cap_check(t):
    """Rows pass an ample cap uncut; ``over_cap`` tells whom a cap of 50 would fail."""
    rows = paging.enforce_cap(t.stored.glucose, 1_000_000_000, "glucose")
    counts = rows.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("over_cap", F.col("n") > 50)


# --- aggregates ----------------------------------------------------------------
@query("a1_category_extent", "SELECT subject_id, 'meals' AS kind, count(*) AS count, min(us) AS first_at, max(us) AS last_at FROM meals GROUP BY 1")
def category_extent(t):
    out = aggregates.extent(t.stored.meals, "meals", "meal_completed_at")
    return out.select("subject_id", "kind", "count", us("first_at"), us("last_at"))


@query(
    "a2_rollup_15m",
    """SELECT subject_id, us - us % 900000000 AS bucket_start, count(*) AS n, CAST(min(v) AS DOUBLE) AS lo,
  CAST(max(v) AS DOUBLE) AS hi, CAST(sum(v) * 1000 AS BIGINT) / (count(*) * 1000) AS mean FROM glucose GROUP BY 1, 2""",
)
def rollup_15m(t):
    out = aggregates.rollup(t.stored.glucose, "sample_time", "value_mg_dl", "15m")
    return out.select(
        "subject_id",
        us("bucket_start"),
        F.col("sample_count").alias("n"),
        F.col("min_value").cast("double").alias("lo"),
        F.col("max_value").cast("double").alias("hi"),
        F.col("mean_value").cast("double").alias("mean"),
    )


@query(
    "a3_overall_stats",
    f"""SELECT subject_id, count(*) AS n, CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi,
  CAST(sum(v) * 1000 AS BIGINT) / (count(*) * 1000) AS mean, {MEDIAN} AS median FROM glucose GROUP BY 1""",
)
def overall_stats(t):
    out = aggregates.summary(t.stored.glucose, ["subject_id"], "sample_time", "value_mg_dl")
    return _stats_columns(out, ["subject_id"])


@query(
    "a4_daily_stats",
    f"""SELECT subject_id, day AS local_date, count(*) AS n, CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi,
  CAST(sum(v) * 1000 AS BIGINT) / (count(*) * 1000) AS mean, {MEDIAN} AS median FROM glucose GROUP BY 1, 2""",
)
def daily_stats(t):
    out = aggregates.daily_summary(t.stored.glucose, "sample_time", "value_mg_dl", ZONE)
    return _stats_columns(out, ["subject_id", "local_date"])


def _stats_columns(out, keys):
    return out.select(
        *keys,
        F.col("sample_count").alias("n"),
        F.col("min_value").cast("double").alias("lo"),
        F.col("max_value").cast("double").alias("hi"),
        F.col("mean_value").cast("double").alias("mean"),
        F.col("median_value").alias("median"),
    )


@query(
    "a5_sleep_sources",
    """SELECT subject_id, count(*) AS record_count, min(s) AS first_start, max(e) AS last_end,
  array_to_string(list_sort(list(DISTINCT src)), ',') AS sources
FROM sleep, bounds WHERE s < hi AND e > lo GROUP BY 1""",
)
def sleep_sources(t):
    from subjectseries.functions.predicates import overlaps, ts_lit

    rows = t.stored.sleep.filter(overlaps("start_time", "end_time", ts_lit(START), ts_lit(END)))
    out = aggregates.sources_overlapping(rows, ["subject_id"], "source", "start_time", "end_time")
    return out.select(
        "subject_id",
        "record_count",
        us("first_start_time", "first_start"),
        us("last_end_time", "last_end"),
        F.array_join("sources", ",").alias("sources"),
    )


@query("a11_freshness", "SELECT subject_id, max(e) AS data_fresh_through FROM workouts GROUP BY 1")
def freshness(t):
    out = aggregates.freshness(t.stored.workouts, "end_time")
    return out.select("subject_id", us("data_fresh_through"))


@query(
    "w1_bucket_totals",
    """WITH b AS (SELECT subject_id, us - us % 3600000000 AS bucket_start, count(*) AS n, max(us) AS fresh FROM glucose GROUP BY 1, 2)
SELECT subject_id, bucket_start, n, CAST(sum(n) OVER (PARTITION BY subject_id) AS BIGINT) AS total,
  max(fresh) OVER (PARTITION BY subject_id) AS fresh FROM b""",
)
def bucket_totals(t):
    out = aggregates.with_totals(
        aggregates.rollup(t.stored.glucose, "sample_time", "value_mg_dl", "hourly")
    )
    return out.select(
        "subject_id",
        us("bucket_start"),
        F.col("sample_count").alias("n"),
        F.col("source_record_count").alias("total"),
        us("data_fresh_through", "fresh"),
    )


@query(
    "u1_union_all_extents",
    """SELECT 'meals' AS kind, count(*) AS count, min(us) AS first_at, max(us) AS last_at FROM meals
UNION ALL SELECT 'weight', count(*), min(us), max(us) FROM weight
UNION ALL SELECT 'workouts', count(*), min(s), max(s) FROM workouts""",
)
def union_extents(t):
    s = t.stored
    out = (
        aggregates.extent(s.meals, "meals", "meal_completed_at", ())
        .unionByName(aggregates.extent(s.weight, "weight", "measured_at", ()))
        .unionByName(aggregates.extent(s.workouts, "workouts", "start_time", ()))
    )
    return out.select("kind", "count", us("first_at"), us("last_at"))
