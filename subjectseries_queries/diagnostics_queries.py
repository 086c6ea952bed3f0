"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from subjectseries_queries.base import DIAGNOSTICS, END, SQL_END, SQL_START, START, ZONE, query, us
from subjectseries.plans import diagnostics as D

MINUTE = 60_000_000
WARNING, MAJOR = 240 * MINUTE, 720 * MINUTE
GAPS_SQL = """gaps AS (SELECT subject_id, prev_us, us, us - prev_us AS gap FROM (
  SELECT subject_id, us, lag(us) OVER (PARTITION BY subject_id ORDER BY us) AS prev_us FROM {source}) WHERE prev_us IS NOT NULL)"""
DOUBLED = "dbl AS (SELECT subject_id, us, value FROM glucose UNION ALL SELECT subject_id, us, value FROM glucose WHERE event_type = 'error')"


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    "d1_point_structure",
    """SELECT subject_id, 'meals' AS category, count(*) AS row_count, min(us) AS earliest, max(us) AS latest,
  count(*) FILTER (us >= lo AND us < hi) AS in_window, count(*) FILTER (NOT (us >= lo AND us < hi)) AS out_of_window,
  count(*) - count(DISTINCT id) AS duplicates FROM meals, bounds GROUP BY 1""",
)
def point_structure(t):
    out = D.point_structure(t.snap["meals"], "meals", START, END)
    return out.withColumns({c: F.unix_micros(c) for c in ("earliest", "latest")})


@query(
    "d1_glucose_structure_with_repeats",
    f"""WITH {DOUBLED} SELECT subject_id, 'glucose' AS category, count(*) AS row_count, min(us) AS earliest, max(us) AS latest,
  count(*) FILTER (us >= lo AND us < hi) AS in_window, count(*) FILTER (NOT (us >= lo AND us < hi)) AS out_of_window,
  count(*) - count(DISTINCT us) AS duplicates FROM dbl, bounds GROUP BY 1""",
)
def glucose_structure(t):
    rows = t.snap["glucose"]
    twice = rows.unionByName(
        t.events.filter(F.col("event_type") == "error").select(
            "subject_id",
            F.col("ts").alias("timestamp"),
            F.col("value").alias("glucose_mg_dl"),
            F.col("event_id").alias("seq"),
        )
    )
    out = D.point_structure(twice, "glucose", START, END)
    return out.withColumns({c: F.unix_micros(c) for c in ("earliest", "latest")})


@query(
    "d2_interval_structure",
    """SELECT subject_id, 'workouts' AS category, count(*) AS row_count, min(s) AS earliest, max(e) AS latest,
  count(*) FILTER (s < hi AND e > lo) AS overlapping, count(*) FILTER (NOT (s < hi AND e > lo)) AS non_overlapping,
  count(*) FILTER (s < lo OR e > hi) AS extends_beyond, count(*) - count(DISTINCT id) AS duplicates
FROM workouts, bounds GROUP BY 1""",
)
def interval_structure(t):
    out = D.interval_structure(t.snap["workouts"], "workouts", START, END)
    return out.withColumns({c: F.unix_micros(c) for c in ("earliest", "latest")})


@query(
    "d2_interval_durations",
    """SELECT kind, count(*) AS count, min(len) / 6e7 AS min, round(quantile_cont(len, 0.5) / 6e7, 6) AS p50,
  round(quantile_cont(len, 0.9) / 6e7, 6) AS p90, round(quantile_cont(len, 0.95) / 6e7, 6) AS p95,
  max(len) / 6e7 AS max, round(avg(len) / 6e7, 6) AS mean
FROM (SELECT 'workouts' AS kind, CAST(e - s AS DOUBLE) AS len FROM workouts UNION ALL SELECT 'sleep', CAST(e - s AS DOUBLE) FROM sleep)
GROUP BY 1""",
)
def interval_durations(t):
    rows = (
        t.snap["workouts"].select(F.lit("workouts").alias("kind"), "start", "end")
        .unionByName(t.snap["sleep"].select(F.lit("sleep").alias("kind"), "start", "end"))
    )
    return _rounded(D.interval_durations(rows, ["kind"]), "p50", "p90", "p95", "mean")


@query(
    "d3_sort_status",
    """WITH p AS (SELECT subject_id, (us, value) < lag((us, value)) OVER (PARTITION BY subject_id ORDER BY event_id) AS late FROM glucose)
SELECT subject_id, CASE WHEN coalesce(bool_or(late), false) THEN 'sorted_for_analysis' ELSE 'already_sorted' END AS sort_status
FROM p GROUP BY 1""",
)
def sort_status(t):
    return D.sort_status(t.snap["glucose"], "glucose", "seq")


@query(
    "d3_sort_status_reordered",
    """WITH p AS (SELECT subject_id, (us, id) < lag((us, id)) OVER (PARTITION BY subject_id ORDER BY cents, event_id) AS late FROM meals)
SELECT subject_id, CASE WHEN coalesce(bool_or(late), false) THEN 'sorted_for_analysis' ELSE 'already_sorted' END AS sort_status
FROM p GROUP BY 1""",
)
def sort_status_reordered(t):
    """Meals as if they had arrived by amount: mostly not in canonical order."""
    arrival = F.col("cents") * 1_000_000_000 + F.col("event_id")
    rows = t.events.filter(F.col("event_type") == "purchase").select(
        "subject_id",
        F.col("source_sample_id").alias("meal_id"),
        F.col("ts").alias("timestamp"),
        arrival.alias("arrival"),
    )
    return D.sort_status(rows, "meals", "arrival")


@query(
    "d4_value_summary",
    """SELECT subject_id, min(value) AS min, max(value) AS max, CAST(sum(v) * 1000 AS BIGINT) / (count(*) * 1000) AS mean,
  quantile_cont(CAST(v * 1000 AS BIGINT)::DOUBLE, 0.5) / 1000 AS median FROM glucose GROUP BY 1""",
)
def value_summary(t):
    return D.value_summary(t.snap["glucose"])


SAMPLING_SQL = f"""SELECT c.subject_id, observed_record_count, duplicate_timestamp_count,
  count(*) FILTER (gap > {WARNING} AND gap <= {MAJOR}) AS warning_gap_count, count(*) FILTER (gap > {MAJOR}) AS major_gap_count,
  coalesce(CAST(sum(gap) FILTER (gap > {WARNING} AND gap <= {MAJOR}) AS BIGINT), 0) / 6e7 AS warning_gap_minutes,
  coalesce(CAST(sum(gap) FILTER (gap > {MAJOR}) AS BIGINT), 0) / 6e7 AS major_gap_minutes,
  observed_record_count >= 2 AS interval_distribution_available
FROM c LEFT JOIN gaps USING (subject_id) GROUP BY ALL"""


@query(
    "d5_sampling_summary",
    f"""WITH {DOUBLED}, {GAPS_SQL.format(source='dbl')},
c AS (SELECT subject_id, count(*) AS observed_record_count, count(*) - count(DISTINCT us) AS duplicate_timestamp_count FROM dbl GROUP BY 1)
{SAMPLING_SQL}""",
)
def sampling_summary(t):
    return D.sampling_summary(t.doubled, DIAGNOSTICS)


@query(
    "d5_interval_distribution",
    f"""WITH {DOUBLED}, {GAPS_SQL.format(source='dbl')}
SELECT subject_id, count(*) AS count, min(gap) / 6e7 AS min, round(quantile_cont(CAST(gap AS DOUBLE), 0.5) / 6e7, 3) AS p50,
  round(quantile_cont(CAST(gap AS DOUBLE), 0.9) / 6e7, 3) AS p90, round(quantile_cont(CAST(gap AS DOUBLE), 0.95) / 6e7, 3) AS p95,
  max(gap) / 6e7 AS max FROM gaps GROUP BY 1""",
)
def interval_distribution(t):
    # Three places: at six, microsecond data often lies exactly between two results.
    out = D.interval_distribution(t.doubled)
    return out.withColumns({n: F.round(n, 3) for n in ("p50", "p90", "p95")})


@query(
    "d6_gap_table",
    f"""WITH {GAPS_SQL.format(source='glucose')}
SELECT subject_id, prev_us AS previous_timestamp_utc, us AS next_timestamp_utc, gap / 6e7 AS elapsed_minutes,
  CASE WHEN gap <= {MAJOR} THEN 'warning' ELSE 'major' END AS classification FROM gaps WHERE gap > {WARNING}""",
)
def gap_table(t):
    out = D.gap_table(t.obs, DIAGNOSTICS)
    return out.withColumns(
        {c: F.unix_micros(c) for c in ("previous_timestamp_utc", "next_timestamp_utc")}
    )


LOCAL = "CAST(timezone('{z}', make_timestamp({c}) AT TIME ZONE 'UTC') AS DATE)"


def _day(column: str) -> str:
    return LOCAL.format(z=ZONE, c=column)


WINDOW_DAYS = f"""days AS (SELECT CAST(unnest(generate_series(
    date_trunc('day', timezone('{ZONE}', {SQL_START} AT TIME ZONE 'UTC')),
    date_trunc('day', timezone('{ZONE}', ({SQL_END} - INTERVAL 1 MICROSECOND) AT TIME ZONE 'UTC')), INTERVAL 1 DAY)) AS DATE) AS local_date)"""


def _touch(table: str) -> str:
    return f"""(SELECT subject_id, local_date, count(*) AS n FROM days JOIN {table}
    ON {_day('s')} <= local_date AND {_day('e - 1')} >= local_date GROUP BY 1, 2)"""


def _hits(table: str) -> str:
    return f"(SELECT subject_id, day AS local_date, count(*) AS n FROM {table} GROUP BY 1, 2)"


@query(
    "d7_daily_coverage",
    f"""WITH {WINDOW_DAYS}, subjects AS (SELECT DISTINCT subject_id FROM ev),
g AS {_hits('glucose')}, m AS {_hits('meals')}, k AS {_hits('weight')}, w AS {_touch('workouts')}, z AS {_touch('sleep')},
x AS (SELECT *, CAST((epoch_us(timezone('{ZONE}', CAST(local_date + INTERVAL 1 DAY AS TIMESTAMP)))
  - epoch_us(timezone('{ZONE}', CAST(local_date AS TIMESTAMP)))) // {360 * MINUTE} AS BIGINT) AS expected FROM subjects, days)
SELECT x.subject_id, x.local_date, coalesce(g.n, 0) AS glucose_observed_count, expected AS glucose_expected_count_estimate,
  coalesce(g.n, 0) / CAST(expected AS DOUBLE) AS glucose_coverage_ratio_estimate, coalesce(m.n, 0) AS meal_count,
  coalesce(w.n, 0) AS workout_overlap_count, coalesce(z.n, 0) AS raw_sleep_interval_overlap_count, coalesce(k.n, 0) AS weight_count
FROM x LEFT JOIN g USING (subject_id, local_date) LEFT JOIN m USING (subject_id, local_date) LEFT JOIN k USING (subject_id, local_date)
  LEFT JOIN w USING (subject_id, local_date) LEFT JOIN z USING (subject_id, local_date)""",
)
def daily_coverage(t):
    return D.daily_coverage(t.snap, START, END, DIAGNOSTICS)


def _readiness_sql(source: str = "glucose") -> str:
    tol, history = 240 * MINUTE, 2880 * MINUTE
    return f"""f AS (SELECT subject_id, min(us) AS first_us FROM {source} GROUP BY 1),
h AS (SELECT unnest(CAST([720, 1440] AS BIGINT[])) AS horizon_minutes),
a AS (SELECT subject_id, us, count(*) AS n FROM {source} GROUP BY 1, 2),
r AS (SELECT a.subject_id, a.us AS anchor, a.n, horizon_minutes, a.us + horizon_minutes * {MINUTE} AS ideal, count(b.us) AS candidates,
    arg_min(b.us, (abs(b.us - a.us - horizon_minutes * {MINUTE}), b.us)) AS nearest
  FROM a CROSS JOIN h LEFT JOIN {source} b ON a.subject_id = b.subject_id
    AND b.us BETWEEN a.us + horizon_minutes * {MINUTE} - {tol} AND a.us + horizon_minutes * {MINUTE} + {tol} GROUP BY ALL),
readiness AS (SELECT r.*, CASE WHEN first_us > anchor - {history} THEN 'insufficient_history' WHEN candidates = 0 THEN 'missing_target'
    WHEN candidates = 1 THEN 'eligible_unique' ELSE 'eligible_ambiguous' END AS status FROM r JOIN f USING (subject_id))"""


@query(
    "d8_forecast_readiness",
    f"""WITH {_readiness_sql()} SELECT subject_id, anchor, horizon_minutes, ideal, candidates, nearest,
  (nearest - ideal) / 1e6 AS offset_seconds, status FROM readiness""",
)
def readiness(t):
    out = D.forecast_readiness(t.obs, DIAGNOSTICS)
    return out.select(
        "subject_id",
        us("anchor_timestamp_utc", "anchor"),
        "horizon_minutes",
        us("ideal_target_timestamp_utc", "ideal"),
        F.col("candidate_observation_count").alias("candidates"),
        us("nearest_observation_timestamp_utc", "nearest"),
        F.col("nearest_offset_seconds").alias("offset_seconds"),
        "status",
    )


@query(
    "d8_forecast_readiness_with_repeats",
    f"""WITH {DOUBLED}, {_readiness_sql('dbl')} SELECT subject_id, anchor, n, horizon_minutes, candidates, nearest, status FROM readiness""",
)
def readiness_repeats(t):
    out = D.readiness_by_instant(t.doubled, DIAGNOSTICS)
    return out.select(
        "subject_id",
        F.col("us").alias("anchor"),
        "n",
        "horizon_minutes",
        F.col("candidate_observation_count").alias("candidates"),
        F.col("nearest_us").alias("nearest"),
        "status",
    )


@query(
    "d9_readiness_summary",
    f"""WITH {_readiness_sql()} SELECT subject_id, horizon_minutes, count(*) AS anchor_count,
  count(*) FILTER (status = 'eligible_unique') AS eligible_unique_count, count(*) FILTER (status = 'eligible_ambiguous') AS eligible_ambiguous_count,
  count(*) FILTER (status = 'missing_target') AS missing_target_count, count(*) FILTER (status = 'insufficient_history') AS insufficient_history_count,
  count(*) FILTER (status LIKE 'eligible%') AS eligible_any_count,
  count(*) FILTER (status = 'eligible_unique') / CAST(count(*) AS DOUBLE) AS eligible_unique_rate,
  count(*) FILTER (status LIKE 'eligible%') / CAST(count(*) AS DOUBLE) AS eligible_any_rate
FROM readiness GROUP BY 1, 2""",
)
def readiness_summary(t):
    return D.readiness_summary(D.readiness_by_instant(t.obs, DIAGNOSTICS))


@query(
    "d9_readiness_offsets",
    f"""WITH {_readiness_sql()}, o AS (SELECT horizon_minutes, CAST(nearest - ideal AS DOUBLE) AS d FROM readiness WHERE candidates > 0)
SELECT horizon_minutes, count(*) AS count, min(d) / 1e6 AS min, round(quantile_cont(d, 0.5) / 1e6, 8) AS p50,
  round(quantile_cont(d, 0.9) / 1e6, 8) AS p90, round(quantile_cont(d, 0.95) / 1e6, 8) AS p95, max(d) / 1e6 AS max FROM o GROUP BY 1""",
)
def readiness_offsets(t):
    out = D.readiness_offsets(D.readiness_by_instant(t.obs, DIAGNOSTICS), ())
    return out.withColumns({n: F.round(n, 8) for n in ("p50", "p90", "p95")})


SEGMENTS = f"""s0 AS (SELECT subject_id, us, CASE WHEN us - lag(us) OVER w > {MAJOR} THEN 1 ELSE 0 END AS b
  FROM glucose WINDOW w AS (PARTITION BY subject_id ORDER BY us)),
s1 AS (SELECT *, sum(b) OVER (PARTITION BY subject_id ORDER BY us) AS seg FROM s0),
seg AS (SELECT subject_id, min(us) AS s, max(us) AS e, count(*) AS n FROM s1 GROUP BY subject_id, seg)"""


@query(
    "d10_contiguous_segments",
    f"""WITH {SEGMENTS} SELECT subject_id, s AS start_timestamp_utc, e AS end_timestamp_utc, n AS observation_count,
  (e - s) / 6e7 AS elapsed_minutes FROM seg""",
)
def contiguous_segments(t):
    out = D.contiguous_segments(t.obs, DIAGNOSTICS)
    return out.withColumns(
        {c: F.unix_micros(c) for c in ("start_timestamp_utc", "end_timestamp_utc")}
    )


@query(
    "d11_days_with_major_gaps",
    f"""WITH {GAPS_SQL.format(source='glucose')}, {WINDOW_DAYS},
d AS (SELECT DISTINCT subject_id, local_date FROM gaps JOIN days ON {_day('prev_us')} <= local_date AND {_day('us - 1')} >= local_date
  WHERE gap > {MAJOR})
SELECT subject_id, count(*) AS major_gap_days FROM d GROUP BY 1""",
)
def major_gap_days(t):
    return D.days_with_major_gaps(t.obs, DIAGNOSTICS, START, END)


@query(
    "d12_split_boundaries",
    f"""WITH {SEGMENTS}, tot AS (SELECT subject_id, sum(n) AS n, count(*) AS k, min(s) AS first FROM seg GROUP BY 1)
SELECT subject_id, s AS boundary_utc FROM seg JOIN tot USING (subject_id) WHERE tot.n >= 50 AND k >= 2 AND s > first""",
)
def split_boundaries(t):
    return D.split_boundaries(t.obs, DIAGNOSTICS, min_observations=50).select("subject_id", us("boundary_utc"))


@query(
    "d13_observed_ranges",
    """SELECT subject_id, 'glucose' AS category, min(us) AS earliest, max(us) AS latest FROM glucose GROUP BY 1
UNION ALL SELECT subject_id, 'meals', min(us), max(us) FROM meals GROUP BY 1
UNION ALL SELECT subject_id, 'weight', min(us), max(us) FROM weight GROUP BY 1
UNION ALL SELECT subject_id, 'workouts', min(s), max(e) FROM workouts GROUP BY 1
UNION ALL SELECT subject_id, 'sleep', min(s), max(e) FROM sleep GROUP BY 1""",
)
def observed_ranges(t):
    out = D.observed_ranges(t.snap)
    return out.select("subject_id", "category", us("earliest"), us("latest"))


def _warn(table: str, name: str, spans: bool) -> str:
    if spans:
        extra = f"""UNION ALL SELECT subject_id, '{name}', 'extends_beyond_window', count(*) FROM {table}, bounds WHERE s < lo OR e > hi GROUP BY 1
  UNION ALL SELECT subject_id, '{name}', 'outside_window', count(*) FROM {table}, bounds WHERE NOT (s < hi AND e > lo) GROUP BY 1"""
    else:
        extra = f"UNION ALL SELECT subject_id, '{name}', 'outside_window', count(*) FROM {table}, bounds WHERE NOT (us >= lo AND us < hi) GROUP BY 1"
    return f"""SELECT subject_id, '{name}' AS category, 'zero_rows' AS code, 1 AS n FROM subjects
    WHERE subject_id NOT IN (SELECT subject_id FROM {table}) {extra}"""


@query(
    "d14_warnings",
    f"""WITH subjects AS (SELECT DISTINCT subject_id FROM ev), {GAPS_SQL.format(source='glucose')},
cnt AS (SELECT subject_id, count(*) AS n FROM glucose GROUP BY 1)
{_warn('glucose', 'glucose', False)} UNION ALL {_warn('meals', 'meals', False)} UNION ALL {_warn('weight', 'weight', False)}
UNION ALL {_warn('workouts', 'workouts', True)} UNION ALL {_warn('sleep', 'sleep', True)}
UNION ALL SELECT subject_id, 'glucose', 'warning_gaps', count(*) FROM gaps WHERE gap > {WARNING} AND gap <= {MAJOR} GROUP BY 1
UNION ALL SELECT subject_id, 'glucose', 'major_gaps', count(*) FROM gaps WHERE gap > {MAJOR} GROUP BY 1
UNION ALL SELECT subject_id, 'glucose', 'too_few_observations', 1 FROM cnt WHERE n < 2""",
)
def warnings(t):
    return D.warnings(
        D.structural_summary(t.snap, START, END),
        D.sampling_summary(t.obs, DIAGNOSTICS),
        D.source_order(t.snap["glucose"], "seq"),
        t.events.select("subject_id").distinct(),
    )
