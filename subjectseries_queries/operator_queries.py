"""F, X, A, W, J and U rows: single operators."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from subjectseries_queries.base import DIAGNOSTICS, END, SQL_END, SQL_START, START, ZONE, query, us
from subjectseries.functions import predicates as P
from subjectseries.functions import scalars as X
from subjectseries.operators import aggregates, gaps, ranges
from subjectseries.operators.asof import asof_join
from subjectseries.operators.bands import (
    BandPlan,
    chunked,
    largest_gap,
    unique_in_band,
    with_block_maxima,
)
from subjectseries.operators.chunks import halo_width
from subjectseries.operators.nearest import nearest
from subjectseries.plans import diagnostics as D

DAY = X.US_PER_DAY
HOUR = X.US_PER_HOUR
MINUTE = X.US_PER_MINUTE
ANCHOR = datetime(2024, 1, 20, 12, tzinfo=timezone.utc)
SQL_ANCHOR = "epoch_us(TIMESTAMP '2024-01-20 12:00:00')"


def _window():
    return P.ts_lit(START), P.ts_lit(END)


# --- predicates ------------------------------------------------------------------
@query("f1_half_open_range", "SELECT subject_id, id, us FROM glucose, bounds WHERE us >= lo AND us < hi")
def half_open(t):
    rows = t.stored.glucose.filter(P.in_range("sample_time", *_window()))
    return rows.select("subject_id", F.col("source_sample_id").alias("id"), us("sample_time", "us"))


@query("f2_interval_overlap", "SELECT subject_id, id, s, e FROM sleep, bounds WHERE s < hi AND e > lo")
def overlap(t):
    rows = t.stored.sleep.filter(P.overlaps("start_time", "end_time", *_window()))
    return rows.select(
        "subject_id", F.col("source_sample_id").alias("id"), us("start_time", "s"), us("end_time", "e")
    )


@query(
    "f3_closed_lookback",
    f"SELECT subject_id, id, e FROM workouts WHERE e BETWEEN {SQL_ANCHOR} - {14 * DAY} AND {SQL_ANCHOR}",
)
def lookback(t):
    low = P.ts_lit(ANCHOR - timedelta(days=14))
    rows = t.stored.workouts.filter(P.in_closed("end_time", low, P.ts_lit(ANCHOR)))
    return rows.select("subject_id", F.col("source_sample_id").alias("id"), us("end_time", "e"))


@query(
    "f4_closed_band",
    f"SELECT subject_id, id, us FROM glucose WHERE us BETWEEN {SQL_ANCHOR} - {6 * HOUR} AND {SQL_ANCHOR} + {6 * HOUR}",
)
def band(t):
    at = F.unix_micros("sample_time")
    rows = t.stored.glucose.filter(P.in_band(at, F.unix_micros(P.ts_lit(ANCHOR)), 6 * HOUR))
    return rows.select("subject_id", F.col("source_sample_id").alias("id"), us("sample_time", "us"))


@query("f6_not_inside_bounds", "SELECT subject_id, count(*) FILTER (s < lo OR e > hi) AS n FROM sleep, bounds GROUP BY 1")
def not_inside(t):
    outside = P.not_inside("start_time", "end_time", *_window())
    return t.stored.sleep.groupBy("subject_id").agg(F.count_if(outside).alias("n"))


@query("f7_live_rows", "SELECT subject_id, count(*) AS n FROM glucose WHERE event_type <> 'error' GROUP BY 1")
def live_rows(t):
    marked = t.events.withColumn("deleted_at", F.when(F.col("event_type") == "error", F.col("ts")))
    return P.live(marked).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))


@query("f10_sanity_flag", "SELECT subject_id, id, NOT (value BETWEEN 20 AND 600) AS outside FROM glucose")
def sanity(t):
    return t.events.select(
        "subject_id", F.col("source_sample_id").alias("id"), P.outside_sanity("value").alias("outside")
    )


# --- scalars -----------------------------------------------------------------------
@query(
    "x1_bucket_bounds",
    f"SELECT id, us - us % {5 * MINUTE} AS bucket_start, us - us % {5 * MINUTE} + {5 * MINUTE} AS bucket_end FROM glucose",
)
def bucket_bounds(t):
    start = X.bucket_start_us(F.unix_micros("ts"), 5 * MINUTE)
    return t.events.select(
        F.col("source_sample_id").alias("id"),
        start.alias("bucket_start"),
        (start + 5 * MINUTE).alias("bucket_end"),
    )


@query("x2_local_date", "SELECT id, day FROM glucose")
def local_date(t):
    return t.events.select(
        F.col("source_sample_id").alias("id"), X.local_date("ts", ZONE).alias("day")
    )


# Days of the events moved to each month of 2026, so both DST changes occur.
SHIFTED_DAY = "CAST(DATE '2026-01-01' + INTERVAL 1 DAY * CAST((event_id * 7) % 365 AS INT) AS DATE)"


@query(
    "x3_local_day_bounds",
    f"""WITH d AS (SELECT id, {SHIFTED_DAY} AS day FROM glucose)
SELECT id, day, epoch_us(timezone('{ZONE}', CAST(day AS TIMESTAMP))) AS day_start,
  epoch_us(timezone('{ZONE}', CAST(day + INTERVAL 1 DAY AS TIMESTAMP))) AS day_end FROM d""",
)
def day_bounds(t):
    shifted = F.date_add(F.to_date(F.lit("2026-01-01")), F.pmod(F.col("event_id") * 7, F.lit(365)).cast("int"))
    rows = t.events.select(F.col("source_sample_id").alias("id"), shifted.alias("day"))
    return rows.select(
        "id",
        "day",
        us(X.local_day_start("day", ZONE), "day_start"),
        us(X.local_day_end("day", ZONE), "day_end"),
    )


@query(
    "x4_local_dates_touched",
    f"""SELECT id, CAST(unnest(generate_series(
  date_trunc('day', timezone('{ZONE}', make_timestamp(s) AT TIME ZONE 'UTC')),
  date_trunc('day', timezone('{ZONE}', make_timestamp(e - 1) AT TIME ZONE 'UTC')), INTERVAL 1 DAY)) AS DATE) AS day
FROM sleep""",
)
def dates_touched(t):
    days = X.local_dates_touched("start_time", "end_time", ZONE)
    return t.stored.sleep.select(F.col("source_sample_id").alias("id"), F.explode(days).alias("day"))


@query("x5_duration_minutes", "SELECT id, ((e - s) + 3000000) // 6000000 / 10.0 AS minutes FROM sleep")
def duration(t):
    return t.stored.sleep.select(
        F.col("source_sample_id").alias("id"), X.duration_minutes("start_time", "end_time").alias("minutes")
    )


@query("x6_elapsed_minutes", "SELECT id, (e - s) / 6e7 AS minutes FROM sleep")
def elapsed(t):
    return t.stored.sleep.select(
        F.col("source_sample_id").alias("id"), X.elapsed_minutes("start_time", "end_time").alias("minutes")
    )


@query(
    "x7_overlap_seconds",
    "SELECT id, greatest(0, least(e, hi) - greatest(s, lo)) / 1e6 AS seconds FROM sleep, bounds",
)
def overlap_seconds(t):
    seconds = X.overlap_seconds(
        F.unix_micros("start_time"), F.unix_micros("end_time"), *[F.unix_micros(b) for b in _window()]
    )
    return t.stored.sleep.select(F.col("source_sample_id").alias("id"), seconds.alias("seconds"))


@query("x8_round_one_decimal", "SELECT id, ((CAST(v * 1000 AS BIGINT) + 50) // 100) / 10.0 AS value FROM glucose")
def round_one(t):
    return t.stored.glucose.select(
        F.col("source_sample_id").alias("id"), X.round1("value_mg_dl").alias("value")
    )


@query(
    "x9_gap_class",
    "SELECT id, CASE WHEN value <= 15 THEN 'normal' WHEN value <= 60 THEN 'warning' ELSE 'major' END AS class FROM glucose",
)
def gap_classes(t):
    return t.events.select(
        F.col("source_sample_id").alias("id"), X.gap_class("value", 15, 60).alias("class")
    )


@query(
    "x10_source_type",
    """SELECT id, CASE WHEN event_type = 'purchase' THEN 'manual' WHEN event_type IN ('view', 'click') THEN 'app' END AS kind
FROM glucose""",
)
def source_types(t):
    source = F.when(F.col("event_type") == "purchase", "manual").otherwise("device")
    name = F.when(F.col("event_type") == "view", "Strava").when(F.col("event_type") == "click", "Stelo")
    return t.events.select(
        F.col("source_sample_id").alias("id"), X.source_type(source, name).alias("kind")
    )


@query(
    "x11_canonical_json_sha256",
    """SELECT id, sha256('{"a":{"y":' || id || ',"z":"' || event_type || '"},"b":[1,' || CAST(cents AS VARCHAR) || ']}') AS digest
FROM glucose""",
)
def json_digest(t):
    body = F.concat(
        F.lit('{ "b" : [1, '),
        F.col("cents").cast("string"),
        F.lit('], "a": {"z": "'),
        F.col("event_type"),
        F.lit('", "y": '),
        F.col("source_sample_id"),
        F.lit("}}"),
    )
    rows = t.events.select(F.col("source_sample_id").alias("id"), body.alias("body"))
    return rows.select("id", X.json_sha256("body").alias("digest"))


@query(
    "x12_episode_id",
    """SELECT id, 'ep_' || strftime(ts, '%Y%m%dT%H%M%S%fZ') || '_' || substr(sha256('demo|' || subject_id || '|' ||
  CASE WHEN us % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END), 1, 12) AS episode_id
FROM glucose""",
)
def episode_ids(t):
    return t.events.select(
        F.col("source_sample_id").alias("id"),
        X.episode_id("demo", "subject_id", F.unix_micros("ts")).alias("episode_id"),
    )


@query("x14_offset_seconds", f"SELECT id, (us - {SQL_ANCHOR}) / 1e6 AS seconds FROM glucose")
def offsets(t):
    seconds = X.offset_seconds(F.unix_micros("ts"), F.unix_micros(P.ts_lit(ANCHOR)))
    return t.events.select(F.col("source_sample_id").alias("id"), seconds.alias("seconds"))


@query(
    "x16_expected_samples",
    f"""WITH d AS (SELECT id, {SHIFTED_DAY} AS day FROM glucose)
SELECT id, CAST((epoch_us(timezone('{ZONE}', CAST(day + INTERVAL 1 DAY AS TIMESTAMP)))
  - epoch_us(timezone('{ZONE}', CAST(day AS TIMESTAMP)))) // {5 * MINUTE} AS BIGINT) AS expected FROM d""",
)
def expected(t):
    shifted = F.date_add(F.to_date(F.lit("2026-01-01")), F.pmod(F.col("event_id") * 7, F.lit(365)).cast("int"))
    return t.events.select(
        F.col("source_sample_id").alias("id"), X.expected_samples(shifted, ZONE, 5).alias("expected")
    )


@query(
    "x17_grid_timestamps",
    f"""SELECT id, i AS grid_index, us - {2880 * MINUTE} + i * {720 * MINUTE} AS grid_us
FROM glucose, (SELECT unnest(range(5)) AS i)""",
)
def grid(t):
    stamps = X.grid_us(F.unix_micros("ts") - 2880 * MINUTE, 720 * MINUTE, 5)
    return t.events.select(
        F.col("source_sample_id").alias("id"), F.posexplode(stamps).alias("grid_index", "grid_us")
    )


@query("x18_foods_normalization", "SELECT id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS n FROM glucose")
def foods(t):
    given = F.when(F.col("event_type") == "purchase", F.array("event_type"))
    return t.events.select(
        F.col("source_sample_id").alias("id"), F.size(X.normalized_foods(given)).alias("n")
    )


# --- aggregates ------------------------------------------------------------------------
@query(
    "a6_distribution",
    """SELECT subject_id, count(*) AS count, min(us_len) / 6e7 AS min, round(quantile_cont(us_len, 0.5) / 6e7, 6) AS p50,
  round(quantile_cont(us_len, 0.9) / 6e7, 6) AS p90, round(quantile_cont(us_len, 0.95) / 6e7, 6) AS p95, max(us_len) / 6e7 AS max,
  round(avg(us_len) / 6e7, 6) AS mean
FROM (SELECT subject_id, CAST(e - s AS DOUBLE) AS us_len FROM sleep) GROUP BY 1""",
)
def distributions(t):
    out = D.interval_durations(t.snap["sleep"], ["subject_id"])
    return _rounded(out, ["p50", "p90", "p95", "mean"])


def _rounded(df, names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


@query(
    "a7_duplicate_count",
    "SELECT subject_id, count(*) - count(DISTINCT (event_type, day)) AS duplicates FROM glucose GROUP BY 1",
)
def duplicates(t):
    rows = t.events.withColumn("day", X.local_date("ts", ZONE))
    return aggregates.duplicate_count(rows, ["event_type", "day"], ["subject_id"])


@query(
    "a8_conditional_counts",
    """SELECT subject_id, count(*) FILTER (value <= 15) AS normal, count(*) FILTER (value > 15 AND value <= 60) AS warning,
  CAST(coalesce(sum(v) FILTER (value > 60), 0) AS DOUBLE) AS major_total FROM glucose GROUP BY 1""",
)
def conditional(t):
    kind = X.gap_class("value", 15, 60)
    exact = F.col("value").cast("decimal(10,3)")
    return t.events.groupBy("subject_id").agg(
        F.count_if(kind == "normal").alias("normal"),
        F.count_if(kind == "warning").alias("warning"),
        F.coalesce(F.sum(F.when(kind == "major", exact)).cast("double"), F.lit(0.0)).alias("major_total"),
    )


@query(
    "a9_multi_label_count",
    """SELECT code, count(*) AS n FROM (SELECT DISTINCT id, unnest([event_type, src, event_type]) AS code FROM glucose) GROUP BY 1""",
)
def multi_label(t):
    rows = t.events.withColumn("codes", F.array("event_type", "source", "event_type"))
    return aggregates.code_counts(rows, "codes")


@query(
    "a10_rates",
    """SELECT subject_id, CAST(count(*) FILTER (event_type = 'view' AND value > 250) AS DOUBLE)
  / nullif(count(*) FILTER (event_type = 'view'), 0) AS rate FROM glucose GROUP BY 1""",
)
def rates(t):
    view = F.col("event_type") == "view"
    counted = t.events.groupBy("subject_id").agg(
        F.count_if(view & (F.col("value") > 250)).alias("part"), F.count_if(view).alias("whole")
    )
    return counted.select("subject_id", X.rate("part", "whole").alias("rate"))


# --- windows ------------------------------------------------------------------------------
@query(
    "w2_adjacent_gaps",
    """SELECT * FROM (SELECT subject_id, lag(us) OVER w AS prev_us, us AS next_us, us - lag(us) OVER w AS gap_us
FROM glucose WINDOW w AS (PARTITION BY subject_id ORDER BY us)) WHERE prev_us IS NOT NULL""",
)
def adjacent_gaps(t):
    return gaps.time_gaps(t.obs)


SEGMENT_SQL = """WITH f AS (SELECT subject_id, us, CASE WHEN us - lag(us) OVER w > {limit} THEN 1 ELSE 0 END AS b
  FROM glucose WINDOW w AS (PARTITION BY subject_id ORDER BY us)),
g AS (SELECT *, sum(b) OVER (PARTITION BY subject_id ORDER BY us) AS seg FROM f)
SELECT subject_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM g GROUP BY subject_id, seg"""


@query("w3_segments", SEGMENT_SQL.format(limit=720 * MINUTE))
def segment(t):
    return gaps.segments(t.obs, 720)


@query(
    "w4_out_of_order_pairs",
    """WITH p AS (SELECT subject_id, value, lag(value) OVER (PARTITION BY subject_id ORDER BY event_id) AS prev FROM glucose)
SELECT subject_id, count(*) FILTER (value < prev) AS out_of_order_pairs FROM p GROUP BY 1""",
)
def order_pairs(t):
    """Source order is the event id; the checked key is the value, which is often out of order."""
    return gaps.out_of_order(t.events, "event_id", F.col("value"), rows_per_chunk=1_000)


@query(
    "w5_first_per_subject",
    "SELECT subject_id, us, min(us) OVER (PARTITION BY subject_id) AS first_us FROM glucose",
)
def first_instant(t):
    from subjectseries.operators.chunks import with_chunk

    rows = with_chunk(t.obs)
    return rows.join(D.first_seen(t.obs, DAY), ["subject_id", "chunk"]).select(
        "subject_id", "us", "first_us"
    )


BAND_LOW, BAND_HIGH = 480 * MINUTE, 960 * MINUTE
H = 2880 * MINUTE


def _banded(t, plan: BandPlan, obs=None):
    before, after = H + 240 * MINUTE, 1680 * MINUTE
    rows = chunked(t.obs if obs is None else obs, halo_width(before, after), before, after)
    return plan.apply(rows).filter("owned")


@query(
    "w6_band_counts",
    f"""SELECT a.subject_id, a.us, count(*) FILTER (b.us BETWEEN a.us - {H} AND a.us) AS history,
  count(*) FILTER (b.us BETWEEN a.us + {BAND_LOW} AND a.us + {BAND_HIGH}) AS target
FROM glucose a JOIN glucose b USING (subject_id) GROUP BY 1, 2""",
)
def band_counts(t):
    plan = BandPlan()
    history, target = plan.count(-H, 0), plan.count(BAND_LOW, BAND_HIGH)
    return _banded(t, plan).select("subject_id", "us", history.alias("history"), target.alias("target"))


@query(
    "w7_largest_gap_in_window",
    f"""WITH p AS (SELECT subject_id, us, lag(us) OVER (PARTITION BY subject_id ORDER BY us) AS prev FROM glucose)
SELECT a.subject_id, a.us, max(p.us - p.prev) FILTER (p.us <= a.us AND p.prev >= a.us - {H}) AS max_gap_us
FROM glucose a JOIN p USING (subject_id) GROUP BY 1, 2""",
)
def window_gap(t):
    before = H
    rows = chunked(t.obs, halo_width(before, 0), before, 0)
    return largest_gap(with_block_maxima(rows, H), H).filter("owned").select("subject_id", "us", "max_gap_us")


DOUBLED_SQL = "dbl AS (SELECT subject_id, us FROM glucose UNION ALL SELECT subject_id, us FROM glucose WHERE event_type = 'error')"


@query(
    "w8_repeated_instants_in_window",
    f"""WITH {DOUBLED_SQL}, c AS (SELECT subject_id, us, count(*) AS n FROM dbl GROUP BY 1, 2)
SELECT a.subject_id, a.us, a.n, count(*) FILTER (b.us BETWEEN a.us - {H} AND a.us AND b.n > 1) > 0 AS repeated
FROM c a JOIN c b USING (subject_id) GROUP BY 1, 2, 3""",
)
def repeated_instants(t):
    plan = BandPlan()
    repeated = plan.repeated(-H, 0) > 0
    return _banded(t, plan, t.doubled).select("subject_id", "us", "n", repeated.alias("repeated"))


@query(
    "w9_unique_value_in_band",
    f"""WITH m AS (SELECT a.subject_id, a.us, count(b.us) AS n, min(b.us) AS hit_us, min(b.value) AS hit_value
  FROM glucose a LEFT JOIN glucose b ON a.subject_id = b.subject_id AND b.us BETWEEN a.us + {BAND_LOW} AND a.us + {BAND_HIGH}
  GROUP BY 1, 2)
SELECT subject_id, us, CASE WHEN n = 1 THEN hit_us END AS hit_us, CASE WHEN n = 1 THEN hit_value END AS hit_value FROM m""",
)
def unique_value(t):
    plan = BandPlan()
    hit = unique_in_band(plan.count(BAND_LOW, BAND_HIGH), plan.last(BAND_HIGH))
    return _banded(t, plan).select(
        "subject_id", "us", hit["us"].alias("hit_us"), hit["value"].alias("hit_value")
    )


# --- joins ------------------------------------------------------------------------------------
@query(
    "j1_band_join",
    f"""SELECT a.subject_id, a.us AS anchor_us, b.us AS observed_us FROM ev a JOIN glucose b
  ON a.subject_id = b.subject_id AND b.us BETWEEN a.us + {BAND_LOW} AND a.us + {BAND_HIGH} AND b.us > a.us
WHERE a.event_type = 'error'""",
)
def band_join(t):
    windows = t.anchors.select("subject_id", us("anchor", "anchor_us"))
    points = t.events.select("subject_id", us("ts", "observed_us"))
    return ranges.point_in_window(
        windows,
        points,
        low=F.col("anchor_us") + BAND_LOW,
        high=F.col("anchor_us") + BAND_HIGH,
        us=F.col("observed_us"),
        width_us=BAND_HIGH - BAND_LOW,
    ).filter(F.col("observed_us") > F.col("anchor_us"))


@query(
    "j2_interval_overlap_join",
    f"""SELECT a.subject_id, a.us AS anchor_us, b.id, b.s, b.e,
  (least(b.e, a.us) - greatest(b.s, a.us - {H})) / 1e6 AS overlap_seconds
FROM ev a JOIN sleep b ON a.subject_id = b.subject_id AND b.s < a.us AND b.e > a.us - {H}
WHERE a.event_type = 'error'""",
)
def interval_join(t):
    windows = t.anchors.select("subject_id", us("anchor", "anchor_us"))
    spans = t.stored.sleep.select(
        "subject_id", F.col("source_sample_id").alias("id"), us("start_time", "s"), us("end_time", "e")
    )
    low, high = F.col("anchor_us") - H, F.col("anchor_us")
    pairs = ranges.interval_overlap(
        windows, spans, low=low, high=high, start_us=F.col("s"), end_us=F.col("e"), width_us=H
    )
    return pairs.withColumn("overlap_seconds", X.overlap_seconds("s", "e", low, high))


@query(
    "j2_interval_overlap_join_narrow_buckets",
    f"""SELECT a.subject_id, a.us AS anchor_us, b.id FROM ev a JOIN sleep b
  ON a.subject_id = b.subject_id AND b.s < a.us AND b.e > a.us - {HOUR} WHERE a.event_type = 'error'""",
)
def interval_join_narrow(t):
    """Intervals much longer than the window: they live in the upper tiers."""
    windows = t.anchors.select("subject_id", us("anchor", "anchor_us"))
    spans = t.stored.sleep.select(
        "subject_id", F.col("source_sample_id").alias("id"), us("start_time", "s"), us("end_time", "e")
    )
    return ranges.interval_overlap(
        windows,
        spans,
        low=F.col("anchor_us") - HOUR,
        high=F.col("anchor_us"),
        start_us=F.col("s"),
        end_us=F.col("e"),
        width_us=MINUTE,
    ).select("subject_id", "anchor_us", "id")


@query(
    "j3_point_in_window_join",
    f"""SELECT a.subject_id, a.us AS anchor_us, b.id FROM ev a JOIN meals b
  ON a.subject_id = b.subject_id AND b.us BETWEEN a.us - {H} AND a.us WHERE a.event_type = 'error'""",
)
def point_join(t):
    windows = t.anchors.select("subject_id", us("anchor", "anchor_us"))
    points = t.stored.meals.select(
        "subject_id", F.col("source_sample_id").alias("id"), us("meal_completed_at", "at_us")
    )
    return ranges.point_in_window(
        windows,
        points,
        low=F.col("anchor_us") - H,
        high=F.col("anchor_us"),
        us=F.col("at_us"),
        width_us=H,
    ).select("subject_id", "anchor_us", "id")


@query(
    "j4_asof_join",
    f"""SELECT a.subject_id, a.us AS anchor_us, max_by(w.id, (w.e, w.id)) AS workout_id, max(w.e) AS workout_us
FROM ev a LEFT JOIN workouts w ON a.subject_id = w.subject_id AND w.e BETWEEN a.us - {14 * DAY} AND a.us
GROUP BY 1, 2""",
)
def asof(t):
    """Every event is an anchor."""
    out = asof_join(
        t.events.select("subject_id", "ts"),
        t.stored.workouts,
        anchor_time="ts",
        event_time="end_time",
        event_id="source_sample_id",
        columns=[],
        lookback_us=14 * DAY,
        name="w",
    )
    return out.select(
        "subject_id", us("ts", "anchor_us"), F.col("w.id").alias("workout_id"), F.col("w.us").alias("workout_us")
    )


@query(
    "j5_interval_local_days",
    f"""SELECT subject_id, day2 AS day, count(*) AS n FROM (SELECT subject_id, CAST(unnest(generate_series(
  date_trunc('day', timezone('{ZONE}', make_timestamp(s) AT TIME ZONE 'UTC')),
  date_trunc('day', timezone('{ZONE}', make_timestamp(e - 1) AT TIME ZONE 'UTC')), INTERVAL 1 DAY)) AS DATE) AS day2
FROM sleep) GROUP BY 1, 2""",
)
def interval_days(t):
    days = X.local_dates_touched("start_time", "end_time", ZONE)
    return (
        t.stored.sleep.select("subject_id", F.explode(days).alias("day"))
        .groupBy("subject_id", "day")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "j6_major_gap_days",
    f"""WITH p AS (SELECT subject_id, lag(us) OVER (PARTITION BY subject_id ORDER BY us) AS prev, us FROM glucose),
days AS (SELECT CAST(unnest(generate_series(
    date_trunc('day', timezone('{ZONE}', {SQL_START} AT TIME ZONE 'UTC')),
    date_trunc('day', timezone('{ZONE}', ({SQL_END} - INTERVAL 1 MICROSECOND) AT TIME ZONE 'UTC')), INTERVAL 1 DAY)) AS DATE) AS day),
b AS (SELECT day, epoch_us(timezone('{ZONE}', CAST(day AS TIMESTAMP))) AS ds,
  epoch_us(timezone('{ZONE}', CAST(day + INTERVAL 1 DAY AS TIMESTAMP))) AS de FROM days)
SELECT subject_id, count(DISTINCT day) AS major_gap_days FROM p JOIN b ON prev < de AND us > ds
WHERE us - prev > {720 * MINUTE} GROUP BY 1""",
)
def gap_days(t):
    return D.days_with_major_gaps(t.obs, DIAGNOSTICS, START, END)


@query(
    "t6_nearest_candidate",
    f"""SELECT a.subject_id, a.us AS anchor_us, arg_min(b.us, (abs(b.us - a.us - {12 * HOUR}), b.us)) AS nearest_us
FROM ev a JOIN glucose b ON a.subject_id = b.subject_id AND b.us BETWEEN a.us + {BAND_LOW} AND a.us + {BAND_HIGH}
WHERE a.event_type = 'error' GROUP BY 1, 2""",
)
def nearest_candidate(t):
    pairs = band_join(t)
    offset = F.col("observed_us") - F.col("anchor_us") - 12 * HOUR
    return pairs.groupBy("subject_id", "anchor_us").agg(nearest("observed_us", offset).alias("nearest_us"))


@query(
    "u2_union_of_typed_events",
    """SELECT subject_id, 'meal' AS event_type, us AS at, NULL AS until FROM meals
UNION ALL SELECT subject_id, 'sleep_interval', s, e FROM sleep""",
)
def typed_union(t):
    meals = t.stored.meals.select(
        "subject_id", F.lit("meal").alias("event_type"), us("meal_completed_at", "at")
    )
    sleep = t.stored.sleep.select(
        "subject_id",
        F.lit("sleep_interval").alias("event_type"),
        us("start_time", "at"),
        us("end_time", "until"),
    )
    return meals.unionByName(sleep, allowMissingColumns=True)


@query("t5_canonical_order", "SELECT subject_id, us, value, id FROM glucose ORDER BY subject_id, us, value")
def canonical_sort(t):
    from subjectseries.sources.snapshot import canonical_order

    return canonical_order(t.snap["glucose"], "glucose").select(
        "subject_id",
        us("timestamp", "us"),
        F.col("glucose_mg_dl").alias("value"),
        F.col("seq").cast("string").alias("id"),
    )
