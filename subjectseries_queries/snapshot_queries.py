"""Snapshots and the datasets derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from subjectseries_queries.base import DIAGNOSTICS, END, EPISODES, START, query, us
from subjectseries_queries.episode_queries import _EVENT_SQL, evaluation_sql
from subjectseries.plans import datasets
from subjectseries.schemas import ID_COLUMNS, POINT_TABLES
from subjectseries.session import scratch_dir
from subjectseries.sources import snapshot as S

WINDOWED = """gw AS (SELECT * FROM glucose, bounds WHERE us >= lo AND us < hi), mw AS (SELECT * FROM meals, bounds WHERE us >= lo AND us < hi),
kw AS (SELECT * FROM weight, bounds WHERE us >= lo AND us < hi), ww AS (SELECT * FROM workouts, bounds WHERE s < hi AND e > lo),
zw AS (SELECT * FROM sleep, bounds WHERE s < hi AND e > lo)"""


@query(
    "s11_snapshot_extract",
    f"""WITH {WINDOWED} SELECT 'glucose' AS "table", subject_id, NULL AS id, us AS s, NULL AS e, ((CAST(v * 1000 AS BIGINT) + 50) // 100) / 10.0 AS value FROM gw
UNION ALL SELECT 'meals', subject_id, id, us, NULL, NULL FROM mw UNION ALL SELECT 'workouts', subject_id, id, s, e, value FROM ww
UNION ALL SELECT 'sleep', subject_id, id, s, e, NULL FROM zw UNION ALL SELECT 'weight', subject_id, id, us, NULL, value FROM kw""",
)
def extract(t):
    out = None
    for name, df in S.extract(t.stored, START, END).items():
        value = {"glucose": "glucose_mg_dl", "workouts": "distance_meters", "weight": "weight_kg"}.get(name)
        point = name in POINT_TABLES
        none = F.lit(None)
        part = df.select(
            F.lit(name).alias("table"),
            "subject_id",
            (F.col(ID_COLUMNS[name]) if name in ID_COLUMNS else none.cast("string")).alias("id"),
            us("timestamp" if point else "start", "s"),
            (none.cast("bigint") if point else F.unix_micros("end")).alias("e"),
            (F.col(value) if value else none.cast("double")).alias("value"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def _damaged(t):
    """The whole tables with values that break rules."""
    s = t.snap
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    low = lambda c: F.col(c) < 50
    return {
        "glucose": s["glucose"].withColumn(
            "glucose_mg_dl", F.when(low("glucose_mg_dl"), nan).otherwise(F.col("glucose_mg_dl"))
        ),
        "meals": s["meals"].withColumn("source", F.when(F.col("source") == "watch", "  ").otherwise(F.col("source"))),
        "workouts": s["workouts"].withColumns(
            {
                "distance_meters": F.when(low("distance_meters"), inf).otherwise(F.col("distance_meters")),
                "sport": F.when(F.col("source") == "phone", "").otherwise(F.col("sport")),
            }
        ),
        "sleep": s["sleep"].withColumn("end", F.when(F.col("source") == "phone", F.col("start")).otherwise(F.col("end"))),
        "weight": s["weight"].withColumn("weight_kg", F.col("weight_kg") - 250),
    }


@query(
    "s12_canonical_violations",
    """SELECT 'glucose' AS "table", 'glucose_mg_dl is not finite' AS rule, count(*) FILTER (value < 50) AS violations FROM glucose
UNION ALL SELECT 'meals', 'source is blank', count(*) FILTER (src = 'watch') FROM meals
UNION ALL SELECT 'workouts', 'sport is blank', count(*) FILTER (src = 'phone') FROM workouts
UNION ALL SELECT 'workouts', 'distance_meters is not finite', count(*) FILTER (value < 50) FROM workouts
UNION ALL SELECT 'sleep', 'end is not later than start', count(*) FILTER (src = 'phone') FROM sleep
UNION ALL SELECT 'weight', 'weight_kg is not positive', count(*) FILTER (value <= 250) FROM weight""",
)
def violations(t):
    return S.violation_counts(_damaged(t)).filter(F.col("violations") > 0)


@query(
    "s13_duplicate_ids",
    """SELECT 'meals' AS "table", subject_id, id, 2 AS n FROM meals WHERE src = 'watch'
UNION ALL SELECT 'sleep', subject_id, id, 2 FROM sleep WHERE src = 'phone'""",
)
def duplicate_ids(t):
    tables = dict(t.snap)
    tables["meals"] = tables["meals"].unionByName(tables["meals"].filter(F.col("source") == "watch"))
    tables["sleep"] = tables["sleep"].unionByName(tables["sleep"].filter(F.col("source") == "phone"))
    return S.duplicate_ids(tables)


@query(
    "s14_quality_counts",
    """WITH dbl AS (SELECT subject_id, us, value FROM glucose UNION ALL SELECT subject_id, us, value FROM glucose WHERE event_type = 'error'),
gp AS (SELECT us - lag(us) OVER (PARTITION BY subject_id ORDER BY us) AS gap FROM dbl),
pt AS (SELECT 'glucose' AS tab, us FROM dbl UNION ALL SELECT 'meals', us FROM meals UNION ALL SELECT 'weight', us FROM weight),
sp AS (SELECT 'workouts' AS tab, s, e FROM workouts UNION ALL SELECT 'sleep', s, e FROM sleep)
SELECT tab AS "table", 'rows' AS measure, count(*) AS n FROM pt GROUP BY 1 UNION ALL SELECT tab, 'rows', count(*) FROM sp GROUP BY 1
UNION ALL SELECT tab, 'out_of_window', count(*) FILTER (NOT (us >= lo AND us < hi)) FROM pt, bounds GROUP BY 1
UNION ALL SELECT tab, 'out_of_window', count(*) FILTER (s < lo OR e > hi) FROM sp, bounds GROUP BY 1
UNION ALL SELECT 'glucose', 'out_of_range', count(*) FILTER (NOT value BETWEEN 20 AND 600) FROM dbl
UNION ALL SELECT 'glucose', 'duplicate_timestamps', count(*) - count(DISTINCT (subject_id, us)) FROM dbl
UNION ALL SELECT 'glucose', 'gaps_over_15m', count(*) FILTER (gap > 900000000) FROM gp
UNION ALL SELECT 'glucose', 'gaps_over_60m', count(*) FILTER (gap > 3600000000) FROM gp""",
)
def quality_counts(t):
    tables = dict(t.snap)
    again = t.events.filter(F.col("event_type") == "error").select(
        "subject_id",
        F.col("ts").alias("timestamp"),
        F.col("value").alias("glucose_mg_dl"),
        F.col("event_id").alias("seq"),
    )
    tables["glucose"] = tables["glucose"].unionByName(again)
    return S.quality_counts(tables, START, END)


def _written(t) -> str:
    # Stand-in weights are any value of an event, zero among them.
    return S.write_snapshot(
        t.stored, START, END, scratch_dir(t.spark, "snapshots"), tolerated=["weight_kg is not positive"]
    )


@query(
    "s15_snapshot_write",
    f"""WITH {WINDOWED} SELECT 'glucose' AS "table", count(*) AS rows FROM gw UNION ALL SELECT 'meals', count(*) FROM mw
UNION ALL SELECT 'workouts', count(*) FROM ww UNION ALL SELECT 'sleep', count(*) FROM zw UNION ALL SELECT 'weight', count(*) FROM kw""",
)
def snapshot_write(t):
    return t.spark.read.parquet(f"{_written(t)}/manifest").select("table", "rows")


@query(
    "s14_manifest_counts",
    f"""WITH {WINDOWED}, gv AS (SELECT subject_id, us, ((CAST(v * 1000 AS BIGINT) + 50) // 100) / 10.0 AS value FROM gw),
gp AS (SELECT us - lag(us) OVER (PARTITION BY subject_id ORDER BY us) AS gap FROM gv),
pt AS (SELECT 'glucose' AS tab, us FROM gv UNION ALL SELECT 'meals', us FROM mw UNION ALL SELECT 'weight', us FROM kw),
sp AS (SELECT 'workouts' AS tab, s, e FROM ww UNION ALL SELECT 'sleep', s, e FROM zw)
SELECT tab AS "table", 'rows' AS measure, count(*) AS n FROM pt GROUP BY 1 UNION ALL SELECT tab, 'rows', count(*) FROM sp GROUP BY 1
UNION ALL SELECT tab, 'out_of_window', 0 FROM pt GROUP BY 1
UNION ALL SELECT tab, 'out_of_window', count(*) FILTER (s < lo OR e > hi) FROM sp, bounds GROUP BY 1
UNION ALL SELECT 'glucose', 'out_of_range', count(*) FILTER (NOT value BETWEEN 20 AND 600) FROM gv
UNION ALL SELECT 'glucose', 'duplicate_timestamps', count(*) - count(DISTINCT (subject_id, us)) FROM gv
UNION ALL SELECT 'glucose', 'gaps_over_15m', count(*) FILTER (gap > 900000000) FROM gp
UNION ALL SELECT 'glucose', 'gaps_over_60m', count(*) FILTER (gap > 3600000000) FROM gp""",
)
def manifest_counts(t):
    return t.spark.read.parquet(f"{_written(t)}/manifest").select("table", F.explode("quality").alias("measure", "n"))


@query(
    "s16_snapshot_load",
    f"WITH {WINDOWED} SELECT subject_id, us, ((CAST(v * 1000 AS BIGINT) + 50) // 100) / 10.0 AS value FROM gw",
)
def snapshot_load(t):
    loaded = S.load_snapshot(t.spark, _written(t))
    return loaded.tables["glucose"].select(
        "subject_id", us("timestamp", "us"), F.col("glucose_mg_dl").alias("value")
    )


_EVENTS = (
    _EVENT_SQL.replace("JOIN meals", "JOIN mw")
    .replace("JOIN weight", "JOIN kw")
    .replace("JOIN workouts", "JOIN ww")
    .replace("JOIN sleep", "JOIN zw")
)


@query(
    "s17_matched_pair_episodes",
    f"""WITH {WINDOWED}, {evaluation_sql(EPISODES, 'gw')}, {_EVENTS}
SELECT 'episodes' AS "table", count(*) AS rows FROM ok UNION ALL SELECT 'episode_glucose_history', count(*) * 5 FROM ok
UNION ALL SELECT 'episode_targets', count(*) * 2 FROM ok UNION ALL SELECT 'episode_events', count(*) FROM events_in
UNION ALL SELECT 'rejected_anchors', CAST(coalesce(sum(n), 0) AS BIGINT) FROM eva WHERE codes <> ''""",
)
def matched_pair(t):
    """Snapshot, its diagnostics, the pair check and the episode tables, all written."""
    loaded = S.load_snapshot(t.spark, _written(t))
    root = scratch_dir(t.spark, "derived")
    made = datasets.write_diagnostics(t.spark, loaded, root, DIAGNOSTICS)
    diagnostics = datasets.load_dataset(t.spark, made, datasets.DIAGNOSTICS_VERSION)
    path = datasets.write_episodes(t.spark, loaded, diagnostics, root, EPISODES)
    return t.spark.read.parquet(f"{path}/manifest").select("table", "rows")
