"""Registry and stand-in tables.

No driver table holds health data, so ``events`` plays all five parts: every event is
a glucose sample; purchases are meals, signups weights, views workouts and clicks
sleep, with ``value`` minutes as the length of an interval. Whole tables are used.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjectseries.operators.chunks import observations
from subjectseries.plans.episodes import evaluate_anchors
from subjectseries.plans.policies import DiagnosticsPolicy, EpisodePolicy
from subjectseries.plans.queries import SubjectTables
from subjectseries.session import materialize, use_defaults

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The request window of the bounded queries.
START = datetime(2024, 1, 2, tzinfo=timezone.utc)
END = datetime(2024, 1, 29, 12, tzinfo=timezone.utc)
SQL_START = "TIMESTAMP '2024-01-02 00:00:00'"
SQL_END = "TIMESTAMP '2024-01-29 12:00:00'"
ZONE = "America/New_York"

DIAGNOSTICS = DiagnosticsPolicy(
    gap_warning_minutes=240.0,
    gap_major_minutes=720.0,
    cadence_minutes=360.0,
    target_tolerance_minutes=240.0,
    minimum_history_minutes=2880.0,
    horizons_minutes=(720, 1440),
    timezone=ZONE,
)
EPISODES = EpisodePolicy(
    history_minutes=2880,
    cadence_minutes=720,
    max_gap_minutes=1440,
    start_tolerance_minutes=240,
    target_tolerance_minutes=240,
    horizons_minutes=(720, 1440),
)
DATASET = "demo"

# CTEs that spell the stand-ins in SQL.
SQL_TABLES = f"""
ev AS (
  SELECT CAST(user_id AS VARCHAR) AS subject_id, CAST(event_id AS VARCHAR) AS id, event_id,
         event_type, ts, epoch_us(ts) AS us, CAST(value AS DECIMAL(10,3)) AS v, value,
         CAST(round(value * 100) AS BIGINT) AS cents,
         CASE WHEN value >= 250 THEN 'watch' ELSE 'phone' END AS src,
         CAST(timezone('{ZONE}', ts AT TIME ZONE 'UTC') AS DATE) AS day
  FROM events),
glucose AS (SELECT * FROM ev),
meals AS (SELECT * FROM ev WHERE event_type = 'purchase'),
weight AS (SELECT * FROM ev WHERE event_type = 'signup'),
workouts AS (SELECT *, us AS s, us + cents * 600000 AS e FROM ev WHERE event_type = 'view' AND cents > 0),
sleep AS (SELECT *, us AS s, us + cents * 600000 AS e FROM ev WHERE event_type = 'click' AND cents > 0),
anchors AS (SELECT subject_id, us AS anchor FROM ev WHERE event_type = 'error'),
bounds AS (SELECT epoch_us({SQL_START}) AS lo, epoch_us({SQL_END}) AS hi)
"""


class Standins:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = use_defaults(spark), sf_dir

    @cached_property
    def events(self) -> DataFrame:
        raw = self.spark.read.parquet(f"{self.dir}/events.parquet")
        # Naive times are UTC; the session is UTC, so the cast keeps the instant.
        return raw.select(
            F.col("user_id").cast("string").alias("subject_id"),
            F.col("event_id").cast("string").alias("source_sample_id"),
            "event_id",
            "event_type",
            F.col("ts").cast("timestamp").alias("ts"),
            "value",
            F.round(F.col("value") * 100).cast("bigint").alias("cents"),
            F.when(F.col("value") >= 250, "watch").otherwise("phone").alias("source"),
        )

    def _only(self, kind: str) -> DataFrame:
        return self.events.filter(F.col("event_type") == kind)

    def _interval(self, kind: str) -> DataFrame:
        end = F.timestamp_micros(F.unix_micros("ts") + F.col("cents") * 600_000)
        return (
            self._only(kind)
            .filter(F.col("cents") > 0)
            .withColumns({"start_time": F.col("ts"), "end_time": end})
        )

    @cached_property
    def stored(self) -> SubjectTables:
        none = F.lit(None).cast("timestamp")
        head = ["subject_id", "source", "source_sample_id"]
        tail = [none.alias("deleted_at")]
        return SubjectTables(
            glucose=self.events.select(
                *head,
                F.col("ts").alias("sample_time"),
                F.col("value").cast("decimal(10,3)").alias("value_mg_dl"),
                *tail,
            ),
            meals=self._only("purchase").select(
                *head,
                F.col("ts").alias("meal_completed_at"),
                F.array("event_type").alias("foods"),
                *tail,
            ),
            workouts=self._interval("view").select(
                *head,
                "start_time",
                "end_time",
                F.lit("running").alias("sport"),
                F.col("value").cast("decimal(12,3)").alias("distance_meters"),
                *tail,
            ),
            sleep=self._interval("click").select(
                *head, "start_time", "end_time", F.lit("core").alias("stage"), *tail
            ),
            weight=self._only("signup").select(
                *head,
                F.col("ts").alias("measured_at"),
                F.col("value").cast("decimal(10,6)").alias("value_kg"),
                *tail,
            ),
        )

    @cached_property
    def snap(self) -> dict[str, DataFrame]:
        """Snapshot-shaped tables of the whole data, with the ingest sequence ``seq``."""
        seq = F.col("event_id").alias("seq")
        ident, source = F.col("source_sample_id"), F.col("source")
        start, end = F.col("start_time").alias("start"), F.col("end_time").alias("end")
        when = F.col("ts").alias("timestamp")
        return {
            "glucose": self.events.select(
                "subject_id", when, F.col("value").alias("glucose_mg_dl"), seq
            ),
            "meals": self._only("purchase").select(
                "subject_id",
                ident.alias("meal_id"),
                when,
                F.array("event_type").alias("foods"),
                source,
                seq,
            ),
            "workouts": self._interval("view").select(
                "subject_id",
                ident.alias("workout_id"),
                start,
                end,
                F.lit("running").alias("sport"),
                F.col("value").alias("distance_meters"),
                source,
                seq,
            ),
            "sleep": self._interval("click").select(
                "subject_id",
                ident.alias("sleep_id"),
                start,
                end,
                F.lit("core").alias("stage"),
                source,
                seq,
            ),
            "weight": self._only("signup").select(
                "subject_id",
                ident.alias("weight_id"),
                when,
                F.col("value").alias("weight_kg"),
                source,
                seq,
            ),
        }

    @cached_property
    def obs(self) -> DataFrame:
        return observations(self.snap["glucose"], "timestamp", "glucose_mg_dl")

    @cached_property
    def doubled(self) -> DataFrame:
        """Observations where every error event occurs twice at its instant."""
        twice = self.snap["glucose"].unionByName(
            self._only("error").select(
                "subject_id",
                F.col("ts").alias("timestamp"),
                F.col("value").alias("glucose_mg_dl"),
                F.col("event_id").alias("seq"),
            )
        )
        return observations(twice, "timestamp", "glucose_mg_dl")

    @cached_property
    def evaluated(self) -> DataFrame:
        """The evaluation written once, for reports that read it several times."""
        return materialize(evaluate_anchors(self.obs, EPISODES), "evaluated")

    @cached_property
    def anchors(self) -> DataFrame:
        return self._only("error").select("subject_id", F.col("ts").alias("anchor"))


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the stand-in CTEs."""

    def register(fn: Callable[[Standins], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Standins(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = _with_tables(sql)
        return fn

    return register


def _with_tables(sql: str) -> str:
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {SQL_TABLES}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {SQL_TABLES}, {body[4:]}"
    return f"WITH {SQL_TABLES} {body}"


def us(column, name: str | None = None):
    """Epoch µs for output, so that both engines compare integers."""
    col = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(col).alias(name or str(column))


def r6(column, name: str | None = None):
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col, 6).alias(name or str(column))
