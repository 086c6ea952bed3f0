"""Fixed schemas of the stored and derived tables. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _TS, _D, _L = T.StringType(), T.TimestampType(), T.DoubleType(), T.LongType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


# Names of the stored tables.
ENTITIES = (
    "glucose_samples",
    "workouts",
    "sleep_sessions",
    "weight_measurements",
    "meal_events",
)

# --- stored tables (fixed values: the data contract) -----------------------
_IDENTITY = {"subject_id": _S, "source": _S, "source_sample_id": _S, "source_name": _S}
_AUDIT = {"metadata": _S, "ingested_at": _TS, "updated_at": _TS, "deleted_at": _TS}

STORED = {
    "glucose_samples": _schema(
        **_IDENTITY, sample_time=_TS, value_mg_dl=T.DecimalType(10, 3), trend=_S, **_AUDIT
    ),
    "workouts": _schema(
        **_IDENTITY,
        sport=_S,
        start_time=_TS,
        end_time=_TS,
        distance_meters=T.DecimalType(12, 3),
        active_energy_kcal=T.DecimalType(12, 3),
        average_heart_rate=T.DecimalType(10, 3),
        maximum_heart_rate=T.DecimalType(10, 3),
        **_AUDIT,
    ),
    "sleep_sessions": _schema(**_IDENTITY, start_time=_TS, end_time=_TS, stage=_S, **_AUDIT),
    "weight_measurements": _schema(
        **_IDENTITY, measured_at=_TS, value_kg=T.DecimalType(10, 6), **_AUDIT
    ),
    "meal_events": _schema(
        **_IDENTITY, meal_completed_at=_TS, foods=T.ArrayType(_S), notes=_S, **_AUDIT
    ),
}

SOURCES = _schema(subject_id=_S, source=_S, source_name=_S, source_type=_S)

# Columns whose change turns a matched row into an update.
MEANINGFUL = {
    "glucose_samples": ("sample_time", "value_mg_dl", "trend", "source_name", "metadata"),
    "workouts": (
        "sport",
        "start_time",
        "end_time",
        "distance_meters",
        "active_energy_kcal",
        "average_heart_rate",
        "maximum_heart_rate",
        "source_name",
        "metadata",
    ),
    "sleep_sessions": ("start_time", "end_time", "stage", "source_name", "metadata"),
    "weight_measurements": ("measured_at", "value_kg", "source_name", "metadata"),
    "meal_events": ("meal_completed_at", "foods", "notes", "source_name", "metadata"),
}
IDENTITY = ("subject_id", "source", "source_sample_id")

# --- snapshot tables (fixed values: the data contract) ---------------------
SNAPSHOT = {
    "glucose": _schema(subject_id=_S, timestamp=_TS, glucose_mg_dl=_D),
    "meals": _schema(
        subject_id=_S, meal_id=_S, timestamp=_TS, foods=T.ArrayType(_S), source=_S
    ),
    "workouts": _schema(
        subject_id=_S,
        workout_id=_S,
        start=_TS,
        end=_TS,
        sport=_S,
        distance_meters=_D,
        source=_S,
    ),
    "sleep": _schema(subject_id=_S, sleep_id=_S, start=_TS, end=_TS, stage=_S, source=_S),
    "weight": _schema(subject_id=_S, weight_id=_S, timestamp=_TS, weight_kg=_D, source=_S),
}
POINT_TABLES = ("glucose", "meals", "weight")
INTERVAL_TABLES = ("workouts", "sleep")
ID_COLUMNS = {
    "meals": "meal_id",
    "workouts": "workout_id",
    "sleep": "sleep_id",
    "weight": "weight_id",
}

# Statuses of an anchor and horizon.
READINESS_STATUSES = (
    "eligible_unique",
    "eligible_ambiguous",
    "missing_target",
    "insufficient_history",
)


def same_schema(actual: T.StructType, expected: T.StructType) -> bool:
    """Names, order and types must agree; nullability is not part of the contract."""
    return [(f.name, f.dataType.simpleString()) for f in actual] == [
        (f.name, f.dataType.simpleString()) for f in expected
    ]
