import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from subjectseries.session import use_defaults  # noqa: E402

T0 = datetime(2026, 8, 5, 12, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield use_defaults(session)
    session.stop()


def minutes(value: float) -> timedelta:
    return timedelta(minutes=value)


def glucose(spark, times, subject="s", values=None):
    rows = [(subject, t, float(values[i]) if values else 100.0 + i) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "subject_id string, timestamp timestamp, glucose_mg_dl double")


def regular(count=49, step=5):
    return [T0 + minutes(step * i) for i in range(count)]
