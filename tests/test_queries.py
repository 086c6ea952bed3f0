from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from conftest import T0, minutes
from subjectseries.functions.predicates import RequestError
from subjectseries.operators import paging
from subjectseries.plans import queries as Q

G = "subject_id string, source string, source_sample_id string, sample_time timestamp, value_mg_dl decimal(10,3), deleted_at timestamp"


def samples(spark, rows, subject="s"):
    from decimal import Decimal

    data = [(subject, "x", f"g{i}", t, Decimal(str(v)), d) for i, (t, v, d) in enumerate(rows)]
    return spark.createDataFrame(data, G)


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


DAY0, DAY1 = at("2026-08-05T00:00:00"), at("2026-08-06T00:00:00")


@pytest.fixture(scope="module")
def bucket_rows(spark):
    times = ["14:16", "14:18", "14:22", "15:05"]
    rows = [(at(f"2026-08-05T{t}:00"), v, None) for t, v in zip(times, (90, 100, 110, 120))]
    return samples(spark, [*rows, (at("2026-08-05T14:17:00"), 500, T0)])


@pytest.mark.parametrize(
    "resolution,first,mean,n", [("5m", "14:15", 95.0, 2), ("15m", "14:15", 100.0, 3), ("hourly", "14:00", 100.0, 3)]
)
def test_buckets_and_tombstones(bucket_rows, resolution, first, mean, n):
    out = Q.glucose_series(bucket_rows, DAY0, DAY1, resolution).withColumn("us", F.unix_micros("start"))
    row = out.orderBy("us").first()
    assert row.us == int(at(f"2026-08-05T{first}:00").timestamp() * 1e6)
    assert (row.mean_mg_dl, row.sample_count, row.source_record_count) == (mean, n, 4)


def test_point_cap_fails_whole(bucket_rows):
    for resolution, cap in (("raw", 3), ("15m", 1)):
        capped = Q.glucose_series(bucket_rows, DAY0, DAY1, resolution, max_points=cap)
        with pytest.raises(RequestError, match="more than"), paging.reading():
            capped.collect()
    with pytest.raises(ZeroDivisionError), paging.reading():
        1 / 0
    assert Q.glucose_series(bucket_rows, DAY0, DAY1, "raw", max_points=4).count() == 4


def test_span_limits(bucket_rows):
    Q.glucose_series(bucket_rows, DAY0, DAY0 + timedelta(days=7), "raw")
    with pytest.raises(RequestError):
        Q.glucose_series(bucket_rows, DAY0, DAY0 + timedelta(days=7, seconds=1), "raw")


def test_daily_summary_uses_local_days(spark):
    rows = samples(spark, [(at("2026-03-08T04:30:00"), 80, None), (at("2026-03-08T05:30:00"), 100, None), (at("2026-03-08T07:30:00"), 120, None)])
    out = Q.glucose_summary(rows, at("2026-03-07T00:00:00"), at("2026-03-10T00:00:00"), "daily", "America/New_York")
    got = {str(r.local_date): (r.sample_count, r.median_mg_dl) for r in out.collect()}
    assert got == {"2026-03-07": (1, 80.0), "2026-03-08": (2, 110.0)}


def test_summary_completes_empty_subjects(spark, bucket_rows):
    stats = Q.glucose_summary(bucket_rows, DAY0, DAY1)
    subjects = spark.createDataFrame([("s",), ("none",)], "subject_id string")
    got = {r.subject_id: (r.sample_count, r.mean_mg_dl) for r in Q.complete_summary(stats, subjects).collect()}
    assert got == {"s": (4, 105.0), "none": (0, None)}


def test_pages_walk_without_loss(spark):
    rows = [("s", "m", f"id{i:02d}", T0 + minutes(i // 3), ["a"], None) for i in range(10)]
    df = spark.createDataFrame(rows, "subject_id string, source string, source_sample_id string, meal_completed_at timestamp, foods array<string>, deleted_at timestamp")
    seen, after = [], None
    while True:
        page = Q.meals(df, T0, T0 + minutes(60), limit=4, after=after)
        got = page.withColumn("us", F.unix_micros("meal_completed_at")).orderBy("us", "id").collect()
        seen += [r.id for r in got]
        if not got[-1].truncated:
            break
        after = (datetime.fromtimestamp(got[-1].us / 1e6, timezone.utc), got[-1].id)
    assert seen == [f"id{i:02d}" for i in range(10)]


def test_last_meal_bounds_and_ties(spark):
    rows = [("s", "m", "a", T0, None, None), ("s", "m", "b", T0, ["x"], None), ("s", "m", "late", T0 + minutes(1), [], None)]
    df = spark.createDataFrame(rows, "subject_id string, source string, source_sample_id string, meal_completed_at timestamp, foods array<string>, deleted_at timestamp")
    anchors = spark.createDataFrame([("s", T0), ("s", T0 - minutes(1)), ("s", T0 + timedelta(days=30, minutes=2))], "subject_id string, anchor timestamp")
    got = sorted(((r.meal.id if r.meal else None), r.minutes_since_last_logged_meal) for r in Q.last_logged_meal(df, anchors).collect() if r.meal)
    assert got == [("b", 0.0)]
    single = Q.last_logged_meal_at(df, T0 + minutes(0.5)).first()
    assert single.meal.id == "b"


def test_timeline_span_is_elapsed(spark):
    tables = Q.SubjectTables(*[None] * 5)
    with pytest.raises(RequestError):
        Q.personal_timeline(tables, T0, T0 + timedelta(hours=72, seconds=1))


def test_time_filter_and_columns_reach_the_scan(spark, bucket_rows, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = str(tmp_path / "glucose")
    bucket_rows.write.parquet(path)
    stored = spark.read.schema(bucket_rows.schema).parquet(path)
    plan = Q.glucose_series(stored, DAY0, DAY1, "15m")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(sample_time" in pushed and "LessThan(sample_time" in pushed
    assert "IsNull(deleted_at)" in pushed
    read = plan.split("ReadSchema: ")[1].split(chr(10))[0]
    assert "source_sample_id" not in read
    assert plan.count("Exchange hashpartitioning") == 2


def test_page_ranks_before_the_shuffle(spark, bucket_rows):
    from subjectseries.operators.paging import page

    plan = page(bucket_rows, "sample_time", "source_sample_id", 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
