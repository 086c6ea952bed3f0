from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from conftest import T0
from subjectseries.functions import predicates as P
from subjectseries.functions import scalars as X


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize("day,expected", [("2026-03-08", 276), ("2026-11-01", 300), ("2026-08-01", 288)])
def test_expected_samples_follow_dst(spark, day, expected):
    assert one(spark, X.expected_samples(F.to_date(F.lit(day)), "America/New_York", 5)) == expected


def test_bucket_is_floor_before_epoch(spark):
    assert one(spark, X.bucket_start_us(F.lit(-1).cast("bigint"), 300_000_000)) == -300_000_000
    assert one(spark, X.bucket_index(F.lit(-1).cast("bigint"), 300_000_000)) == -1


def test_interval_ending_at_local_midnight_stays_on_its_day(spark):
    start, end = datetime(2026, 8, 5, 3, 30, tzinfo=timezone.utc), datetime(2026, 8, 5, 4, tzinfo=timezone.utc)
    days = one(spark, X.local_dates_touched(P.ts_lit(start), P.ts_lit(end), "America/New_York"))
    assert [str(d) for d in days] == ["2026-08-04"]
    days = one(spark, X.local_dates_touched(P.ts_lit(start), P.ts_lit(end + timedelta(minutes=1)), "America/New_York"))
    assert [str(d) for d in days] == ["2026-08-04", "2026-08-05"]


@pytest.mark.parametrize("value,expected", [(15, "normal"), (15.1, "warning"), (60, "warning"), (61, "major")])
def test_gap_class_bounds(spark, value, expected):
    assert one(spark, X.gap_class(F.lit(float(value)), 15, 60)) == expected


def test_overlap_seconds_is_never_negative(spark):
    assert one(spark, X.overlap_seconds(*[F.lit(v) for v in (0, 10, 20, 30)])) == 0.0


def test_rate_of_nothing_is_null(spark):
    assert one(spark, X.rate(F.lit(1), F.lit(0))) is None


def test_canonical_json_ignores_key_order(spark):
    a = one(spark, X.json_sha256(F.lit('{"b": 1, "a": [1, 2]}')))
    b = one(spark, X.json_sha256(F.lit('{"a":[1,2],"b":1}')))
    assert a == b


def test_touching_intervals_do_not_overlap(spark):
    lo, hi = P.ts_lit(T0), P.ts_lit(T0 + timedelta(hours=1))
    before = P.overlaps(P.ts_lit(T0 - timedelta(hours=1)), lo, lo, hi)
    after = P.overlaps(hi, P.ts_lit(T0 + timedelta(hours=2)), lo, hi)
    assert one(spark, before) is False and one(spark, after) is False


def test_request_checks():
    with pytest.raises(P.RequestError):
        P.time_range(datetime(2026, 1, 1), T0)
    with pytest.raises(P.RequestError):
        P.time_range(T0, T0)
    with pytest.raises(P.RequestError):
        P.zone("Mars/Base")
    with pytest.raises(P.RequestError):
        P.positive_lookback(0, 30, "x")
    P.span_at_most(T0, T0 + timedelta(hours=72), timedelta(hours=72), "timeline")
    with pytest.raises(P.RequestError):
        P.span_at_most(T0, T0 + timedelta(hours=72, seconds=1), timedelta(hours=72), "timeline")
