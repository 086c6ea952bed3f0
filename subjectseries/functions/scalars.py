"""Scalar expressions: time arithmetic, rounding, identifiers. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_SECOND = 1_000_000
US_PER_MINUTE = 60 * US_PER_SECOND
US_PER_HOUR = 60 * US_PER_MINUTE
US_PER_DAY = 24 * US_PER_HOUR

# Rollup widths in seconds by resolution name.
RESOLUTION_SECONDS = {"5m": 300, "15m": 900, "hourly": 3600}

DEFAULT_TIMEZONE = "America/New_York"

# Source names that are applications.
APP_SOURCE_NAMES = ("Stelo", "Strava", "Health")


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def minutes_to_us(minutes: float) -> int:
    return int(round(minutes * US_PER_MINUTE))


def epoch_us(ts: Column | str) -> Column:
    return F.unix_micros(as_col(ts))


def from_us(us: Column | str) -> Column:
    return F.timestamp_micros(as_col(us))


def integral_div(numerator: Column, denominator: Column | int) -> Column:
    if isinstance(denominator, int):
        denominator = F.lit(denominator).cast("bigint")
    return F.call_function("div", numerator, denominator)


def bucket_index(us: Column | str, width_us: int) -> Column:
    """Floor bucket number of an epoch value; right before 1970 as well."""
    us = as_col(us)
    width = F.lit(width_us).cast("bigint")
    return integral_div(us - F.pmod(us, width), width)


def bucket_start_us(us: Column | str, width_us: int) -> Column:
    us = as_col(us)
    return us - F.pmod(us, F.lit(width_us).cast("bigint"))


def local_date(ts: Column | str, tz: str) -> Column:
    """Civil date of an instant in an IANA zone (session time zone is UTC)."""
    return F.to_date(F.from_utc_timestamp(as_col(ts), tz))


def local_day_start(day: Column | str, tz: str) -> Column:
    """Instant at which a civil day begins; consecutive starts may be 23 h or 25 h apart."""
    return F.to_utc_timestamp(as_col(day).cast("timestamp"), tz)


def local_day_end(day: Column | str, tz: str) -> Column:
    return local_day_start(F.date_add(as_col(day), 1), tz)


def local_dates_touched(start: Column | str, end: Column | str, tz: str) -> Column:
    """Civil dates met by ``[start, end)``; empty for an empty interval."""
    start, end = as_col(start), as_col(end)
    last_instant = F.timestamp_micros(F.unix_micros(end) - 1)
    return F.when(
        end > start, F.sequence(local_date(start, tz), local_date(last_instant, tz))
    ).otherwise(F.array().cast("array<date>"))


def elapsed_minutes(start: Column | str, end: Column | str) -> Column:
    return (epoch_us(end) - epoch_us(start)) / F.lit(float(US_PER_MINUTE))


def duration_minutes(start: Column | str, end: Column | str) -> Column:
    """Minutes rounded to one decimal."""
    return F.round(elapsed_minutes(start, end), 1)


def offset_seconds(observed_us: Column | str, ideal_us: Column | str) -> Column:
    return (as_col(observed_us) - as_col(ideal_us)) / F.lit(float(US_PER_SECOND))


def overlap_seconds(
    start: Column | str, end: Column | str, window_start: Column | str, window_end: Column | str
) -> Column:
    """Length of the common part of two intervals given in epoch µs, never negative."""
    shared = F.least(as_col(end), as_col(window_end)) - F.greatest(
        as_col(start), as_col(window_start)
    )
    return F.greatest(shared, F.lit(0)) / F.lit(float(US_PER_SECOND))


def round1(value: Column | str) -> Column:
    """One decimal, halves away from zero, as a double."""
    return F.round(as_col(value), 1).cast("double")


def exact_mean(value: Column | str) -> Column:
    """Mean of a decimal column, as a decimal: neither row order nor rounding of the
    sum can move it, so a later rounding to one place is well defined."""
    value = as_col(value)
    return F.sum(value) / F.count(value)


def rate(part: Column | str, whole: Column | str) -> Column:
    """Ratio, null when the denominator is zero."""
    return F.try_divide(as_col(part).cast("double"), as_col(whole).cast("double"))


def gap_class(minutes: Column | str, warning: float, major: float) -> Column:
    minutes = as_col(minutes)
    return (
        F.when(minutes <= warning, "normal").when(minutes <= major, "warning").otherwise("major")
    )


def source_type(source: Column | str, source_name: Column | str) -> Column:
    return F.when(as_col(source) == "manual", "manual").when(
        as_col(source_name).isin(*APP_SOURCE_NAMES), "app"
    )


def expected_samples(day: Column | str, tz: str, cadence_minutes: float) -> Column:
    """Whole samples that fit a civil day at a cadence (DST days differ)."""
    day_us = epoch_us(local_day_end(day, tz)) - epoch_us(local_day_start(day, tz))
    return F.floor(day_us / F.lit(float(US_PER_MINUTE)) / F.lit(float(cadence_minutes)))


def canonical_json(text: Column | str) -> Column:
    """Key-sorted, whitespace-free JSON text."""
    return F.to_json(F.parse_json(as_col(text)))


def json_sha256(text: Column | str) -> Column:
    return F.sha2(canonical_json(text), 256)


def normalized_foods(foods: Column | str) -> Column:
    return F.coalesce(as_col(foods), F.array().cast("array<string>"))


def iso_z(us: Column | str) -> Column:
    """ISO-8601 UTC text of an instant, microseconds shown only when present."""
    ts = from_us(us)
    return F.when(
        F.pmod(as_col(us), F.lit(US_PER_SECOND)) == 0,
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def episode_id(dataset_id: str, subject: Column | str, anchor_us: Column | str) -> Column:
    """Stable name of one episode; the subject is part of the digest."""
    stamp = F.date_format(from_us(anchor_us), "yyyyMMdd'T'HHmmssSSSSSS'Z'")
    digest = F.sha2(
        F.concat_ws("|", F.lit(dataset_id), as_col(subject).cast("string"), iso_z(anchor_us)), 256
    )
    return F.concat(F.lit("ep_"), stamp, F.lit("_"), F.substring(digest, 1, 12))


def grid_us(history_start_us: Column | str, cadence_us: int, positions: int) -> Column:
    """Array of grid instants, the last one being the anchor."""
    start = as_col(history_start_us)
    return F.transform(
        F.sequence(F.lit(0), F.lit(positions - 1)),
        lambda i: start + i.cast("bigint") * F.lit(cadence_us),
    )
