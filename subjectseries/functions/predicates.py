"""Boolean expressions. Time columns are compared raw so that they reach the scan."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjectseries.functions.scalars import as_col

SANITY_RANGE = (20.0, 600.0)


class RequestError(ValueError):
    """A query was called with arguments outside its contract."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def aware_utc(value: datetime, name: str) -> datetime:
    if value.tzinfo is None:
        raise RequestError("INVALID_TIME_RANGE", f"{name} has no time zone")
    return value.astimezone(timezone.utc)


def time_range(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    start, end = aware_utc(start, "start"), aware_utc(end, "end")
    if end <= start:
        raise RequestError("INVALID_TIME_RANGE", "end is not later than start")
    return start, end


def span_at_most(start: datetime, end: datetime, limit: timedelta | None, what: str) -> None:
    """Elapsed span check; ``None`` switches it off."""
    if limit is not None and end - start > limit:
        raise RequestError("RANGE_TOO_LARGE", f"{what} spans more than {limit}")


def zone(name: str) -> str:
    try:
        ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError) as error:
        raise RequestError("INVALID_TIMEZONE", f"unknown time zone {name!r}") from error
    return name


def positive_lookback(value: int, maximum: int | None, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise RequestError("INVALID_LOOKBACK", f"{what} is not a positive integer")
    if maximum is not None and value > maximum:
        raise RequestError("INVALID_LOOKBACK", f"{what} exceeds {maximum}")
    return value


def ts_lit(value: datetime) -> Column:
    """Timestamp literal of an aware instant, independent of the driver's own zone."""
    value = aware_utc(value, "literal")
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f+00:00")).cast("timestamp")


def to_us(value: datetime) -> int:
    delta = aware_utc(value, "instant") - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def live(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.filter(F.col("deleted_at").isNull()) if "deleted_at" in df.columns else df


def in_range(t: Column | str, start: Column, end: Column) -> Column:
    """Half-open ``start <= t < end``."""
    t = as_col(t)
    return (t >= start) & (t < end)


def overlaps(s: Column | str, e: Column | str, start: Column, end: Column) -> Column:
    """Shares more than a boundary with ``[start, end)``."""
    return (as_col(s) < end) & (as_col(e) > start)


def not_inside(s: Column | str, e: Column | str, start: Column, end: Column) -> Column:
    """Reaches past either bound."""
    return (as_col(s) < start) | (as_col(e) > end)


def in_closed(t: Column | str, low: Column, high: Column) -> Column:
    return as_col(t).between(low, high)


def in_band(t: Column | str, center: Column, tolerance: Column | int) -> Column:
    """Closed ``center ± tolerance`` on epoch µs."""
    return as_col(t).between(center - tolerance, center + tolerance)


def after_key(time: Column | str, ident: Column | str, last_time: Column, last_id: Column) -> Column:
    """Strictly after ``(last_time, last_id)`` in list order; raw comparisons still push down."""
    time, ident = as_col(time), as_col(ident)
    return (time >= last_time) & ((time > last_time) | (ident > last_id))


def outside_sanity(value: Column | str) -> Column:
    return ~as_col(value).between(*SANITY_RANGE)
