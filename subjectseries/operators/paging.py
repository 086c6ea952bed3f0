"""List order, keyset pages and result caps."""

from __future__ import annotations

import re
from collections.abc import Sequence
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subjectseries.functions.predicates import RequestError, after_key, ts_lit

DEFAULT_PAGE, MAX_PAGE = 100, 500
TOO_LARGE = "RESULT_TOO_LARGE"


def list_order(df: DataFrame, time: str, ident: str) -> DataFrame:
    """Stable ascending order by time, then id."""
    return df.orderBy(time, ident)


def page(
    df: DataFrame,
    time: str,
    ident: str,
    limit: int = DEFAULT_PAGE,
    after: tuple[datetime, str] | None = None,
    max_limit: int | None = MAX_PAGE,
    keys: Sequence[str] = ("subject_id",),
) -> DataFrame:
    """One page per subject, plus ``truncated``.

    ``limit + 1`` rows are ranked and the extra one only reports that more exist.
    The rank filter becomes a per-task top-k before the shuffle, so a busy subject
    ships at most ``limit + 1`` rows from each task.
    """
    if limit < 1 or (max_limit is not None and limit > max_limit):
        raise RequestError("INVALID_LIMIT", f"page limit {limit} is out of range")
    if after is not None:
        df = df.filter(after_key(time, ident, ts_lit(after[0]), F.lit(after[1])))
    order = Window.partitionBy(*keys).orderBy(time, ident)
    ranked = df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit + 1)
    return (
        ranked.withColumn(
            "truncated", F.max("_rank").over(Window.partitionBy(*keys)) > F.lit(limit)
        )
        .filter(F.col("_rank") <= limit)
        .drop("_rank")
    )


def continuation(
    page_df: DataFrame, time: str, ident: str, keys: Sequence[str] = ("subject_id",)
) -> DataFrame:
    """Key to resume from, for subjects whose page was truncated."""
    return (
        page_df.filter("truncated")
        .groupBy(*keys)
        .agg(F.max(F.struct(F.col(time), F.col(ident))).alias("_last"))
        .select(*keys, f"_last.{time}", f"_last.{ident}")
    )


def enforce_cap(
    df: DataFrame,
    cap: int | None,
    what: str,
    keys: Sequence[str] = ("subject_id",),
    order: Sequence[str] = (),
) -> DataFrame:
    """Fail when a subject exceeds the cap; rows are never cut. ``None`` switches it off.

    The check is part of the plan and needs one scan: rows are numbered by subject (in
    ``order``, if given), the limit of ``cap + 1`` is applied in every task before the
    shuffle, and a row numbered above the cap makes any read fail. The failure is an error
    of the job; :func:`reading` turns it into a :class:`RequestError`.
    """
    if cap is None:
        return df
    number = Window.partitionBy(*keys).orderBy(*(order or keys))
    ranked = df.withColumn("_row", F.row_number().over(number)).filter(F.col("_row") <= cap + 1)
    return within_cap(ranked, F.col("_row"), cap, what).select(*df.columns)


@contextmanager
def reading():
    """Around a read of a capped result: a cap that fails is a ``RequestError`` for the caller."""
    try:
        yield
    except Exception as error:
        found = re.search(rf"{TOO_LARGE}: ([^\n]*? rows)", str(error))
        if found is None:
            raise
        raise RequestError(TOO_LARGE, found.group(1)) from error


def within_cap(df: DataFrame, count: Column, cap: int | None, what: str) -> DataFrame:
    """``df``, failing on any read of it that meets a row whose ``count`` is above the cap."""
    if cap is None:
        return df
    message = F.lit(f"{TOO_LARGE}: {what}: a subject has more than {cap} rows")
    return df.filter(F.when(count > cap, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def top_codes(counts: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent codes, ties in code order."""
    return counts.orderBy(F.col("n").desc(), F.col("code")).limit(k)
