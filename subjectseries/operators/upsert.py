"""Keyed de-duplication and idempotent upsert with outcome classification."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjectseries.functions.scalars import source_type
from subjectseries.schemas import IDENTITY


def keep_last(df: DataFrame, order: Sequence[str], identity: Sequence[str] = IDENTITY) -> DataFrame:
    """One row per identity, the last in ``order``.

    Written as an aggregate rather than a ranking window: each task reduces its own
    rows first, so many copies of one identity do not meet in one task.
    """
    rest = [c for c in df.columns if c not in identity]
    latest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*identity).agg(latest.alias("_row")).select(*identity, "_row.*")


def differs(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """True when any pair is distinct, nulls comparing equal."""
    return reduce(lambda a, b: a | b, [~left.eqNullSafe(right) for left, right in pairs])


def classify(
    target: DataFrame,
    batch: DataFrame,
    meaningful: Sequence[str],
    identity: Sequence[str] = IDENTITY,
) -> DataFrame:
    """Match a de-duplicated batch to the stored table.

    One row per identity of either side: ``identity, stored, incoming, outcome``
    where outcome is inserted / updated / unchanged, or ``kept`` for stored rows the
    batch does not mention. Soft-deleted rows are never touched and count as
    unchanged.
    """
    stored = target.select(*identity, F.struct(*[c for c in target.columns if c not in identity]).alias("stored"))
    incoming = batch.select(*identity, F.struct(*[c for c in batch.columns if c not in identity]).alias("incoming"))
    both = stored.join(incoming, list(identity), "full_outer")
    changed = differs([(F.col(f"stored.{c}"), F.col(f"incoming.{c}")) for c in meaningful])
    outcome = (
        F.when(F.col("incoming").isNull(), "kept")
        .when(F.col("stored").isNull(), "inserted")
        .when(F.col("stored.deleted_at").isNotNull(), "unchanged")
        .when(changed, "updated")
        .otherwise("unchanged")
    )
    return both.withColumn("outcome", outcome)


def next_version(
    classified: DataFrame,
    meaningful: Sequence[str],
    columns: Sequence[str],
    now: Column,
    identity: Sequence[str] = IDENTITY,
) -> DataFrame:
    """Contents of the table after the upsert.

    ``ingested_at`` is set once; ``updated_at`` moves only on insert or change.
    """
    write = F.col("outcome").isin("inserted", "updated")
    out: list[Column] = []
    for name in columns:
        stored = F.col(f"stored.{name}") if name not in identity else None
        if name in identity:
            out.append(F.col(name))
        elif name in meaningful:
            out.append(F.when(write, F.col(f"incoming.{name}")).otherwise(stored).alias(name))
        elif name == "ingested_at":
            out.append(F.when(F.col("outcome") == "inserted", now).otherwise(stored).alias(name))
        elif name == "updated_at":
            out.append(F.when(write, now).otherwise(stored).alias(name))
        else:
            out.append(stored.alias(name))
    return classified.select(*out)


def upsert_sources(catalog: DataFrame, records: DataFrame) -> DataFrame:
    """One catalog row per (subject, source, source_name), a missing name being a value.

    A known type is kept when the new one is unknown.
    """
    seen = (
        records.select("subject_id", "source", "source_name")
        .distinct()
        .withColumn("source_type", source_type("source", "source_name"))
    )
    old, new = catalog.alias("old"), seen.alias("new")
    match = (
        (F.col("old.subject_id") == F.col("new.subject_id"))
        & (F.col("old.source") == F.col("new.source"))
        & F.col("old.source_name").eqNullSafe(F.col("new.source_name"))
    )
    either = [
        F.coalesce(f"new.{c}", f"old.{c}").alias(c)
        for c in ("subject_id", "source", "source_name", "source_type")
    ]
    return old.join(new, match, "full_outer").select(*either)
