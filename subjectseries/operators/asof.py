"""Latest event at or before each anchor, within a bounded lookback."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from subjectseries.functions.scalars import epoch_us
from subjectseries.operators.chunks import DEFAULT_CHUNK_US, with_chunk


def latest_at(
    events: DataFrame, time: str, ident: str, columns: Sequence[str], name: str = "latest"
) -> DataFrame:
    """Latest row per subject (ties by id, descending), as a struct column ``name``.

    A plain aggregate: partial maxima are formed before the shuffle.
    """
    ranked = F.struct(F.col(time), F.col(ident), *[F.col(c) for c in columns if c not in (time, ident)])
    return events.groupBy("subject_id").agg(F.max(ranked).alias(name))


@dataclass(frozen=True)
class Lookup:
    """What to find for each anchor: the latest of ``events``, not older than ``lookback_us``."""

    events: DataFrame
    time: str
    ident: str
    columns: Sequence[str]
    lookback_us: int
    name: str

    def payload(self) -> Column:
        return F.struct(
            epoch_us(self.time).alias("us"),
            F.col(self.ident).alias("id"),
            *[F.col(c).alias(c) for c in self.columns],
        )


def asof_lookups(
    anchors: DataFrame,
    lookups: Sequence[Lookup],
    *,
    anchor_time: str,
    width_us: int = DEFAULT_CHUNK_US,
) -> DataFrame:
    """Add a struct (``us, id, *columns``) per lookup to every anchor row; null when none.

    Anchors and the events of all lookups are one tagged union, shuffled once by (subject,
    chunk) and scanned once in time order. What a chunk needs of earlier ones is the latest
    event of each lookup, carried over the chunks' last rows for as long as the lookback lasts.
    Nothing is joined to events, so neither busy subjects nor long lookbacks multiply rows.

    Repeated anchors stay repeated; of events at one instant the largest id counts; null
    subjects and times find nothing.
    """
    values = [f"_ev{i}" for i in range(len(lookups))]
    # An anchor is its subject and instant; only further columns travel as a payload. Without
    # one, the scan of anchors and of chunk ends are of the same exchange.
    plain = isinstance(anchors.schema[anchor_time].dataType, TimestampType)
    rest = [c for c in anchors.columns if c != "subject_id" and not (plain and c == anchor_time)]
    lanes = [
        anchors.select(
            "subject_id",
            epoch_us(anchor_time).alias("_us"),
            F.lit(1).alias("_kind"),
            *([F.struct(*rest).alias("_anchor")] if rest else []),
        )
    ]
    for value, lookup in zip(values, lookups):
        found = lookup.events.select("subject_id", lookup.payload().alias(value))
        lanes.append(
            found.select("subject_id", F.col(value)["us"].alias("_us"), F.lit(0).alias("_kind"), value).filter(
                F.col("_us").isNotNull() & F.col("subject_id").isNotNull()
            )
        )
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lanes)
    in_time = Window.partitionBy("subject_id", "chunk").orderBy("_us", "_kind", *values)
    so_far = in_time.rowsBetween(Window.unboundedPreceding, 0)
    scanned = with_chunk(merged, "_us", width_us).withColumns(
        {
            **{v: F.last(v, ignorenulls=True).over(so_far) for v in values},
            "_ends": F.lead("_kind").over(in_time).isNull(),
        }
    )
    carried = scanned.filter("_ends").select("subject_id", "chunk", *values)
    earlier = Window.partitionBy("subject_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumns({v: F.last(v, ignorenulls=True).over(earlier) for v in values})
    begins = F.col("chunk") * F.lit(width_us)
    before = {
        f"_before{v}": F.when(F.col(v)["us"] >= begins - F.lit(lookup.lookback_us), F.col(v))
        for v, lookup in zip(values, lookups)
    }
    some = reduce(Column.__or__, [F.col(name).isNotNull() for name in before])
    carried = carried.select("subject_id", "chunk", *[v.alias(name) for name, v in before.items()]).filter(some)
    # Keys that cannot be null keep the optimizer from filtering one of two equal exchanges. Null
    # keys have no events, so none of them is left here.
    any_subject = F.lit("0").cast(merged.schema["subject_id"].dataType)
    carried = carried.select(
        F.coalesce("subject_id", any_subject).alias("subject_id"),
        F.coalesce("chunk", F.lit(0).cast("long")).alias("chunk"),
        *before,
    )
    at = scanned.filter(F.col("_kind") == 1).join(carried, ["subject_id", "chunk"], "left")
    latest = {v: F.coalesce(v, f"_before{v}") for v in values}
    kept = {
        "subject_id": F.col("subject_id"),
        **({anchor_time: F.timestamp_micros("_us")} if plain else {}),
        **{c: F.col("_anchor")[c] for c in rest},
    }
    return at.select(
        *[kept[c].alias(c) for c in anchors.columns],
        *[
            F.when(latest[v]["us"] >= F.col("_us") - F.lit(lookup.lookback_us), latest[v]).alias(lookup.name)
            for v, lookup in zip(values, lookups)
        ],
    )


def asof_join(
    anchors: DataFrame,
    events: DataFrame,
    *,
    anchor_time: str,
    event_time: str,
    event_id: str,
    columns: Sequence[str],
    lookback_us: int,
    name: str,
    width_us: int = DEFAULT_CHUNK_US,
) -> DataFrame:
    """:func:`asof_lookups` with one lookup."""
    lookup = Lookup(events, event_time, event_id, columns, lookback_us, name)
    return asof_lookups(anchors, [lookup], anchor_time=anchor_time, width_us=width_us)
