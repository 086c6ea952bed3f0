"""Structured Streaming jobs: file ingest, rollup and contiguous segments.

Rollup and segments come in two forms. ``maintain_...`` keeps mergeable parts in a versioned
store, one delta for each micro-batch under its epoch: what is read from the store is the
batch result of all rows so far, rows that come late and the newest buckets included.
``stream_...`` appends results once, as soon as the watermark has closed them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from subjectseries.functions.scalars import RESOLUTION_SECONDS, elapsed_minutes, exact_mean
from subjectseries.operators.aggregates import finished_rollup, merge_parts, rollup_parts
from subjectseries.operators.gaps import merge_segments, segments
from subjectseries.plans.ingest import ingest
from subjectseries.sources.store import MOST_DELTAS, VersionedStore


def stream_rollup(
    samples: DataFrame, time: str, value: str, resolution: str, watermark: str
) -> DataFrame:
    """Count, min, max, mean per subject and UTC bucket; late rows are dropped.

    State holds the open buckets only: one row per subject and bucket.
    """
    seconds = RESOLUTION_SECONDS[resolution]
    return (
        samples.withWatermark(time, watermark)
        .groupBy("subject_id", F.window(time, f"{seconds} seconds").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("sample_count"),
            F.min(value).alias("min_value"),
            F.max(value).alias("max_value"),
            exact_mean(value).alias("mean_value"),
        )
        .select(
            "subject_id",
            F.col("w.start").alias("bucket_start"),
            F.col("w.end").alias("bucket_end"),
            "sample_count",
            "min_value",
            "max_value",
            "mean_value",
        )
    )


def stream_segments(
    samples: DataFrame, time: str, max_gap_minutes: float, watermark: str
) -> DataFrame:
    """Contiguous segments as session windows; a segment is emitted once it is closed.

    A session ends one gap after its last row, and sessions that touch are merged, so
    a gap equal to the threshold does not split, as in the batch operator. Sessions
    are merged inside each task before the shuffle.
    """
    gap = f"{int(round(max_gap_minutes * 60_000))} milliseconds"
    return (
        samples.withWatermark(time, watermark)
        .groupBy("subject_id", F.session_window(time, gap).alias("w"))
        .agg(
            F.min(time).alias("start_timestamp_utc"),
            F.max(time).alias("end_timestamp_utc"),
            F.count(F.lit(1)).alias("observation_count"),
        )
        .select(
            "subject_id",
            "start_timestamp_utc",
            "end_timestamp_utc",
            "observation_count",
            elapsed_minutes("start_timestamp_utc", "end_timestamp_utc").alias("elapsed_minutes"),
        )
    )


def stream_ingest(
    documents: DataFrame, store: VersionedStore, checkpoint: str
) -> StreamingQuery:
    """Ingest each micro-batch of documents; a replayed batch changes nothing.

    Batches are told apart by epoch, so a retry overwrites its own audit rows.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        ingest(batch.sparkSession, batch, store, batch_label=f"epoch-{epoch:010d}")

    return (
        documents.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


ROLLUP_PARTS = T.StructType(
    [
        T.StructField("subject_id", T.StringType()),
        T.StructField("bucket_start", T.TimestampType()),
        T.StructField("sample_count", T.LongType()),
        T.StructField("_values", T.LongType()),
        T.StructField("_sum", T.DecimalType(20, 3)),
        T.StructField("min_value", T.DecimalType(10, 3)),
        T.StructField("max_value", T.DecimalType(10, 3)),
        T.StructField("_fresh", T.TimestampType()),
    ]
)
SEGMENT_PARTS = T.StructType(
    [
        T.StructField("subject_id", T.StringType()),
        T.StructField("start_us", T.LongType()),
        T.StructField("end_us", T.LongType()),
        T.StructField("n", T.LongType()),
    ]
)
_SUBJECT = ("subject_id",)


def _maintain(
    samples: DataFrame,
    store: VersionedStore,
    table: str,
    checkpoint: str,
    parts: Callable[[DataFrame], DataFrame],
    merge: Callable[[DataFrame], DataFrame],
    schema: T.StructType,
) -> StreamingQuery:
    """Commit the parts of every micro-batch once; fold them when there are many deltas.

    Spark gives a micro-batch that is run again the same epoch, so its label keeps its rows
    from being counted twice. Each stream has its own table.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        store.commit(table, parts(batch).select(*schema.names), "delta", _SUBJECT, f"epoch-{epoch:010d}")
        if store.deltas(table) > MOST_DELTAS:
            folded = merge(store.rows(table, schema, _SUBJECT).drop("_version"))
            store.commit(table, folded.select(*schema.names), "base", _SUBJECT)

    return (
        samples.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def maintain_rollup(
    samples: DataFrame, time: str, value: str, resolution: str, store: VersionedStore, checkpoint: str
) -> StreamingQuery:
    """Keep the rollup of a stream of samples; :func:`rollup_so_far` reads it."""

    def parts(batch: DataFrame) -> DataFrame:
        return rollup_parts(batch, time, value, resolution)

    return _maintain(samples, store, f"rollup_{resolution}", checkpoint, parts, merge_parts, ROLLUP_PARTS)


def rollup_so_far(store: VersionedStore, resolution: str, subjects: DataFrame | None = None) -> DataFrame:
    """The rollup of all rows that came so far, as the batch operator gives it.

    With ``subjects`` (column subject_id), only their partitions are read.
    """
    parts = store.rows(f"rollup_{resolution}", ROLLUP_PARTS, _SUBJECT, subjects).drop("_version")
    if subjects is not None:
        parts = parts.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    return finished_rollup(merge_parts(parts), resolution)


def maintain_segments(
    samples: DataFrame, time: str, max_gap_minutes: float, store: VersionedStore, checkpoint: str
) -> StreamingQuery:
    """Keep the contiguous segments of a stream; :func:`segments_so_far` reads them.

    A micro-batch adds the segments of its own rows. Read together, parts that overlap or lie
    within the gap are one, so a late row lengthens a segment or bridges two.
    """

    def parts(batch: DataFrame) -> DataFrame:
        times = batch.groupBy("subject_id", F.unix_micros(time).alias("us")).agg(F.count(F.lit(1)).alias("n"))
        return segments(times, max_gap_minutes)

    def merge(found: DataFrame) -> DataFrame:
        return merge_segments(found, max_gap_minutes)

    return _maintain(samples, store, "segments", checkpoint, parts, merge, SEGMENT_PARTS)


def segments_so_far(store: VersionedStore, max_gap_minutes: float) -> DataFrame:
    """The segments of all rows that came so far, as the batch operator gives them."""
    found = store.rows("segments", SEGMENT_PARTS, _SUBJECT).drop("_version")
    return merge_segments(found, max_gap_minutes)


def run_available(result: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, append the closed results to Parquet, and stop."""
    query = (
        result.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
