"""Adjacent gaps, contiguous segments and source-order checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subjectseries.functions.scalars import bucket_index, minutes_to_us
from subjectseries.operators.chunks import DEFAULT_CHUNK_US, adjacent_pairs, with_chunk


def time_gaps(obs: DataFrame, width_us: int = DEFAULT_CHUNK_US) -> DataFrame:
    """Positive gaps between consecutive instants: ``subject_id, prev_us, next_us, gap_us``.

    ``obs`` comes from :func:`observations`; repeated instants add ``n - 1`` gaps
    of zero, which :func:`zero_gaps` counts.
    """
    pairs = adjacent_pairs(with_chunk(obs, "us", width_us), ["us"], F.col("us"))
    return pairs.select(
        "subject_id",
        F.col("prev").alias("prev_us"),
        F.col("next").alias("next_us"),
        (F.col("next") - F.col("prev")).alias("gap_us"),
    )


def zero_gaps(obs: DataFrame) -> DataFrame:
    """Gaps of length zero, as a weight per instant."""
    return obs.filter(F.col("n") > 1).select("subject_id", (F.col("n") - 1).alias("n"))


def gap_weights(obs: DataFrame, width_us: int = DEFAULT_CHUNK_US) -> DataFrame:
    """Every adjacent gap with a multiplicity: ``subject_id, gap_us, n``."""
    positive = time_gaps(obs, width_us).select("subject_id", "gap_us", F.lit(1).cast("bigint").alias("n"))
    zero = zero_gaps(obs).select("subject_id", F.lit(0).cast("bigint").alias("gap_us"), "n")
    return positive.unionByName(zero)


def segments(
    obs: DataFrame, max_gap_minutes: float, width_us: int = DEFAULT_CHUNK_US
) -> DataFrame:
    """Runs without a gap longer than the threshold: ``subject_id, start_us, end_us, n``.

    Runs are first formed inside chunks. A run that neither opens nor closes its
    chunk is final; the others (at most two per chunk) are stitched together.
    """
    limit = minutes_to_us(max_gap_minutes)
    by_chunk = Window.partitionBy("subject_id", "chunk")
    ordered = by_chunk.orderBy("us")
    breaks = (F.col("us") - F.lag("us").over(ordered)) > limit
    local = (
        with_chunk(obs, "us", width_us)
        .withColumn("_break", F.coalesce(breaks, F.lit(False)).cast("int"))
        .withColumn(
            "_run", F.sum("_break").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        )
        .groupBy("subject_id", "chunk", "_run")
        .agg(
            F.min("us").alias("start_us"),
            F.max("us").alias("end_us"),
            F.sum("n").alias("n"),
        )
        .withColumn("_next_run", F.lead("_run").over(by_chunk.orderBy("_run")))
    )
    is_edge = (F.col("_run") == 0) | F.col("_next_run").isNull()
    final = local.filter(~is_edge).select("subject_id", "start_us", "end_us", "n")

    along = Window.partitionBy("subject_id").orderBy("start_us")
    opens = (F.col("start_us") - F.lag("end_us").over(along)) > limit
    stitched = (
        local.filter(is_edge)
        .withColumn("_opens", F.coalesce(opens, F.lit(False)).cast("int"))
        .withColumn("_seg", F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("subject_id", "_seg")
        .agg(
            F.min("start_us").alias("start_us"),
            F.max("end_us").alias("end_us"),
            F.sum("n").alias("n"),
        )
        .drop("_seg")
    )
    return final.unionByName(stitched)


def merge_segments(
    parts: DataFrame, max_gap_minutes: float, width_us: int = DEFAULT_CHUNK_US
) -> DataFrame:
    """Segments of rows that came in several batches, from the segments of each batch.

    ``parts`` has ``subject_id, start_us, end_us, n``; parts that overlap, or lie no further
    apart than the gap, are one segment. In order of their starts, the segment that is open is
    the one with the latest end, so what a time chunk needs of the earlier ones is that end,
    and only a chunk's first and last segment can go on in another.
    """
    limit = minutes_to_us(max_gap_minutes)
    placed = with_chunk(parts, "start_us", width_us)
    before = Window.partitionBy("subject_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    reach = placed.groupBy("subject_id", "chunk").agg(F.max("end_us").alias("_end"))
    reach = reach.withColumn("_reach", F.max("_end").over(before)).drop("_end")
    by_chunk = Window.partitionBy("subject_id", "chunk")
    ordered = by_chunk.orderBy("start_us", "end_us")
    latest = F.greatest("_reach", F.max("end_us").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.coalesce(F.col("start_us") - F.col("_latest") > limit, F.lit(True))
    local = (
        placed.join(reach, ["subject_id", "chunk"])
        .withColumn("_latest", latest)
        .withColumn("_opens", opens.cast("int"))
        .withColumn("_run", F.sum("_opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("subject_id", "chunk", "_run")
        .agg(
            F.max("_opens").alias("_opens"),
            F.min("start_us").alias("start_us"),
            F.max("end_us").alias("end_us"),
            F.sum("n").alias("n"),
        )
        .withColumn("_last", F.lead("_run").over(by_chunk.orderBy("_run")).isNull())
    )
    is_edge = (F.col("_opens") == 0) | F.col("_last")
    final = local.filter(~is_edge).select("subject_id", "start_us", "end_us", "n")
    along = Window.partitionBy("subject_id").orderBy("chunk", "_run").rowsBetween(Window.unboundedPreceding, 0)
    stitched = (
        local.filter(is_edge)
        .withColumn("_seg", F.sum("_opens").over(along))
        .groupBy("subject_id", "_seg")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n"))
        .drop("_seg")
    )
    return final.unionByName(stitched)


def out_of_order(
    df: DataFrame,
    sequence: str,
    sort_key: Column,
    keys: Sequence[str] = ("subject_id",),
    rows_per_chunk: int = 1_000_000,
) -> DataFrame:
    """Adjacent source rows whose sort key decreases: ``keys, out_of_order_pairs``.

    ``sequence`` is the ingest order. Keys without any such pair are listed with 0.
    """
    ranked = df.withColumn("chunk", bucket_index(sequence, rows_per_chunk))
    pairs = adjacent_pairs(ranked, [sequence], sort_key, keys)
    late = pairs.select(*keys, (F.col("next") < F.col("prev")).cast("bigint").alias("late"))
    present = df.select(*keys, F.lit(0).cast("bigint").alias("late"))
    return (
        late.unionByName(present).groupBy(*keys).agg(F.sum("late").alias("out_of_order_pairs"))
    )
