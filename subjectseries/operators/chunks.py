"""Time chunks, halos and per-chunk carries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subjectseries.functions.scalars import US_PER_DAY, bucket_index, epoch_us, integral_div

DEFAULT_CHUNK_US = US_PER_DAY


def observations(
    df: DataFrame,
    time: str,
    value: str,
    source: str | None = None,
    keys: Sequence[str] = ("subject_id",),
) -> DataFrame:
    """One row per distinct instant: ``keys, us, n, value, source``.

    ``n`` keeps the multiplicity, so copies of one instant, however many, are
    reduced before the first shuffle. ``value``/``source`` are only meaningful
    where ``n`` is 1; elsewhere the smallest is taken.
    """
    columns = [*keys, epoch_us(time).alias("us"), F.col(value).alias("value")]
    smallest = [F.min("value").alias("value")]
    if source:
        columns.append(F.col(source).alias("source"))
        smallest.append(F.min("source").alias("source"))
    grouped = df.select(*columns).groupBy(*keys, "us").agg(
        F.count(F.lit(1)).alias("n"), *smallest
    )
    return grouped if source else grouped.withColumn("source", F.lit(None).cast("string"))


def with_chunk(df: DataFrame, us: str = "us", width_us: int = DEFAULT_CHUNK_US) -> DataFrame:
    return df.withColumn("chunk", bucket_index(us, width_us))


def with_halo(
    df: DataFrame, width_us: int, before_us: int, after_us: int, us: str = "us"
) -> DataFrame:
    """Copy each row to the chunks that must see it.

    A chunk sees everything from ``before_us`` ahead of its start to ``after_us``
    past its end; ``owned`` marks the one copy that produces output.
    """
    first = bucket_index(F.col(us) - F.lit(after_us), width_us)
    last = bucket_index(F.col(us) + F.lit(before_us), width_us)
    return df.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn(
        "owned", F.col("chunk") == bucket_index(us, width_us)
    )


def halo_width(before_us: int, after_us: int, minimum_us: int = DEFAULT_CHUNK_US) -> int:
    """Chunk width at which halo copies add at most about a quarter more rows."""
    return max(minimum_us, 4 * (before_us + after_us))


def carry_forward(
    summary: DataFrame, value: str, keys: Sequence[str] = ("subject_id",)
) -> DataFrame:
    """For each ``(keys, chunk)``: the last non-null ``value`` of any earlier chunk."""
    earlier = (
        Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    return summary.select(
        *keys, "chunk", F.last(value, ignorenulls=True).over(earlier).alias(value)
    )


def adjacent_pairs(
    df: DataFrame,
    order: Sequence[str],
    payload: Column,
    keys: Sequence[str] = ("subject_id",),
) -> DataFrame:
    """Neighbours in ``order`` within ``keys``: columns ``keys, prev, next``.

    ``df`` carries ``chunk``, non-decreasing in ``order``. Neighbours inside a
    chunk come from a window over the chunk; the pair that crosses to the next
    non-empty chunk comes from the chunk's first and last rows.
    """
    rows = df.select(*keys, "chunk", F.struct(*order).alias("_o"), payload.alias("_p"))
    inside = (
        rows.withColumn(
            "prev", F.lag("_p").over(Window.partitionBy(*keys, "chunk").orderBy("_o"))
        )
        .filter(F.col("prev").isNotNull())
        .select(*keys, "prev", F.col("_p").alias("next"))
    )
    edges = rows.groupBy(*keys, "chunk").agg(
        F.min_by("_p", "_o").alias("next"), F.max_by("_p", "_o").alias("_last")
    )
    across = (
        edges.withColumn(
            "prev", F.lag("_last").over(Window.partitionBy(*keys).orderBy("chunk"))
        )
        .filter(F.col("prev").isNotNull())
        .select(*keys, "prev", "next")
    )
    return inside.unionByName(across)


def expand_copies(df: DataFrame, count: str = "n", block: int = 65_536, spread: bool = False) -> DataFrame:
    """Repeat each row ``count`` times.

    Expansion goes through blocks so that no large array is built. ``spread``
    shuffles at block level, which divides an instant with very many copies over
    tasks; use it when the result is written out.
    """
    blocks = integral_div(F.col(count) - 1, block)
    out = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks)))
    if spread:
        out = out.repartition("subject_id", "us", "_block")
    size = F.least(F.lit(block).cast("bigint"), F.col(count) - F.col("_block") * block)
    return (
        out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), size)))
        .withColumn("copy", F.col("copy") + F.col("_block") * block)
        .drop("_block")
    )
