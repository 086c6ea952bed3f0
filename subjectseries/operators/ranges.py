"""Range joins: equality on (subject, time bucket) plus a residual comparison.

Windows are copied to the buckets they meet. Points fall in one bucket. Intervals
are kept in tiers by length, so an interval meets at most two buckets of its own
tier however long it is (beyond the last tier it meets a few more). Each pair is
produced in exactly one bucket, hence no de-duplication afterwards. Both joins are
sort-merge joins: the planner does not see how many copies a row gets and would broadcast
them through the driver. Adaptive execution splits skewed buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjectseries.functions.scalars import bucket_index

TIER_FACTORS = (1, 32, 1024)


def point_in_window(
    windows: DataFrame,
    points: DataFrame,
    *,
    low: Column,
    high: Column,
    us: Column,
    width_us: int,
    closed_high: bool = True,
) -> DataFrame:
    """Pairs with ``low <= us <= high`` (or ``us < high``) for the same subject.

    Column names of the two sides must differ apart from ``subject_id``.
    """
    left = (
        windows.withColumn("_lo", low)
        .withColumn("_hi", high)
        .filter(F.col("_lo") <= F.col("_hi"))
        .withColumn(
            "_bucket",
            F.explode(F.sequence(bucket_index("_lo", width_us), bucket_index("_hi", width_us))),
        )
    )
    right = points.withColumn("_us", us).withColumn("_bucket", bucket_index("_us", width_us))
    below = F.col("_us") <= F.col("_hi") if closed_high else F.col("_us") < F.col("_hi")
    return (
        left.join(right.hint("merge"), ["subject_id", "_bucket"])
        .filter((F.col("_us") >= F.col("_lo")) & below)
        .drop("_bucket", "_lo", "_hi", "_us")
    )


def interval_overlap(
    windows: DataFrame,
    intervals: DataFrame,
    *,
    low: Column,
    high: Column,
    start_us: Column,
    end_us: Column,
    width_us: int,
) -> DataFrame:
    """Pairs where ``[start, end)`` and ``[low, high)`` share more than a boundary."""

    def tier_width(tier: Column) -> Column:
        chain = F.lit(TIER_FACTORS[-1] * width_us)
        for number in range(len(TIER_FACTORS) - 2, -1, -1):
            chain = F.when(tier == number, F.lit(TIER_FACTORS[number] * width_us)).otherwise(chain)
        return chain.cast("bigint")

    def bucket(value: Column, width: Column) -> Column:
        return F.call_function("div", value - F.pmod(value, width), width)

    length = F.col("_e") - F.col("_s")
    tier = F.lit(len(TIER_FACTORS) - 1)
    for number in range(len(TIER_FACTORS) - 2, -1, -1):
        tier = F.when(length <= TIER_FACTORS[number] * width_us, number).otherwise(tier)

    left = (
        windows.withColumn("_lo", low)
        .withColumn("_hi", high)
        .filter(F.col("_lo") < F.col("_hi"))
        .withColumn("_tier", F.explode(F.array(*[F.lit(i) for i in range(len(TIER_FACTORS))])))
        .withColumn("_w", tier_width(F.col("_tier")))
        .withColumn("_first", bucket(F.col("_lo"), F.col("_w")))
        .withColumn(
            "_bucket", F.explode(F.sequence("_first", bucket(F.col("_hi") - 1, F.col("_w"))))
        )
        .withColumnRenamed("_first", "_lfirst")
        .drop("_w")
    )
    right = (
        intervals.withColumn("_s", start_us)
        .withColumn("_e", end_us)
        .filter(F.col("_s") < F.col("_e"))
        .withColumn("_tier", tier)
        .withColumn("_w", tier_width(F.col("_tier")))
        .withColumn("_rfirst", bucket(F.col("_s"), F.col("_w")))
        .withColumn(
            "_bucket", F.explode(F.sequence("_rfirst", bucket(F.col("_e") - 1, F.col("_w"))))
        )
        .drop("_w")
    )
    meets = (F.col("_s") < F.col("_hi")) & (F.col("_e") > F.col("_lo"))
    first_shared = F.col("_bucket") == F.greatest("_lfirst", "_rfirst")
    return (
        left.join(right.hint("merge"), ["subject_id", "_tier", "_bucket"])
        .filter(meets & first_shared)
        .drop("_tier", "_bucket", "_lo", "_hi", "_lfirst", "_s", "_e", "_rfirst")
    )
