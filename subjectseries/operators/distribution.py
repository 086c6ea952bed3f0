"""Exact statistics without holding a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTS = {"p50": 0.5, "p90": 0.9, "p95": 0.95}
_MANTISSA_BITS = 12


def _coarse(value: Column) -> Column:
    """Monotone bucket of a BIGINT: sign, power of two and the next 12 bits.

    At most about 2 x 64 x 4096 buckets exist, whatever the data.
    """
    size = F.abs(value)
    bits = F.length(F.bin(size))
    shift = F.greatest(bits - F.lit(_MANTISSA_BITS + 1), F.lit(0))
    step = F.call_function("shiftright", size, shift)
    bucket = shift.cast("bigint") * F.lit(1 << (_MANTISSA_BITS + 1)) + step
    return F.when(value < 0, -bucket - F.lit(1)).otherwise(bucket)


def distribution(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str | None = None,
    *,
    percents: dict[str, float] = PERCENTS,
    scale: float = 1.0,
    include_mean: bool = False,
) -> DataFrame:
    """Count, min, percentiles, max (and mean) of a BIGINT column, per non-null ``keys``.

    Percentiles interpolate linearly. They are found by rank in two passes over
    value frequencies: coarse buckets give the bucket of each wanted rank, and
    only the frequencies inside those buckets are ranked one by one. ``scale``
    divides the results, so exact integers go in and e.g. minutes come out.
    """
    keys = list(keys)
    weight_col = F.col(weight) if weight else F.lit(1).cast("bigint")
    # Nulls go before anything else: all branches below then read the same plan, and
    # the input is computed and shuffled once (exchange reuse).
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, value)])
    freq = (
        df.filter(present)
        .select(*keys, F.col(value).cast("bigint").alias("_v"), weight_col.alias("_n"))
        .groupBy(*keys, "_v")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_b", F.coalesce(_coarse(F.col("_v")), F.lit(0).cast("bigint")))
    )
    buckets = freq.groupBy(*keys, "_b").agg(
        F.sum("_n").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.sum(F.col("_v").cast("decimal(19,0)") * F.col("_n")).alias("_sum"),
    )
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ranked = buckets.select(
        *keys,
        "_b",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        F.sum("_n").over(upto).alias("_upto"),
        F.sum("_n").over(whole).alias("_total"),
    )
    # Wanted 0-based ranks: the two neighbours of p * (total - 1).
    wanted = [
        F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("_total") - 1)).alias("pos"))
        for name, p in percents.items()
    ]
    sides = (
        ranked.withColumn("_w", F.explode(F.array(*wanted)))
        .withColumn(
            "_side",
            F.explode(
                F.array(
                    F.struct(F.lit("lo").alias("s"), F.floor("_w.pos").alias("r")),
                    F.struct(F.lit("hi").alias("s"), F.ceil("_w.pos").alias("r")),
                )
            ),
        )
        .filter(F.col("_side.r").between(F.col("_before"), F.col("_upto") - 1))
        .select(
            *keys,
            "_b",
            (F.col("_side.r") - F.col("_before")).alias("_rank"),
            F.col("_w.name").alias("_name"),
            (F.col("_w.pos") - F.floor("_w.pos")).alias("_frac"),
            F.col("_side.s").alias("_s"),
        )
    )
    # One row per bucket that holds a wanted rank, so the join below never multiplies.
    targets = sides.groupBy(*keys, "_b").agg(
        F.collect_list(F.struct("_rank", "_name", "_frac", "_s")).alias("_t")
    )
    inside = freq.join(targets, [*keys, "_b"])
    within = (
        Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    hits = (
        inside.withColumn("_cum", F.sum("_n").over(within))
        .withColumn("_h", F.explode("_t"))
        .filter(
            (F.col("_h._rank") < F.col("_cum"))
            & (F.col("_h._rank") >= F.col("_cum") - F.col("_n"))
        )
    )
    lo = F.when(F.col("_h._s") == "lo", F.col("_v") * (F.lit(1.0) - F.col("_h._frac")))
    hi = F.when(F.col("_h._s") == "hi", F.col("_v") * F.col("_h._frac"))
    parts = hits.select(
        *keys,
        F.col("_h._name").alias("_name"),
        F.coalesce(lo, hi).alias("_part"),
    )
    points = parts.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("_name") == name, F.col("_part"))).alias(name)
            for name in percents
        ]
    )
    stats = buckets.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("count"),
        F.min("_min").alias("_lowest"),
        F.max("_max").alias("_highest"),
        F.sum("_sum").alias("_sum"),
    )
    joined = stats.join(points, keys, "left")
    out = [
        *keys,
        "count",
        (F.col("_lowest") / F.lit(scale)).alias("min"),
        *[(F.col(name) / F.lit(scale)).alias(name) for name in percents],
        (F.col("_highest") / F.lit(scale)).alias("max"),
    ]
    if include_mean:
        out.append(
            (F.col("_sum").cast("double") / F.col("count") / F.lit(scale)).alias("mean")
        )
    return joined.select(*out)


def frequency_median(df: DataFrame, keys: Sequence[str], value: str, places: int = 3) -> DataFrame:
    """Exact median per group of a decimal column with few distinct values.

    Equal values are counted first (spread over tasks by value), so what one
    group's aggregate holds is bounded by the value domain, not by its rows.
    Works on whole units of the last decimal place; interpolation is exact.
    """
    unit = 10**places
    counted = (
        df.select(*keys, (F.col(value) * F.lit(unit)).cast("bigint").alias("_v"))
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return counted.groupBy(*keys).agg(
        (F.percentile("_v", 0.5, F.col("_n")) / F.lit(float(unit))).alias("median")
    )
