"""Forecast episodes: eligible anchors with history grid, future targets and context.

Every observation is a candidate anchor. All rules are band counts around the anchor
and are evaluated in one pass over (subject, chunk) windows; accepted anchors carry
their grid and targets along, so neither needs a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subjectseries.functions.scalars import (
    US_PER_MINUTE,
    episode_id,
    epoch_us,
    from_us,
    grid_us,
    minutes_to_us,
    offset_seconds,
    overlap_seconds,
    rate,
)
from subjectseries.operators import ranges
from subjectseries.operators.aggregates import code_counts
from subjectseries.operators.barrier import settled
from subjectseries.operators.bands import (
    BandPlan,
    chunked,
    first_code,
    largest_gap,
    unique_in_band,
    with_block_maxima,
)
from subjectseries.operators.chunks import expand_copies, halo_width
from subjectseries.operators.distribution import distribution
from subjectseries.plans.policies import EpisodePolicy

LONG = "bigint"

# Rejection codes.
MISSING_START = "MISSING_HISTORY_START"
AMBIGUOUS_START = "AMBIGUOUS_HISTORY_START"
TOO_FEW = "HISTORY_INSUFFICIENT_OBSERVATIONS"
NOT_INCREASING = "DUPLICATE_OR_NONINCREASING_HISTORY_TIMESTAMP"
GAP_TOO_LONG = "HISTORY_GAP_EXCEEDS_MAX"
AMBIGUOUS_GRID = "AMBIGUOUS_GRID_MAPPING"


def target_code(kind: str, horizon: int) -> str:
    return f"{kind}_TARGET_{horizon}M"


def evaluate_anchors(obs: DataFrame, policy: EpisodePolicy) -> DataFrame:
    """One row per distinct instant (``n`` copies) with all rule results.

    Columns: ``subject_id, us, n, start_us, history_count, max_gap_us, targets, slots,
    codes``. ``targets`` and ``slots`` are arrays in horizon and grid order.
    """
    history, tolerance = policy.history_us, policy.start_tolerance_us
    reach = policy.target_tolerance_us
    before = history + tolerance
    after = max(minutes_to_us(policy.max_horizon_minutes) + reach, tolerance)
    plan = BandPlan()

    start_count = plan.count(-history - tolerance, -history + tolerance)
    start_seen = unique_in_band(start_count, plan.last(-history + tolerance))
    history_count = plan.count(-history, 0)
    repeated = plan.repeated(-history, 0)

    targets, target_codes = [], []
    for minutes in policy.horizons_minutes:
        ideal = minutes_to_us(minutes)
        count = plan.count(max(1, ideal - reach), ideal + reach)
        missing = (count == 0, target_code("MISSING", minutes))
        ambiguous = (count > 1, target_code("AMBIGUOUS", minutes))
        target_codes += [missing, ambiguous]
        targets.append(
            F.struct(
                F.lit(minutes).cast(LONG).alias("horizon_minutes"),
                count.alias("count"),
                unique_in_band(count, plan.last(ideal + reach)).alias("hit"),
                F.when(*missing).when(*ambiguous).alias("code"),
            )
        )
    slots, crowded = [], F.lit(False)
    for index in range(policy.positions):
        at = index * policy.cadence_us - history
        is_last = index == policy.positions - 1
        # Slots are half-open; the last one is closed at the anchor.
        high = 0 if is_last else at + tolerance - 1
        count = plan.count(at - tolerance, high)
        crowded = crowded | (count > 1)
        slots.append(
            F.struct(
                count.alias("count"),
                unique_in_band(count, plan.last(high)).alias("hit"),
            )
        )

    enough = history_count >= 2
    # When all observations of the window are copies of one instant the only gap is zero.
    gap = F.when(enough, F.coalesce("max_gap_us", F.lit(0).cast(LONG)))
    duplicate = enough & (repeated > 0)
    codes = first_code(
        [
            (start_count == 0, MISSING_START),
            (start_count > 1, AMBIGUOUS_START),
            (~enough, TOO_FEW),
            (duplicate, NOT_INCREASING),
            (gap > minutes_to_us(policy.max_gap_minutes), GAP_TOO_LONG),
            *target_codes,
            (~duplicate & crowded, AMBIGUOUS_GRID),
        ]
    )
    width = halo_width(before, after)
    rows = largest_gap(with_block_maxima(chunked(obs, width, before, after), history), history)
    return settled(
        plan.apply(rows).filter("owned"),
        "subject_id",
        "us",
        "n",
        start_count.alias("start_count"),
        start_seen["us"].alias("start_us"),
        history_count.alias("history_count"),
        gap.alias("max_gap_us"),
        F.array(*targets).alias("targets"),
        F.array(*slots).alias("slots"),
        codes.alias("codes"),
    )


def accepted(evaluated: DataFrame) -> DataFrame:
    return evaluated.filter(F.size("codes") == 0)


def _named(evaluated: DataFrame, dataset_id: str) -> DataFrame:
    return accepted(evaluated).withColumn("episode_id", episode_id(dataset_id, "subject_id", "us"))


# --- tables --------------------------------------------------------------------------
def history_grid(evaluated: DataFrame, policy: EpisodePolicy, dataset_id: str) -> DataFrame:
    """Accepted episodes x grid slots; empty slots are null with mask false."""
    stamps = grid_us(F.col("us") - F.lit(policy.history_us), policy.cadence_us, policy.positions)
    zipped = F.zip_with(
        stamps,
        F.col("slots"),
        lambda g, s: F.struct(g.alias("grid_us"), s["count"].alias("count"), s["hit"].alias("hit")),
    )
    slot = F.col("s.hit")
    return _named(evaluated, dataset_id).select(
        "subject_id", "episode_id", F.posexplode(zipped).alias("grid_index", "s")
    ).select(
        "subject_id",
        "episode_id",
        F.col("grid_index").cast(LONG).alias("grid_index"),
        from_us("s.grid_us").alias("grid_timestamp_utc"),
        slot["value"].alias("glucose_mg_dl"),
        slot.isNotNull().alias("observed_mask"),
        from_us(slot["us"]).alias("source_timestamp_utc"),
        slot["source"].alias("source"),
    )


def targets(evaluated: DataFrame, dataset_id: str) -> DataFrame:
    """Accepted episodes x horizons with the one future observation of each."""
    ideal = F.col("us") + F.col("t.horizon_minutes") * F.lit(US_PER_MINUTE)
    return (
        _named(evaluated, dataset_id)
        .select("subject_id", "episode_id", "us", F.explode("targets").alias("t"))
        .select(
            "subject_id",
            "episode_id",
            F.col("t.horizon_minutes").alias("horizon_minutes"),
            from_us(ideal).alias("ideal_target_timestamp_utc"),
            from_us("t.hit.us").alias("target_source_timestamp_utc"),
            F.col("t.hit.value").alias("target_glucose_mg_dl"),
            offset_seconds(F.col("t.hit.us"), ideal).alias("target_offset_seconds"),
            F.col("t.hit.source").alias("source"),
        )
    )


EVENT_TYPES = ("meal", "workout", "sleep_interval", "weight")


def event_context(
    evaluated: DataFrame, tables: dict[str, DataFrame], policy: EpisodePolicy, dataset_id: str
) -> DataFrame:
    """Events of the history window: points in it (closed), intervals that overlap it.

    Intervals stay unclipped; their shared seconds are given. ``tables`` are snapshot
    tables. The points of both kinds go through one range join, as do the intervals.
    """
    windows = _named(evaluated, dataset_id).select(
        "subject_id", "episode_id", "us", (F.col("us") - F.lit(policy.history_us)).alias("low_us")
    )
    points = tables["meals"].select(
        "subject_id",
        F.lit("meal").alias("event_type"),
        F.col("meal_id").alias("event_id"),
        epoch_us("timestamp").alias("at_us"),
        "source",
    ).unionByName(
        tables["weight"].select(
            "subject_id",
            F.lit("weight").alias("event_type"),
            F.col("weight_id").alias("event_id"),
            epoch_us("timestamp").alias("at_us"),
            "source",
        )
    )
    spans = tables["workouts"].select(
        "subject_id",
        F.lit("workout").alias("event_type"),
        F.col("workout_id").alias("event_id"),
        epoch_us("start").alias("from_us"),
        epoch_us("end").alias("to_us"),
        "source",
    ).unionByName(
        tables["sleep"].select(
            "subject_id",
            F.lit("sleep_interval").alias("event_type"),
            F.col("sleep_id").alias("event_id"),
            epoch_us("start").alias("from_us"),
            epoch_us("end").alias("to_us"),
            "source",
        )
    )
    in_window = ranges.point_in_window(
        windows,
        points,
        low=F.col("low_us"),
        high=F.col("us"),
        us=F.col("at_us"),
        width_us=policy.history_us,
    ).select(
        "subject_id",
        "episode_id",
        "event_type",
        "event_id",
        from_us("at_us").alias("event_timestamp_utc"),
        "source",
    )
    met = ranges.interval_overlap(
        windows,
        spans,
        low=F.col("low_us"),
        high=F.col("us"),
        start_us=F.col("from_us"),
        end_us=F.col("to_us"),
        width_us=policy.history_us,
    ).select(
        "subject_id",
        "episode_id",
        "event_type",
        "event_id",
        from_us("from_us").alias("event_start_timestamp_utc"),
        from_us("to_us").alias("event_end_timestamp_utc"),
        "source",
        overlap_seconds("from_us", "to_us", "low_us", "us").alias("overlap_duration_seconds"),
    )
    return in_window.unionByName(met, allowMissingColumns=True)


def context_counts(events: DataFrame) -> DataFrame:
    """Events per episode and type."""
    counts = [
        F.count_if(F.col("event_type") == kind).alias(
            f"{'sleep' if kind == 'sleep_interval' else kind}_context_count"
        )
        for kind in EVENT_TYPES
    ]
    return events.groupBy("episode_id").agg(*counts)


def missing_slots(slots: str = "slots") -> Column:
    """Grid positions without a single observation."""
    return F.size(F.filter(slots, lambda s: s["count"] != 1)).cast(LONG)


def episodes(
    evaluated: DataFrame,
    policy: EpisodePolicy,
    dataset_id: str,
    lineage: dict[str, str] | None = None,
    events: DataFrame | None = None,
) -> DataFrame:
    """One row per accepted anchor, with policy, history statistics and context counts."""
    named = _named(evaluated, dataset_id)
    zero = F.lit(0).cast(LONG)
    names = ("meal", "workout", "sleep", "weight")
    if events is None:
        counted = named.withColumns({f"{n}_context_count": zero for n in names})
    else:
        counted = named.join(context_counts(events), "episode_id", "left").withColumns(
            {f"{n}_context_count": F.coalesce(f"{n}_context_count", zero) for n in names}
        )
    start = F.col("us") - F.lit(policy.history_us)
    furthest = F.col("us") + F.lit(minutes_to_us(policy.max_horizon_minutes))
    lineage_columns = [F.lit(v).alias(k) for k, v in (lineage or {}).items()]
    return counted.select(
        "subject_id",
        "episode_id",
        from_us("us").alias("anchor_timestamp_utc"),
        from_us(start).alias("history_start_timestamp_utc"),
        from_us("us").alias("history_end_timestamp_utc"),
        from_us(furthest).alias("maximum_target_timestamp_utc"),
        *lineage_columns,
        F.lit(policy.history_minutes).cast(LONG).alias("history_minutes"),
        F.lit(policy.cadence_minutes).cast(LONG).alias("grid_cadence_minutes"),
        F.lit(policy.positions).cast(LONG).alias("grid_position_count"),
        F.lit(float(policy.max_gap_minutes)).alias("max_history_gap_minutes"),
        F.lit(float(policy.start_tolerance_minutes)).alias("history_start_tolerance_minutes"),
        F.lit(float(policy.target_tolerance_minutes)).alias("target_tolerance_minutes"),
        F.array(*[F.lit(h).cast(LONG) for h in policy.horizons_minutes]).alias("horizons_minutes"),
        F.col("history_count").alias("history_observed_count"),
        missing_slots().alias("history_missing_grid_count"),
        (F.col("max_gap_us") / F.lit(float(US_PER_MINUTE))).alias(
            "history_max_observed_gap_minutes"
        ),
        from_us("start_us").alias("history_start_source_timestamp_utc"),
        from_us("us").alias("anchor_source_timestamp_utc"),
        *[f"{n}_context_count" for n in names],
    )


def rejected_anchors(
    evaluated: DataFrame, policy: EpisodePolicy, snapshot: str | None = None, spread: bool = False
) -> DataFrame:
    """One row per rejected observation with its codes and horizon diagnostics."""
    rows = expand_copies(evaluated.filter(F.size("codes") > 0).drop("slots"), "n", spread=spread)
    diagnostics = F.transform(
        "targets",
        lambda t: F.struct(
            t["horizon_minutes"].alias("horizon_minutes"),
            t["count"].alias("target_candidate_count"),
            t["code"].alias("rejection_code"),
        ),
    )
    return rows.select(
        "subject_id",
        from_us("us").alias("anchor_timestamp_utc"),
        F.lit(snapshot).cast("string").alias("snapshot_id"),
        from_us(F.col("us") - F.lit(policy.history_us)).alias("history_start_timestamp_utc"),
        F.lit("rejected").alias("status"),
        F.col("codes").alias("rejection_codes"),
        F.col("history_count").alias("history_observed_count"),
        (F.col("max_gap_us") / F.lit(float(US_PER_MINUTE))).alias(
            "history_max_observed_gap_minutes"
        ),
        diagnostics.alias("horizon_diagnostics"),
    )


# --- reports ---------------------------------------------------------------------------
def acceptance(evaluated: DataFrame, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Candidate, accepted and rejected counts and the acceptance rate."""
    ok = F.size("codes") == 0
    counted = evaluated.groupBy(*keys).agg(
        F.sum("n").alias("candidate_anchor_count"),
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("accepted_episode_count"),
        F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("rejected_anchor_count"),
    )
    return counted.withColumn(
        "acceptance_rate", rate("accepted_episode_count", "candidate_anchor_count")
    )


def rejections_by_code(evaluated: DataFrame) -> DataFrame:
    return code_counts(evaluated.filter(F.size("codes") > 0), "codes", "n")


def rejections_by_horizon(evaluated: DataFrame) -> DataFrame:
    return (
        evaluated.filter(F.size("codes") > 0)
        .select("n", F.explode("targets").alias("t"))
        .filter(F.col("t.code").isNotNull())
        .groupBy(F.col("t.horizon_minutes").alias("horizon_minutes"), F.col("t.code").alias("code"))
        .agg(F.sum("n").alias("n"))
    )


def history_quality(evaluated: DataFrame) -> DataFrame:
    """Distributions over accepted episodes of observed count, missing slots, largest gap."""
    measures = accepted(evaluated).select(
        F.explode(
            F.array(
                F.struct(F.lit("observed_count").alias("measure"), F.col("history_count").alias("v")),
                F.struct(F.lit("missing_grid_count").alias("measure"), missing_slots().alias("v")),
                F.struct(F.lit("max_gap_us").alias("measure"), F.col("max_gap_us").alias("v")),
            )
        ).alias("m")
    ).select("m.measure", "m.v")
    return distribution(measures, ["measure"], "v")


def target_quality(target_rows: DataFrame) -> DataFrame:
    """Offset distribution per horizon, in seconds."""
    offsets = target_rows.withColumn(
        "offset_us",
        epoch_us("target_source_timestamp_utc") - epoch_us("ideal_target_timestamp_utc"),
    )
    return distribution(offsets, ["horizon_minutes"], "offset_us", scale=1_000_000.0)


def target_sources(target_rows: DataFrame) -> DataFrame:
    return target_rows.groupBy(
        "horizon_minutes", F.coalesce("source", F.lit("<null>")).alias("source")
    ).agg(F.count(F.lit(1)).alias("n"))


def compare_readiness(
    evaluated: DataFrame, readiness: DataFrame, policy: EpisodePolicy, diagnostics_horizons: tuple[int, ...]
) -> DataFrame:
    """One row: how far unique readiness on all horizons and acceptance agree.

    Both sides have one row (or one per horizon) per distinct instant, so the join key
    never repeats. Counts weigh copies. When readiness does not cover anchors x
    horizons the status says so and the comparison counts are null.
    """
    wanted = F.array(*[F.lit(h).cast(LONG) for h in policy.horizons_minutes])
    per_anchor = readiness.groupBy("subject_id", "us").agg(
        F.sum("n").alias("_rows"),
        F.count_if(
            F.array_contains(wanted, F.col("horizon_minutes"))
            & (F.col("status") == "eligible_unique")
        ).alias("_unique"),
    )
    pairs = evaluated.select(
        "subject_id", "us", "n", (F.size("codes") == 0).alias("ok")
    ).join(per_anchor, ["subject_id", "us"], "full_outer")
    unique = F.coalesce(F.col("_unique") == len(policy.horizons_minutes), F.lit(False))
    zero = F.lit(0)

    def weigh(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), zero)

    totals = pairs.agg(
        F.coalesce(F.sum("n"), zero).alias("candidate_anchor_count"),
        F.coalesce(F.sum("_rows"), zero).alias("readiness_row_count"),
        weigh(unique).alias("_ua"),
        weigh(unique & ~F.col("ok")).alias("_ur"),
        weigh(~unique & F.col("ok")).alias("_nu"),
    )
    complete = F.lit(bool(diagnostics_horizons)) & (
        F.col("readiness_row_count")
        == F.col("candidate_anchor_count") * F.lit(len(diagnostics_horizons))
    )
    return totals.select(
        F.when(complete, "compared").otherwise("skipped_cardinality_mismatch").alias("status"),
        "candidate_anchor_count",
        "readiness_row_count",
        F.when(complete, F.col("_ua")).alias("unique_all_horizons"),
        F.when(complete, F.col("_ur")).alias("unique_but_rejected"),
        F.when(complete, F.col("_nu")).alias("accepted_but_not_unique"),
    )


# --- audits ------------------------------------------------------------------------------
def grid_violations(grid: DataFrame, policy: EpisodePolicy) -> DataFrame:
    """Grid rows or episodes that break the grid contract; empty when all is well."""
    us = epoch_us("grid_timestamp_utc")
    step = Window.partitionBy("episode_id").orderBy("grid_index")
    # One episode has a fixed number of slots, so this window is small by construction.
    rows = grid.withColumns(
        {
            "_index_step": F.col("grid_index") - F.lag("grid_index").over(step),
            "_time_step": us - F.lag(us).over(step),
        }
    )
    half = (
        F.col("glucose_mg_dl").isNull() | F.col("source_timestamp_utc").isNull()
    )
    leftover = (
        F.col("glucose_mg_dl").isNotNull()
        | F.col("source_timestamp_utc").isNotNull()
        | F.col("source").isNotNull()
    )
    problem = F.array_compact(
        F.array(
            F.when(F.col("_index_step") != 1, F.lit("index step")),
            F.when(F.col("_time_step") != policy.cadence_us, F.lit("cadence")),
            F.when(F.col("observed_mask") & half, F.lit("observed slot incomplete")),
            F.when(~F.col("observed_mask") & leftover, F.lit("missing slot not null")),
        )
    )
    by_row = rows.select("episode_id", F.explode(problem).alias("problem"))
    whole = grid.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("grid_index").alias("_lo"),
        F.max("grid_index").alias("_hi"),
        (F.max(us) - F.min(us)).alias("_span"),
    )
    bad = (
        (F.col("_n") != policy.positions)
        | (F.col("_lo") != 0)
        | (F.col("_hi") != policy.positions - 1)
        | (F.col("_span") != policy.history_us)
    )
    return by_row.unionByName(
        whole.filter(bad).select("episode_id", F.lit("grid extent").alias("problem"))
    )


def target_violations(target_rows: DataFrame, episode_rows: DataFrame, policy: EpisodePolicy) -> DataFrame:
    """Targets not after the anchor or too far off, and episodes lacking a horizon."""
    expected = F.array(*[F.lit(h).cast(LONG) for h in policy.horizons_minutes])
    joined = target_rows.join(
        episode_rows.select("episode_id", "anchor_timestamp_utc"), "episode_id"
    )
    by_row = joined.select(
        "episode_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        F.col("target_source_timestamp_utc") <= F.col("anchor_timestamp_utc"),
                        F.lit("target not after anchor"),
                    ),
                    F.when(
                        F.abs("target_offset_seconds") > policy.target_tolerance_minutes * 60,
                        F.lit("offset beyond tolerance"),
                    ),
                )
            )
        ).alias("problem"),
    )
    have = target_rows.groupBy("episode_id").agg(
        F.array_sort(F.collect_list("horizon_minutes")).alias("_have")
    )
    lacking = (
        episode_rows.select("episode_id")
        .join(have, "episode_id", "left")
        .filter(~F.col("_have").eqNullSafe(expected))
        .select("episode_id", F.lit("horizons incomplete").alias("problem"))
    )
    return by_row.unionByName(lacking)


def leakage(grid: DataFrame, events: DataFrame, episode_rows: DataFrame) -> DataFrame:
    """History or context from after the anchor, or intervals outside the window."""
    bounds = episode_rows.select(
        "episode_id", "anchor_timestamp_utc", "history_start_timestamp_utc"
    )
    anchor, start = F.col("anchor_timestamp_utc"), F.col("history_start_timestamp_utc")
    late_grid = grid.join(bounds, "episode_id").filter(
        (F.col("source_timestamp_utc") > anchor) | (F.col("grid_timestamp_utc") > anchor)
    )
    joined = events.join(bounds, "episode_id")
    late_point = joined.filter(F.col("event_timestamp_utc") > anchor)
    apart = joined.filter(
        ~(
            (F.col("event_start_timestamp_utc") < anchor)
            & (F.col("event_end_timestamp_utc") > start)
        )
    )
    parts = [
        late_grid.select("episode_id", F.lit("future history").alias("problem")),
        late_point.select("episode_id", F.lit("future event").alias("problem")),
        apart.select("episode_id", F.lit("interval outside window").alias("problem")),
    ]
    return reduce(DataFrame.unionByName, parts)


def changed_values(
    grid: DataFrame, target_rows: DataFrame, glucose: DataFrame
) -> DataFrame:
    """History and target values that no source row has at that time."""
    used = grid.filter("observed_mask").select(
        "subject_id",
        "episode_id",
        F.col("source_timestamp_utc").alias("timestamp"),
        "glucose_mg_dl",
    ).unionByName(
        target_rows.select(
            "subject_id",
            "episode_id",
            F.col("target_source_timestamp_utc").alias("timestamp"),
            F.col("target_glucose_mg_dl").alias("glucose_mg_dl"),
        )
    )
    source = glucose.select("subject_id", "timestamp", "glucose_mg_dl").distinct()
    return used.join(source, ["subject_id", "timestamp", "glucose_mg_dl"], "left_anti")
