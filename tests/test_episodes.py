from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import T0, glucose, minutes, regular
from subjectseries.plans import diagnostics as D
from subjectseries.plans import episodes as E
from subjectseries.session import materialize
from subjectseries.plans.policies import DiagnosticsPolicy, EpisodePolicy, PolicyError

ANCHOR = T0 + minutes(120)
POLICY = EpisodePolicy()


def evaluate(spark, times, policy=POLICY):
    return E.evaluate_anchors(D.glucose_observations(glucose(spark, times)), policy)


def codes_at(spark, times, anchor=ANCHOR, policy=POLICY):
    us = int(anchor.timestamp() * 1_000_000)
    return evaluate(spark, times, policy).filter(F.col("us") == us).first()


def test_regular_series_accepts_one_anchor(spark):
    row = codes_at(spark, regular())
    assert row.codes == [] and row.history_count == 25 and row.max_gap_us == 300_000_000
    assert E.accepted(evaluate(spark, regular())).count() == 1


@pytest.mark.parametrize("extra,code", [(0, None), (1, "HISTORY_GAP_EXCEEDS_MAX")])
def test_history_gap_limit_is_inclusive(spark, extra, code):
    kept = [t for t in regular() if t not in (T0 + minutes(30), T0 + minutes(35), T0 + minutes(40))]
    times = [t for t in kept if t != T0 + minutes(25)] + [T0 + minutes(25)]
    # 25 -> 40 minutes is exactly 15; one second more breaks the limit.
    times = [t for t in times if t != T0 + minutes(45)] + [T0 + minutes(40) + timedelta(seconds=extra), T0 + minutes(45)]
    row = codes_at(spark, sorted(times))
    assert ("HISTORY_GAP_EXCEEDS_MAX" in row.codes) == (code is not None)


def test_duplicate_history_suppresses_grid_code(spark):
    row = codes_at(spark, sorted(regular() + [T0 + minutes(60)]))
    assert "DUPLICATE_OR_NONINCREASING_HISTORY_TIMESTAMP" in row.codes
    assert "AMBIGUOUS_GRID_MAPPING" not in row.codes


def test_close_pair_is_an_ambiguous_slot(spark):
    row = codes_at(spark, sorted(regular() + [T0 + minutes(61)]))
    assert row.codes == ["AMBIGUOUS_GRID_MAPPING"]


def test_ambiguous_and_missing_targets(spark):
    two = codes_at(spark, sorted(regular() + [ANCHOR + minutes(31)]))
    assert two.codes == ["AMBIGUOUS_TARGET_30M"]
    none = codes_at(spark, [t for t in regular() if t != ANCHOR + minutes(60)])
    assert none.codes == ["MISSING_TARGET_60M"]


def test_missing_start(spark):
    row = codes_at(spark, regular()[1:])
    assert row.codes[0] == "MISSING_HISTORY_START"


def test_midpoint_fills_one_slot(spark):
    times = sorted([t for t in regular() if t not in (T0 + minutes(60), T0 + minutes(65))] + [T0 + minutes(62.5)])
    evaluated = evaluate(spark, times)
    row = evaluated.filter(F.col("us") == int(ANCHOR.timestamp() * 1e6)).first()
    hits = [i for i, s in enumerate(row.slots) if s["hit"] and s["hit"]["us"] == int((T0 + minutes(62.5)).timestamp() * 1e6)]
    assert hits == [13]
    grid = E.history_grid(evaluated, POLICY, "d")
    assert grid.filter("grid_index = 12").first().observed_mask is False


def test_rejected_rows_repeat_with_copies(spark):
    times = [T0, T0, T0]
    out = E.rejected_anchors(evaluate(spark, times), POLICY, "snap").collect()
    assert len(out) == 3 and out[0].history_observed_count == 3
    assert out[0].history_max_observed_gap_minutes == 0.0
    assert "DUPLICATE_OR_NONINCREASING_HISTORY_TIMESTAMP" in out[0].rejection_codes


def test_context_keeps_past_only(spark):
    points = "subject_id string, {i} string, timestamp timestamp, source string"
    spans = "subject_id string, {i} string, start timestamp, end timestamp, source string"
    tables = {
        "meals": spark.createDataFrame([("s", "in", ANCHOR, "m"), ("s", "late", ANCHOR + minutes(1), "m")], points.format(i="meal_id")),
        "weight": spark.createDataFrame([("s", "edge", T0, "k"), ("s", "early", T0 - minutes(1), "k")], points.format(i="weight_id")),
        "workouts": spark.createDataFrame(
            [("s", "touch", T0 - minutes(30), T0, "w"), ("s", "over", T0 - minutes(30), T0 + minutes(10), "w")], spans.format(i="workout_id")
        ),
        "sleep": spark.createDataFrame([("s", "future", ANCHOR, ANCHOR + minutes(5), "z")], spans.format(i="sleep_id")),
    }
    evaluated = materialize(evaluate(spark, regular()), "evaluated")
    events = E.event_context(evaluated, tables, POLICY, "d")
    got = {r.event_id: r.overlap_duration_seconds for r in events.collect()}
    assert got == {"in": None, "edge": None, "over": 600.0}
    rows = E.episodes(evaluated, POLICY, "d", {"snapshot_id": "x"}, events)
    assert (rows.first().meal_context_count, rows.first().sleep_context_count) == (1, 0)
    grid, hits = E.history_grid(evaluated, POLICY, "d"), E.targets(evaluated, "d")
    assert E.grid_violations(grid, POLICY).isEmpty()
    assert E.target_violations(hits, rows, POLICY).isEmpty()
    assert E.leakage(grid, events, rows).isEmpty()
    assert E.changed_values(grid, hits, glucose(spark, regular())).isEmpty()
    late = events.withColumn("event_timestamp_utc", F.col("event_timestamp_utc") + F.expr("interval 1 day"))
    assert not E.leakage(grid, late, rows).isEmpty()
    assert not E.grid_violations(grid.filter("grid_index <> 3"), POLICY).isEmpty()
    assert not E.target_violations(hits.filter("horizon_minutes <> 30"), rows, POLICY).isEmpty()


def test_readiness_ties_and_priority(spark):
    policy = DiagnosticsPolicy(horizons_minutes=(30,), minimum_history_minutes=0)
    times = [T0, T0 + minutes(28), T0 + minutes(32)]
    obs = D.glucose_observations(glucose(spark, times))
    row = D.forecast_readiness(obs, policy).filter(F.col("us") == int(T0.timestamp() * 1e6)).first()
    assert row.status == "eligible_ambiguous" and row.candidate_observation_count == 2
    assert row.nearest_offset_seconds == -120.0
    strict = DiagnosticsPolicy(horizons_minutes=(30,), minimum_history_minutes=120)
    row = D.forecast_readiness(obs, strict).filter(F.col("us") == int(T0.timestamp() * 1e6)).first()
    assert row.status == "insufficient_history" and row.candidate_observation_count == 2


def test_comparison_is_skipped_when_readiness_is_short(spark):
    obs = D.glucose_observations(glucose(spark, regular()))
    evaluated = E.evaluate_anchors(obs, POLICY)
    ready = D.readiness_by_instant(obs, DiagnosticsPolicy())
    full = E.compare_readiness(evaluated, ready, POLICY, (30, 60, 120)).first()
    assert full.status == "compared" and full.accepted_but_not_unique == 0
    short = E.compare_readiness(evaluated, ready.filter("horizon_minutes = 30"), POLICY, (30, 60, 120)).first()
    assert short.status == "skipped_cardinality_mismatch" and short.unique_all_horizons is None


def test_policies_refuse_bad_values():
    with pytest.raises(PolicyError):
        EpisodePolicy(history_minutes=121)
    with pytest.raises(PolicyError):
        EpisodePolicy(horizons_minutes=(60, 30))
    with pytest.raises(PolicyError):
        DiagnosticsPolicy(target_tolerance_minutes=30)
    with pytest.raises(PolicyError):
        DiagnosticsPolicy(gap_major_minutes=5)
