"""Forecast episodes and their reports and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from subjectseries_queries.base import DATASET, DIAGNOSTICS, EPISODES, query, us
from subjectseries_queries.diagnostics_queries import DOUBLED, _readiness_sql
from subjectseries.operators.paging import top_codes
from subjectseries.plans import diagnostics as D
from subjectseries.plans import episodes as E
from subjectseries.plans.policies import EpisodePolicy

M = 60_000_000

# A second policy with overlapping slots: twice the tolerance exceeds the cadence.
DENSE = EpisodePolicy(
    history_minutes=1440,
    cadence_minutes=360,
    max_gap_minutes=1440,
    start_tolerance_minutes=240,
    target_tolerance_minutes=240,
    horizons_minutes=(720, 1440),
)


def evaluation_sql(policy: EpisodePolicy, source: str = "glucose") -> str:
    """Brute force: every anchor against every observation of the subject."""
    H, tol, reach = policy.history_us, policy.start_tolerance_us, policy.target_tolerance_us
    bands = {"start": f"b.us BETWEEN a.us - {H + tol} AND a.us - {H - tol}"}
    bands["hist"] = f"b.us BETWEEN a.us - {H} AND a.us"
    for h in policy.horizons_minutes:
        bands[f"t{h}"] = f"b.us > a.us AND b.us BETWEEN a.us + {h * M - reach} AND a.us + {h * M + reach}"
    last = policy.positions - 1
    for i in range(policy.positions):
        at = i * policy.cadence_us - H
        if i == last:
            bands[f"s{i}"] = f"b.us >= a.us + {at - tol} AND b.us <= a.us"
        else:
            bands[f"s{i}"] = f"b.us >= a.us + {at - tol} AND b.us < a.us + {at + tol}"
    aggs = ", ".join(
        f"coalesce(CAST(sum(b.n) FILTER ({c}) AS BIGINT), 0) AS {k}_n, min(b.us) FILTER ({c}) AS {k}_us, min(b.value) FILTER ({c}) AS {k}_v"
        for k, c in bands.items()
    )
    targets = ", ".join(
        f"CASE WHEN t{h}_n = 0 THEN 'MISSING_TARGET_{h}M' WHEN t{h}_n > 1 THEN 'AMBIGUOUS_TARGET_{h}M' END"
        for h in policy.horizons_minutes
    )
    crowded = " OR ".join(f"s{i}_n > 1" for i in range(policy.positions))
    return f"""o AS (SELECT subject_id, us, count(*) AS n, min(value) AS value FROM {source} GROUP BY 1, 2),
p AS (SELECT *, lag(us) OVER (PARTITION BY subject_id ORDER BY us) AS prev FROM o),
e0 AS (SELECT a.subject_id, a.us, a.n, {aggs},
  coalesce(bool_or(b.n > 1) FILTER ({bands['hist']}), false) AS dup,
  max(b.us - b.prev) FILTER (b.us <= a.us AND b.prev >= a.us - {H}) AS gap
FROM o a JOIN p b USING (subject_id) GROUP BY 1, 2, 3),
eva AS (SELECT *, CASE WHEN hist_n >= 2 THEN coalesce(gap, 0) END AS max_gap, concat_ws(',',
    CASE WHEN start_n = 0 THEN 'MISSING_HISTORY_START' WHEN start_n > 1 THEN 'AMBIGUOUS_HISTORY_START' END,
    CASE WHEN hist_n < 2 THEN 'HISTORY_INSUFFICIENT_OBSERVATIONS' END,
    CASE WHEN hist_n >= 2 AND dup THEN 'DUPLICATE_OR_NONINCREASING_HISTORY_TIMESTAMP' END,
    CASE WHEN hist_n >= 2 AND gap > {int(policy.max_gap_minutes * M)} THEN 'HISTORY_GAP_EXCEEDS_MAX' END,
    {targets},
    CASE WHEN NOT (hist_n >= 2 AND dup) AND ({crowded}) THEN 'AMBIGUOUS_GRID_MAPPING' END) AS codes
FROM e0),
ok AS (SELECT *, 'ep_' || strftime(make_timestamp(us), '%Y%m%dT%H%M%S%fZ') || '_' || substr(sha256('demo|' || subject_id || '|' ||
    CASE WHEN us % 1000000 = 0 THEN strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ')
         ELSE strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ') END), 1, 12) AS episode_id
  FROM eva WHERE codes = '')"""


BASE = evaluation_sql(EPISODES)
MISSING = " + ".join(f"CASE WHEN s{i}_n = 1 THEN 0 ELSE 1 END" for i in range(EPISODES.positions))
H = EPISODES.history_us


def _eval(t, policy=EPISODES):
    return E.evaluate_anchors(t.obs, policy)


@query("e1_candidate_anchors", "SELECT subject_id, us, count(*) AS n FROM glucose GROUP BY 1, 2")
def candidates(t):
    return _eval(t).select("subject_id", "us", "n")


RULES_SQL = "SELECT subject_id, us, n, start_n AS start_count, CASE WHEN start_n = 1 THEN start_us END AS start_us, hist_n AS history_count, max_gap, codes FROM eva"


def _rules(evaluated):
    return evaluated.select(
        "subject_id",
        "us",
        "n",
        "start_count",
        "start_us",
        "history_count",
        F.col("max_gap_us").alias("max_gap"),
        F.array_join("codes", ",").alias("codes"),
    )


@query("e2_history_start_rule", f"WITH {BASE} SELECT subject_id, us, start_n AS start_count, CASE WHEN start_n = 1 THEN start_us END AS start_us FROM eva")
def start_rule(t):
    return _eval(t).select("subject_id", "us", "start_count", "start_us")


@query("e3_history_rule", f"WITH {BASE} SELECT subject_id, us, hist_n AS history_count, max_gap FROM eva")
def history_rule(t):
    return _eval(t).select("subject_id", "us", "history_count", F.col("max_gap_us").alias("max_gap"))


_TARGET_ROWS = " UNION ALL ".join(
    f"SELECT subject_id, us, {h} AS horizon_minutes, t{h}_n AS n, CASE WHEN t{h}_n = 1 THEN t{h}_us END AS hit_us, CASE WHEN t{h}_n = 1 THEN t{h}_v END AS hit_value FROM eva"
    for h in EPISODES.horizons_minutes
)


@query("e4_target_rule", f"WITH {BASE} {_TARGET_ROWS}")
def target_rule(t):
    return _eval(t).select("subject_id", "us", F.explode("targets").alias("t")).select(
        "subject_id",
        "us",
        "t.horizon_minutes",
        F.col("t.count").alias("n"),
        F.col("t.hit.us").alias("hit_us"),
        F.col("t.hit.value").alias("hit_value"),
    )


_SLOT_ROWS = " UNION ALL ".join(
    f"SELECT subject_id, us, {i} AS slot, s{i}_n AS n FROM eva" for i in range(EPISODES.positions)
)


@query("e5_grid_slot_counts", f"WITH {BASE} {_SLOT_ROWS}")
def slot_counts(t):
    return _eval(t).select("subject_id", "us", F.posexplode("slots").alias("slot", "s")).select(
        "subject_id", "us", "slot", F.col("s.count").alias("n")
    )


@query("e6_rejection_codes", f"WITH {BASE} {RULES_SQL}")
def codes(t):
    return _rules(_eval(t))


@query("e6_rejection_codes_overlapping_slots", f"WITH {evaluation_sql(DENSE)} {RULES_SQL}")
def codes_dense(t):
    return _rules(_eval(t, DENSE))


@query("e6_rejection_codes_with_repeats", f"WITH {DOUBLED}, {evaluation_sql(EPISODES, 'dbl')} {RULES_SQL}")
def codes_repeats(t):
    return _rules(E.evaluate_anchors(t.doubled, EPISODES))


_EVENT_SQL = f"""events_in AS (
  SELECT k.subject_id, k.episode_id, 'meal' AS event_type, m.id AS event_id, m.us AS at, NULL AS s, NULL AS e, m.src AS source, NULL AS overlap_seconds
  FROM ok k JOIN meals m ON k.subject_id = m.subject_id AND m.us BETWEEN k.us - {H} AND k.us
  UNION ALL SELECT k.subject_id, k.episode_id, 'weight', m.id, m.us, NULL, NULL, m.src, NULL
  FROM ok k JOIN weight m ON k.subject_id = m.subject_id AND m.us BETWEEN k.us - {H} AND k.us
  UNION ALL SELECT k.subject_id, k.episode_id, 'workout', m.id, NULL, m.s, m.e, m.src, (least(m.e, k.us) - greatest(m.s, k.us - {H})) / 1e6
  FROM ok k JOIN workouts m ON k.subject_id = m.subject_id AND m.s < k.us AND m.e > k.us - {H}
  UNION ALL SELECT k.subject_id, k.episode_id, 'sleep_interval', m.id, NULL, m.s, m.e, m.src, (least(m.e, k.us) - greatest(m.s, k.us - {H})) / 1e6
  FROM ok k JOIN sleep m ON k.subject_id = m.subject_id AND m.s < k.us AND m.e > k.us - {H})"""


@query(
    "e7_episode_table",
    f"""WITH {BASE}, {_EVENT_SQL}, cnt AS (SELECT episode_id, count(*) FILTER (event_type = 'meal') AS meal,
  count(*) FILTER (event_type = 'workout') AS workout, count(*) FILTER (event_type = 'sleep_interval') AS sleep,
  count(*) FILTER (event_type = 'weight') AS weight FROM events_in GROUP BY 1)
SELECT subject_id, episode_id, us AS anchor, us - {H} AS history_start, us + {1440 * M} AS furthest, 5 AS positions,
  '720,1440' AS horizons, hist_n AS observed, {MISSING} AS missing, max_gap / 6e7 AS max_gap_minutes, start_us,
  coalesce(meal, 0) AS meal, coalesce(workout, 0) AS workout, coalesce(sleep, 0) AS sleep, coalesce(weight, 0) AS weight
FROM ok LEFT JOIN cnt USING (episode_id)""",
)
def episode_table(t):
    evaluated = t.evaluated
    events = E.event_context(evaluated, t.snap, EPISODES, DATASET)
    out = E.episodes(evaluated, EPISODES, DATASET, {"snapshot_id": "s"}, events)
    return out.select(
        "subject_id",
        "episode_id",
        us("anchor_timestamp_utc", "anchor"),
        us("history_start_timestamp_utc", "history_start"),
        us("maximum_target_timestamp_utc", "furthest"),
        F.col("grid_position_count").alias("positions"),
        F.array_join(F.col("horizons_minutes").cast("array<string>"), ",").alias("horizons"),
        F.col("history_observed_count").alias("observed"),
        F.col("history_missing_grid_count").alias("missing"),
        F.col("history_max_observed_gap_minutes").alias("max_gap_minutes"),
        us("history_start_source_timestamp_utc", "start_us"),
        F.col("meal_context_count").alias("meal"),
        F.col("workout_context_count").alias("workout"),
        F.col("sleep_context_count").alias("sleep"),
        F.col("weight_context_count").alias("weight"),
    )


_GRID_ROWS = " UNION ALL ".join(
    f"""SELECT subject_id, episode_id, {i} AS grid_index, us - {H} + {i * EPISODES.cadence_us} AS grid_us,
  CASE WHEN s{i}_n = 1 THEN s{i}_v END AS value, s{i}_n = 1 AS observed_mask, CASE WHEN s{i}_n = 1 THEN s{i}_us END AS source_us FROM ok"""
    for i in range(EPISODES.positions)
)


@query("e8_history_grid", f"WITH {BASE} {_GRID_ROWS}")
def history_grid(t):
    out = E.history_grid(_eval(t), EPISODES, DATASET)
    return out.select(
        "subject_id",
        "episode_id",
        "grid_index",
        us("grid_timestamp_utc", "grid_us"),
        F.col("glucose_mg_dl").alias("value"),
        "observed_mask",
        us("source_timestamp_utc", "source_us"),
    )


_OK_TARGETS = " UNION ALL ".join(
    f"SELECT subject_id, episode_id, {h} AS horizon_minutes, us + {h * M} AS ideal, t{h}_us AS hit, t{h}_v AS value, (t{h}_us - us - {h * M}) / 1e6 AS offset_seconds FROM ok"
    for h in EPISODES.horizons_minutes
)


@query("e9_targets", f"WITH {BASE} {_OK_TARGETS}")
def targets(t):
    out = E.targets(_eval(t), DATASET)
    return out.select(
        "subject_id",
        "episode_id",
        "horizon_minutes",
        us("ideal_target_timestamp_utc", "ideal"),
        us("target_source_timestamp_utc", "hit"),
        F.col("target_glucose_mg_dl").alias("value"),
        F.col("target_offset_seconds").alias("offset_seconds"),
    )


@query("e10_event_context", f"WITH {BASE}, {_EVENT_SQL} SELECT * FROM events_in")
def event_context(t):
    out = E.event_context(_eval(t), t.snap, EPISODES, DATASET)
    return out.select(
        "subject_id",
        "episode_id",
        "event_type",
        "event_id",
        us("event_timestamp_utc", "at"),
        us("event_start_timestamp_utc", "s"),
        us("event_end_timestamp_utc", "e"),
        "source",
        F.col("overlap_duration_seconds").alias("overlap_seconds"),
    )


@query(
    "e11_context_counts",
    f"""WITH {BASE}, {_EVENT_SQL} SELECT episode_id, count(*) FILTER (event_type = 'meal') AS meal_context_count,
  count(*) FILTER (event_type = 'workout') AS workout_context_count, count(*) FILTER (event_type = 'sleep_interval') AS sleep_context_count,
  count(*) FILTER (event_type = 'weight') AS weight_context_count FROM events_in GROUP BY 1""",
)
def context_counts(t):
    return E.context_counts(E.event_context(_eval(t), t.snap, EPISODES, DATASET))


@query(
    "f5_closed_history_membership",
    f"WITH {BASE} SELECT k.episode_id, m.id FROM ok k JOIN meals m ON k.subject_id = m.subject_id AND m.us >= k.us - {H} AND m.us <= k.us",
)
def history_membership(t):
    out = E.event_context(_eval(t), t.snap, EPISODES, DATASET)
    return out.filter(F.col("event_type") == "meal").select("episode_id", F.col("event_id").alias("id"))


_DIAG = " || ';' || ".join(
    f"'{h}:' || t{h}_n || ':' || CASE WHEN t{h}_n = 0 THEN 'MISSING_TARGET_{h}M' WHEN t{h}_n > 1 THEN 'AMBIGUOUS_TARGET_{h}M' ELSE '' END"
    for h in EPISODES.horizons_minutes
)


@query(
    "e12_rejected_anchors",
    f"""WITH {DOUBLED}, {evaluation_sql(EPISODES, 'dbl')} SELECT subject_id, us AS anchor, us - {H} AS history_start, 'rejected' AS status, codes,
  hist_n AS observed, max_gap / 6e7 AS max_gap_minutes, {_DIAG} AS horizons FROM eva, (SELECT unnest(range(2)) AS k) WHERE codes <> '' AND k < n""",
)
def rejected(t):
    out = E.rejected_anchors(E.evaluate_anchors(t.doubled, EPISODES), EPISODES, "s", spread=True)
    text = F.transform(
        "horizon_diagnostics",
        lambda d: F.concat(
            d["horizon_minutes"].cast("string"),
            F.lit(":"),
            d["target_candidate_count"].cast("string"),
            F.lit(":"),
            F.coalesce(d["rejection_code"], F.lit("")),
        ),
    )
    return out.select(
        "subject_id",
        us("anchor_timestamp_utc", "anchor"),
        us("history_start_timestamp_utc", "history_start"),
        "status",
        F.array_join("rejection_codes", ",").alias("codes"),
        F.col("history_observed_count").alias("observed"),
        F.col("history_max_observed_gap_minutes").alias("max_gap_minutes"),
        F.array_join(text, ";").alias("horizons"),
    )


@query(
    "e13_acceptance",
    f"""WITH {DOUBLED}, {evaluation_sql(EPISODES, 'dbl')} SELECT subject_id, CAST(sum(n) AS BIGINT) AS candidate_anchor_count,
  CAST(coalesce(sum(n) FILTER (codes = ''), 0) AS BIGINT) AS accepted_episode_count, CAST(coalesce(sum(n) FILTER (codes <> ''), 0) AS BIGINT) AS rejected_anchor_count,
  CAST(coalesce(sum(n) FILTER (codes = ''), 0) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS acceptance_rate FROM eva GROUP BY 1""",
)
def acceptance(t):
    return E.acceptance(E.evaluate_anchors(t.doubled, EPISODES))


_BY_CODE = "SELECT code, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, unnest(string_split(codes, ',')) AS code FROM eva WHERE codes <> '') GROUP BY 1"


@query("e13_rejections_by_code", f"WITH {DOUBLED}, {evaluation_sql(EPISODES, 'dbl')} {_BY_CODE}")
def by_code(t):
    return E.rejections_by_code(E.evaluate_anchors(t.doubled, EPISODES))


@query("t7_top_rejection_codes", f"WITH {BASE} SELECT * FROM ({_BY_CODE}) ORDER BY n DESC, code LIMIT 5")
def top_rejections(t):
    return top_codes(E.rejections_by_code(_eval(t)), 5)


_BY_HORIZON = " UNION ALL ".join(
    f"SELECT n, {h} AS horizon_minutes, CASE WHEN t{h}_n = 0 THEN 'MISSING_TARGET_{h}M' WHEN t{h}_n > 1 THEN 'AMBIGUOUS_TARGET_{h}M' END AS code FROM eva"
    for h in EPISODES.horizons_minutes
)


@query(
    "e13_rejections_by_horizon",
    f"WITH {BASE} SELECT horizon_minutes, code, CAST(sum(n) AS BIGINT) AS n FROM ({_BY_HORIZON}) WHERE code IS NOT NULL GROUP BY 1, 2",
)
def by_horizon(t):
    return E.rejections_by_horizon(_eval(t))


_Q = "count(*) AS count, CAST(min(v) AS DOUBLE) AS min, round(quantile_cont(v, 0.5), {p}) AS p50, round(quantile_cont(v, 0.9), {p}) AS p90, round(quantile_cont(v, 0.95), {p}) AS p95, CAST(max(v) AS DOUBLE) AS max"


@query(
    "e14_history_quality",
    f"""WITH {BASE}, m AS (SELECT 'observed_count' AS measure, CAST(hist_n AS DOUBLE) AS v FROM ok
  UNION ALL SELECT 'missing_grid_count', CAST({MISSING} AS DOUBLE) FROM ok UNION ALL SELECT 'max_gap_us', CAST(max_gap AS DOUBLE) FROM ok)
SELECT measure, {_Q.format(p=3)} FROM m GROUP BY 1""",
)
def history_quality(t):
    out = E.history_quality(t.evaluated)
    return out.withColumns({c: F.round(c, 3) for c in ("p50", "p90", "p95")})


@query(
    "e14_target_quality",
    f"""WITH {BASE}, m AS (SELECT horizon_minutes, CAST(hit - ideal AS DOUBLE) AS v FROM ({_OK_TARGETS}))
SELECT horizon_minutes, count(*) AS count, min(v) / 1e6 AS min, round(quantile_cont(v, 0.5) / 1e6, 8) AS p50,
  round(quantile_cont(v, 0.9) / 1e6, 8) AS p90, round(quantile_cont(v, 0.95) / 1e6, 8) AS p95, max(v) / 1e6 AS max FROM m GROUP BY 1""",
)
def target_quality(t):
    out = E.target_quality(E.targets(t.evaluated, DATASET))
    return out.withColumns({c: F.round(c, 8) for c in ("p50", "p90", "p95")})


@query(
    "e14_target_sources",
    f"""WITH {BASE}, m AS ({_OK_TARGETS}) SELECT horizon_minutes, coalesce(CASE WHEN g.event_type = 'error' THEN NULL ELSE g.src END, '<null>') AS source, count(*) AS n
FROM m JOIN glucose g ON g.subject_id = m.subject_id AND g.us = m.hit GROUP BY 1, 2""",
)
def target_sources(t):
    from subjectseries.operators.chunks import observations

    rows = t.events.select(
        "subject_id",
        "ts",
        "value",
        F.when(F.col("event_type") != "error", F.col("source")).alias("source"),
    )
    obs = observations(rows, "ts", "value", "source")
    return E.target_sources(E.targets(E.evaluate_anchors(obs, EPISODES), DATASET))


_COMPARE = """WITH {base}, {ready}, u AS (SELECT subject_id, anchor, bool_and(status = 'eligible_unique') AS uniq FROM readiness GROUP BY 1, 2)
SELECT 'compared' AS status, CAST(sum(n) AS BIGINT) AS candidate_anchor_count, CAST(sum(n) * 2 AS BIGINT) AS readiness_row_count,
  CAST(coalesce(sum(n) FILTER (uniq), 0) AS BIGINT) AS unique_all_horizons, CAST(coalesce(sum(n) FILTER (uniq AND codes <> ''), 0) AS BIGINT) AS unique_but_rejected,
  CAST(coalesce(sum(n) FILTER (NOT uniq AND codes = ''), 0) AS BIGINT) AS accepted_but_not_unique
FROM eva JOIN u ON eva.subject_id = u.subject_id AND eva.us = u.anchor"""
# Both parts define CTEs a/h/f/r and o/p/e0/eva/ok; the names do not clash.


@query("e15_readiness_comparison", _COMPARE.format(base=BASE, ready=_readiness_sql()))
def comparison(t):
    ready = D.readiness_by_instant(t.obs, DIAGNOSTICS)
    return E.compare_readiness(_eval(t), ready, EPISODES, DIAGNOSTICS.horizons_minutes)


@query(
    "j8_readiness_comparison_with_repeats",
    _COMPARE.format(base=f"{DOUBLED}, {evaluation_sql(EPISODES, 'dbl')}", ready=_readiness_sql("dbl")),
)
def comparison_repeats(t):
    ready = D.readiness_by_instant(t.doubled, DIAGNOSTICS)
    return E.compare_readiness(
        E.evaluate_anchors(t.doubled, EPISODES), ready, EPISODES, DIAGNOSTICS.horizons_minutes
    )


@query(
    "e16_audits",
    f"""WITH {BASE} SELECT a.audit, CAST(0 AS BIGINT) AS violations, (SELECT count(*) FROM ok) AS episodes
FROM (SELECT unnest(['changed values', 'grid', 'leakage', 'targets']) AS audit) a""",
)
def audits(t):
    """Each audit over the real outputs, with the number of episodes it covered."""
    evaluated = t.evaluated
    grid = E.history_grid(evaluated, EPISODES, DATASET)
    hits = E.targets(evaluated, DATASET)
    events = E.event_context(evaluated, t.snap, EPISODES, DATASET)
    rows = E.episodes(evaluated, EPISODES, DATASET)
    found = {
        "changed values": E.changed_values(grid, hits, t.snap["glucose"]),
        "grid": E.grid_violations(grid, EPISODES),
        "leakage": E.leakage(grid, events, rows),
        "targets": E.target_violations(hits, rows, EPISODES),
    }
    marks = rows.select(F.lit("").alias("audit"), F.lit(1).alias("ep"), F.lit(0).alias("bad"))
    names = F.array(*[F.lit(n) for n in found])
    marks = marks.withColumn("audit", F.explode(names))
    for name, df in found.items():
        marks = marks.unionByName(
            df.select(F.lit(name).alias("audit"), F.lit(0).alias("ep"), F.lit(1).alias("bad"))
        )
    return marks.groupBy("audit").agg(
        F.sum("bad").alias("violations"), F.sum("ep").alias("episodes")
    )


@query(
    "j9_value_provenance",
    f"""WITH {BASE}, used AS (SELECT subject_id, hit AS us, value + CASE WHEN horizon_minutes = 720 THEN 1 ELSE 0 END AS value, episode_id FROM ({_OK_TARGETS}))
SELECT subject_id, episode_id, us, value FROM used u WHERE NOT EXISTS (
  SELECT 1 FROM glucose g WHERE g.subject_id = u.subject_id AND g.us = u.us AND g.value = u.value)""",
)
def provenance(t):
    """Targets of one horizon are altered first, so the audit has something to find."""
    evaluated = t.evaluated
    altered = E.targets(evaluated, DATASET).withColumn(
        "target_glucose_mg_dl",
        F.col("target_glucose_mg_dl") + F.when(F.col("horizon_minutes") == 720, 1).otherwise(0),
    )
    found = E.changed_values(E.history_grid(evaluated, EPISODES, DATASET), altered, t.snap["glucose"])
    return found.select(
        "subject_id", "episode_id", us("timestamp", "us"), F.col("glucose_mg_dl").alias("value")
    )
