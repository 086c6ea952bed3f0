"""Ordered operators against brute force, with busy subjects and repeated instants."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from subjectseries.operators import gaps, ranges
from subjectseries.operators.asof import Lookup, asof_join, asof_lookups
from subjectseries.operators.bands import BandPlan, chunked, largest_gap, with_block_maxima
from subjectseries.operators.chunks import expand_copies, observations
from subjectseries.operators.distribution import distribution

UNIT = 1_000_000


def random_times(seed, subjects=4, hot=400, rest=40, span=20_000):
    rng = random.Random(seed)
    rows = []
    for s in range(subjects):
        n = hot if s == 0 else rest
        rows += [(f"s{s}", rng.randrange(span) * UNIT) for _ in range(n)]
    # One instant with many copies.
    rows += [("s0", 777 * UNIT)] * 60
    return rows


@pytest.fixture(scope="module")
def series(spark):
    rows = random_times(7)
    df = spark.createDataFrame(rows, "subject_id string, us long").select(
        "subject_id", F.timestamp_micros("us").alias("t"), F.lit(1.0).alias("v")
    )
    by_subject = {}
    for s, us in rows:
        by_subject.setdefault(s, []).append(us)
    return observations(df, "t", "v"), {s: sorted(v) for s, v in by_subject.items()}


def test_gaps_cross_chunks(series):
    obs, raw = series
    got = {(r.subject_id, r.prev_us, r.next_us) for r in gaps.time_gaps(obs, 300 * UNIT).collect()}
    want = set()
    for s, times in raw.items():
        distinct = sorted(set(times))
        want |= {(s, a, b) for a, b in zip(distinct, distinct[1:])}
    assert got == want


def test_zero_gaps_count_copies(series):
    obs, raw = series
    got = sum(r.n for r in gaps.zero_gaps(obs).collect())
    assert got == sum(len(v) - len(set(v)) for v in raw.values())


@pytest.mark.parametrize("limit_minutes", [0.5, 2, 10])
def test_segments_are_stitched(series, limit_minutes):
    obs, raw = series
    got = {tuple(r) for r in gaps.segments(obs, limit_minutes, 300 * UNIT).select("subject_id", "start_us", "end_us", "n").collect()}
    want = set()
    for s, times in raw.items():
        start, last, n = times[0], times[0], 0
        for t in times:
            if t - last > limit_minutes * 60 * UNIT:
                want.add((s, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        want.add((s, start, last, n))
    assert got == want


@pytest.mark.parametrize("span_s", [30, 600, 5000])
def test_bands_and_largest_gap(series, span_s):
    obs, raw = series
    span, low, high = span_s * UNIT, 100 * UNIT, 400 * UNIT
    plan = BandPlan()
    history, future = plan.count(-span, 0), plan.count(low, high)
    repeated, hit = plan.repeated(-span, 0), plan.last(high)
    rows = chunked(obs, 1000 * UNIT, span, high)
    out = plan.apply(largest_gap(with_block_maxima(rows, span), span)).filter("owned")
    got = {
        (r.subject_id, r.us): (r.h, r.f, r.rep, r.hit if r.f == 1 else None, r.max_gap_us)
        for r in out.select(
            "subject_id", "us", history.alias("h"), future.alias("f"), repeated.alias("rep"),
            hit["us"].alias("hit"), "max_gap_us",
        ).collect()
    }
    for s, times in raw.items():
        counts = Counter(times)
        distinct = sorted(counts)
        for t in distinct:
            inside = [x for x in distinct if t - span <= x <= t]
            ahead = [x for x in times if t + low <= x <= t + high]
            steps = [b - a for a, b in zip(inside, inside[1:])]
            want = (
                sum(counts[x] for x in inside),
                len(ahead),
                sum(counts[x] > 1 for x in inside),
                ahead[0] if len(ahead) == 1 else None,
                max(steps) if steps else None,
            )
            assert got[(s, t)] == want
    assert len(got) == sum(len(set(v)) for v in raw.values())


def test_asof_ties_bounds_and_far_carry(spark):
    day = 86_400 * UNIT
    events = [("s", 0, "a"), ("s", 10 * day, "b"), ("s", 10 * day, "c"), ("x", 5, "z")]
    anchors = [("s", 10 * day - 1), ("s", 10 * day), ("s", 30 * day), ("s", 40 * day), ("s", 40 * day + 1), ("q", 3)]
    ev = spark.createDataFrame(events, "subject_id string, us long, id string").withColumn("t", F.timestamp_micros("us"))
    an = spark.createDataFrame(anchors, "subject_id string, us long").withColumn("anchor", F.timestamp_micros("us"))
    out = asof_join(an, ev, anchor_time="anchor", event_time="t", event_id="id", columns=[], lookback_us=30 * day, name="e")
    got = {(r.subject_id, r.us): (r.e.id if r.e else None) for r in out.collect()}
    assert got == {
        ("s", 10 * day - 1): "a",
        ("s", 10 * day): "c",
        ("s", 30 * day): "c",
        ("s", 40 * day): "c",
        ("s", 40 * day + 1): None,
        ("q", 3): None,
    }


def test_asof_lookups_against_brute_force(spark):
    rng = random.Random(11)
    names = {"a": (900 * UNIT, 400), "b": (5000 * UNIT, 60), "c": (40 * UNIT, 300)}
    events = {
        name: [(rng.choice("ssst"), rng.randrange(4000) * UNIT, f"{name}{rng.randrange(50)}") for _ in range(n)] + [("s", None, "none")]
        for name, (_, n) in names.items()
    }
    anchors = [(rng.choice("sstq"), rng.randrange(-10, 9000) * UNIT, k % 7) for k in range(200)]
    anchors += anchors[:5] + [("s", None, 0), (None, 7, 0)]
    events["b"] += [(None, 5, "nobody")]
    lookups = [
        Lookup(spark.createDataFrame(events[name], "subject_id string, us long, id string").withColumn("t", F.timestamp_micros("us")), "t", "id", [], back, name)
        for name, (back, _) in names.items()
    ]
    frame = spark.createDataFrame(anchors, "subject_id string, at long, a int").select("subject_id", F.timestamp_micros("at").alias("anchor"), F.col("a").alias("_us"))

    def latest(name, subject, at):
        fitting = [(t, i) for s, t, i in events[name] if s == subject and None not in (s, t, at) and at - names[name][0] <= t <= at]
        return max(fitting, default=None)

    def found(out):
        at = F.unix_micros("anchor").alias("at")
        return [(r.subject_id, r.at, *((v.us, v.id) if v else None for v in (r.a, r.b, r.c))) for r in out.select("subject_id", at, *names).collect()]

    want = Counter((s, at, *(latest(name, s, at) for name in names)) for s, at, _ in anchors)
    for an in (frame, frame.drop("_us")):
        out = asof_lookups(an, lookups, anchor_time="anchor", width_us=300 * UNIT)
        assert out.columns == [*an.columns, *names]
        assert Counter(found(out)) == want
    assert Counter(r["_us"] for r in asof_lookups(frame, lookups, anchor_time="anchor").collect()) == Counter(a for _, _, a in anchors)


def test_range_joins_against_brute_force(spark):
    rng = random.Random(3)
    windows = [("s" if rng.random() < 0.8 else "q", i, rng.randrange(5000)) for i in range(60)]
    spans = []
    for i in range(120):
        start = rng.randrange(5000)
        spans.append(("s" if rng.random() < 0.8 else "q", f"e{i}", start, start + rng.choice([1, 5, 40, 900, 4000])))
    w = spark.createDataFrame(windows, "subject_id string, w long, hi long").withColumn("lo", F.col("hi") - 50)
    e = spark.createDataFrame(spans, "subject_id string, e string, s long, t long")
    for width in (1, 7, 50, 3000):
        got = sorted(
            (r.w, r.e)
            for r in ranges.interval_overlap(
                w, e, low=F.col("lo"), high=F.col("hi"), start_us=F.col("s"), end_us=F.col("t"), width_us=width
            ).collect()
        )
        want = sorted((i, n) for a, i, hi in windows for b, n, s, t in spans if a == b and s < hi and t > hi - 50)
        assert got == want
        got = sorted(
            (r.w, r.e)
            for r in ranges.point_in_window(
                w, e, low=F.col("lo"), high=F.col("hi"), us=F.col("s"), width_us=width
            ).collect()
        )
        assert got == sorted((i, n) for a, i, hi in windows for b, n, s, _ in spans if a == b and hi - 50 <= s <= hi)


def test_copied_rows_of_a_range_join_are_not_broadcast(spark, tmp_path):
    spark.range(50).select(F.lit("s").alias("subject_id"), F.col("id").alias("at")).write.parquet(f"{tmp_path}/w")
    spark.range(50).select(F.lit("s").alias("subject_id"), "id", (F.col("id") + 9).alias("end")).write.parquet(f"{tmp_path}/e")
    w, e = (spark.read.parquet(f"{tmp_path}/{name}") for name in "we")
    bounds = {"low": F.col("at") - 40, "high": F.col("at"), "width_us": 1}
    for df in (
        ranges.interval_overlap(w, e, start_us=F.col("id"), end_us=F.col("end"), **bounds),
        ranges.point_in_window(w, e, us=F.col("id"), **bounds),
    ):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_distribution_is_exact(spark):
    rng = random.Random(5)
    groups = {
        "hot": [int(rng.expovariate(1 / 3e8)) - 1000 for _ in range(1500)] + [5] * 700,
        "one": [42],
        "wide": [rng.randrange(-(2**45), 2**45) for _ in range(333)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v long")
    got = {r.g: r for r in distribution(df, ["g"], "v", include_mean=True).collect()}

    def percentile(values, p):
        ordered = sorted(values)
        rank = p * (len(ordered) - 1)
        low = int(rank)
        high = min(low + 1, len(ordered) - 1)
        return ordered[low] * (1 - (rank - low)) + ordered[high] * (rank - low)

    for g, values in groups.items():
        r = got[g]
        assert (r["count"], r["min"], r["max"]) == (len(values), min(values), max(values))
        for name, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95)):
            assert r[name] == pytest.approx(percentile(values, p), rel=1e-12, abs=1e-6)
        assert r["mean"] == pytest.approx(sum(values) / len(values), rel=1e-12)


def test_expand_copies(spark):
    df = spark.createDataFrame([("s", 1, 1), ("s", 2, 7)], "subject_id string, us long, n long")
    for spread in (False, True):
        got = Counter((r.us, r.copy) for r in expand_copies(df, "n", block=3, spread=spread).collect())
        assert got == Counter([(1, 1)] + [(2, i) for i in range(1, 8)])


def test_out_of_order_counts_every_subject(spark):
    rows = [("s", 1, 5), ("s", 2, 4), ("s", 3, 4), ("s", 4, 1), ("t", 1, 1), ("t", 2, 2)]
    df = spark.createDataFrame(rows, "subject_id string, seq long, k long")
    got = {r.subject_id: r.out_of_order_pairs for r in gaps.out_of_order(df, "seq", F.col("k"), rows_per_chunk=2).collect()}
    assert got == {"s": 2, "t": 0}
