"""Ingest, snapshot, derived datasets and streams on small inputs."""

import json
import shutil
import tempfile
from datetime import timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import T0, minutes, regular
from subjectseries.plans import datasets
from subjectseries.plans.ingest import ingest, validate_all
from subjectseries.plans.policies import DiagnosticsPolicy, EpisodePolicy
from subjectseries.plans.queries import SubjectTables
from subjectseries.schemas import SOURCES, STORED
from subjectseries.sources import export, snapshot as S
from subjectseries.sources.store import VersionedStore
from subjectseries.streaming import run_available, stream_rollup, stream_segments

HEAD = {"schema_version": 1, "exported_at": "2026-08-10T20:02:50Z", "data_start": "2026-07-30T00:00:00Z", "data_end": "2026-08-10T20:02:50Z"}


def sample(ident, value, **extra):
    return {"source": "apple", "source_sample_id": ident, "sample_time": "2026-08-01T02:05:51", "value": value, "unit": "mg/dL", **extra}


def docs(spark, *bodies):
    rows = [("s", f"d{i}", b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "subject_id string, document_id string, body string")


def test_replay_update_and_tombstone(spark):
    store = VersionedStore(spark, tempfile.mkdtemp(prefix="run-"))
    first = {**HEAD, "glucose_samples": [sample("a", 90), sample("a", 91.0004), sample("b", "95"), sample("c", -1), 7]}
    counts = lambda out: out["counts"].filter("entity_type = 'glucose_samples'").select("received", "inserted", "updated", "unchanged", "rejected").first()
    out = ingest(spark, docs(spark, first), store)
    assert tuple(counts(out)) == (5, 2, 0, 0, 2)
    assert out["audit"].first().status == "partial"
    # The same values at storage scale are no change.
    assert tuple(counts(ingest(spark, docs(spark, first), store))) == (5, 0, 0, 2, 2)
    stored = store.read("glucose_samples", STORED["glucose_samples"])
    before = {r.source_sample_id: r for r in stored.collect()}
    assert before["a"].value_mg_dl == Decimal("91.000")
    gone = stored.filter("source_sample_id = 'b'").withColumn("deleted_at", F.current_timestamp())
    store.commit("glucose_samples", gone, "delta")
    second = {**HEAD, "glucose_samples": [sample("a", 92, metadata={"x": 1}), sample("b", 96)]}
    assert tuple(counts(ingest(spark, docs(spark, second), store))) == (2, 0, 1, 1, 0)
    store.compact("glucose_samples", STORED["glucose_samples"])
    after = {r.source_sample_id: r for r in store.read("glucose_samples", STORED["glucose_samples"]).collect()}
    assert after["a"].value_mg_dl == 92 and after["a"].ingested_at == before["a"].ingested_at
    assert after["a"].updated_at > before["a"].updated_at
    assert after["b"].value_mg_dl == 95 and after["b"].deleted_at is not None
    sources = store.read("sources", SOURCES, ("subject_id", "source", "source_name")).collect()
    assert [(r.source, r.source_name) for r in sources] == [("apple", None)]


@pytest.mark.parametrize(
    "body,code",
    [
        ("{not json", "INVALID_REQUEST"),
        ({**HEAD, "schema_version": 2}, "UNSUPPORTED_SCHEMA_VERSION"),
        ({**HEAD, "data_end": HEAD["data_start"]}, "INVALID_TIMESTAMP"),
        ({**HEAD, "workouts": {}}, "INVALID_REQUEST"),
        ({**HEAD, "other": 1}, None),
    ],
)
def test_envelope(spark, body, code):
    assert export.envelopes(docs(spark, body)).first().reject_code == code


def test_documents_are_parsed_once_and_not_sorted(spark):
    kinds = [{**HEAD, "glucose_samples": [sample("a", 90), 7, [1]], "meal_events": [{"foods": "x"}]}, "{not json", {**HEAD, "workouts": None}]
    envelope = export.envelopes(docs(spark, *kinds), hashed=True)
    plain = export.document_hash(export.envelopes(docs(spark, *kinds))).select("payload_sha256").collect()
    assert plain == envelope.select("payload_sha256").collect() and plain[1][0] is None
    assert [r.reject_code for r in envelope.collect()] == [None, "INVALID_REQUEST", "INVALID_REQUEST"]
    for df in validate_all(envelope).values():
        read = spark.read.parquet(str(Path(df.inputFiles()[0]).parent))
        assert "body" not in read.columns and "entity" not in read.columns
    messages = {(r["index"], r.rejection.message) for r in validate_all(envelope)["glucose_samples"].filter("rejection is not null").collect()}
    assert messages == {(1, "record must be a JSON object"), (2, "record must be a JSON object")}


def tables(spark):
    glucose = [("s", "x", f"g{i}", t, Decimal(100 + i), None) for i, t in enumerate(regular())]
    point = "subject_id string, source string, source_sample_id string, "
    meals = spark.createDataFrame([("s", "m", "m1", T0, None, None)], point + "meal_completed_at timestamp, foods array<string>, deleted_at timestamp")
    spans = point + "start_time timestamp, end_time timestamp, {x}, deleted_at timestamp"
    return SubjectTables(
        glucose=spark.createDataFrame(glucose, point + "sample_time timestamp, value_mg_dl decimal(10,3), deleted_at timestamp"),
        meals=meals,
        workouts=spark.createDataFrame([], spans.format(x="sport string, distance_meters decimal(12,3)")),
        sleep=spark.createDataFrame([("s", "w", "z1", T0 - minutes(60), T0 + minutes(5), "core", None)], spans.format(x="stage string")),
        weight=spark.createDataFrame([("s", "k", "k1", T0 - minutes(999), Decimal(90), None)], point + "measured_at timestamp, value_kg decimal(10,6), deleted_at timestamp"),
    )


def test_snapshot_to_episodes(spark):
    root = tempfile.mkdtemp(prefix="run-")
    end = T0 + timedelta(hours=5)
    path = S.write_snapshot(tables(spark), T0, end, root)
    with pytest.raises(S.SnapshotError):
        S.write_snapshot(tables(spark), T0, end, root)
    loaded = S.load_snapshot(spark, path)
    assert (loaded.start, loaded.end) == (T0, end)
    assert {k: v.count() for k, v in loaded.tables.items()} == {"glucose": 49, "meals": 1, "workouts": 0, "sleep": 1, "weight": 0}
    made = datasets.write_diagnostics(spark, loaded, root, DiagnosticsPolicy())
    diagnostics = datasets.load_dataset(spark, made, datasets.DIAGNOSTICS_VERSION)
    assert diagnostics.tables["forecast_readiness"].count() == 49 * 3
    out = datasets.write_episodes(spark, loaded, diagnostics, root, EpisodePolicy())
    episodes = datasets.load_dataset(spark, out, datasets.EPISODES_VERSION)
    assert {k: v.count() for k, v in episodes.tables.items()} == {
        "episodes": 1, "episode_glucose_history": 25, "episode_targets": 3, "episode_events": 2, "rejected_anchors": 48,
    }
    row = episodes.tables["episodes"].first()
    assert (row.meal_context_count, row.sleep_context_count, row.history_missing_grid_count) == (1, 1, 0)
    for violations in datasets.audit_episodes(episodes, loaded.tables["glucose"], EpisodePolicy()).values():
        assert violations.isEmpty()
    # Another snapshot of other contents is no match for these diagnostics.
    other = S.load_snapshot(spark, S.write_snapshot(tables(spark), T0, end + minutes(1), root))
    with pytest.raises(S.SnapshotError):
        datasets.check_pair(other, diagnostics)
    stored = loaded.tables["meals"].inputFiles()
    loaded.tables["glucose"].limit(1).write.mode("append").parquet(f"{path}/glucose")
    loaded.tables["meals"].withColumn("source", F.lit("other")).coalesce(1).write.parquet(f"{root}/other")
    old, new = Path(stored[0].removeprefix("file://")), next(Path(f"{root}/other").glob("part-*"))
    for name, place in ((new.name, old.name), (f".{new.name}.crc", f".{old.name}.crc")):
        shutil.copy(new.with_name(name), old.with_name(place))
    with pytest.raises(S.SnapshotError, match="glucose differs.* was added") as failure:
        S.load_snapshot(spark, path)
    assert f"meals differs from the manifest: {old.name} was changed" in failure.value.problems


def test_manifest_counts_are_those_of_the_tables(spark):
    end = T0 + timedelta(hours=5)
    path = S.write_snapshot(tables(spark), T0, end, tempfile.mkdtemp(prefix="run-"))
    loaded = S.load_snapshot(spark, path)
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    got = {(r["table"], measure, n) for r in manifest for measure, n in r["quality"].items()}
    assert got == {tuple(r) for r in S.quality_counts(loaded.tables, T0, end).collect()}
    assert {(r["table"], r["rows"], r["fingerprint"]) for r in manifest} == {
        (name, *S.fingerprint(df).first()) for name, df in loaded.tables.items()
    }


def test_non_canonical_records_stop_the_snapshot(spark):
    bad = tables(spark)
    twice = bad.meals.unionByName(bad.meals)
    with pytest.raises(S.SnapshotError, match="duplicate ids"):
        S.write_snapshot(SubjectTables(bad.glucose, twice, bad.workouts, bad.sleep, bad.weight), T0, T0 + minutes(60), tempfile.mkdtemp(prefix="run-"))


def test_a_tolerated_rule_keeps_its_rows(spark):
    end = T0 + timedelta(hours=5)
    good = tables(spark)
    weight = good.weight.withColumn("value_kg", F.lit(0).cast("decimal(10,6)")).withColumn("measured_at", F.lit(T0))
    zero = SubjectTables(good.glucose, good.meals, good.workouts, good.sleep, weight)
    with pytest.raises(S.SnapshotError, match="weight_kg is not positive"):
        S.write_snapshot(zero, T0, end, tempfile.mkdtemp(prefix="run-"))
    path = S.write_snapshot(zero, T0, end, tempfile.mkdtemp(prefix="run-"), tolerated=["weight_kg is not positive"])
    assert [r.weight_kg for r in S.load_snapshot(spark, path).tables["weight"].collect()] == [0.0]
    twice = SubjectTables(good.glucose, good.meals, good.workouts, good.sleep, weight.unionByName(weight))
    with pytest.raises(S.SnapshotError, match="duplicate ids"):
        S.write_snapshot(twice, T0, end, tempfile.mkdtemp(prefix="run-"), tolerated=["weight_kg is not positive"])


def test_streams_drop_late_rows(spark):
    root = tempfile.mkdtemp(prefix="run-")
    schema = "subject_id string, ts timestamp, value decimal(10,3)"
    times = [T0, T0 + minutes(4), T0 + minutes(30), T0 + minutes(200)]
    spark.createDataFrame([("s", t, Decimal(10)) for t in times], schema).coalesce(1).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(schema).parquet(f"{root}/in")
    result = stream_rollup(stream, "ts", "value", "15m", "10 minutes")
    run_available(result, f"{root}/out", f"{root}/cp")
    assert spark.read.schema(result.schema).parquet(f"{root}/out").count() == 2
    # A row from before the watermark arrives afterwards and changes nothing.
    spark.createDataFrame([("s", T0 + minutes(1), Decimal(99)), ("s", T0 + minutes(400), Decimal(1))], schema).write.mode("append").parquet(f"{root}/in")
    run_available(result, f"{root}/out", f"{root}/cp")
    rows = spark.read.schema(result.schema).parquet(f"{root}/out")
    assert rows.count() == 3 and rows.agg(F.max("max_value")).first()[0] == 10
    seg = stream_segments(stream, "ts", 26, "1 minute")
    run_available(seg, f"{root}/seg", f"{root}/segcp")
    got = sorted(r.observation_count for r in spark.read.schema(seg.schema).parquet(f"{root}/seg").collect())
    assert got[-1] >= 3


def test_lists_and_snapshots_come_out_in_order(spark):
    from subjectseries.operators.paging import list_order

    rows = [("s", f"i{i}", T0 + minutes((i * 7) % 20), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "subject_id string, id string, timestamp timestamp, glucose_mg_dl double")
    listed = [(r.timestamp, r.id) for r in list_order(df, "timestamp", "id").collect()]
    assert listed == sorted(listed)
    stored = S.canonical_order(df, "glucose").collect()
    keys = [(r.subject_id, r.timestamp, r.glucose_mg_dl) for r in stored]
    assert keys == sorted(keys)


def test_later_export_wins_and_nothing_is_capped(spark):
    store = VersionedStore(spark, tempfile.mkdtemp(prefix="run-"))
    late = {**HEAD, "exported_at": "2026-08-09T00:00:00Z", "glucose_samples": [sample("a", 111)]}
    early = {**HEAD, "exported_at": "2026-08-01T00:00:00Z", "glucose_samples": [sample("a", 90), *[sample(f"x{i}", -1) for i in range(150)]]}
    out = ingest(spark, docs(spark, late, early), store)  # the later export has the smaller id
    stored = store.read("glucose_samples", STORED["glucose_samples"]).collect()
    assert [r.value_mg_dl for r in stored] == [111]
    assert out["rejections"].count() == 150 and not out["rejections"].filter("truncated").count()


def test_retried_batch_keeps_its_audit(spark):
    store = VersionedStore(spark, tempfile.mkdtemp(prefix="run-"))
    body = {**HEAD, "glucose_samples": [sample("a", 90)]}
    first = ingest(spark, docs(spark, body), store, batch_label="epoch-0")
    again = ingest(spark, docs(spark, body), store, batch_label="epoch-0")
    for out in (first, again):
        assert (out["audit"].first().glucose_inserted, out["audit"].first().glucose_unchanged) == (1, 0)
    other = ingest(spark, docs(spark, body), store, batch_label="epoch-1")
    assert (other["audit"].first().glucose_inserted, other["audit"].first().glucose_unchanged) == (0, 1)


def test_fingerprint_sees_moved_values(spark):
    schema = "a string, b string"
    left = spark.createDataFrame([(None, "x"), ("y", "z")], schema)
    right = spark.createDataFrame([("x", None), ("y", "z")], schema)
    doubled = left.union(left.limit(1))
    found = [S.fingerprint(df).first() for df in (left, right, doubled, left.orderBy("b"))]
    assert found[0].fingerprint != found[1].fingerprint and found[0].rows == found[1].rows
    assert found[0] != found[2] and found[0] == found[3]


def test_caps_fail_whatever_is_read(spark):
    from subjectseries.operators import paging

    rows = spark.createDataFrame([("s", i) for i in range(10)] + [("t", 1)], "subject_id string, n int")
    for capped in (paging.enforce_cap(rows, 3, "rows"), paging.within_cap(rows, F.col("n"), 5, "rows")):
        for read in (capped.count, capped.select("n").collect, capped.collect):
            with pytest.raises(Exception, match="RESULT_TOO_LARGE"):
                read()
    assert paging.enforce_cap(rows, 10, "rows").count() == 11
    assert paging.enforce_cap(rows, 10, "rows").columns == rows.columns
