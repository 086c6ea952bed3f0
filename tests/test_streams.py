"""Mergeable streaming results, the keyed store and ingest that dies on the way."""

import json
import random
from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import T0, minutes
from subjectseries.operators.aggregates import rollup
from subjectseries.operators.gaps import merge_segments, segments
from subjectseries.plans.ingest import ingest
from subjectseries.schemas import IDENTITY, STORED
from subjectseries.sources.store import VersionedStore
from subjectseries.streaming import maintain_rollup, maintain_segments, rollup_so_far, segments_so_far

SAMPLES = "subject_id string, ts timestamp, value decimal(10,3)"


def arrive(spark, root, times, values=None):
    rows = [("s", t, Decimal(values[i] if values else 10)) for i, t in enumerate(times)]
    spark.createDataFrame(rows, SAMPLES).coalesce(1).write.mode("append").parquet(f"{root}/in")


def stream(spark, root):
    return spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def test_rollup_holds_late_rows_and_the_newest_bucket(spark, tmp_path):
    root, store = str(tmp_path), VersionedStore(spark, f"{tmp_path}/store", parts=4)
    arrive(spark, root, [T0, T0 + minutes(4), T0 + minutes(200)], [5, 7, 9])
    maintain_rollup(stream(spark, root), "ts", "value", "15m", store, f"{root}/cp").awaitTermination()
    assert rollup_so_far(store, "15m").count() == 2
    arrive(spark, root, [T0 + minutes(1), T0 - timedelta(days=9)], [99, 1])
    maintain_rollup(stream(spark, root), "ts", "value", "15m", store, f"{root}/cp").awaitTermination()
    whole = rollup(spark.read.parquet(f"{root}/in"), "ts", "value", "15m")
    key = lambda r: r.bucket_start
    assert sorted(rollup_so_far(store, "15m").collect(), key=key) == sorted(whole.collect(), key=key)
    asked = spark.createDataFrame([("s",), ("t",)], "subject_id string")
    assert rollup_so_far(store, "15m", asked).count() == whole.count()


def test_an_epoch_that_runs_again_counts_once_and_deltas_are_folded(spark, tmp_path, monkeypatch):
    from subjectseries.streaming import jobs

    monkeypatch.setattr(jobs, "MOST_DELTAS", 2)
    root, store = str(tmp_path), VersionedStore(spark, f"{tmp_path}/store", parts=2)
    for k in range(4):
        arrive(spark, root, [T0 + minutes(k)])
        if k == 2:  # the checkpoint of this epoch is lost after its commit
            store.commit("rollup_15m", store.rows("rollup_15m", jobs.ROLLUP_PARTS).drop("_version"), "delta", ("subject_id",), f"epoch-{0:010d}")
        maintain_rollup(stream(spark, root), "ts", "value", "15m", store, f"{root}/cp").awaitTermination()
    assert [r.sample_count for r in rollup_so_far(store, "15m").collect()] == [4]
    assert store.deltas("rollup_15m") <= 2


def test_a_late_row_bridges_segments(spark, tmp_path):
    root, store = str(tmp_path), VersionedStore(spark, f"{tmp_path}/store", parts=4)
    arrive(spark, root, [T0, T0 + minutes(10), T0 + minutes(40), T0 + timedelta(days=3)])
    run = lambda: maintain_segments(stream(spark, root), "ts", 15, store, f"{root}/cp").awaitTermination()
    run()
    assert sorted(r.n for r in segments_so_far(store, 15).collect()) == [1, 1, 2]
    arrive(spark, root, [T0 + minutes(25), T0 + minutes(25)])
    run()
    found = {r.start_us: (r.end_us, r.n) for r in segments_so_far(store, 15).collect()}
    start = int(T0.timestamp() * 1e6)
    assert len(found) == 2 and found[start] == (start + 40 * 60_000_000, 5)


@pytest.mark.parametrize("seed", range(4))
def test_merged_parts_are_the_segments_of_all_rows(spark, seed):
    draw = random.Random(seed)
    hour = 3_600_000_000
    rows = [(s, draw.randrange(0, 24 * 40) * hour // 2, draw.randrange(4)) for s in "ab" for _ in range(250)]
    obs = spark.createDataFrame(rows, "subject_id string, us long, batch int")
    times = lambda df: df.groupBy("subject_id", "us").agg(F.count("*").alias("n"))
    gap = 60 * draw.randrange(1, 8)
    parts = None
    for k in range(4):
        part = segments(times(obs.where(F.col("batch") == k)), gap)
        parts = part if parts is None else parts.unionByName(part)
    merged = merge_segments(parts, gap, width_us=7 * hour)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, segments(times(obs), gap).collect()))


def test_a_batch_reads_only_the_partitions_of_its_keys(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path), parts=8)
    schema = STORED["glucose_samples"]
    rows = spark.range(200).select(F.lit("s").alias("subject_id"), F.lit("x").alias("source"), F.col("id").cast("string").alias("source_sample_id"))
    full = rows.select(*[F.col(c) if c in IDENTITY else F.lit(None).cast(schema[c].dataType).alias(c) for c in schema.names])
    store.commit("glucose_samples", full, "base", IDENTITY)
    needed = rows.where("source_sample_id = '7'")
    found = store.read("glucose_samples", schema, needed=needed)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan or "PartitionFilters: [(_part" in plan
    assert 0 < found.count() < 80 and found.where("source_sample_id = '7'").count() == 1
    assert len({r[0] for r in found.select(F.input_file_name()).distinct().collect()}) == 1


HEAD = {"schema_version": 1, "exported_at": "2026-08-10T20:02:50Z", "data_start": "2026-07-30T00:00:00Z", "data_end": "2026-08-10T20:02:50Z"}


def document(spark, name, *values):
    samples = [
        {"source": "apple", "source_sample_id": f"{name}{i}", "sample_time": "2026-08-01T02:05:51", "value": v, "unit": "mg/dL"}
        for i, v in enumerate(values)
    ]
    body = json.dumps({**HEAD, "glucose_samples": samples})
    return spark.createDataFrame([("s", name, body)], "subject_id string, document_id string, body string")


def test_a_batch_after_one_that_died_keeps_its_own_reports(spark, tmp_path, monkeypatch):
    store = VersionedStore(spark, str(tmp_path), parts=2)
    with monkeypatch.context() as broken:
        broken.setattr(VersionedStore, "commit", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest(spark, document(spark, "a", 90), store)
    out = ingest(spark, document(spark, "b", 91, -1, -2), store)
    assert out["rejections"].count() == 2
    assert (out["audit"].first().document_id, out["audit"].first().glucose_inserted) == ("b", 1)
    # The first batch again: its reports of the run that died no longer fit the version.
    again = ingest(spark, document(spark, "a", 90), store)
    assert (again["audit"].first().document_id, again["audit"].first().glucose_inserted) == ("a", 1)
    assert store.read("glucose_samples", STORED["glucose_samples"]).count() == 2
