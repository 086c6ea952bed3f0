"""Derived datasets on disk: diagnostics of a snapshot, episodes of a matched pair.

Every dataset is a folder named after its inputs and policy. Tables come first, the
manifest last: without a manifest a folder is not a dataset.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subjectseries.operators.chunks import expand_copies
from subjectseries.plans import diagnostics as D
from subjectseries.plans import episodes as E
from subjectseries.plans.policies import DiagnosticsPolicy, EpisodePolicy
from subjectseries.schemas import READINESS_STATUSES
from subjectseries.session import materialize
from subjectseries.sources.snapshot import (
    Snapshot,
    SnapshotError,
    derived_id,
    fingerprint,
)

DIAGNOSTICS_VERSION = "1"
EPISODES_VERSION = "1"

_MANIFEST = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("input_id", T.StringType()),
        T.StructField("input_identity", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Dataset:
    path: str
    dataset_id: str
    input_id: str
    input_identity: str
    tables: dict[str, DataFrame]


def _write(
    spark: SparkSession,
    path: str,
    tables: dict[str, DataFrame],
    dataset_id: str,
    version: str,
    snapshot: Snapshot,
    overwrite: bool,
) -> str:
    if not overwrite and _has_manifest(spark, path):
        raise SnapshotError(f"dataset {dataset_id} exists")
    # An old manifest is emptied before its tables are replaced, so it never covers new ones.
    if overwrite and _has_manifest(spark, path):
        spark.createDataFrame([], _MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    marks = [
        fingerprint(spark.read.schema(df.schema).parquet(f"{path}/{name}")).select(
            F.lit(name).alias("table"),
            "rows",
            "fingerprint",
            F.lit(dataset_id).alias("dataset_id"),
            F.lit(version).alias("version"),
            F.lit(snapshot.snapshot_id).alias("input_id"),
            F.lit(snapshot.identity).alias("input_identity"),
        )
        for name, df in tables.items()
    ]
    manifest = reduce(DataFrame.unionByName, marks)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return path


def _has_manifest(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").limit(1).isEmpty()
    except AnalysisException:
        return False


def load_dataset(spark: SparkSession, path: str, version: str) -> Dataset:
    """Read a derived dataset after checking version, name and table contents."""
    if not _has_manifest(spark, path):
        raise SnapshotError("dataset has no manifest")
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").collect()
    head = rows[0]
    problems = []
    if head["version"] != version:
        problems.append(f"version {head['version']} is not supported")
    if path.rstrip("/").rsplit("/", 1)[-1] != head["dataset_id"]:
        problems.append("folder name differs from the manifest")
    tables = {r["table"]: spark.read.parquet(f"{path}/{r['table']}") for r in rows}
    for r in rows:
        found = fingerprint(tables[r["table"]]).first()
        if (found["rows"], found["fingerprint"]) != (r["rows"], r["fingerprint"]):
            problems.append(f"{r['table']} differs from the manifest")
    if problems:
        raise SnapshotError("dataset verification failed", problems)
    return Dataset(path, head["dataset_id"], head["input_id"], head["input_identity"], tables)


# --- diagnostics ------------------------------------------------------------------
def diagnostics_id(snapshot: Snapshot, policy: DiagnosticsPolicy) -> str:
    return derived_id(
        f"d{DIAGNOSTICS_VERSION}",
        snapshot=snapshot.snapshot_id,
        identity=snapshot.identity,
        version=DIAGNOSTICS_VERSION,
        policy=policy.identity(),
    )


def write_diagnostics(
    spark: SparkSession,
    snapshot: Snapshot,
    root: str,
    policy: DiagnosticsPolicy,
    overwrite: bool = False,
) -> str:
    """Gap table, daily coverage and forecast readiness of one snapshot."""
    name = diagnostics_id(snapshot, policy)
    obs = materialize(D.glucose_observations(snapshot.tables["glucose"]), "observations")
    readiness = expand_copies(D.forecast_readiness(obs, policy), "n", spread=True)
    tables = {
        "glucose_gaps": D.gap_table(obs, policy),
        "daily_coverage": D.daily_coverage(snapshot.tables, snapshot.start, snapshot.end, policy),
        "forecast_readiness": readiness.drop("us", "n", "copy"),
    }
    path = f"{root.rstrip('/')}/{snapshot.snapshot_id}/{name}"
    return _write(spark, path, tables, name, DIAGNOSTICS_VERSION, snapshot, overwrite)


def check_pair(snapshot: Snapshot, diagnostics: Dataset) -> None:
    """Diagnostics must come from exactly this snapshot and use known statuses."""
    problems = []
    if diagnostics.input_id != snapshot.snapshot_id:
        problems.append("diagnostics name another snapshot")
    if diagnostics.input_identity != snapshot.identity:
        problems.append("diagnostics were made from other snapshot contents")
    status = F.col("status")
    unknown = diagnostics.tables["forecast_readiness"].filter(
        status.isNull() | ~status.isin(*READINESS_STATUSES)
    )
    if not unknown.limit(1).isEmpty():
        problems.append("readiness has unknown statuses")
    if problems:
        raise SnapshotError("snapshot and diagnostics do not match", problems)


# --- episodes ------------------------------------------------------------------------
def episodes_id(snapshot: Snapshot, diagnostics: Dataset, policy: EpisodePolicy) -> str:
    return derived_id(
        f"e{EPISODES_VERSION}",
        snapshot=snapshot.snapshot_id,
        identity=snapshot.identity,
        diagnostics=diagnostics.dataset_id,
        version=EPISODES_VERSION,
        policy=policy.identity(),
    )


def write_episodes(
    spark: SparkSession,
    snapshot: Snapshot,
    diagnostics: Dataset,
    root: str,
    policy: EpisodePolicy,
    overwrite: bool = False,
) -> str:
    """The five episode tables. Anchors are evaluated once and written to scratch."""
    check_pair(snapshot, diagnostics)
    name = episodes_id(snapshot, diagnostics, policy)
    obs = D.glucose_observations(snapshot.tables["glucose"])
    evaluated = materialize(E.evaluate_anchors(obs, policy), "evaluated")
    events = E.event_context(evaluated, snapshot.tables, policy, name)
    if policy.include_events:
        events = materialize(events, "events")
    else:
        events = events.limit(0)
    lineage = {
        "snapshot_id": snapshot.snapshot_id,
        "snapshot_identity": snapshot.identity,
        "diagnostics_id": diagnostics.dataset_id,
    }
    tables = {
        "episodes": E.episodes(
            evaluated, policy, name, lineage, events if policy.include_events else None
        ),
        "episode_glucose_history": E.history_grid(evaluated, policy, name),
        "episode_targets": E.targets(evaluated, name),
        "episode_events": events,
        "rejected_anchors": E.rejected_anchors(
            evaluated, policy, snapshot.snapshot_id, spread=True
        ),
    }
    path = f"{root.rstrip('/')}/{snapshot.snapshot_id}/{name}"
    return _write(spark, path, tables, name, EPISODES_VERSION, snapshot, overwrite)


def audit_episodes(
    dataset: Dataset, glucose: DataFrame, policy: EpisodePolicy
) -> dict[str, DataFrame]:
    """Violations found in written episodes; each frame must be empty."""
    t = dataset.tables
    grid, hits = t["episode_glucose_history"], t["episode_targets"]
    return {
        "grid": E.grid_violations(grid, policy),
        "targets": E.target_violations(hits, t["episodes"], policy),
        "leakage": E.leakage(grid, t["episode_events"], t["episodes"]),
        "changed_values": E.changed_values(grid, hits, glucose),
    }
