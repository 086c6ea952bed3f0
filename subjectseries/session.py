"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession

# Runtime options every job relies on. All can be set on a live session.
RUNTIME_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def use_defaults(spark: SparkSession) -> SparkSession:
    """Apply the runtime options this library needs; all instants are UTC."""
    for key, value in RUNTIME_OPTIONS.items():
        spark.conf.set(key, value)
    return spark


def get_session(app_name: str = "subjectseries") -> SparkSession:
    return use_defaults(SparkSession.builder.appName(app_name).getOrCreate())


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="subjectseries-")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the cluster's checkpoint folder.

    Intermediate tables that cut lineage are written here, so executors that are
    lost can be replaced. Only a local session that names no folder, as in tests, gets
    a temporary one, once per driver process; on a cluster the setting is needed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_scratch()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df, label: str):
    """Write ``df`` once to the scratch folder and read it back."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
