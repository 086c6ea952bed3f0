"""Versioned Parquet tables without a table format.

Each commit writes a folder (``base`` or ``delta``) and then one row to the commit
log; a folder without a row is invisible, so a job that dies half-way leaves the
table as it was. A delta holds only inserted and changed rows. Readers take the
newest row per identity; ``compact`` folds the deltas into a new base.

A commit with ``keys`` deals its rows by a hash of them over partition folders. A reader that
knows which keys it needs lists only their partitions, so a small batch does not read the
whole table. A commit with a label that is in the log already is skipped, so a batch that
is run again after its commit adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from subjectseries.operators.upsert import keep_last
from subjectseries.schemas import IDENTITY

#: Partition folders of a keyed commit, and deltas after which a table is folded.
PARTS = 32
MOST_DELTAS = 16
_PART = "_part"

_LOG = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("parts", T.IntegerType()),
        T.StructField("label", T.StringType()),
    ]
)


def part(keys: Sequence[str], parts: int) -> Column:
    """The partition folder of a row."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


class VersionedStore:
    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts

    def _log(self, table: str) -> list:
        """Log rows by version: metadata, a few rows per table."""
        try:
            log = self.spark.read.schema(_LOG).parquet(f"{self.root}/_log")
        except AnalysisException:
            return []
        return sorted(log.filter(F.col("table") == table).collect(), key=lambda r: r["version"])

    def _commits(self, table: str) -> list:
        """Log rows since the last base."""
        rows = self._log(table)
        bases = [i for i, r in enumerate(rows) if r["kind"] == "base"]
        return rows[bases[-1] :] if bases else rows

    def version(self, table: str) -> int:
        commits = self._commits(table)
        return commits[-1]["version"] if commits else 0

    def deltas(self, table: str) -> int:
        return sum(c["kind"] == "delta" for c in self._commits(table))

    def rows(
        self, table: str, schema: T.StructType, keys: Sequence[str] = IDENTITY, needed: DataFrame | None = None
    ) -> DataFrame:
        """The rows of all commits with their ``_version``, of the partitions of ``needed`` keys only."""
        listed: dict[int, list[int]] = {}
        merged = None
        for commit in self._commits(table):
            full = schema if commit["parts"] is None else T.StructType([*schema.fields, T.StructField(_PART, T.IntegerType())])
            found = self.spark.read.schema(full).parquet(commit["path"])
            if commit["parts"] is not None and needed is not None:
                n = commit["parts"]
                if n not in listed:  # no more numbers than partitions
                    listed[n] = [r[0] for r in needed.select(part(keys, n)).distinct().collect()]
                found = found.filter(F.col(_PART).isin(listed[n]))
            found = found.select(*schema.names, F.lit(commit["version"]).alias("_version"))
            merged = found if merged is None else merged.unionByName(found)
        if merged is None:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_version", T.IntegerType())]))
        return merged

    def read(
        self,
        table: str,
        schema: T.StructType,
        identity: Sequence[str] = IDENTITY,
        needed: DataFrame | None = None,
    ) -> DataFrame:
        """The newest row per identity; with ``needed``, at least those of its identities."""
        rows = self.rows(table, schema, identity, needed)
        if len(self._commits(table)) < 2:
            return rows.drop("_version")
        return keep_last(rows, ["_version"], identity).select(*schema.names)

    def commit(
        self,
        table: str,
        df: DataFrame,
        kind: str,
        keys: Sequence[str] | None = None,
        label: str | None = None,
    ) -> None:
        log = self._log(table)
        if label is not None and any(r["label"] == label for r in log):
            return
        version = (log[-1]["version"] if log else 0) + 1
        path = f"{self.root}/{table}/{kind}-{version:08d}"
        parts = None if keys is None else self.parts
        # A folder left by a commit that never reached the log is replaced.
        if parts is None:
            writer = df.write
        else:
            writer = df.withColumn(_PART, part(keys, parts)).repartition(_PART).write.partitionBy(_PART)
        writer.mode("overwrite").option("compression", "zstd").parquet(path)
        row = self.spark.createDataFrame([(table, version, kind, path, parts, label)], _LOG)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/_log")

    def compact(self, table: str, schema: T.StructType, identity: Sequence[str] = IDENTITY) -> None:
        if len(self._commits(table)) > 1:
            self.commit(table, self.read(table, schema, identity), "base", identity)

    def mark(self, label: str) -> None:
        """Note that a piece of work is complete."""
        row = self.spark.createDataFrame([(label,)], "label string")
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/_marks")

    def marked(self, label: str) -> bool:
        try:
            marks = self.spark.read.schema("label string").parquet(f"{self.root}/_marks")
        except AnalysisException:  # none yet
            return False
        return not marks.filter(F.col("label") == label).isEmpty()
