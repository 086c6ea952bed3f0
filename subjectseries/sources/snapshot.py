"""Immutable Parquet snapshots: extract, check, write, load."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Collection
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subjectseries.functions.predicates import (
    in_range,
    live,
    not_inside,
    outside_sanity,
    overlaps,
    time_range,
    to_us,
    ts_lit,
)
from subjectseries.functions.scalars import US_PER_MINUTE, normalized_foods, round1
from subjectseries.operators.chunks import observations
from subjectseries.operators.gaps import time_gaps
from subjectseries.plans.queries import SubjectTables
from subjectseries.schemas import (
    ID_COLUMNS,
    INTERVAL_TABLES,
    POINT_TABLES,
    SNAPSHOT,
    same_schema,
)

SNAPSHOT_SCHEMA_VERSION = "1"
SUPPORTED_VERSIONS = frozenset({SNAPSHOT_SCHEMA_VERSION})
GAP_LIMITS_MINUTES = (15, 60)

_MANIFEST = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("snapshot_id", T.StringType()),
        T.StructField("schema_version", T.StringType()),
        T.StructField("source_start_us", T.LongType()),
        T.StructField("source_end_us", T.LongType()),
        T.StructField("timezone", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("quality", T.MapType(T.StringType(), T.LongType())),
    ]
)

_DIGEST_PARTS = ("d0", "d1", "d2", "d3")
_FILES = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("rows", T.LongType()),
        *[T.StructField(part, T.DecimalType(38, 0)) for part in _DIGEST_PARTS],
    ]
)
#: Damaged files that an error names.
_NAMED_FILES = 100


class SnapshotError(ValueError):
    """A snapshot is incomplete, altered or not canonical. ``problems`` lists all findings."""

    def __init__(self, message: str, problems: list[str] | None = None):
        self.problems = problems or []
        super().__init__("; ".join([message, *self.problems]))


# --- extract -------------------------------------------------------------------
def extract(tables: SubjectTables, start: datetime, end: datetime) -> dict[str, DataFrame]:
    """The five canonical tables of ``[start, end)``; intervals overlap and stay unclipped."""
    start, end = time_range(start, end)
    lo, hi = ts_lit(start), ts_lit(end)

    def points(df: DataFrame, time: str) -> DataFrame:
        return live(df).filter(in_range(time, lo, hi))

    def intervals(df: DataFrame) -> DataFrame:
        return live(df).filter(overlaps("start_time", "end_time", lo, hi))

    ident = F.col("source_sample_id")
    subject = F.col("subject_id").cast("string").alias("subject_id")
    return {
        "glucose": points(tables.glucose, "sample_time").select(
            subject,
            F.col("sample_time").alias("timestamp"),
            round1("value_mg_dl").alias("glucose_mg_dl"),
        ),
        "meals": points(tables.meals, "meal_completed_at").select(
            subject,
            ident.alias("meal_id"),
            F.col("meal_completed_at").alias("timestamp"),
            normalized_foods("foods").alias("foods"),
            "source",
        ),
        "workouts": intervals(tables.workouts).select(
            subject,
            ident.alias("workout_id"),
            F.col("start_time").alias("start"),
            F.col("end_time").alias("end"),
            "sport",
            F.col("distance_meters").cast("double").alias("distance_meters"),
            "source",
        ),
        "sleep": intervals(tables.sleep).select(
            subject,
            ident.alias("sleep_id"),
            F.col("start_time").alias("start"),
            F.col("end_time").alias("end"),
            "stage",
            "source",
        ),
        "weight": points(tables.weight, "measured_at").select(
            subject,
            ident.alias("weight_id"),
            F.col("measured_at").alias("timestamp"),
            F.col("value_kg").cast("double").alias("weight_kg"),
            "source",
        ),
    }


# Canonical order of each table, the subject first.
SORT_KEYS: dict[str, list[str]] = {
    "glucose": ["timestamp", "glucose_mg_dl"],
    "meals": ["timestamp", "meal_id"],
    "workouts": ["start", "end", "workout_id"],
    "sleep": ["start", "end", "sleep_id"],
    "weight": ["timestamp", "weight_id"],
}


def sort_key(name: str) -> Column:
    """The canonical order as one comparable struct (values rounded to 6 places)."""
    columns = [
        F.round(c, 6).alias(c) if c == "glucose_mg_dl" else F.col(c) for c in SORT_KEYS[name]
    ]
    return F.struct(*columns)


def canonical_order(df: DataFrame, name: str) -> DataFrame:
    """Range-partition by subject and time, sort inside: files come out in order.

    All sort columns take part in the ranges, so a subject with very many rows is
    cut across files.
    """
    keys = ["subject_id", *SORT_KEYS[name]]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


# --- checks ----------------------------------------------------------------------
def _violations(name: str) -> dict[str, Column]:
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    bad_number = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    rules: dict[str, Column] = {"subject_id is blank": blank("subject_id")}
    if name in ID_COLUMNS:
        rules[f"{ID_COLUMNS[name]} is blank"] = blank(ID_COLUMNS[name])
        rules["source is blank"] = blank("source")
    if name in POINT_TABLES:
        rules["timestamp is missing"] = F.col("timestamp").isNull()
    if name in INTERVAL_TABLES:
        rules["interval bound is missing"] = F.col("start").isNull() | F.col("end").isNull()
        rules["end is not later than start"] = F.col("end") <= F.col("start")
    if name == "glucose":
        rules["glucose_mg_dl is not finite"] = F.col("glucose_mg_dl").isNull() | bad_number("glucose_mg_dl")
    if name == "weight":
        rules["weight_kg is not finite"] = F.col("weight_kg").isNull() | bad_number("weight_kg")
        rules["weight_kg is not positive"] = F.col("weight_kg") <= 0
    if name == "workouts":
        rules["sport is blank"] = blank("sport")
        rules["distance_meters is not finite"] = F.col("distance_meters").isNotNull() & bad_number("distance_meters")
    if name == "sleep":
        rules["stage is blank"] = blank("stage")
    return rules


def violation_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, rule, violations`` for every canonical rule; one pass per table."""
    parts = []
    for name, df in tables.items():
        rules = _violations(name)
        counts = df.agg(
            *[F.count_if(condition).alias(f"r{i}") for i, condition in enumerate(rules.values())]
        )
        entries = [
            F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("violations"))
            for i, rule in enumerate(rules)
        ]
        parts.append(
            counts.select(F.explode(F.array(*entries)).alias("e")).select(
                F.lit(name).alias("table"), "e.rule", "e.violations"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def duplicate_ids(tables: dict[str, DataFrame]) -> DataFrame:
    """Ids that occur more than once for a subject (glucose has no ids)."""
    parts = [
        df.groupBy("subject_id", F.col(ID_COLUMNS[name]).alias("id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select(F.lit(name).alias("table"), "subject_id", "id", "n")
        for name, df in tables.items()
        if name in ID_COLUMNS
    ]
    return reduce(DataFrame.unionByName, parts)


def require_canonical(tables: dict[str, DataFrame], tolerated: Collection[str] = ()) -> None:
    """Fail closed: any broken rule or repeated id stops the job, all findings listed.

    A rule in ``tolerated`` may be broken; its rows stay as they are.
    """
    broken = violation_counts(tables).filter((F.col("violations") > 0) & ~F.col("rule").isin(list(tolerated))).collect()
    problems = [f"{r['table']}: {r['rule']} ({r['violations']})" for r in broken]
    repeated = duplicate_ids(tables).groupBy("table").count().collect()
    problems += [f"{r['table']}: duplicate ids ({r['count']})" for r in repeated]
    if problems:
        raise SnapshotError("records are not canonical", sorted(problems))


def _row_measures(name: str, lo: Column, hi: Column) -> dict[str, Column]:
    """Aggregates that need nothing but a table's rows."""
    outside = ~in_range("timestamp", lo, hi) if name in POINT_TABLES else not_inside("start", "end", lo, hi)
    measures = {"rows": F.count(F.lit(1)), "out_of_window": F.count_if(outside)}
    if name == "glucose":
        measures["out_of_range"] = F.count_if(outside_sanity("glucose_mg_dl"))
    return measures


def _measured(df: DataFrame, name: str, measures: dict[str, Column]) -> DataFrame:
    row = df.agg(*[c.alias(k) for k, c in measures.items()])
    entries = [F.struct(F.lit(k).alias("measure"), F.col(k).alias("n")) for k in measures]
    return row.select(F.explode(F.array(*entries)).alias("e")).select(
        F.lit(name).alias("table"), "e.measure", "e.n"
    )


def _time_measures(glucose: DataFrame) -> DataFrame:
    """Repeated times and long gaps, which need the rows in order."""
    obs = observations(glucose, "timestamp", "glucose_mg_dl")
    repeated = F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("bigint"))
    gap = F.col("gap_us")
    long_gaps = {f"gaps_over_{m}m": F.count_if(gap > m * US_PER_MINUTE) for m in GAP_LIMITS_MINUTES}
    return _measured(obs, "glucose", {"duplicate_timestamps": repeated}).unionByName(
        _measured(time_gaps(obs), "glucose", long_gaps)
    )


def quality_counts(tables: dict[str, DataFrame], start: datetime, end: datetime) -> DataFrame:
    """``table, measure, n``: rows and rows not inside the window per table.

    Glucose also has repeated times, gaps over 15 and 60 minutes and values outside
    the plausible range. Nothing is dropped.
    """
    lo, hi = ts_lit(start), ts_lit(end)
    parts = [_measured(df, name, _row_measures(name, lo, hi)) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, [*parts, _time_measures(tables["glucose"])])


# --- identity ----------------------------------------------------------------------
def snapshot_id(start: datetime, end: datetime, version: str = SNAPSHOT_SCHEMA_VERSION) -> str:
    compact = lambda t: t.astimezone(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    return f"v{version}_{compact(start)}_{compact(end)}"


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content identity: row count and sums of row digests.

    File bytes depend on task layout, so they cannot serve. A sum, unlike xor, also
    changes when a row is doubled. The digest covers the names of the columns and
    nulls, so a value that moves to another column changes it; its 240 bits are
    summed in four parts.
    """
    return df.agg(F.count(F.lit(1)).alias("rows"), _joined(_digest_sums(df)).alias("fingerprint"))


def _digest_sums(df: DataFrame) -> list[Column]:
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    digest = F.sha2(text, 256)
    return [
        F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("decimal(38,0)")
        for k in range(len(_DIGEST_PARTS))
    ]


def _joined(sums: list[Column]) -> Column:
    none = F.lit(0).cast("decimal(38,0)")
    return F.concat_ws("-", *[F.coalesce(part, none).cast("string") for part in sums])


def file_digests(df: DataFrame, table: str) -> DataFrame:
    """(table, file, rows, d0..d3, reversed) of the files that ``df`` reads, in one pass.

    The digests of a table's files add up to its :func:`fingerprint`; ``reversed`` counts
    intervals that end before they start.
    """
    reversed_rows = F.count_if(F.col("end") <= F.col("start")) if table in INTERVAL_TABLES else F.lit(0).cast("bigint")
    parts = [part.alias(name) for part, name in zip(_digest_sums(df), _DIGEST_PARTS)]
    return (
        df.groupBy(F.col("_metadata.file_name").alias("file"))
        .agg(F.count(F.lit(1)).alias("rows"), *parts, reversed_rows.alias("reversed"))
        .select(F.lit(table).alias("table"), "file", "rows", *_DIGEST_PARTS, "reversed")
    )


def _table_digests(files: DataFrame) -> dict[str, tuple[int, str]]:
    """Rows and fingerprint of every table, added up over its files."""
    sums = [F.sum(part).cast("decimal(38,0)") for part in _DIGEST_PARTS]
    rows = files.groupBy("table").agg(F.sum("rows").alias("rows"), _joined(sums).alias("fingerprint")).collect()
    none = (0, "-".join("0" for _ in _DIGEST_PARTS))
    return {table: none for table in SNAPSHOT} | {r["table"]: (r["rows"], r["fingerprint"]) for r in rows}


def _damage(stated: DataFrame, actual: DataFrame) -> list[str]:
    """What differs between the file list of a snapshot and its files; the first of them named."""
    content = F.struct("rows", *_DIGEST_PARTS)
    pairs = stated.select("table", "file", content.alias("stated")).join(
        actual.select("table", "file", content.alias("actual"), "reversed"), ["table", "file"], "full"
    )
    state = (
        F.when(F.col("actual").isNull(), "is missing")
        .when(F.col("stated").isNull(), "was added")
        .when(F.col("stated") != F.col("actual"), "was changed")
    )
    wrong = pairs.select("table", "file", state.alias("state"), "reversed").where("state is not null or reversed > 0")
    found = wrong.orderBy("table", "file").limit(_NAMED_FILES).collect()
    problems = [f"{r['table']} differs from the manifest: {r['file']} {r['state']}" for r in found if r["state"]]
    return problems + [f"{r['table']} has intervals with end <= start in {r['file']}" for r in found if r["reversed"]]


def derived_id(prefix: str, **identity) -> str:
    """Name of a dataset derived from a snapshot: digest of inputs and policy."""
    text = json.dumps(identity, sort_keys=True, separators=(",", ":"), default=str)
    return f"{prefix}_{hashlib.sha256(text.encode()).hexdigest()[:16]}"


# --- write and load ------------------------------------------------------------------
def write_snapshot(
    tables: SubjectTables,
    start: datetime,
    end: datetime,
    root: str,
    tz: str = "America/New_York",
    overwrite: bool = False,
    created_at: datetime | None = None,
    tolerated: Collection[str] = (),
) -> str:
    """Extract, check and write; returns the snapshot folder.

    All five tables are written even when empty. Rows that break a canonical rule stop the job,
    unless the rule is in ``tolerated``: then they are written like all others. The manifest is written last and is
    what makes a snapshot valid, so a job that dies half-way leaves none.
    """
    spark = tables.glucose.sparkSession
    start, end = time_range(start, end)
    name = snapshot_id(start, end)
    target = f"{root.rstrip('/')}/{name}"
    if not overwrite and _readable(spark, f"{target}/manifest"):
        raise SnapshotError(f"snapshot {name} exists")
    extracted = extract(tables, start, end)
    require_canonical(extracted, tolerated)
    # Without a manifest, folders left by a dead job do not count as a snapshot; an old one
    # is emptied before its tables are replaced.
    if overwrite and _readable(spark, f"{target}/manifest"):
        spark.createDataFrame([], _MANIFEST).write.mode("overwrite").parquet(f"{target}/manifest")
    lo, hi = ts_lit(start), ts_lit(end)
    quality: dict[str, dict[str, int]] = {}
    for table, df in extracted.items():
        # Counted in the tasks that write, so that the counts cost no further scan.
        seen = Observation(f"{name}-{table}")
        measures = {**_row_measures(table, lo, hi), "fingerprint": _joined(_digest_sums(df))}
        canonical_order(df, table).observe(seen, *[c.alias(k) for k, c in measures.items()]).write.mode(
            "overwrite"
        ).option("compression", "zstd").parquet(f"{target}/{table}")
        quality[table] = seen.get
    stored = read_tables(spark, target)
    digests = reduce(DataFrame.unionByName, [file_digests(df, table) for table, df in stored.items()])
    digests.drop("reversed").coalesce(1).write.mode("overwrite").parquet(f"{target}/files")
    written = _table_digests(spark.read.schema(_FILES).parquet(f"{target}/files"))
    for table, counts in quality.items():
        if (counts["rows"], counts.pop("fingerprint")) != written[table]:
            raise SnapshotError(f"{table} was not stored as it was extracted")
    quality["glucose"] |= {r["measure"]: r["n"] for r in _time_measures(stored["glucose"]).collect()}
    created = created_at or datetime.now(timezone.utc)
    manifest = [
        (table, *written[table], name, SNAPSHOT_SCHEMA_VERSION, to_us(start), to_us(end), tz, created, counts)
        for table, counts in quality.items()
    ]
    spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest")
    return target


def _readable(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.schema(_MANIFEST).parquet(path).limit(1).isEmpty()
    except AnalysisException:
        return False


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The five tables with their stored schemas checked against the contract."""
    found: dict[str, DataFrame] = {}
    problems: list[str] = []
    for table, expected in SNAPSHOT.items():
        try:
            df = spark.read.parquet(f"{path}/{table}")
        except AnalysisException:
            problems.append(f"{table} is missing")
            continue
        if not same_schema(df.schema, expected):
            problems.append(f"{table} has columns {df.schema.simpleString()}")
        found[table] = df
    if problems:
        raise SnapshotError("snapshot layout is wrong", problems)
    return found


def from_epoch(us: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)


@dataclass(frozen=True)
class Snapshot:
    path: str
    snapshot_id: str
    identity: str
    start: datetime
    end: datetime
    timezone: str
    tables: dict[str, DataFrame]


def manifest_identity(rows: list) -> str:
    """Digest over the manifest without its creation time."""
    text = json.dumps(
        sorted(
            [
                r["table"],
                r["rows"],
                r["fingerprint"],
                r["snapshot_id"],
                r["schema_version"],
                r["source_start_us"],
                r["source_end_us"],
                r["timezone"],
            ]
            for r in rows
        )
    )
    return hashlib.sha256(text.encode()).hexdigest()


def load_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """Read a snapshot and verify it: tables, version, schemas, intervals and contents by file."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").collect()
    except AnalysisException as error:
        raise SnapshotError("snapshot has no manifest") from error
    by_table = {r["table"]: r for r in rows}
    missing = [t for t in SNAPSHOT if t not in by_table]
    if missing:
        raise SnapshotError("manifest is incomplete", missing)
    head = rows[0]
    if head["schema_version"] not in SUPPORTED_VERSIONS:
        raise SnapshotError(f"schema version {head['schema_version']} is not supported")
    tables = read_tables(spark, path)
    problems: list[str] = []
    try:
        files = spark.read.schema(_FILES).parquet(f"{path}/files")
    except AnalysisException as error:
        raise SnapshotError("snapshot has no list of files") from error
    for table, listed in _table_digests(files).items():
        if listed != (by_table[table]["rows"], by_table[table]["fingerprint"]):
            problems.append(f"{table} differs from the manifest in its list of files")
    # Contents and interval order are checked in the same pass over each table.
    actual = reduce(DataFrame.unionByName, [file_digests(df, table) for table, df in tables.items()])
    problems += _damage(files, actual)
    if problems:
        raise SnapshotError("snapshot verification failed", problems)
    return Snapshot(
        path=path,
        snapshot_id=head["snapshot_id"],
        identity=manifest_identity(rows),
        start=from_epoch(head["source_start_us"]),
        end=from_epoch(head["source_end_us"]),
        timezone=head["timezone"],
        tables=tables,
    )
