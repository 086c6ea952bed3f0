"""Ingest of export documents into the versioned tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subjectseries.operators.upsert import classify, keep_last, next_version, upsert_sources
from subjectseries.schemas import ENTITIES, IDENTITY, MEANINGFUL, SOURCES, STORED
from subjectseries.session import materialize, scratch_dir
from subjectseries.sources import export
from subjectseries.sources.store import MOST_DELTAS, VersionedStore

OUTCOMES = ("inserted", "updated", "unchanged", "rejected")
# Column prefixes of the audit row.
AUDIT_PREFIX = {
    "glucose_samples": "glucose",
    "workouts": "workouts",
    "sleep_sessions": "sleep",
    "weight_measurements": "weight",
    "meal_events": "meals",
}


def batch_rows(valid: DataFrame) -> DataFrame:
    """Good records of one entity, one per identity, the last occurrence winning.

    Documents count in the order of their export time, then by id; records by their index.
    """
    return keep_last(export.good(valid), ["exported_at", "document_id", "index"])


def classify_batch(target: DataFrame, batch: DataFrame, entity: str) -> DataFrame:
    """Outcome per batch row; stored rows the batch does not mention are not read on."""
    return classify(target, batch, MEANINGFUL[entity]).filter(F.col("incoming").isNotNull())


def delta(classified: DataFrame, entity: str, now: Column) -> DataFrame:
    """Only the rows a commit has to write."""
    changed = classified.filter(F.col("outcome").isin("inserted", "updated"))
    return next_version(changed, MEANINGFUL[entity], STORED[entity].names, now)


def outcome_counts(
    valid: dict[str, DataFrame], classified: dict[str, DataFrame]
) -> DataFrame:
    """received / inserted / updated / unchanged / rejected per document and entity.

    Duplicates inside a batch are received but have no outcome of their own, so
    received can exceed the sum of the others.
    """
    parts: list[DataFrame] = []
    for entity, df in valid.items():
        parts.append(
            df.select(
                "document_id",
                F.lit(entity).alias("entity_type"),
                F.explode(
                    F.array_compact(
                        F.array(
                            F.lit("received"),
                            F.when(F.col("rejection").isNotNull(), F.lit("rejected")),
                        )
                    )
                ).alias("what"),
            )
        )
        parts.append(
            classified[entity].select(
                F.col("incoming.document_id").alias("document_id"),
                F.lit(entity).alias("entity_type"),
                F.col("outcome").alias("what"),
            )
        )
    events = reduce(DataFrame.unionByName, parts)
    return events.groupBy("document_id", "entity_type").agg(
        *[
            F.count_if(F.col("what") == name).alias(name)
            for name in ("received", *OUTCOMES)
        ]
    )


def audit_rows(envelope: DataFrame, counts: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per accepted document: hash, window, status, 5 x 4 counts, reject summary."""
    wide = counts.groupBy("document_id").agg(
        *[
            F.coalesce(
                F.sum(F.when(F.col("entity_type") == entity, F.col(outcome))), F.lit(0)
            ).alias(f"{AUDIT_PREFIX[entity]}_{outcome}")
            for entity in ENTITIES
            for outcome in OUTCOMES
        ]
    )
    totals = rejected.groupBy("document_id").agg(F.count(F.lit(1)).alias("rejected_total"))
    head = export.document_hash(export.accepted(envelope)).select(
        "subject_id",
        "document_id",
        "schema_version",
        "exported_at",
        "data_start",
        "data_end",
        "payload_sha256",
    )
    zero = F.lit(0).cast("bigint")
    joined = head.join(wide, "document_id", "left").join(totals, "document_id", "left")
    count_names = [f"{AUDIT_PREFIX[e]}_{o}" for e in ENTITIES for o in OUTCOMES]
    return joined.withColumns(
        {
            **{name: F.coalesce(F.col(name), zero) for name in count_names},
            "rejected_total": F.coalesce("rejected_total", zero),
        }
    ).withColumns(
        {
            "status": F.when(F.col("rejected_total") > 0, "partial").otherwise("processed"),
            "rejections_truncated": F.col("rejected_total") > export.REJECTION_CAP,
        }
    )


def validate_all(
    envelope: DataFrame, entities: Iterable[str] = ENTITIES, records: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Validated records per entity. Documents are parsed once (:func:`parsed_once`) and each entity
    reads its own column; ``records``, where the source has split them already, are written to
    scratch and each entity reads its own partition."""
    if records is None:
        parsed = parsed_once(envelope) if "body" in envelope.columns else envelope
        return {entity: export.validated(export.entity_records(parsed, entity), entity) for entity in entities}
    path = scratch_dir(envelope.sparkSession, "records")
    records.write.partitionBy("entity").parquet(path)
    stored = envelope.sparkSession.read.schema(records.schema).parquet(path)
    return {entity: export.validated(stored, entity) for entity in entities}


def parsed_once(envelope: DataFrame, hashed: bool = False) -> DataFrame:
    """Envelopes written to scratch, with the hash of the text or none in place of the text.

    One row per document and one column per array: nothing is sorted, so a task holds a row at a time.
    """
    return materialize((export.document_hash(envelope) if hashed else envelope).drop("body"), "envelopes")


def batch_digest(envelope: DataFrame) -> str:
    """A short name of the batch's documents: it depends on them alone, not on their order."""
    one = F.xxhash64("subject_id", "document_id", "payload_sha256").cast("decimal(38,0)")
    row = export.document_hash(envelope).agg(F.count("*").alias("n"), F.sum(one).alias("total")).first()
    return f"{row['n']}-{int(row['total'] or 0) % (1 << 64):016x}"


def ingest(
    spark: SparkSession,
    documents: DataFrame,
    store: VersionedStore,
    now: Column | None = None,
    batch_label: str | None = None,
) -> dict[str, DataFrame]:
    """Validate, de-duplicate, classify and commit one batch of documents.

    Each table is committed on its own; replaying a batch changes nothing. The audit, the
    counts and all rejections are written before the first commit, and a batch that is
    retried under its label keeps those of its first run, whose commits it completes. Without
    a label, a batch is told by its documents and the version it found: another batch after one
    that died has reports of its own.
    Returns the audit rows, the counts, the rejections and the refused documents.
    """
    return ingest_envelopes(spark, export.envelopes(documents, hashed=True), store, now=now, batch_label=batch_label)


def ingest_envelopes(
    spark: SparkSession,
    envelope: DataFrame,
    store: VersionedStore,
    records: DataFrame | None = None,
    now: Column | None = None,
    batch_label: str | None = None,
) -> dict[str, DataFrame]:
    """:func:`ingest` for documents whose envelopes (and perhaps records) are read already.

    Of every stored table only the partitions that hold keys of the batch are read.
    """
    now = F.current_timestamp() if now is None else now
    if records is None:
        envelope = parsed_once(envelope, hashed=True)
    valid = {
        entity: materialize(df, f"valid-{entity}")
        for entity, df in validate_all(envelope, records=records).items()
    }
    catalog = store.read("sources", SOURCES, ("subject_id", "source", "source_name"))
    seen = reduce(
        DataFrame.unionByName,
        [export.good(df).select("subject_id", "source", "source_name") for df in valid.values()],
    )
    merged_catalog = materialize(upsert_sources(catalog, seen), "sources")
    classified: dict[str, DataFrame] = {}
    for entity in ENTITIES:
        rows = batch_rows(valid[entity])
        target = store.read(entity, STORED[entity], needed=export.good(valid[entity]))
        classified[entity] = materialize(classify_batch(target, rows, entity), f"classified-{entity}")
    label = batch_label
    if label is None:
        label = f"v{store.version('sources') + 1:08d}-{batch_digest(envelope)}"
    rejected = export.rejections(valid)
    counts = outcome_counts(valid, classified)
    reports = {"counts": counts, "rejections": rejected, "audit": audit_rows(envelope, counts, rejected)}
    kept = {name: _kept(store, _FOLDERS[name], label, df) for name, df in reports.items()}
    for entity, outcome in classified.items():
        if not outcome.filter(F.col("outcome").isin("inserted", "updated")).limit(1).isEmpty():
            kind = "delta" if store.version(entity) else "base"
            store.commit(entity, delta(outcome, entity, now), kind, IDENTITY)
            if store.deltas(entity) > MOST_DELTAS:
                store.compact(entity, STORED[entity])
    store.commit("sources", merged_catalog, "base")

    return {
        "audit": kept["audit"],
        "counts": kept["counts"],
        "rejections": export.rejection_report(kept["rejections"]),
        "refused": export.refused(envelope),
    }


_FOLDERS = {"audit": "batches", "counts": "batch_counts", "rejections": "batch_rejections"}


def _kept(store: VersionedStore, folder: str, label: str, df: DataFrame) -> DataFrame:
    """``df`` as the first complete run wrote it; a run that died while writing is replaced."""
    path, mark = f"{store.root}/{folder}/batch={label}", f"{folder}/{label}"
    if not store.marked(mark):
        df.write.mode("overwrite").parquet(path)
        store.mark(mark)
    return store.spark.read.schema(df.schema).parquet(path)


__all__ = ["IDENTITY", "audit_rows", "batch_rows", "classify_batch", "delta", "ingest", "ingest_envelopes", "outcome_counts", "validate_all"]
