"""Export documents, validation and upsert.

One document is derived from every event. The same small description gives the text
Spark parses (keys unsorted, spaced) and, in the SQL, its canonical form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from subjectseries_queries.base import ZONE, query, us
from subjectseries.functions.scalars import local_date
from subjectseries.operators import upsert
from subjectseries.plans import ingest as I
from subjectseries.schemas import ENTITIES, MEANINGFUL, STORED
from subjectseries.session import materialize, scratch_dir
from subjectseries.sources import export
from subjectseries.sources.large_export import read_large_documents


# --- the documents --------------------------------------------------------------
class Sql(str):
    """A SQL text expression that already yields JSON."""


ID = Sql("""'"' || id || '"'""")
T = Sql("""'"' || t || '"'""")
CENTS = Sql("CAST(cents AS STRING)")


def to_sql(value, canonical: bool) -> str:
    """SQL that builds the JSON text of ``value``; valid in both engines."""
    if isinstance(value, Sql):
        return f"({value})"
    comma, colon = (",", ":") if canonical else (" , ", ": ")
    if isinstance(value, dict):
        keys = sorted(value) if canonical else list(value)
        parts = [f"'\"{k}\"{colon}' || {to_sql(value[k], canonical)}" for k in keys]
        return f"('{{' || {(' || ' + repr(comma) + ' || ').join(parts)} || '}}')"
    if isinstance(value, list):
        inner = (f" || '{comma}' || ").join(to_sql(v, canonical) for v in value)
        return f"('[' || {inner} || ']')"
    if isinstance(value, str):
        return f"'\"{value}\"'"
    return f"'{value}'"


def pick(condition: str, yes, no, canonical: bool) -> Sql:
    return Sql(
        f"CASE WHEN {condition} THEN {to_sql(yes, canonical)} ELSE {to_sql(no, canonical)} END"
    )


def document(canonical: bool) -> str:
    glucose = {
        "source": "events",
        "source_sample_id": ID,
        "sample_time": T,
        "unit": pick("event_type = 'error'", "mmol/L", "mg/dL", canonical),
        "metadata": {"z": 1, "a": CENTS},
    }
    meal = {"source": "manual", "source_sample_id": ID, "meal_completed_at": T}
    foods = pick("event_type = 'error'", [1], [Sql("""'"' || event_type || '"'"""), "x"], canonical)
    meal_foods = {**meal, "foods": foods}
    meals = pick(
        "event_type = 'purchase'",
        {**meal_foods, "meal_start": T},
        pick("event_type = 'view'", meal, meal_foods, canonical),
        canonical,
    )
    end = Sql("""'"' || t_end || '"'""")
    body = {
        "schema_version": pick("event_type = 'signup' AND cents < 5000", 2, 1, canonical),
        "exported_at": T,
        "data_start": T,
        "data_end": Sql("""'"' || t_data || '"'"""),
        "extra": "ignored",
        "glucose_samples": [
            {**glucose, "value": CENTS},
            {**glucose, "value": Sql("CAST(cents + 1 AS STRING)")},
            "not an object",
        ],
        "workouts": [
            {
                "source": "events",
                "source_name": pick("event_type IN ('view', 'click')", "Strava", "Health", canonical),
                "source_sample_id": ID,
                "sport": pick("cents >= 10000", "running", "cycling", canonical),
                "start_time": T,
                "end_time": end,
                "distance_meters": Sql("CAST(cents - 30000 AS STRING)"),
            }
        ],
        "sleep_sessions": [
            {
                "source": "events",
                "source_sample_id": ID,
                "start_time": T,
                "end_time": end,
                "stage": pick("event_type = 'click'", "", "core", canonical),
            }
        ],
        "weight_measurements": [
            {
                "source": "events",
                "source_sample_id": ID,
                "measured_at": T,
                "value": CENTS,
                "unit": pick("event_type = 'signup'", "lb", "kg", canonical),
            }
        ],
        "meal_events": [meals],
    }
    return to_sql(body, canonical)


def documents(t):
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    later = lambda seconds: F.timestamp_micros(
        F.unix_micros("ts") + (F.col("cents") - seconds) * 1_000_000
    )
    rows = t.events.select(
        "subject_id",
        F.col("source_sample_id").alias("id"),
        "event_type",
        "cents",
        "ts",
        F.date_format("ts", iso).alias("t"),
        F.date_format(later(20_000), iso).alias("t_end"),
        F.date_format(later(1_000), iso).alias("t_data"),
    )
    # The events are one small file, the documents are not: build and parse them in parallel.
    # Without a number, adaptive execution gives more tasks the more rows there are.
    spread = rows.repartition("id")
    return spread.select(
        "subject_id", F.col("id").alias("document_id"), F.expr(document(False)).alias("body")
    )


DOCS = """docs AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS t,
    strftime(make_timestamp(us + (cents - 20000) * 1000000), '%Y-%m-%dT%H:%M:%S.%fZ') AS t_end,
    strftime(make_timestamp(us + (cents - 1000) * 1000000), '%Y-%m-%dT%H:%M:%S.%fZ') AS t_data,
    CASE WHEN event_type = 'signup' AND cents < 5000 THEN 'UNSUPPORTED_SCHEMA_VERSION' WHEN cents <= 1000 THEN 'INVALID_TIMESTAMP' END AS refused
  FROM ev),
good AS (SELECT * FROM docs WHERE refused IS NULL),
recs AS (
  SELECT id AS document_id, 0 AS eo, 'glucose_samples' AS entity, k AS index, CASE WHEN k < 2 THEN id END AS sample_id, subject_id, event_type, cents,
    CASE WHEN k = 2 THEN 'INVALID_REQUEST' WHEN cents + k <= 0 THEN 'INVALID_REQUEST' WHEN event_type = 'error' THEN 'INVALID_UNIT' END AS code
  FROM good, (SELECT unnest(range(3)) AS k)
  UNION ALL SELECT id, 1, 'workouts', 0, id, subject_id, event_type, cents, CASE WHEN event_type NOT IN ('view', 'click') THEN 'UNSUPPORTED_WORKOUT_SOURCE'
    WHEN cents < 10000 OR cents <= 20000 OR cents < 30000 THEN 'INVALID_WORKOUT' END FROM good
  UNION ALL SELECT id, 2, 'sleep_sessions', 0, id, subject_id, event_type, cents, CASE WHEN event_type = 'click' THEN 'INVALID_REQUEST' WHEN cents <= 20000 THEN 'INVALID_TIMESTAMP' END FROM good
  UNION ALL SELECT id, 3, 'weight_measurements', 0, id, subject_id, event_type, cents, CASE WHEN cents >= 10000 THEN 'INVALID_REQUEST' WHEN event_type = 'signup' THEN 'INVALID_UNIT' END FROM good
  UNION ALL SELECT id, 4, 'meal_events', 0, id, subject_id, event_type, cents, CASE WHEN event_type IN ('purchase', 'error') THEN 'INVALID_REQUEST' END FROM good)"""


@query("s1_export_records", f"WITH {DOCS} SELECT document_id, entity, index, sample_id FROM recs")
def export_records(t):
    rows = export.records(export.envelopes(documents(t)))
    return rows.select(
        "document_id",
        "entity",
        "index",
        F.try_variant_get("record", "$.source_sample_id", "string").alias("sample_id"),
    )


@query("s2_envelope_check", f"WITH {DOCS} SELECT id AS document_id, refused AS reject_code FROM docs")
def envelope_check(t):
    return export.envelopes(documents(t)).select("document_id", "reject_code")


@query("s3_record_validation", f"WITH {DOCS} SELECT document_id, entity, index, code FROM recs")
def record_validation(t):
    valid = I.validate_all(export.envelopes(documents(t)))
    out = None
    for entity, df in valid.items():
        part = df.select(
            "document_id", F.lit(entity).alias("entity"), "index", F.col("rejection.code").alias("code")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "s4_rejection_report",
    f"""WITH {DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY eo, index) AS rn,
  count(*) OVER (PARTITION BY document_id) AS total FROM recs WHERE code IS NOT NULL)
SELECT document_id, entity AS entity_type, index, sample_id, code, total > 2 AS truncated FROM r WHERE rn <= 2""",
)
def rejection_report(t):
    valid = I.validate_all(export.envelopes(documents(t)))
    report = export.rejection_report(export.rejections(valid), cap=2)
    return report.select(
        "document_id",
        "entity_type",
        "index",
        F.col("source_sample_id").alias("sample_id"),
        "code",
        "truncated",
    )


@query(
    "s5_timestamp_normalization",
    """SELECT id, event_type IN ('view', 'click') AS zoned, CASE event_type WHEN 'view' THEN us WHEN 'click' THEN us - 7200000000
  WHEN 'error' THEN NULL ELSE us END AS us FROM ev""",
)
def timestamp_normalization(t):
    naive = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (
        F.when(F.col("event_type") == "view", F.concat(naive, F.lit("Z")))
        .when(F.col("event_type") == "click", F.concat(naive, F.lit("+02:00")))
        .when(F.col("event_type") == "error", F.concat(F.lit("on "), naive))
        .otherwise(naive)
    )
    return t.events.select(
        F.col("source_sample_id").alias("id"),
        export.has_zone(text).alias("zoned"),
        us(export.parse_time(text), "us"),
    )


@query(
    "s6_last_occurrence_wins",
    """SELECT subject_id, event_type, day, max_by(id, event_id) AS id, max_by(v::DOUBLE, event_id) AS value FROM ev GROUP BY 1, 2, 3""",
)
def last_wins(t):
    rows = t.events.withColumn("day", local_date("ts", ZONE))
    out = upsert.keep_last(rows, ["event_id"], ["subject_id", "event_type", "day"])
    return out.select(
        "subject_id", "event_type", "day", F.col("source_sample_id").alias("id"), "value"
    )


@query(
    "w10_keep_latest_row",
    """SELECT * EXCLUDE (rn) FROM (SELECT subject_id, event_type, id, us, row_number() OVER (PARTITION BY subject_id, event_type ORDER BY us DESC, event_id DESC) AS rn FROM ev) WHERE rn = 1""",
)
def keep_latest(t):
    out = upsert.keep_last(t.events, ["ts", "event_id"], ["subject_id", "event_type"])
    return out.select("subject_id", "event_type", F.col("source_sample_id").alias("id"), us("ts", "us"))


# --- catalog and upsert -----------------------------------------------------------
@query(
    "s7_source_catalog",
    """WITH rec AS (SELECT DISTINCT subject_id, CASE WHEN event_type = 'purchase' THEN 'manual' ELSE 'events' END AS source,
    CASE event_type WHEN 'view' THEN 'Strava' WHEN 'click' THEN 'Stelo' WHEN 'signup' THEN 'Watch' END AS source_name, event_type FROM ev),
old AS (SELECT subject_id, source, source_name, CASE WHEN event_type = 'error' THEN 'device' END AS source_type FROM rec WHERE event_type IN ('error', 'click')
  UNION ALL SELECT DISTINCT subject_id, 'events', 'Retired', 'app' FROM ev),
new AS (SELECT subject_id, source, source_name, CASE WHEN source = 'manual' THEN 'manual' WHEN source_name IN ('Strava', 'Stelo', 'Health') THEN 'app' END AS source_type FROM rec)
SELECT coalesce(n.subject_id, o.subject_id) AS subject_id, coalesce(n.source, o.source) AS source,
  coalesce(n.source_name, o.source_name) AS source_name, coalesce(n.source_type, o.source_type) AS source_type
FROM old o FULL OUTER JOIN new n ON o.subject_id = n.subject_id AND o.source = n.source AND o.source_name IS NOT DISTINCT FROM n.source_name""",
)
def source_catalog(t):
    kind = F.col("event_type")
    name = (
        F.when(kind == "view", "Strava").when(kind == "click", "Stelo").when(kind == "signup", "Watch")
    )
    source = F.when(kind == "purchase", "manual").otherwise("events")
    records = t.events.select(
        "subject_id", source.alias("source"), name.alias("source_name"), "event_type"
    )
    known = (
        records.filter(kind.isin("error", "click"))
        .withColumn("source_type", F.when(kind == "error", "device"))
        .drop("event_type")
    )
    retired = t.events.select(
        "subject_id",
        F.lit("events").alias("source"),
        F.lit("Retired").alias("source_name"),
        F.lit("app").alias("source_type"),
    )
    return upsert.upsert_sources(known.unionByName(retired).distinct(), records)


def _stored_glucose(t, value, deleted):
    none = F.lit(None)
    return t.events.select(
        "subject_id",
        F.lit("events").alias("source"),
        "source_sample_id",
        none.cast("string").alias("source_name"),
        F.col("ts").alias("sample_time"),
        value.cast("decimal(10,3)").alias("value_mg_dl"),
        none.cast("string").alias("trend"),
        F.lit("{}").alias("metadata"),
        F.col("ts").alias("ingested_at"),
        F.col("ts").alias("updated_at"),
        deleted.alias("deleted_at"),
        "event_type",
    )


def _upsert_sides(t):
    """Stored: all but clicks, signups deleted. Batch: all but purchases, errors and signups changed."""
    kind = F.col("event_type")
    deleted = F.when(kind == "signup", F.col("ts"))
    stored = _stored_glucose(t, F.col("value"), deleted).filter(kind != "click").drop("event_type")
    changed = F.col("value") + F.when(kind.isin("error", "signup"), 1).otherwise(0)
    batch = (
        _stored_glucose(t, changed, F.lit(None).cast("timestamp"))
        .filter(kind != "purchase")
        .drop("event_type", "ingested_at", "updated_at", "deleted_at")
    )
    return stored, batch


OUTCOME = "CASE event_type WHEN 'click' THEN 'inserted' WHEN 'error' THEN 'updated' WHEN 'purchase' THEN 'kept' ELSE 'unchanged' END"


@query("s8_upsert_outcomes", f"SELECT subject_id, id, {OUTCOME} AS outcome FROM ev")
def upsert_outcomes(t):
    stored, batch = _upsert_sides(t)
    out = upsert.classify(stored, batch, MEANINGFUL["glucose_samples"])
    return out.select("subject_id", F.col("source_sample_id").alias("id"), "outcome")


@query(
    "s8_upsert_next_version",
    """SELECT subject_id, id, CAST(v + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS DOUBLE) AS value,
  CASE WHEN event_type = 'click' THEN 0 ELSE us END AS ingested, CASE WHEN event_type IN ('click', 'error') THEN 0 ELSE us END AS updated,
  event_type = 'signup' AS deleted FROM ev""",
)
def upsert_next(t):
    stored, batch = _upsert_sides(t)
    classified = upsert.classify(stored, batch, MEANINGFUL["glucose_samples"])
    out = upsert.next_version(
        classified,
        MEANINGFUL["glucose_samples"],
        STORED["glucose_samples"].names,
        F.timestamp_micros(F.lit(0)),
    )
    return out.select(
        "subject_id",
        F.col("source_sample_id").alias("id"),
        F.col("value_mg_dl").cast("double").alias("value"),
        us("ingested_at", "ingested"),
        us("updated_at", "updated"),
        F.col("deleted_at").isNotNull().alias("deleted"),
    )


@query(
    "j7_full_outer_match",
    "SELECT subject_id, id, event_type <> 'click' AS in_stored, event_type <> 'purchase' AS in_batch FROM ev",
)
def full_match(t):
    stored, batch = _upsert_sides(t)
    out = upsert.classify(stored, batch, MEANINGFUL["glucose_samples"])
    return out.select(
        "subject_id",
        F.col("source_sample_id").alias("id"),
        F.col("stored").isNotNull().alias("in_stored"),
        F.col("incoming").isNotNull().alias("in_batch"),
    )


def _validated_once(envelope):
    """Validated records written once, as ingest does: they are both counted and classified."""
    return {entity: materialize(df, f"valid-{entity}") for entity, df in I.validate_all(envelope).items()}


def _classified(t, valid):
    """Stored before: views as the batch has them, clicks with another value."""
    kind, none = F.col("event_type"), F.lit(None)
    stored = t.events.filter(kind.isin("view", "click")).select(
        "subject_id",
        F.lit("events").alias("source"),
        "source_sample_id",
        none.cast("string").alias("source_name"),
        F.col("ts").alias("sample_time"),
        (F.col("cents") + F.when(kind == "view", 1).otherwise(0))
        .cast("decimal(10,3)")
        .alias("value_mg_dl"),
        none.cast("string").alias("trend"),
        F.concat(F.lit('{"a":'), F.col("cents").cast("string"), F.lit(',"z":1}')).alias("metadata"),
        F.col("ts").alias("ingested_at"),
        F.col("ts").alias("updated_at"),
        none.cast("timestamp").alias("deleted_at"),
    )
    out = {}
    for entity in ENTITIES:
        target = stored
        if entity != "glucose_samples":
            target = t.spark.createDataFrame([], STORED[entity])
        out[entity] = I.classify_batch(target, I.batch_rows(valid[entity]), entity)
    return out


COUNTS = f"""{DOCS}, cnt AS (SELECT document_id, entity AS entity_type, count(*) AS received,
  count(*) FILTER (code IS NOT NULL) AS rejected, count(*) FILTER (code IS NULL) > 0 AS has_good, any_value(event_type) AS event_type FROM recs GROUP BY 1, 2),
outc AS (SELECT document_id, entity_type, received, CAST(has_good AND NOT (entity_type = 'glucose_samples' AND event_type IN ('view', 'click')) AS BIGINT) AS inserted,
  CAST(has_good AND entity_type = 'glucose_samples' AND event_type = 'click' AS BIGINT) AS updated,
  CAST(has_good AND entity_type = 'glucose_samples' AND event_type = 'view' AS BIGINT) AS unchanged, rejected FROM cnt)"""


@query("s9_outcome_counts", f"WITH {COUNTS} SELECT * FROM outc")
def outcome_counts(t):
    valid = _validated_once(export.envelopes(documents(t)))
    return I.outcome_counts(valid, _classified(t, valid))


_WIDE = ", ".join(
    f"CAST(sum({o}) FILTER (entity_type = '{e}') AS BIGINT) AS {I.AUDIT_PREFIX[e]}_{o}"
    for e in ENTITIES
    for o in I.OUTCOMES
)


@query(
    "s10_batch_audit",
    f"""WITH {COUNTS}, w AS (SELECT document_id, {_WIDE}, CAST(sum(rejected) AS BIGINT) AS rejected_total FROM outc GROUP BY 1)
SELECT w.*, CASE WHEN rejected_total > 0 THEN 'partial' ELSE 'processed' END AS status, rejected_total > 100 AS rejections_truncated,
  subject_id, us AS data_start, us + (cents - 1000) * 1000000 AS data_end, sha256({document(True)}) AS payload_sha256
FROM w JOIN good ON w.document_id = good.id""",
)
def batch_audit(t):
    envelope = I.parsed_once(export.envelopes(documents(t), hashed=True), hashed=True)
    valid = _validated_once(envelope)
    counts = I.outcome_counts(valid, _classified(t, valid))
    out = I.audit_rows(envelope, counts, export.rejections(valid))
    return out.withColumns(
        {"data_start": F.unix_micros("data_start"), "data_end": F.unix_micros("data_end")}
    ).drop("schema_version", "exported_at")


@query(
    "s1_large_documents",
    """SELECT event_type AS document, 'glucose_samples' AS entity, k AS index, sample_id, cents FROM (
  SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, id AS sample_id, cents FROM ev
  UNION ALL SELECT DISTINCT event_type, 0, NULL, NULL FROM ev)""",
)
def large_documents(t):
    """One file per event type, written row by row, and read back in pieces."""
    path = scratch_dir(t.spark, "large-documents")
    head = (
        '{"schema_version": 1, "exported_at": "2024-02-01T00:00:00Z", "data_start": "2024-01-01T00:00:00Z", '
        '"extra": [{"a": "},{"}, [1, 2]], "data_end": "2024-02-01T00:00:00Z", "glucose_samples": ["no, object"'
    )
    lines = t.events.select("event_type", "event_id", "source_sample_id", "cents").select(
        "event_type",
        "event_id",
        F.concat(
            F.lit(', {"source_sample_id": "'),
            "source_sample_id",
            F.lit(r'", "metadata": {"note": "a \"quoted\", ]}", "list": [1, {}]}, "value": '),
            F.col("cents").cast("string"),
            F.lit("}"),
        ).alias("value"),
    )
    types = t.events.select("event_type").distinct()
    ends = types.select("event_type", F.explode(F.array(F.lit(-1), F.lit(2**62))).alias("event_id")).withColumn(
        "value", F.when(F.col("event_id") < 0, head).otherwise(F.lit('], "meal_events": []}'))
    )
    written = lines.unionByName(ends).repartition("event_type").sortWithinPartitions("event_type", "event_id")
    written.drop("event_id").write.partitionBy("event_type").text(path)
    found = read_large_documents(t.spark, path)
    return found.records.select(
        F.regexp_extract("document_id", "event_type=([^/]*)", 1).alias("document"),
        "entity",
        F.col("index").cast("long").alias("index"),
        F.try_variant_get("record", "$.source_sample_id", "string").alias("sample_id"),
        F.try_variant_get("record", "$.value", "bigint").alias("cents"),
    )
