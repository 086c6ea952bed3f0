"""Export documents: envelope check, per-record validation, rejection report.

Input is a DataFrame of documents ``(subject_id, document_id, body)``, ``body`` being
one JSON text. Records stay in the JVM as variants until each entity is typed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subjectseries.operators.barrier import settled
from subjectseries.schemas import ENTITIES

SCHEMA_VERSION = 1
REJECTION_CAP = 100

# Accepted forms of a time text. A missing zone means UTC.
TIME_TEXT = r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?\s?([Zz]|[+-]\d{2}:?\d{2})?)?$"
ZONED_TEXT = r"([Zz]|[+-]\d{2}:?\d{2})$"
# Fixed value: numeric times beyond this are milliseconds, not seconds.
MAX_EPOCH_SECONDS = 20_000_000_000


def read_documents(spark: SparkSession, path: str, subject_id: str) -> DataFrame:
    """One document per file, all for one subject."""
    return spark.read.text(path, wholetext=True).select(
        F.lit(subject_id).alias("subject_id"),
        F.col("_metadata.file_path").alias("document_id"),
        F.col("value").alias("body"),
    )


# --- typed access to variant fields --------------------------------------------
# Fields are taken out in stages, each a projection of its own: variant, then its kind
# and text, then the typed value. Later rules only read columns, so no extraction is
# repeated and the generated code stays small.
def parse_time(text: Column) -> Column:
    """Instant of an ISO text under a UTC session; null when it is not one."""
    upper = F.translate(text, "tz,", "TZ.")
    return F.when(text.rlike(TIME_TEXT), upper.try_cast("timestamp"))


def has_zone(text: Column) -> Column:
    return text.rlike(ZONED_TEXT)


def _kind(name: str) -> Column:
    return F.col(f"k_{name}")


def _value(name: str) -> Column:
    return F.col(f"x_{name}")


def _absent(name: str) -> Column:
    """Missing, or JSON null."""
    return _kind(name).isNull() | (_kind(name) == "VOID")


def _is(name: str, kind: str) -> Column:
    return F.coalesce(_kind(name).startswith(kind), F.lit(False))


def _typed(name: str, kind: str) -> Column:
    k, s = _kind(name), F.col(f"s_{name}")
    is_text = k == "STRING"
    is_number = k.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    if kind == "text":
        return F.when(is_text, s)
    if kind == "number":
        return F.when(is_text | is_number, s).try_cast("decimal(38,18)")
    if kind == "integer":
        return F.when(is_text | is_number, s).try_cast("decimal(38,18)").try_cast("int")
    if kind == "time":
        scale = F.when(F.abs(s.try_cast("double")) > MAX_EPOCH_SECONDS, 1_000).otherwise(1_000_000)
        micros = F.round(s.try_cast("double") * scale).cast("bigint")
        return F.when(is_text, parse_time(s)).when(is_number, F.timestamp_micros(micros))
    if kind == "list":
        return F.try_variant_get(F.col(f"v_{name}"), "$", "array<variant>")
    raise ValueError(f"unknown kind {kind!r}")


def with_fields(df: DataFrame, variant: str, fields: dict[str, str]) -> DataFrame:
    """Add ``v_``, ``k_``, ``s_`` and ``x_`` columns (variant, kind, text, value) per field."""
    taken = df.withColumns(
        {f"v_{n}": F.try_variant_get(F.col(variant), f"$.{n}", "variant") for n in fields}
    )
    described = taken.withColumns(
        {
            # An object is told by its JSON text, which is stored anyway.
            **{f"k_{n}": F.schema_of_variant(F.col(f"v_{n}")) for n, kind in fields.items() if kind != "object"},
            **{f"s_{n}": F.to_json(f"v_{n}") for n, kind in fields.items() if kind == "object"},
            **{
                f"s_{n}": F.try_variant_get(F.col(f"v_{n}"), "$", "string")
                for n, kind in fields.items()
                if kind in ("text", "number", "integer", "time")
            },
        }
    )
    return described.withColumns({f"x_{n}": _typed(n, kind) for n, kind in fields.items() if kind != "object"})


# --- envelope --------------------------------------------------------------------
_HEADER = {
    "schema_version": "integer",
    "exported_at": "time",
    "data_start": "time",
    "data_end": "time",
}


def envelopes(documents: DataFrame, hashed: bool = False) -> DataFrame:
    """Parse documents: header, items of each array and a ``reject_code`` (null when acceptable).

    With ``hashed``, the hash of the payload comes from the same parse.
    """
    parsed = documents.select(
        "subject_id", "document_id", "body", F.try_parse_json("body").alias("doc")
    )
    arrays = {name: F.try_variant_get("doc", f"$.{name}", "array<variant>") for name in ENTITIES}
    fielded = with_fields(parsed, "doc", _HEADER).withColumns(arrays)
    # What is there but no array has no items; the schema of the items is not needed to tell.
    arrays_ok = reduce(
        lambda a, b: a & b,
        [F.col(name).isNotNull() | F.try_variant_get("doc", f"$.{name}", "variant").isNull() for name in ENTITIES],
    )
    header_ok = reduce(lambda a, b: a & b, [_value(name).isNotNull() for name in _HEADER])
    code = (
        F.when(~(F.col("doc").isNotNull() & header_ok & arrays_ok), "INVALID_REQUEST")
        .when(_value("schema_version") != SCHEMA_VERSION, "UNSUPPORTED_SCHEMA_VERSION")
        .when(_value("data_end") <= _value("data_start"), "INVALID_TIMESTAMP")
    )
    return settled(
        fielded,
        "subject_id",
        "document_id",
        "body",
        *ENTITIES,
        *[_value(name).alias(name) for name in _HEADER],
        code.alias("reject_code"),
        *([F.sha2(F.to_json("doc"), 256).alias("payload_sha256")] if hashed else []),
    )


def accepted(envelope: DataFrame) -> DataFrame:
    return envelope.filter(F.col("reject_code").isNull())


def refused(envelope: DataFrame) -> DataFrame:
    return envelope.filter(F.col("reject_code").isNotNull()).select(
        "subject_id", "document_id", "reject_code"
    )


def records(envelope: DataFrame) -> DataFrame:
    """Records of accepted documents: ``subject_id, document_id, exported_at, entity, index, record``.

    One parse and one pass give the five arrays; the element index is kept.
    """
    arrays = F.array(*[F.struct(F.lit(name).alias("entity"), F.col(name).alias("items")) for name in ENTITIES])
    return (
        accepted(envelope)
        .select("subject_id", "document_id", "exported_at", F.explode(arrays).alias("a"))
        .select(
            "subject_id",
            "document_id",
            "exported_at",
            F.col("a.entity").alias("entity"),
            F.posexplode("a.items").alias("index", "record"),
        )
    )


def entity_records(envelope: DataFrame, entity: str) -> DataFrame:
    """:func:`records` of one entity; from a stored envelope, only its column is read."""
    return accepted(envelope).select(
        "subject_id",
        "document_id",
        "exported_at",
        F.lit(entity).alias("entity"),
        F.posexplode(entity).alias("index", "record"),
    )


# --- per-record rules --------------------------------------------------------------
METRICS = {
    "distance_meters": "decimal(12,3)",
    "active_energy_kcal": "decimal(12,3)",
    "average_heart_rate": "decimal(10,3)",
    "maximum_heart_rate": "decimal(10,3)",
}
_IDENTITY_FIELDS = {"source": "text", "source_name": "text", "source_sample_id": "text"}
FIELDS: dict[str, dict[str, str]] = {
    "glucose_samples": {
        **_IDENTITY_FIELDS,
        "sample_time": "time",
        "value": "number",
        "unit": "text",
        "trend": "text",
        "metadata": "object",
    },
    "workouts": {
        **_IDENTITY_FIELDS,
        "sport": "text",
        "start_time": "time",
        "end_time": "time",
        **{name: "number" for name in METRICS},
        "metadata": "object",
    },
    "sleep_sessions": {
        **_IDENTITY_FIELDS,
        "start_time": "time",
        "end_time": "time",
        "stage": "text",
        "metadata": "object",
    },
    "weight_measurements": {
        **_IDENTITY_FIELDS,
        "measured_at": "time",
        "value": "number",
        "unit": "text",
        "metadata": "object",
    },
    "meal_events": {
        **_IDENTITY_FIELDS,
        "meal_completed_at": "time",
        "foods": "list",
        "notes": "text",
        "metadata": "object",
    },
}

# A rule is (holds, code, message); the first that does not hold names the rejection.
Rule = tuple[Column, str, str]
BAD = "INVALID_REQUEST"


def _required_text(name: str) -> Rule:
    return (F.length(_value(name)) > 0, BAD, f"{name} must be a non-empty string")


def _optional_text(name: str) -> Rule:
    return (_absent(name) | _is(name, "STRING"), BAD, f"{name} must be a string")


def _time(name: str) -> Rule:
    return (_value(name).isNotNull(), BAD, f"{name} must be a time")


def _metadata() -> Rule:
    text = F.col("s_metadata")
    return (text.isNull() | text.startswith("{"), BAD, "metadata must be an object")


def _object() -> Rule:
    # Only an object has fields; the costly schema of a record is for those without a source.
    holds = F.col("v_source").isNotNull() | F.schema_of_variant("record").startswith("OBJECT")
    return (holds, BAD, "record must be a JSON object")


def _positive(stored: str) -> Rule:
    holds = (_value("value") > 0) & (_value("value").try_cast(stored) > 0)
    return (holds, BAD, "value must be a number above zero")


def _unit(unit: str) -> list[Rule]:
    return [
        (_value("unit").isNotNull(), BAD, "unit must be a string"),
        (_value("unit") == unit, "INVALID_UNIT", f"unit must be {unit}"),
    ]


def _optional_number(name: str, stored: str) -> Rule:
    holds = _absent(name) | _value(name).try_cast(stored).isNotNull()
    return (holds, BAD, f"{name} must be a number")


def _ordered(code: str) -> Rule:
    holds = _value("end_time") > _value("start_time")
    return (holds, code, "end_time must be later than start_time")


def rules(entity: str) -> list[Rule]:
    """Checks in order: structure field by field, then meaning."""
    head: list[Rule] = [
        _object(),
        _required_text("source"),
        _optional_text("source_name"),
        _required_text("source_sample_id"),
    ]
    if entity == "glucose_samples":
        body = [
            _time("sample_time"),
            _positive("decimal(10,3)"),
            *_unit("mg/dL"),
            _optional_text("trend"),
            _metadata(),
        ]
    elif entity == "weight_measurements":
        body = [_time("measured_at"), _positive("decimal(10,6)"), *_unit("kg"), _metadata()]
    elif entity == "sleep_sessions":
        body = [
            _time("start_time"),
            _time("end_time"),
            _required_text("stage"),
            _metadata(),
            _ordered("INVALID_TIMESTAMP"),
        ]
    elif entity == "workouts":
        strava = F.coalesce(_value("source_name") == "Strava", F.lit(False))
        body = [
            _required_text("sport"),
            _time("start_time"),
            _time("end_time"),
            *[_optional_number(name, kind) for name, kind in METRICS.items()],
            _metadata(),
            (strava, "UNSUPPORTED_WORKOUT_SOURCE", "source_name must be Strava"),
            (_value("sport") == "running", "INVALID_WORKOUT", "sport must be running"),
            _ordered("INVALID_WORKOUT"),
            *[
                (
                    _absent(name) | (_value(name) >= 0),
                    "INVALID_WORKOUT",
                    f"{name} must not be negative",
                )
                for name in METRICS
            ],
        ]
    elif entity == "meal_events":
        texts = F.forall(_value("foods"), lambda item: F.schema_of_variant(item) == "STRING")
        allowed = F.array(*[F.lit(name) for name in FIELDS["meal_events"]])
        body = [
            _time("meal_completed_at"),
            (_absent("foods") | texts, BAD, "foods must be a list of strings"),
            _optional_text("notes"),
            _metadata(),
            (F.size(F.array_except("keys", allowed)) == 0, BAD, "unexpected field"),
        ]
    else:
        raise ValueError(f"unknown entity {entity!r}")
    return [*head, *body]


def _rejection(entity: str) -> Column:
    chain = None
    for holds, code, message in rules(entity):
        failed = ~F.coalesce(holds, F.lit(False))
        reason = F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))
        chain = F.when(failed, reason) if chain is None else chain.when(failed, reason)
    return chain


def _stored_columns(entity: str) -> list[Column]:
    """Values at storage scale, under their stored names."""
    out: list[Column] = []
    for name, kind in FIELDS[entity].items():
        if name == "value":
            stored = {"glucose_samples": ("value_mg_dl", "decimal(10,3)")}.get(
                entity, ("value_kg", "decimal(10,6)")
            )
            out.append(_value("value").try_cast(stored[1]).alias(stored[0]))
        elif name in METRICS:
            out.append(_value(name).try_cast(METRICS[name]).alias(name))
        elif name == "metadata":
            out.append(F.coalesce("s_metadata", F.lit("{}")).alias("metadata"))
        elif kind == "list":
            texts = F.try_variant_get(F.col(f"v_{name}"), "$", "array<string>")
            out.append(F.coalesce(texts, F.array().cast("array<string>")).alias(name))
        elif name != "unit":
            out.append(_value(name).alias(name))
    return out


def validated(all_records: DataFrame, entity: str) -> DataFrame:
    """Typed records of one entity with ``rejection`` (null, or code and message)."""
    rows = all_records.filter(F.col("entity") == entity)
    if entity == "meal_events":
        rows = rows.withColumn(
            "keys", F.map_keys(F.try_variant_get("record", "$", "map<string,variant>"))
        )
    fielded = with_fields(rows, "record", FIELDS[entity])
    return settled(
        fielded,
        "subject_id",
        "document_id",
        "exported_at",
        "index",
        F.col("s_source_sample_id").alias("raw_sample_id"),
        _rejection(entity).alias("rejection"),
        *_stored_columns(entity),
    )


def good(validated_records: DataFrame) -> DataFrame:
    return validated_records.filter(F.col("rejection").isNull()).drop("rejection", "raw_sample_id")


def rejections(validated_by_entity: dict[str, DataFrame]) -> DataFrame:
    """All rejected records with the one reason each."""
    parts = [
        df.filter(F.col("rejection").isNotNull()).select(
            "subject_id",
            "document_id",
            F.lit(ENTITIES.index(entity)).alias("entity_order"),
            F.lit(entity).alias("entity_type"),
            "index",
            F.col("raw_sample_id").alias("source_sample_id"),
            "rejection.code",
            "rejection.message",
        )
        for entity, df in validated_by_entity.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def rejection_report(rejected: DataFrame, cap: int | None = None) -> DataFrame:
    """The first ``cap`` rejections of each document, and whether there are more.

    Without a cap all rejections are reported and none is truncated.
    """
    if cap is None:
        return rejected.withColumn("truncated", F.lit(False))
    by_doc = Window.partitionBy("document_id")
    ranked = rejected.withColumn(
        "_rank", F.row_number().over(by_doc.orderBy("entity_order", "index"))
    ).filter(F.col("_rank") <= cap + 1)
    return (
        ranked.withColumn("truncated", F.max("_rank").over(by_doc) > F.lit(cap))
        .filter(F.col("_rank") <= cap)
        .drop("_rank")
    )


def document_hash(envelope: DataFrame) -> DataFrame:
    """``envelope`` with the hash of each payload, which a source may have made already."""
    if "payload_sha256" in envelope.columns:
        return envelope
    return envelope.withColumn("payload_sha256", F.sha2(F.to_json(F.try_parse_json("body")), 256))
