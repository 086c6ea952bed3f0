"""Export files of any size: one document is read by many tasks.

A JSON text cannot be cut without knowing what is a string and how deep a bracket lies. Files are
read as fragments between commas, split over tasks as any text file. What a fragment does depends
only on whether it starts inside a string: the number of unescaped quotes tells whether the next
one does, and for either start the brackets outside strings tell how much deeper the next one
is. Such summaries add up over a file block, and those of the blocks of a file, in order, give
each block its true start; inside a block, running sums give it to each fragment. A comma
outside strings at depth 1 or 2 ends an element: a field of the document, or one item of one of
its arrays. Fragments are joined again by element, and an item's index is its distance from
the element that opened its array, so no task sees a document.

The header fields, with an empty array for each one found, are a small document of the same form;
it is checked by the rules that hold for small ones. A file that is no JSON object is refused.
The payload's hash is one over its elements in order, so it differs from that of a small document.
A record is parsed by one task; a document of very many top-level fields is one array of them. An
empty file has no rows, and text after the document refuses it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subjectseries.schemas import ENTITIES
from subjectseries.session import materialize
from subjectseries.sources import export

# Fields of the document that are checked.
HEADER = ("schema_version", "exported_at", "data_start", "data_end")
#: Elements whose hashes are joined first.
HASHED = 10_000
_FIELD = r'(?s)^\s*"((?:[^"\\]|\\.)*)"\s*:\s*(.*?)\s*$'


@dataclass(frozen=True)
class SplitExport:
    """What :func:`subjectseries.plans.ingest.ingest_envelopes` takes."""

    envelope: DataFrame
    records: DataFrame


def _deeper(text: Column) -> Column:
    """Opening less closing brackets outside strings; ``text`` has no escapes and starts outside."""
    bare = F.regexp_replace(text, r'"[^"]*("|$)', "")
    return F.length(F.translate(bare, "}]", "")) - F.length(F.translate(bare, "{[", ""))


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, block, at, text) and the effect of each fragment for both starts."""
    raw = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("document_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("text"),
    )
    bare = F.regexp_replace("text", r"(?s)\\.", "")
    quotes = F.length("_bare") - F.length(F.translate("_bare", '"', ""))
    return raw.withColumn("_bare", bare).select(
        "document_id",
        "block",
        "at",
        "text",
        (quotes % 2).alias("flip"),
        _deeper(F.col("_bare")).alias("outside"),
        _deeper(F.concat(F.lit('"'), "_bare")).alias("inside"),
    )


def _running(*order: str, keys: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def structure(found: DataFrame) -> DataFrame:
    """Fragments with the depth before and after them, and whether a structural comma follows."""
    within = _running("at", keys=("document_id", "block"))
    turned = found.withColumn("turns", F.sum("flip").over(within) - F.col("flip"))
    even = F.col("turns") % 2 == 0
    chosen = turned.withColumns(
        {
            "same": F.when(even, F.col("outside")).otherwise(F.col("inside")),
            "other": F.when(even, F.col("inside")).otherwise(F.col("outside")),
        }
    ).drop("outside", "inside")
    # Running sums for both starts come from the same sort; later only one of them is taken.
    summed = chosen.withColumns({"same_run": F.sum("same").over(within), "other_run": F.sum("other").over(within)})
    both = materialize(summed, "export-fragments")
    blocks = both.groupBy("document_id", "block").agg(
        F.sum("flip").alias("flips"), F.sum("same").alias("same_sum"), F.sum("other").alias("other_sum")
    )
    along = _running("block", keys=("document_id",))
    started = blocks.withColumn("start_in", (F.sum("flips").over(along) - F.col("flips")) % 2)
    total = F.when(F.col("start_in") == 0, F.col("same_sum")).otherwise(F.col("other_sum"))
    started = started.withColumn("total", total)
    starts = started.select(
        "document_id", "block", "start_in", (F.sum("total").over(along) - F.col("total")).alias("depth")
    )
    known = both.join(starts, ["document_id", "block"]).withColumn(
        "step", F.when(F.col("start_in") == 0, F.col("same")).otherwise(F.col("other"))
    )
    run = F.when(F.col("start_in") == 0, F.col("same_run")).otherwise(F.col("other_run"))
    after = F.col("depth") + run
    placed = known.withColumn("after", after).select(
        "document_id",
        "block",
        "at",
        "text",
        (F.col("after") - F.col("step")).alias("before"),
        "after",
        ((F.col("start_in") + F.col("turns") + F.col("flip")) % 2).alias("in_string"),
    )
    return placed.withColumn("ends", ((F.col("in_string") == 0) & (F.col("after") <= 2)).cast("int"))


def elements(placed: DataFrame) -> DataFrame:
    """(document_id, element, text, before, after, in_string): fields and items, numbered by document."""
    along = _running("block", keys=("document_id",))
    ends = placed.groupBy("document_id", "block").agg(F.sum("ends").alias("n"))
    ahead = ends.select("document_id", "block", (F.sum("n").over(along) - F.col("n")).alias("ahead"))
    within = _running("at", keys=("document_id", "block"))
    numbered = placed.join(ahead, ["document_id", "block"]).withColumn(
        "element", F.col("ahead") + F.sum("ends").over(within) - F.col("ends")
    )
    order = F.struct("block", "at")
    pieces = F.sort_array(F.collect_list(F.struct("block", "at", "text")))
    return numbered.groupBy("document_id", "element").agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), ",").alias("text"),
        F.min_by("before", order).alias("before"),
        F.max_by("after", order).alias("after"),
        F.max_by("in_string", order).alias("in_string"),
    )


def read_large_documents(spark: SparkSession, path: str, subject_id: str | None = None) -> SplitExport:
    """One document per file below ``path``, for one subject (or for the name of its folder)."""
    cut = elements(structure(fragments(spark, path)))
    ends = cut.groupBy("document_id").agg(F.max("element").alias("last"))
    rows = cut.join(ends, "document_id")
    # The document's own brackets belong to its first and its last element.
    first, final = F.col("element") == 0, F.col("element") == F.col("last")
    opened = ~first | F.col("text").rlike(r"^\s*\{")
    closed = F.when(final, (F.col("after") == 0) & (F.col("in_string") == 0) & F.col("text").rlike(r"\}\s*$")).otherwise(
        F.col("after") > 0
    )
    text = F.when(first, F.regexp_replace("text", r"^\s*\{", "")).otherwise(F.col("text"))
    text = F.when(final, F.regexp_replace(text, r"\}\s*$", "")).otherwise(text)
    rows = rows.select(
        "document_id",
        "element",
        "last",
        F.col("before") <= 1,
        F.col("before"),
        F.greatest(F.col("after"), F.lit(1)).alias("after"),
        opened & closed & (first | (F.col("before") > 0)) & (F.col("before") <= 2),
        text.alias("text"),
    ).toDF("document_id", "element", "last", "is_field", "before", "after", "sound", "text")
    empty = F.col("text").rlike(r"^\s*$")
    key = F.when(F.col("is_field"), F.regexp_extract("text", _FIELD, 1))
    value = F.when(F.col("is_field"), F.regexp_extract("text", _FIELD, 2)).otherwise(F.trim("text"))
    rows = rows.withColumns({"key": key, "value": value})
    # A field that goes on opens an array or an object, whose other items have it as their owner.
    rows = rows.withColumns(
        {
            "is_array": F.col("is_field") & F.col("value").startswith("["),
            "goes_on": F.col("after") > 1,
            "opens": F.when(F.col("is_field"), F.substring("value", 1, 1)),
        }
    )
    rows = materialize(rows, "export-elements")
    opening = F.when(F.col("is_field"), F.struct("element", "key", "opens"))
    fields = rows.where("is_field").groupBy("document_id").agg(
        F.sort_array(F.collect_list(opening)).alias("fields")
    )
    owner = F.element_at(F.filter("fields", lambda f: f["element"] <= F.col("element")), -1)
    owned = rows.join(fields, "document_id", "left").withColumn("owner", owner).drop("fields")
    inner = F.when(F.col("is_field"), F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
    for bracket, closing in (("[", r"\]"), ("{", r"\}")):
        ended = (F.col("owner.opens") == bracket) & ~F.col("goes_on")
        # The closing bracket has to be there; without it the item does not parse.
        cut = F.when(inner.rlike(closing + r"\s*$"), F.regexp_replace(inner, closing + r"\s*$", ""))
        inner = F.when(ended, cut).otherwise(inner)
    nothing = F.col("is_field") & ~F.col("goes_on") & F.coalesce(inner.rlike(r"^\s*$"), F.lit(False))
    item = F.when(F.col("owner.opens") == "[", inner).when(
        F.col("owner.opens") == "{", F.when(inner.rlike(_FIELD), F.regexp_extract(inner, _FIELD, 2))
    )
    simple = F.col("is_field") & ~F.col("goes_on") & (nothing | ~F.col("is_array"))
    listed = F.col("owner.key").isin(list(ENTITIES)) & (F.col("owner.opens") == "[") & ~nothing
    parsed = owned.withColumns(
        {
            "listed": F.coalesce(listed, F.lit(False)),
            "record": F.try_parse_json(F.when(simple, F.col("value")).otherwise(item)),
            "digest": F.sha2("text", 256),
        }
    )
    blank = empty & F.col("is_field") & (F.col("element") == 0) & (F.col("element") == F.col("last"))
    good = F.col("sound") & (blank | F.col("record").isNotNull() & (~F.col("is_field") | (F.length("key") > 0)))
    checked = materialize(
        parsed.withColumn("good", F.coalesce(good, F.lit(False))).select(
            "document_id",
            "element",
            "owner",
            "is_field",
            "is_array",
            "key",
            # Texts of records are not needed any more, only those of the header.
            F.when(F.col("is_field") & F.col("key").isin(list(HEADER)), F.col("value")).alias("value"),
            "listed",
            # Of all others it matters only that they parse.
            F.when(F.col("listed"), F.col("record")).alias("record"),
            "digest",
            "good",
        ),
        "export-checked",
    )

    header = F.col("is_field") & F.col("key").isin(list(HEADER))
    array = F.col("is_field") & F.col("key").isin(list(ENTITIES))
    shown = F.when(header, F.col("value")).when(array & F.col("is_array"), F.lit("[]")).when(array, F.lit("0"))
    part = F.when(shown.isNotNull(), F.struct("element", F.concat(F.lit('"'), "key", F.lit('":'), shown).alias("t")))
    joined = F.concat(
        F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["t"]), ","), F.lit("}")
    )
    hashes = (
        checked.groupBy("document_id", F.floor(F.col("element") / HASHED).alias("k"))
        .agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("element", "digest"))), lambda p: p["digest"]), ""), 256).alias("h"))
        .groupBy("document_id")
        .agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "h"))), lambda p: p["h"]), ""), 256).alias("payload_sha256"))
    )
    subject = F.lit(subject_id) if subject_id is not None else F.element_at(F.split("document_id", "/"), -2)
    skeletons = (
        checked.groupBy("document_id")
        .agg(F.bool_and("good").alias("good"), joined.alias("body"))
        .select(
            subject.alias("subject_id"),
            "document_id",
            F.when(F.col("good"), F.col("body")).otherwise(F.lit("")).alias("body"),
        )
    )
    envelope = materialize(export.envelopes(skeletons).drop(*ENTITIES).join(hashes, "document_id"), "export-envelopes")
    records = (
        checked.where("listed")
        .join(export.accepted(envelope).select("document_id", "subject_id", "exported_at"), "document_id")
        .select(
            "subject_id",
            "document_id",
            "exported_at",
            F.col("owner.key").alias("entity"),
            (F.col("element") - F.col("owner.element")).cast("int").alias("index"),
            "record",
        )
    )
    return SplitExport(envelope, records)
