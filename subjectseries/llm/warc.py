"""Operator 7: WARC archives, written by Spark's text writer and read back by boundary chains.

A record is one text row; the writer ends each with an empty line pair, so every part file is
a WARC file. Reading splits the archives at the magic line, also inside large files: Spark's
text reader hands out chunks between magics, and a running sum of chunk lengths gives their byte
offsets. Every chunk is a candidate record whose Content-Length names its successor. Records
are those reached from the file's first byte. Runs of candidates that follow each other without
a gap collapse to one node first; pointer jumping over the few nodes left finds the reachable
ones. A magic inside a payload makes a candidate that nothing reaches, and is rejected.
Payloads never move in a shuffle when reading, except those that hold a magic.

Edge cases: a null html is an empty payload; a null url is written as a page address; line
breaks in urls are escaped; a null page_id is written empty and read back as null, and counts
as larger than any id; repeated page ids with one payload are all the response; an empty table
gives no archive records; further columns are ignored. An archive that does not begin with a
record holds no record that is reachable, so it gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subjectseries.session import materialize

MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
RECORD = "urn:page:"
DATE = "1970-01-01T00:00:00Z"
#: Digits of Java's and SQL's base 32, and of the alphabet that WARC digests use (fixed values).
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(value: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary or string."""
    digest = F.upper(F.sha1(value))
    parts = [
        F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)
    ]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def dedup(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with their payload, its digest and, for revisits, the page that they refer to.

    Of pages with equal payloads of at least ``least_bytes`` bytes, the smallest id is the
    response. Only digests met more than once take part in the join.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", base32_sha1(F.col("payload")))
    first = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy(F.col("digest").alias("same"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    # Written first, so its size is known: the payloads stay where they are if it is small.
    first = materialize(first, "warc-first")
    return rows.join(first, F.col("digest") == F.col("same"), "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"),
    )


def record_text(pages: DataFrame, date: str = DATE) -> DataFrame:
    """One column ``value``: the records as text, without their closing line pair."""
    revisit = F.col("refers_to").isNotNull()
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    address = F.coalesce(
        F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")),
        F.concat(F.lit(RECORD), name),
    )
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return pages.select(
        F.concat(
            F.lit(f"{MAGIC}WARC-Type: "),
            F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
            F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Record-ID: <{RECORD}"),
            name,
            F.lit(">\r\nWARC-Target-URI: "),
            address,
            F.when(
                revisit,
                F.concat(F.lit(f"\r\nWARC-Refers-To: <{RECORD}"), F.col("refers_to"), F.lit(">")),
            ).otherwise(F.lit("")),
            F.lit("\r\nWARC-Payload-Digest: sha1:"),
            F.col("digest"),
            F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
            F.octet_length(block).cast("string"),
            F.lit(BREAK),
            block,
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = DATE) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files below ``path``; one file a task."""
    record_text(dedup(pages, least_bytes), date).write.option("lineSep", BREAK).text(path)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archives' texts between magics, with the file, the block and a number that orders them.

    Files, splits and their order follow from the files and the session, so the number is the
    same whenever this is read again.
    """
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("chunk"),
            "value",
        )
    )


def _header(name: str) -> Column:
    return F.regexp_extract(F.col("head"), rf"(?:^|\r\n){name}: *([^\r\n]*)", 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every chunk that reads as a record: its start, its successor's offset and its headers.

    ``digest`` is the payload's if the chunk holds it whole, else null.
    """
    size = len(MAGIC)
    by_file = Window.partitionBy("file").orderBy("block", "chunk")
    body = F.substring(
        F.col("value").cast("binary"), F.col("head_bytes") + len(BREAK) + 1, F.col("content")
    )
    parsed = (
        chunks(spark, path)
        .withColumn("bytes", F.octet_length("value").cast("long"))
        .withColumn("head", F.substring_index("value", BREAK, 1))
        .withColumn("head_bytes", F.octet_length("head"))
        .withColumn("content", _header("Content-Length").try_cast("long"))
        .withColumn("whole", F.col("bytes") == F.col("head_bytes") + F.col("content") + 2 * len(BREAK))
        .select(
            "file",
            "block",
            "chunk",
            "bytes",
            "head_bytes",
            F.when(F.col("bytes") > F.col("head_bytes"), F.col("content")).alias("content"),
            F.when(F.col("whole"), base32_sha1(body.cast("binary"))).alias("digest"),
            _header("WARC-Type").alias("type"),
            F.regexp_extract(_header("WARC-Record-ID"), rf"{RECORD}(-?\d*)", 1).alias("id"),
            F.regexp_extract(_header("WARC-Refers-To"), rf"{RECORD}(-?\d*)", 1).alias("refers"),
            F.regexp_extract(_header("WARC-Payload-Digest"), r"sha1:(\w*)", 1).alias("stated"),
        )
    )
    placed = parsed.withColumn(
        "start", F.coalesce(F.sum(F.col("bytes") + size).over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - size
    )
    return placed.where("start >= 0").withColumn(
        "next",
        F.col("start") + size + F.col("head_bytes") + F.col("content") + 2 * len(BREAK),
    )


def reachable(nodes: DataFrame) -> DataFrame:
    """The rows of ``nodes`` (file, start, next, ...) reached from offset 0 of their file.

    Adjacent candidates that link to each other form runs. A run also begins where a pointer
    from elsewhere lands, so that runs are reached at their head or not at all.
    """
    order = Window.partitionBy("file").orderBy("start")
    nodes = materialize(nodes, "warc-candidates")
    far = (
        nodes.withColumn("following", F.lead("start").over(order))
        .where(F.col("next").isNotNull() & ~F.col("next").eqNullSafe(F.col("following")))
        .select("file", F.col("next").alias("start"))
        .distinct()
        .withColumn("landing", F.lit(True))
    )
    begins = F.col("landing").isNotNull() | ~F.lag("next").over(order).eqNullSafe(F.col("start"))
    runs = (
        nodes.join(far, ["file", "start"], "left")
        .withColumn("begins", begins.cast("int"))
        .withColumn("run", F.sum("begins").over(order))
        .drop("landing", "begins")
    )
    runs = materialize(runs, "warc-runs")
    heads = runs.groupBy("file", "run").agg(
        F.min("start").alias("head"), F.max_by("next", "start").alias("jump")
    )
    jumps = materialize(heads.where("jump is not null").select("file", "head", "jump"), "warc-jumps")
    reached = materialize(heads.where("head = 0").select("file", "head"), "warc-reached")
    known = reached.count()
    while True:
        more = (
            reached.join(jumps, ["file", "head"])
            .select("file", F.col("jump").alias("head"))
            .unionByName(reached)
            .distinct()
            .join(heads.select("file", "head"), ["file", "head"], "left_semi")
        )
        reached = materialize(more, "warc-reached")
        count = reached.count()
        if count == known:
            break
        known = count
        twice = jumps.select("file", F.col("head").alias("jump"), F.col("jump").alias("further"))
        jumps = materialize(
            jumps.join(twice, ["file", "jump"], "left").select(
                "file", "head", F.coalesce("further", "jump").alias("jump")
            ),
            "warc-jumps",
        )
    kept = heads.join(reached, ["file", "head"], "left_semi").select("file", "run")
    return runs.join(kept, ["file", "run"], "left_semi").drop("run")


def _split_payloads(spark: SparkSession, path: str, nodes: DataFrame, broken: DataFrame) -> DataFrame:
    """Payloads of records that hold magics: their chunks, found by number, put together again."""
    spans = broken.select("file", "start", "next", "head_bytes", "content")
    members = (
        nodes.select("file", "chunk", F.col("start").alias("at"))
        .join(spans, "file")
        .where("at >= start and at < next")
    )
    # Written first, so its size is known: the payloads stay where they are if it is small.
    members = materialize(members, "warc-members")
    parts = members.join(chunks(spark, path).select("chunk", "value"), "chunk")
    joined = parts.groupBy("file", "start", "head_bytes", "content").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda p: p["value"]),
            MAGIC,
        ).alias("text")
    )
    return joined.select(
        "file",
        "start",
        F.substring(
            F.col("text").cast("binary"), F.col("head_bytes") + len(BREAK) + 1, F.col("content")
        ).alias("payload"),
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The archives' records: file, start, chunk, type, page_id, refers_to, content, digest, stated.

    ``digest`` is computed from the payload read, ``stated`` is the header's.
    """
    nodes = materialize(candidates(spark, path), "warc-chunks")
    found = materialize(reachable(nodes), "warc-records")
    broken = found.where("digest is null")
    mended = _split_payloads(spark, path, nodes, broken).select(
        "file", "start", base32_sha1(F.col("payload")).alias("mended")
    )
    return found.join(mended, ["file", "start"], "left").select(
        "file",
        "start",
        "chunk",
        "type",
        F.col("id").try_cast("long").alias("page_id"),
        F.when(F.col("type") == "revisit", F.col("refers").try_cast("long")).alias("refers_to"),
        "content",
        F.coalesce("digest", "mended").alias("digest"),
        "stated",
    )


def _stored(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """(file, start, payload) of ``records`` as they lie in the archives; revisits hold none."""
    nodes = materialize(candidates(spark, path), "warc-chunks")
    wanted = records.select("file", "start").distinct()
    found = materialize(nodes.join(wanted, ["file", "start"], "left_semi"), "warc-wanted")
    text = chunks(spark, path).select("chunk", "value")
    whole = (
        found.where("digest is not null")
        .join(text, "chunk")
        .select(
            "file",
            "start",
            F.substring(
                F.col("value").cast("binary"), F.col("head_bytes") + len(BREAK) + 1, F.col("content")
            ).alias("payload"),
        )
    )
    return whole.unionByName(_split_payloads(spark, path, nodes, found.where("digest is null")))


def payloads(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """``records`` (of ``read_archives``) with their whole payload as binary column ``payload``.

    Payloads that hold magics are put together from their chunks. A revisit has the payload of
    the response that it refers to, or null if the archives do not hold that.
    """
    own = materialize(
        records.select("file", "start", "type", "page_id", "digest", "refers_to", "stated").join(
            _stored(spark, path, records), ["file", "start"]
        ),
        "warc-payloads",
    )
    again = own.where("type = 'revisit'").select("file", "start", "refers_to", "stated")
    responses = (
        own.where("type = 'response'")
        .select(F.col("page_id").alias("refers_to"), F.col("digest").alias("stated"), "payload")
        .join(again.select("refers_to", "stated").distinct(), ["refers_to", "stated"], "left_semi")
        .dropDuplicates(["refers_to", "stated"])
    )
    through = again.join(responses, ["refers_to", "stated"]).select("file", "start", "payload")
    every = own.where("type <> 'revisit'").select("file", "start", "payload").unionByName(through)
    return records.join(every, ["file", "start"], "left")


def resolve(records: DataFrame) -> DataFrame:
    """One row per page: length and digest of its full payload, revisits through their response."""
    responses = (
        records.where("type = 'response'")
        .groupBy(F.col("page_id").alias("refers_to"), F.col("digest").alias("stated"))
        .agg(F.max("content").alias("full"))
    )
    return records.join(responses, ["refers_to", "stated"], "left").select(
        "page_id",
        F.when(F.col("type") == "revisit", F.col("full")).otherwise(F.col("content")).alias("payload_bytes"),
        F.when(F.col("type") == "revisit", F.when(F.col("full").isNotNull(), F.col("stated")))
        .otherwise(F.col("digest"))
        .alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )
