"""M1-M3: streaming twins, run over what is available and compared with batch SQL.

The samples arrive as several files, dealt by hash, one file in a micro-batch: most rows of
every file after the first are older than what has been seen.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from subjectseries_queries.base import query, us
from subjectseries_queries.ingest_queries import DOCS, documents
from subjectseries.schemas import STORED
from subjectseries.session import scratch_dir
from subjectseries.sources.store import VersionedStore
from subjectseries.streaming import (
    maintain_rollup,
    maintain_segments,
    rollup_so_far,
    segments_so_far,
    stream_ingest,
)

SAMPLES = "subject_id string, ts timestamp, value decimal(10,3)"
FILES = 4


def _arriving(t, root: str):
    """A stream of the samples and the store that its results go to."""
    samples = t.events.select("subject_id", "ts", F.col("value").cast("decimal(10,3)").alias("value"), "event_id")
    samples.repartition(FILES, "event_id").drop("event_id").write.parquet(f"{root}/inbox")
    stream = t.spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(f"{root}/inbox")
    return stream, VersionedStore(t.spark, f"{root}/store")


@query(
    "m1_stream_ingest",
    f"""WITH {DOCS} SELECT subject_id, sample_id AS id, CAST(max(cents + index) AS DOUBLE) AS value FROM recs
WHERE entity = 'glucose_samples' AND code IS NULL GROUP BY 1, 2""",
)
def ingest_stream(t):
    """Documents arrive as files; the glucose table afterwards is the batch result."""
    root = scratch_dir(t.spark, "stream-ingest")
    documents(t).write.parquet(f"{root}/inbox")
    schema = "subject_id string, document_id string, body string"
    arriving = t.spark.readStream.schema(schema).parquet(f"{root}/inbox")
    store = VersionedStore(t.spark, f"{root}/store")
    stream_ingest(arriving, store, f"{root}/checkpoint").awaitTermination()
    rows = store.read("glucose_samples", STORED["glucose_samples"])
    return rows.select(
        "subject_id",
        F.col("source_sample_id").alias("id"),
        F.col("value_mg_dl").cast("double").alias("value"),
    )


def _rollup_sql(seconds: int) -> str:
    width = seconds * 1_000_000
    return f"""SELECT subject_id, us - us % {width} AS bucket_start, count(*) AS n, CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi,
  CAST(sum(v) * 1000 AS BIGINT) / (count(*) * 1000) AS mean
FROM ev GROUP BY 1, 2"""


def _rollup(resolution: str):
    def run(t):
        root = scratch_dir(t.spark, f"rollup-{resolution}")
        stream, store = _arriving(t, root)
        maintain_rollup(stream, "ts", "value", resolution, store, f"{root}/checkpoint").awaitTermination()
        return rollup_so_far(store, resolution).select(
            "subject_id",
            us("bucket_start"),
            F.col("sample_count").alias("n"),
            F.col("min_value").cast("double").alias("lo"),
            F.col("max_value").cast("double").alias("hi"),
            F.col("mean_value").cast("double").alias("mean"),
        )

    return run


for _name, _seconds in (("5m", 300), ("15m", 900), ("hourly", 3600)):
    query(f"m2_stream_rollup_{_name}", _rollup_sql(_seconds))(_rollup(_name))


@query(
    "m3_stream_segments",
    """WITH f AS (SELECT subject_id, us, CASE WHEN us - lag(us) OVER w > 43200000000 THEN 1 ELSE 0 END AS b
  FROM ev WINDOW w AS (PARTITION BY subject_id ORDER BY us)),
g AS (SELECT *, sum(b) OVER (PARTITION BY subject_id ORDER BY us) AS seg FROM f),
s AS (SELECT subject_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM g GROUP BY subject_id, seg)
SELECT subject_id, start_us, end_us, n, (end_us - start_us) / 6e7 AS minutes FROM s""",
)
def segments_stream(t):
    root = scratch_dir(t.spark, "segments")
    stream, store = _arriving(t, root)
    maintain_segments(stream, "ts", 720, store, f"{root}/checkpoint").awaitTermination()
    minutes = ((F.col("end_us") - F.col("start_us")) / 60_000_000).alias("minutes")
    return segments_so_far(store, 720).select("subject_id", "start_us", "end_us", "n", minutes)
