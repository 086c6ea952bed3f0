"""Searching shards of stored rows with streams of queries, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subjectseries.llm.common import partitions

#: Queries that one task answers for a shard; more are dealt over copies of it.
QUERIES = 20_000


def vectors(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """An array column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def answered(
    stored: DataFrame,
    asked: DataFrame,
    build: Callable[[pa.Table], object],
    answer: Callable[[object, pa.RecordBatch], pa.RecordBatch],
    schema: str,
    shards: int,
) -> DataFrame:
    """``answer(build(rows of a shard), queries)`` for every shard that is asked.

    ``stored`` has (shard, ids, v), ``asked`` (shard, query_id, v, least). Both are sorted into one
    stream per task, a shard's rows before its queries: a task holds one shard's index and one
    Arrow batch of queries. A shard that many queries ask is copied, each copy for some of them.
    """
    spark = stored.sparkSession
    copies = asked.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("copies"))
    kept = (
        stored.join(copies, "shard")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .select(
            "shard", "copy", F.lit(0).alias("kind"), "ids", F.lit(None).cast("long").alias("query_id"), "v",
            F.lit(None).cast("double").alias("least"),
        )
    )
    dealt = asked.join(copies, "shard").select(
        "shard",
        F.pmod(F.xxhash64("query_id"), F.col("copies")).cast("int").alias("copy"),
        F.lit(1).alias("kind"),
        F.lit(None).cast("array<long>").alias("ids"),
        "query_id",
        "v",
        F.col("least").cast("double").alias("least"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(a, b - a)
                if (keys[0, a], keys[1, a]) != current:
                    current, rows, index = (keys[0, a], keys[1, a]), [], None
                if keys[2, a] == 0:
                    rows.append(part)
                elif rows or index is not None:
                    if index is None:
                        index, rows = build(pa.Table.from_batches(rows)), []
                    yield answer(index, part)

    tasks = max(partitions(spark), min(2 * shards, 100_000))
    return (
        kept.unionByName(dealt)
        .repartition(tasks, "shard", "copy")
        .sortWithinPartitions("shard", "copy", "kind")
        .mapInArrow(run, schema)
    )


def nearest_rows(found: DataFrame, nearest: int) -> DataFrame:
    """query_id, rank, vec_id, score: the highest scores of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )
