"""Operator 9: approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors are centred, turned by rotations learned on a bounded sample (principal directions,
then rounds that bring the rotated vectors close to their signs, from several starts), and cut to
their signs. A code of b bits is split into m substrings. Of two codes within Hamming distance
r = m q + a, one of the first a + 1 substrings is within q, or one of the others within q - 1.
Each substring has its own index, a bucket for each value. A search probes every bucket within
that distance of the query's substring, so it retrieves every code within the radius, checks the
whole codes, and ranks what is left by the inner product of the vectors in double precision. The
radius is learned on the sample, as the distance that holds nearly all true neighbours there.
A query that finds too little in the whole table asks it again with a wider radius, up to all
codes; what a query finds depends neither on shards nor on other queries.

With several times as many bits as dimensions few codes are within the radius, so few vectors
are ranked; most codes share some bucket with a query then, so retrieving them is a look at their
bits. Every vector is indexed. Vectors are dealt at random over shards; a task builds the index of
a shard and answers a stream of queries in batches, and the best of each shard are merged. Equal
vectors are one entry with the smallest ids that a result can need, so a third of all rows may be
one vector.

Edge cases: vectors that are null, of another length than most, zero, or with null or non-finite components take
no part, neither as query nor as candidate; the query's own row is left out, its copies are not;
ties go to the smaller id; with too few candidates all are returned; repeated rows of one id and
vector count once; an id with several vectors takes part with each; a null id takes no part; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subjectseries.llm.shards import answered, nearest_rows, vectors as matrix
from subjectseries.session import materialize

NEAREST = 20
#: Rows that the rotation and the radius are learned from.
SAMPLE = 4000
SUBSTRING = 8
ROUNDS = 30
#: Bits of a code for each dimension.
ROTATIONS = 8
#: Share of the sample's true neighbours that the radius holds.
HELD = 0.97
#: Rows of a shard at most, on average.
SHARD_ROWS = 20_000


def _rotation(principal: np.ndarray, turned: np.ndarray | None, seed: int) -> np.ndarray:
    """A rotation from a random start, brought close to the signs of the rows if there are any."""
    size = len(principal)
    square = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]
    for _ in range(ROUNDS if turned is not None else 0):
        u, _, v = np.linalg.svd(turned.T @ np.sign(turned @ square), full_matrices=False)
        square = u @ v
    return principal @ square


class Coder:
    """Centre, rotations and radius, learned from sample rows."""

    def __init__(self, rows: np.ndarray, nearest: int = NEAREST):
        self.centre = rows.mean(0) if len(rows) else np.zeros(rows.shape[1])
        size = rows.shape[1]
        principal, turned = np.eye(size), None
        if len(rows) > size:
            principal = np.linalg.svd(rows - self.centre, full_matrices=False)[2].T
            turned = (rows - self.centre) @ principal
        self.turn = np.concatenate([_rotation(principal, turned, 5 + k) for k in range(ROTATIONS)], 1)
        self.bits = self.turn.shape[1]
        self.radius = self.bits // 2
        if len(rows) > nearest + 1:
            some = slice(0, 500)
            scores = rows[some] @ rows.T
            scores[np.arange(len(scores)), np.arange(len(scores))] = -np.inf
            best = np.argpartition(-scores, nearest, axis=1)[:, :nearest]
            codes = self.signs(rows)
            apart = (codes[some][:, None, :] != codes[best]).sum(2)
            self.radius = int(np.quantile(apart, HELD))

    def signs(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.centre) @ self.turn > 0

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """A byte for each substring."""
        return np.packbits(self.signs(vectors), axis=1)


_ONES = np.array([bin(v).count("1") for v in range(256)], np.uint8)


def _words(codes: np.ndarray) -> np.ndarray:
    """The bytes of each code as whole 64-bit words."""
    return np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64)


class Index:
    """The substring buckets of one shard's codes."""

    def __init__(self, codes: np.ndarray):
        self.words = _words(codes)
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.starts = [np.searchsorted(np.sort(c), np.arange(257)) for c in codes.T]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Positions of all codes within ``radius`` of ``code``."""
        most, first = divmod(radius, len(code))
        values = np.arange(256, dtype=np.uint8)
        seen = np.zeros(len(self.words), bool)
        for k, part in enumerate(code):
            for value in np.flatnonzero(_ONES[values ^ part].astype(int) <= most - (k > first)):
                seen[self.order[k][self.starts[k][value] : self.starts[k][value + 1]]] = True
            if seen.all():
                break
        found = np.flatnonzero(seen)
        apart = np.bitwise_count(self.words[found] ^ _words(code[None])).sum(1)
        return found[apart <= radius]


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): the rows that take part, in double precision."""
    v = F.col(column).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, every: int = 20, nearest: int = NEAREST, sample: int = SAMPLE) -> DataFrame:
    """The ``nearest`` rows found for each query, a row whose id is divisible by ``every``.

    Returns query_id, rank, vec_id, score; the score is the inner product.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    width = size[0]["n"] if size else 1
    rows = rows.where(F.size("v") == width)
    # Copies in one entry: one more id than a result needs, as the query itself may be among them.
    copies = Window.partitionBy("v").orderBy("vec_id")
    entries = materialize(
        rows.dropDuplicates(["vec_id", "v"])
        .withColumn("nth", F.row_number().over(copies))
        .where(F.col("nth") <= nearest + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids")),
        "ann-entries",
    )
    taken = entries.orderBy(F.xxhash64("v"), "v").limit(sample).select("v").toPandas()["v"]
    learned = np.array(taken.tolist(), np.float64).reshape(-1, width)
    coder = Coder(learned, nearest)
    shared = spark.sparkContext.broadcast(coder)
    shards = max(4, -(-entries.count() // SHARD_ROWS))
    stored = entries.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> tuple[Index, np.ndarray, list[np.ndarray]]:
        base = matrix(table.column("v").combine_chunks(), width, np.float64)
        return Index(shared.value.codes(base)), base, [np.asarray(i, np.int64) for i in table.column("ids").to_pylist()]

    def answer(shard: tuple[Index, np.ndarray, list[np.ndarray]], batch: pa.RecordBatch) -> pa.RecordBatch:
        index, base, ids = shard
        asking = matrix(batch.column("v"), width, np.float64)
        radii = batch.column("least").to_numpy()
        out: list[tuple[int, int, float]] = []
        for name, vector, code, radius in zip(batch.column("query_id").to_pylist(), asking, shared.value.codes(asking), radii):
            found = index.within(code, int(radius))
            scores = base[found] @ vector
            if len(found) > nearest:
                # Products of a block differ from single ones by rounding alone.
                least = np.partition(scores, -nearest - 1)[-nearest - 1]
                found = found[scores >= least - 1e-9 * max(1.0, abs(least))]
            # One by one, so that a score does not depend on the others' number.
            exact = [float(np.dot(base[f], vector)) for f in found]
            pairs = [(s, i) for s, f in zip(exact, found) for i in ids[f].tolist() if i != name]
            out += [(name, i, s) for s, i in sorted(pairs, key=lambda p: (-p[0], p[1]))[:nearest]]
        names, hits, scores = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array(hits, pa.int64()), pa.array(scores, pa.float64())],
            names=["query_id", "vec_id", "score"],
        )

    left = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).withColumnRenamed("vec_id", "query_id")
    left, done, radius = materialize(left, "ann-queries"), [], coder.radius
    while True:
        asked = left.select(
            F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
            "query_id",
            "v",
            F.lit(float(radius)).alias("least"),
        )
        hits = answered(stored, asked, build, answer, "query_id long, vec_id long, score double", shards)
        hits = materialize(nearest_rows(hits, nearest), "ann-hits")
        if radius >= coder.bits:
            done.append(hits)
            break
        enough = hits.groupBy("query_id").count().where(F.col("count") >= nearest).select("query_id")
        done.append(hits.join(enough, "query_id", "left_semi"))
        left = materialize(left.join(enough, "query_id", "left_anti"), "ann-queries")
        if left.isEmpty():
            break
        radius = min(coder.bits, radius + -(-coder.bits // 4))
    return reduce(DataFrame.unionByName, done)
