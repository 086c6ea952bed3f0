"""Operator 13: exact top-k search by inner product with M-trees.

Each component x becomes floor(64 * x); the score is the inner product of these integers. It is
made a distance: rows get one more component that brings all of a tree to one length M, a query
is scaled to length M with nothing in that place, and then the squared distance is
2 M M - 2 (M / |query|) score. An M-tree keeps such rows in pages: an entry of an inner page
stores a routing row, its child page, the child's covering radius and the distance to the page's
own routing row; an entry of a leaf stores a row and that distance. A search takes pages by
rising least distance. |d(query, parent) - d(parent, entry)| less the radius bounds an entry
from what is stored, so entries beyond the last place are left out without computing a distance;
the search ends when the nearest page left is beyond it too.

The root is shared: routing rows from a bounded sample, each the centre of one or more shards
with a covering radius and a greatest length. Every row goes to the nearest one, and every shard
has its own tree. A query first searches the shard of its own nearest routing row; the score of
its last place there then excludes other shards by the root's bounds, and the trees of the rest
start from it. Shards take queries as a stream, so a task holds one shard and one batch.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do
vectors of another length than the most frequent one (of several such lengths, the smallest);
zero and empty vectors do; scaled components and scores beyond 64 bits stay at the limit; of
rows of one id, that with the smallest vector counts; rows with a null id take no part; copies
of a vector are one entry with the smallest ids that a result can need; ties go to the smaller
id; with too few candidates all are returned; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subjectseries.llm.common import col
from subjectseries.llm.shards import answered, nearest_rows, vectors
from subjectseries.session import materialize

NEAREST = 20
SCALE = 64
#: Entries of a page.
PAGE = 512
#: Rows of a shard, on average, and routing rows of the root at most.
SHARD_ROWS = 8_000
ROUTES = 1024
#: Rows that the root's routing rows are drawn from.
SAMPLE = 8_192
_LONG = (1 << 63) - 1
#: Products are added exactly in double precision up to here.
_EXACT = float(1 << 53)


@dataclass(slots=True)
class Page:
    """Entries: rows, their vectors side by side, their distances to the parent's routing row,
    radii and children if inner."""

    rows: np.ndarray
    plain: np.ndarray
    away: np.ndarray
    radii: np.ndarray | None = None
    children: list[Page] | None = None


class Tree:
    """An M-tree over integer rows, built from the top; rows should be distinct."""

    def __init__(self, rows: np.ndarray, ids: list[np.ndarray], page: int = PAGE):
        self.rows, self.ids, self.page = rows, ids, page
        self.plain = rows.astype(np.float64)
        squares = (self.plain * self.plain).sum(1)
        self.length = float(np.sqrt(squares.max(initial=0.0)))
        self.lift = np.sqrt(np.maximum(self.length**2 - squares, 0.0))
        self.most = float(np.abs(self.plain).max(initial=0.0))
        self.computed = 0
        self.root = self._page(np.arange(len(rows)), None)

    def _apart(self, some: np.ndarray, one: int) -> np.ndarray:
        """Distances of rows to one row."""
        flat = self.plain[some] - self.plain[one]
        return np.sqrt((flat * flat).sum(1) + (self.lift[some] - self.lift[one]) ** 2)

    def _page(self, some: np.ndarray, parent: int | None) -> Page:
        away = np.zeros(len(some)) if parent is None else self._apart(some, parent)
        if len(some) <= self.page:
            return Page(some, self.plain[some], away)
        ways = min(self.page, max(2, 2 * -(-len(some) // self.page)))
        routes = some[np.linspace(0, len(some) - 1, ways).astype(np.int64)]
        lifted = np.column_stack((self.plain[some], self.lift[some]))
        centres = np.column_stack((self.plain[routes], self.lift[routes]))
        which = (lifted @ centres.T - (centres * centres).sum(1) / 2).argmax(1)
        parts = [(int(r), some[which == k], self._apart(some[which == k], r)) for k, r in enumerate(routes)]
        parts = [p for p in parts if len(p[1])]
        if len(parts) == 1:  # rows that do not differ in double precision
            half = len(some) // 2
            parts = [(int(part[0]), part, self._apart(part, part[0])) for part in (some[:half], some[half:])]
        own = np.array([p[0] for p in parts])
        return Page(
            own,
            self.plain[own],
            np.zeros(len(own)) if parent is None else self._apart(own, parent),
            np.array([p[2].max() for p in parts]),
            [self._page(p[1], p[0]) for p in parts],
        )

    def _scores(self, page: Page, keep: np.ndarray | None, query, exact: bool) -> np.ndarray:
        """Scores of the page's entries, or of those that ``keep`` marks."""
        if exact:
            plain = page.plain if keep is None else page.plain[keep]
            self.computed += len(plain)
            return plain @ query
        rows = self.rows[page.rows if keep is None else page.rows[keep]]
        self.computed += len(rows)
        sums = (sum(map(int.__mul__, r, query)) for r in rows.tolist())
        return np.array([max(-_LONG - 1, min(_LONG, s)) for s in sums], object)

    def search(self, query: np.ndarray, name: int, nearest: int, least: float = -np.inf) -> list[tuple[int, int]]:
        """(-score, id) of the best rows by rising pair, none of a score below ``least``."""
        plain = query.astype(np.float64)
        exact = self.most * np.abs(plain).max(initial=0.0) * max(1, len(plain)) < _EXACT
        asked = plain if exact else query.tolist()
        norm = float(np.sqrt((plain * plain).sum()))
        scale = self.length / norm if norm else 0.0
        level = self.length**2 * (2.0 if norm else 1.0)
        slack = 1e-7 * (1.0 + self.length)

        def distance(score):
            return np.sqrt(np.maximum(level - 2.0 * scale * np.asarray(score, np.float64), 0.0))

        best: list[tuple[int, int]] = []
        limit = np.inf if least == -np.inf else float(distance(least)) + slack
        queue, made = [(0.0, 0, self.root, None)], 1
        while queue:
            nearer, _, page, parent = heapq.heappop(queue)
            if nearer > limit:
                break
            keep = None
            if parent is not None:
                stored = np.abs(page.away - parent)
                keep = (stored if page.radii is None else stored - page.radii) <= limit
                if keep.all():
                    keep = None
            scores = self._scores(page, keep, asked, exact)
            if page.children is None:
                last = max(least, -best[-1][0]) if len(best) == nearest else least
                better = np.flatnonzero(scores >= last)
                if not len(better):
                    continue
                if len(better) > nearest + 1:  # one may be the query's own row
                    better = better[scores[better] >= np.sort(scores[better])[-nearest - 1]]
                rows = page.rows if keep is None else page.rows[keep]
                for at in better:
                    score = int(scores[at])
                    best.extend((-score, int(i)) for i in self.ids[rows[at]] if i != name)
                best.sort()
                del best[nearest:]
                if len(best) == nearest:
                    limit = min(limit, float(distance(-best[-1][0])) + slack)
            else:
                radii = page.radii if keep is None else page.radii[keep]
                children = page.children if keep is None else [page.children[k] for k in np.flatnonzero(keep)]
                away = distance(scores)
                bound = np.maximum(away - radii, 0.0)
                for k in np.flatnonzero(bound <= limit):
                    heapq.heappush(queue, (float(bound[k]), made, children[k], float(away[k])))
                    made += 1
        best.sort()
        return best


def usable(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): the rows that take part, scaled to integers."""
    v = F.transform(col(embedding), lambda x: x.cast("double"))
    rows = table.select(col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))
    return rows.where(finite).select("vec_id", whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _nearest_route(rows: np.ndarray, routes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest routing row of each row, and its distance."""
    squares = ((rows * rows).sum(1))[:, None] - 2 * rows @ routes.T + (routes * routes).sum(1)
    which = squares.argmin(1)
    flat = rows - routes[which]
    return which, np.sqrt((flat * flat).sum(1))


def search(
    table: DataFrame,
    every: int = 20,
    nearest: int = NEAREST,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``nearest`` rows of highest score for each query.

    Queries are the rows whose id is divisible by ``every``; a query's own row is no candidate.
    """
    spark = table.sparkSession
    rows = materialize(usable(table, vec_id, embedding), "tree-rows")
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = size[0]["n"]
    rows = rows.where(F.size("v") == width)
    total = size[0]["count"]
    taken = rows.select(F.xxhash64("v").alias("draw"), "v").distinct().orderBy("draw", "v").limit(SAMPLE)
    chosen = [r["v"] for r in taken.collect()]
    drawn = np.array(chosen, np.float64).reshape(len(chosen), width)
    routes = drawn[: max(1, min(ROUTES, -(-total // shard_rows)))]
    shared = spark.sparkContext.broadcast(routes)

    # Copies in one entry: one more id than a result needs, as the query itself may be among them.
    copies = Window.partitionBy("v").orderBy("vec_id")
    entries = (
        rows.withColumn("nth", F.row_number().over(copies))
        .where(F.col("nth") <= nearest + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = vectors(batch.column(0), width, np.float64) if width else np.zeros((batch.num_rows, 0))
            which, apart = _nearest_route(own, shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(which), pa.array(apart), pa.array(np.sqrt((own * own).sum(1)))],
                names=["v", "ids", "route", "apart", "norm"],
            )

    placed = materialize(
        entries.select("v", "ids").mapInArrow(
            place, "v array<long>, ids array<long>, route long, apart double, norm double"
        ),
        "tree-entries",
    )
    root = placed.groupBy("route").agg(
        F.count("*").alias("n"), F.max("apart").alias("radius"), F.max("norm").alias("longest")
    )
    held = {r["route"]: r for r in root.collect()}  # no more rows than the root's routing rows
    parts = np.array([-(-held[k]["n"] // shard_rows) if k in held else 0 for k in range(len(routes))], np.int64)
    radius = np.array([held[k]["radius"] if k in held else 0.0 for k in range(len(routes))])
    longest = np.array([held[k]["longest"] if k in held else 0.0 for k in range(len(routes))])
    first = np.concatenate(([0], np.cumsum(parts)))
    page = spark.sparkContext.broadcast((parts, first, radius, longest))
    shards = int(first[-1])
    pieces = F.element_at(F.lit(parts.tolist()), (F.col("route") + 1).cast("int"))
    begins = F.element_at(F.lit(first.tolist()), (F.col("route") + 1).cast("int"))
    stored = placed.select((begins + F.pmod(F.xxhash64("v"), pieces)).alias("shard"), "ids", "v")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shards a query still has to search; ``least`` is null before its first one."""
        parts, first, radius, longest = page.value
        for batch in batches:
            own = vectors(batch.column(1), width, np.float64) if width else np.zeros((batch.num_rows, 0))
            home = _nearest_route(own, shared.value)[0]
            norm = np.sqrt((own * own).sum(1))
            reach = np.minimum(own @ shared.value.T + norm[:, None] * radius, norm[:, None] * longest)
            reach += 1e-6 * (1.0 + norm[:, None] * (longest + radius))
            least = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            begun = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            for k in range(batch.num_rows):
                start = first[home[k]]
                if not begun[k]:
                    go = np.array([start])
                else:
                    open_ = np.flatnonzero((reach[k] >= least[k]) | np.isnan(least[k]))
                    go = np.concatenate([np.arange(first[r], first[r + 1]) for r in open_] or [first[:0]])
                    go = go[go != start]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(go, pa.int64()),
                        batch.column(0).take(pa.array(np.full(len(go), k))),
                        batch.column(1).take(pa.array(np.full(len(go), k))),
                        batch.column(2).take(pa.array(np.full(len(go), k))),
                    ],
                    names=["shard", "query_id", "v", "least"],
                )

    def build(kept: pa.Table) -> Tree:
        own = kept.combine_chunks()
        ids = [np.asarray(i, np.int64) for i in own.column("ids").to_pylist()]
        v = own.column("v").chunk(0)
        return Tree(vectors(v, width, np.int64) if width else np.zeros((len(ids), 0), np.int64), ids)

    def answer(tree: Tree, asked: pa.RecordBatch) -> pa.RecordBatch:
        names = asked.column(4).to_pylist()
        own = vectors(asked.column(5), width, np.int64) if width else np.zeros((len(names), 0), np.int64)
        least = asked.column(6).fill_null(-np.inf).to_numpy(zero_copy_only=False)
        query, vec, score = [], [], []
        for name, vector, low in zip(names, own, least):
            for below, other in tree.search(vector, name, nearest, low):
                query.append(name)
                vec.append(other)
                score.append(-below)
        return pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())],
            names=["query_id", "vec_id", "score"],
        )

    form, routed = "query_id long, vec_id long, score long", "shard long, query_id long, v array<long>, least double"
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    start = queries.select("query_id", "v", F.lit(None).cast("double").alias("least"), F.lit(False).alias("begun"))
    near = materialize(answered(stored, start.mapInArrow(route, routed), build, answer, form, shards), "tree-first")
    last = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    onward = queries.join(last, "query_id", "left").select(
        "query_id",
        "v",
        F.when(F.col("n") >= nearest, F.col("low").cast("double")).alias("least"),
        F.lit(True).alias("begun"),
    )
    rest = answered(stored, materialize(onward.mapInArrow(route, routed), "tree-asked"), build, answer, form, shards)
    return nearest_rows(near.unionByName(rest), nearest)
