"""Operator 11: ranked lexical search by presence masks.

For every item the highest scoring documents, by a term weight that falls with the number of
documents that hold the term and a gain that saturates with its occurrences and falls with the
document's length (integer arithmetic but for the weight's logarithm).

Items are handled in blocks of a bounded number of terms. A first pass over all documents counts
them, their terms and, for the terms of the block, the documents that hold each. A second pass
keeps a bounded number of documents in memory at a time: a bitmap per term says which of them
hold it, the bitmaps of an item's terms, transposed, are the documents' presence masks, and
documents of one mask form a group. The greatest gain of each term in these documents bounds
what a mask can score. Groups are scored by falling bound until no bound can reach the item's
last place; the places are kept from one set of documents to the next. Every task passes on no
more rows than places, which are merged in two steps, so no merge depends on the number of tasks.

Edge cases: null and empty texts have no terms and count for nothing; a text of any length is cut
into terms piece by piece; an item without terms, or with a null id, has no rows; several rows of
one item are one item with the terms of all; each row of a repeated document is a document of its
own; a document with a null id counts in the statistics but is not returned; equal scores go to
the smaller id; empty tables give no rows; further columns are ignored. The terms of one item
are held whole, as are the counts of one document's terms that occur in items.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subjectseries.llm.common import col, small_batches
from subjectseries.session import materialize

PLACES = 50
#: Terms of the items that are searched for together, on average.
BLOCK_TERMS = 20_000
#: Documents, and entries of them, that a task holds at a time.
BLOCK_DOCS = 8192
BLOCK_ENTRIES = 4_000_000
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20
#: Documents that are scored together at least.
SCORED = 256

#: Letters and digits of ASCII in lower case and all bytes of other characters; the rest is space.
_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_BYTES)
    start = 0
    while start < len(data):
        stop = len(data)
        if stop - start > PIECE:
            stop = data.rfind(b" ", start, start + PIECE)
            if stop <= start:
                stop = data.find(b" ", start + PIECE)
            stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop + 1


def counted(text: str | None, vocabulary: dict[bytes, int]) -> tuple[int, Counter]:
    """The number of a text's terms, and the occurrences of those that have a number."""
    n, found = 0, Counter()
    for part in terms(text):
        n += len(part)
        found.update(map(vocabulary.get, part))
    found.pop(None, None)
    return n, found


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term): the distinct terms of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in terms(value):
                    own = list(set(part))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(own), pa.int64()), pa.array(own, pa.binary())],
                        names=["item_id", "term"],
                    )

    rows = items.select(col(item_id).cast("long").alias("item_id"), col(text).cast("string").alias("text"))
    return rows.where("item_id IS NOT NULL").mapInArrow(run, "item_id long, term binary").distinct()


def statistics(docs: DataFrame, vocabulary) -> tuple[int, int, np.ndarray]:
    """Documents with terms, their terms, and for each numbered term the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        holds = np.zeros(len(known) + 2, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n, found = counted(text, known)
                holds[-1] += n
                holds[-2] += n > 0
                holds[list(found)] += 1
        used = np.flatnonzero(holds)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(holds[used])], names=["at", "n"])

    sums = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    size = len(vocabulary.value)
    out = np.zeros(size + 2, np.int64)
    out[sums["at"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return int(out[-2]), int(out[-1]), out[:-2]


class Places:
    """The best documents of one item so far."""

    def __init__(self, places: int):
        self.places = places
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """The score that a document needs, as long as its id is small enough."""
        return int(self.scores[-1]) if len(self.scores) == self.places else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        scores = np.concatenate((self.scores, scores[good]))
        ids = np.concatenate((self.ids, ids[good]))
        order = np.lexsort((ids, -scores))[: self.places]
        self.scores, self.ids = scores[order], ids[order]


class Postings:
    """A bounded set of documents: for each term the documents that hold it and what they gain."""

    def __init__(self, ids: np.ndarray, term: np.ndarray, doc: np.ndarray, gain: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.ids, self.doc, self.gain = ids, doc[order], gain[order]
        self.present, starts = np.unique(term[order], return_index=True)
        self.starts = np.append(starts, len(term))
        self.most = np.maximum.reduceat(self.gain, starts) if len(starts) else self.gain
        rows = []
        for first in range(0, len(self.present), 256):
            last = min(first + 256, len(self.present))
            held = np.zeros((last - first, len(ids)), bool)
            a, b = self.starts[first], self.starts[last]
            held[np.repeat(np.arange(last - first), np.diff(self.starts[first : last + 1])), self.doc[a:b]] = True
            rows.append(np.packbits(held, axis=1))
        self.bitmaps = np.concatenate(rows) if rows else np.zeros((0, 0), np.uint8)

    def search(self, wanted: np.ndarray, best: Places) -> None:
        """Bring ``best`` up to date with the documents that hold ``wanted`` terms."""
        at = np.searchsorted(self.present, wanted)
        at = at[np.append(self.present, -1)[at] == wanted]
        if not len(at):
            return
        held = np.unpackbits(self.bitmaps[at], axis=1, count=len(self.ids))
        width = -(-len(at) // 64)
        masks = np.zeros((len(self.ids), 8 * width), np.uint8)
        masks[:, : -(-len(at) // 8)] = np.packbits(held, axis=0).T
        keys = masks.view(np.uint64)
        order = np.lexsort(keys.T)
        apart = (keys[order[1:]] != keys[order[:-1]]).any(1)
        firsts = np.flatnonzero(np.concatenate(([True], apart)))
        ends = np.append(firsts[1:], len(order))
        bits = np.unpackbits(masks[order[firsts]], axis=1, count=len(at))
        bound = (bits @ self.most[at].astype(np.float64)).astype(np.int64)
        queue = np.argsort(-bound, kind="stable")
        reach = np.cumsum((ends - firsts)[queue])
        done = 0
        while done < len(queue) and bound[queue[done]] >= best.least:
            stop = max(done + 1, int(np.searchsorted(reach, (reach[done - 1] if done else 0) + SCORED)))
            some = queue[done:stop]
            some = some[bound[some] >= best.least]
            docs = np.sort(np.concatenate([order[firsts[g] : ends[g]] for g in some]))
            best.add(self._scores(docs, at), self.ids[docs])
            done = stop

    def _scores(self, docs: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.zeros(len(docs), np.int64)
        for t in at:
            a, b = self.starts[t], self.starts[t + 1]
            own = self.doc[a:b]
            where = np.minimum(np.searchsorted(own, docs), b - a - 1)
            hit = own[where] == docs
            total[hit] += self.gain[a:b][where[hit]]
        return total


def _searcher(shared, places: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights, items, n_docs, n_terms = shared.value
        best = {name: Places(places) for name in items}
        ids, sizes, lengths, term, times = [], [], [], [], []

        def flush() -> None:
            tf = np.array(times, np.int64)
            length = np.array(lengths, np.int64)
            norm = 50 + (50 * length * n_docs) // n_terms
            doc = np.repeat(np.arange(len(ids)), sizes)
            held = np.array(term, np.int64)
            gain = weights[held] * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[doc]))
            block = Postings(np.array(ids, np.int64), held, doc, gain)
            for name, wanted in items.items():
                block.search(wanted, best[name])
            for kept in (ids, sizes, lengths, term, times):
                kept.clear()

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, found = counted(text, vocabulary)
                if found:
                    ids.append(key)
                    sizes.append(len(found))
                    lengths.append(n)
                    term.extend(found.keys())
                    times.extend(found.values())
                    if len(ids) >= BLOCK_DOCS or len(term) >= BLOCK_ENTRIES:
                        flush()
        if ids:
            flush()
        for name, found in best.items():
            if len(found.ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found.ids), name)), pa.array(found.ids), pa.array(found.scores)],
                    names=["item_id", "doc_id", "score"],
                )

    return run


def search(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    places: int = PLACES,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``places`` best documents of each item, best first."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    own = item_terms(items, item_id, item_text).groupBy("item_id").agg(F.collect_list("term").alias("terms"))
    own = materialize(own, "lexical-items")
    total = own.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    named = own.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    found = None
    for k in range(blocks):
        held = {row["item_id"]: row["terms"] for row in named.where(F.col("block") == k).toLocalIterator()}
        if held:
            part = _search_block(rows, held, places)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    def best(*key: str) -> Window:
        return Window.partitionBy(*key).orderBy(F.desc("score"), "doc_id")

    some = found.withColumn("part", F.spark_partition_id() % 64)
    some = some.withColumn("rank", F.row_number().over(best("item_id", "part"))).where(F.col("rank") <= places)
    return (
        some.withColumn("rank", F.row_number().over(best("item_id")))
        .where(F.col("rank") <= places)
        .select("item_id", "rank", "doc_id", "score")
    )


def _search_block(rows: DataFrame, held: dict[int, list[bytes]], places: int) -> DataFrame:
    context = rows.sparkSession.sparkContext
    vocabulary: dict[bytes, int] = {}
    items = {
        name: np.sort([vocabulary.setdefault(bytes(t), len(vocabulary)) for t in held[name]])
        for name in sorted(held)
    }
    n_docs, n_terms, holds = statistics(rows, context.broadcast(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(h) + 1))) for h in holds], np.int64)
    shared = context.broadcast((vocabulary, weights, items, n_docs, max(1, n_terms)))
    return rows.where("doc_id IS NOT NULL").mapInArrow(
        _searcher(shared, places), "item_id long, doc_id long, score long"
    )
