"""Operator 4: n-gram Jaccard join by grouped prefixes, and the classes it links.

Texts are sets of five-word shingles; two link when their Jaccard similarity is 0.8 or more.
Texts of one set are one node. A set's prefix holds its rarest shingles; similar sets share one
of them. The order is only an estimate, but one that all sets share: shingles that are common in
one text of sixteen come last, and a table of fixed size with the number of occurrences per hash
bucket orders the others. Without the former, a bucket of a large corpus holds so many rare
shingles that a shingle of hundreds of texts does not stand out. Nodes with
one prefix and size form a group, groups are indexed by the shingles of their prefix, pairs of
groups are filtered by size and position, and members are verified on their whole sets.

Only the classes are wanted, so not all pairs of a group of copies are made. In star rounds,
each group is tried against one leader per shared shingle, and members against the first of
their group; then, as long as that still links classes, against leaders of other classes. What
these leave apart is joined in full, but only across classes: a pair is left untried only if
its texts are in one class already, by links that are verified. Candidates pass a filter that
cannot reject a similar pair: the parity bits of two sets bound how much they share. The sets
of those that pass are read again and verified. No link between classes is lost.

Hot shingles are dealt over salted lists whose leaders are tried against each other.

Edge cases: null and empty texts have no shingles and are linked with nothing; a text of one to
four words has one shingle, its whole sequence; repeated rows are one node and are all
returned; a null id stays null and takes part in no minimum; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from subjectseries.llm.common import col, fresh, small_batches
from subjectseries.llm.components import components
from subjectseries.llm.shingles import mix, shingle_sets
from subjectseries.session import materialize

#: Numerator of the least similarity, over 100.
PERCENT = 80
#: Counts of shingles by the upper bits of their hash, to order prefixes by rarity.
BUCKET_BITS = 18
#: One text in so many is counted shingle by shingle, and so many of its common shingles, the most
#: frequent ones, are told apart; both only shape the order.
COUNTED = 16
MOST_COMMON = 1 << 19
#: A list of more rows than this is dealt over several.
LONG_LIST = 20_000
#: Rounds with leaders of other classes before the rest is joined in full, and the share of the
#: classes (one in so many) that a round has to link for another one to follow.
MORE_ROUNDS = 4
FEW = 50
#: Bits of the filter that says which documents' sets are needed; false hits only cost time.
FILTER_BITS = 26


class Rarity(NamedTuple):
    """What orders shingles: counts by bucket, and the sorted common shingles with theirs."""

    buckets: np.ndarray
    common: np.ndarray
    times: np.ndarray


def _node(found: np.ndarray) -> int:
    """The number of a set: equal sets have equal numbers."""
    if not len(found):
        return 0
    values = found.view(np.uint64)
    total = np.uint64(mix(values ^ np.uint64(0x51ED270B)).sum() + np.uint64(len(found)))
    return int(mix(np.array([total])).view(np.int64)[0])


def _prefix(found: np.ndarray, rarity: Rarity) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles of a set, in the order all sets share, and their bucket counts."""
    length = len(found) - -(-PERCENT * len(found) // 100) + 1
    rare = rarity.buckets[found.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)]
    keys = [found, rare]
    if len(rarity.common):
        at = np.minimum(np.searchsorted(rarity.common, found), len(rarity.common) - 1)
        keys.append(np.where(rarity.common[at] == found, rarity.times[at], 0))
    order = np.lexsort(keys)[:length]
    return found[order], rare[order]


def _group(found: np.ndarray, prefix: np.ndarray) -> int:
    turned = mix(prefix.view(np.uint64) + np.uint64(0x2545F491))
    total = np.uint64(turned.sum() + np.uint64(len(found)))
    return int(mix(np.array([total])).view(np.int64)[0])


def _parity(found: np.ndarray) -> bytes:
    """A bit for each of at least two buckets a shingle: whether it holds an odd number of them."""
    bits = max(6, int(2 * len(found)).bit_length())
    at = (mix(found.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=1 << bits) & 1).tobytes()


def most_common(n: int, m: int, x: bytes, y: bytes) -> int:
    """No fewer than two sets of sizes n and m share, by their parity bits.

    Each bit in which they differ stands for at least one shingle that only one of them has. The
    finer bits are folded to the coarser ones' number: a pair's parity is the sum of its halves'.
    """
    if len(x) != len(y):
        if len(x) > len(y):
            x, y = y, x
        bits = np.unpackbits(np.frombuffer(y, np.uint8))
        y = np.packbits(bits.reshape(8 * len(x), -1).sum(1) & 1).tobytes()
    apart = (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()
    return (n + m - apart) // 2


@F.arrow_udf(BooleanType())
def may_link(n: pa.Array, x: pa.Array, m: pa.Array, y: pa.Array) -> pa.Array:
    rows = zip(*(c.to_pylist() for c in (n, m, x, y)))
    return pa.array([(100 + PERCENT) * most_common(a, b, p, q) >= PERCENT * (a + b) for a, b, p, q in rows], pa.bool_())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences by bucket, and of every shingle in the texts that are counted so."""

    def rows(shingle, bucket, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(shingle, pa.int64()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64())],
            names=["shingle", "bucket", "n"],
        )

    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        sets = list(shingle_sets([t or "" for t in batch.column(0).to_pylist()]))
        found = np.concatenate([np.zeros(0, np.int64), *sets]).view(np.uint64)
        at = (found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        counts += np.bincount(at, minlength=len(counts))
        # Copies of a text are one node: once in a batch is enough, and all are counted or none.
        chosen = {node: s for s in sets if len(s) and (node := _node(s)) % COUNTED == 0}
        values, n = np.unique(np.concatenate([np.zeros(0, np.int64), *chosen.values()]), return_counts=True)
        for k in range(0, len(values), 65536):
            part = values[k : k + 65536]
            yield rows(part, pa.nulls(len(part), pa.int32()), n[k : k + 65536])
    used = np.flatnonzero(counts)
    for k in range(0, len(used), 65536):
        part = used[k : k + 65536]
        yield rows(pa.nulls(len(part), pa.int64()), part.astype(np.int32), counts[part])


def rarity(docs: DataFrame) -> Rarity:
    """The order of shingles for all documents; its size is fixed.

    Its columns reach the driver as arrays: a Python object for each value takes many times as much.
    """
    sums = materialize(
        docs.select("text")
        .mapInArrow(_count, "shingle long, bucket int, n long")
        .groupBy("shingle", "bucket")
        .agg(F.sum("n").alias("n"))
        .where("shingle is null or n > 1"),
        "join-counts",
    )
    by_bucket = sums.where("shingle is null").select("bucket", "n").toArrow()
    buckets = np.zeros(1 << BUCKET_BITS, np.int64)
    buckets[by_bucket["bucket"].to_numpy()] = by_bucket["n"].to_numpy()
    shingles = sums.where("shingle is not null").select("shingle", "n", F.floor(4 * F.log2("n")).alias("level"))
    least, room = None, MOST_COMMON
    for row in shingles.groupBy("level").agg(F.count("*").alias("rows")).orderBy(F.desc("level")).collect():
        room -= row["rows"]
        if room < 0:
            break
        least = row["level"]
    common = shingles.where(F.col("level") >= F.lit(least)).select("shingle", "n").toArrow()
    order = np.argsort(common["shingle"].to_numpy())
    return Rarity(buckets, common["shingle"].to_numpy()[order], common["n"].to_numpy()[order])


def _members(counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in shingle_sets([t or "" for t in batch.column(1).to_pylist()]):
                group = _group(found, _prefix(found, counts.value)[0]) if len(found) else 0
                rows.append((len(found), _node(found), group, _parity(found)))
            n, node, group, parity = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(n, pa.int64()),
                    pa.array(node, pa.int64()),
                    pa.array(group, pa.int64()),
                    pa.array(parity, pa.binary()),
                ],
                names=["doc_id", "row", "n", "node", "gid", "parity"],
            )

    return run


def _postings(counts, long_list: int):
    schema = pa.schema(
        [
            ("token", pa.int64()),
            ("salt", pa.int32()),
            ("spread", pa.bool_()),
            ("gid", pa.int64()),
            ("n", pa.int32()),
            ("pos", pa.int32()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            for found in shingle_sets([t or "" for t in batch.column(0).to_pylist()]):
                if not len(found):
                    continue
                prefix, rare = _prefix(found, counts.value)
                gid = _group(found, prefix)
                if gid in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(gid)
                lists = 1 + rare // long_list
                length = len(prefix)
                out.append(
                    (
                        prefix,
                        ((gid & 0x7FFFFFFF) % lists).astype(np.int32),
                        lists > 1,
                        np.full(length, gid),
                        np.full(length, len(found), np.int32),
                        np.arange(length, dtype=np.int32),
                    )
                )
            if out:
                columns = [np.concatenate(c) for c in zip(*out)]
                for k in range(0, len(columns[0]), 100_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[k : k + 100_000]) for c in columns], schema=schema
                    )

    return run


def _fits(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Sizes and positions that allow the similarity; the shared shingle counts as the first."""
    need = F.ceil((n + m) * PERCENT / (100 + PERCENT) - 1e-9)
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (
        1 + F.least(n - i, m - j) - 1 >= need
    )


def _may_fit(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Sizes and positions that allow the similarity; shingles before this one may be shared too."""
    alike = 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)
    most = F.least(i, j) + F.least(n - i, m - j)
    return alike & ((100 + PERCENT) * most >= PERCENT * (n + m))


def _filter_bits(ids: DataFrame) -> np.ndarray:
    """A bit for each of two hashes of the ids, set in tasks and merged by slice."""
    slices = 64
    size = (1 << FILTER_BITS) // slices

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
        for batch in batches:
            for at in _filter_slots(batch.column(0).to_numpy(zero_copy_only=False)):
                np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        for k in range(slices):
            part = bits[k * size // 8 : (k + 1) * size // 8]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([part.tobytes()])],
                    names=["slice", "bits"],
                )

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(size // 8, np.uint8)
        for part in table.column("bits").to_pylist():
            total |= np.frombuffer(part, np.uint8)
        return pa.table({"slice": table.column("slice")[:1], "bits": [total.tobytes()]})

    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    schema = "slice int, bits binary"
    for row in ids.mapInArrow(mark, schema).groupBy("slice").applyInArrow(merge, schema).collect():
        start = row["slice"] * size // 8
        out[start : start + size // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _filter_slots(ids: np.ndarray) -> list[np.ndarray]:
    value = ids.astype(np.int64).view(np.uint64)
    shift = np.uint64(64 - FILTER_BITS)
    return [(mix(value + np.uint64(k)) >> shift).astype(np.int64) for k in (1, 2)]


def _sets(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            hit = np.ones(len(ids), bool)
            for at in _filter_slots(ids):
                hit &= (wanted.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
            where = np.flatnonzero(hit)
            texts = batch.column(1).take(pa.array(where)).to_pylist()
            sets = list(shingle_sets([t or "" for t in texts]))
            for k in range(0, len(sets), 100):
                part = sets[k : k + 100]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_node(s) for s in part], pa.int64()),
                        pa.array(part, pa.list_(pa.int64())),
                    ],
                    names=["node", "items"],
                )

    return run


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of nodes (a, b) whose sets reach the similarity."""
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
        .select(
            "a",
            "b",
            F.size(F.array_intersect("x", "y")).alias("common"),
            (F.size("x") + F.size("y")).alias("sizes"),
        )
    )
    return both.where(100 * F.col("common") >= PERCENT * (F.col("sizes") - F.col("common"))).select("a", "b")


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs of nodes (a, b) that their parity bits allow."""

    def side(name: str, n: str, bits: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("n").alias(n), F.col("parity").alias(bits))

    both = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b")
    return both.where(may_link("n", "x", "m", "y")).select("a", "b")


def _stars(postings: DataFrame) -> DataFrame:
    """(gid, leader) of groups that share a shingle and fit; every list has two leaders.

    One is the group with the fewest rarer shingles: of near copies of a text, that with the
    fewest changes, which the others are nearest to. The other is chosen by hash. Leaders of a
    shingle's lists, where it has several, are tried against the first of them.
    """
    lists = Window.partitionBy("token", "salt")
    central = F.min(F.struct("pos", "n", "gid")).over(lists)
    drawn = F.min(F.struct(F.xxhash64("gid").alias("draw"), "n", "gid", "pos")).over(lists)
    leaders = F.array(*(F.struct(f"{x}.n", f"{x}.gid", f"{x}.pos") for x in ("central", "drawn")))
    led = postings.withColumn("central", central).withColumn("drawn", drawn)
    near = led.select("gid", "n", "pos", F.explode(leaders).alias("lead"))
    heads = postings.where("spread").withColumn("central", central).where("gid = central.gid")
    first = F.min(F.struct("pos", "n", "gid")).over(Window.partitionBy("token"))
    far = heads.withColumn("first", first).select(
        "gid", "n", "pos", F.struct("first.n", "first.gid", "first.pos").alias("lead")
    )
    # A leader seldom meets a group at the first shingle that they share, so the position counts
    # in full: what comes before it may be shared too.
    fits = _may_fit(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos"))
    return (
        near.unionByName(far)
        .where(fits & (F.col("gid") != F.col("lead.gid")))
        .select("gid", F.col("lead.gid").alias("leader"))
    )


def row_key(doc_id: Column, text: Column) -> Column:
    """One key for rows of equal id and text; null and empty texts are equal here."""
    return F.md5(
        F.concat_ws(
            "|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text.cast("string"), F.lit(""))
        ).cast("binary")
    )


def link_classes(docs: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """A row per document of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, row, class.

    ``component_id`` is the smallest doc_id reachable over links; ``row`` is the key of the row's
    id and text, ``class`` numbers the linked texts (0 for those without shingles).
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        row_key(F.col("doc_id"), F.col("text")).alias("row"),
    )
    counts = spark.sparkContext.broadcast(rarity(docs))
    members = materialize(
        docs.mapInArrow(_members(counts), "doc_id long, row string, n long, node long, gid long, parity binary"),
        "join-members",
    )
    nodes = materialize(
        members.where("n > 0")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("first"),
            F.first("n").alias("n"),
            F.first("gid").alias("gid"),
            F.first("parity").alias("parity"),
        ),
        "join-nodes",
    )
    lists = Window.partitionBy("token", "salt")
    postings = materialize(
        docs.select("text")
        .mapInArrow(_postings(counts, long_list), "token long, salt int, spread boolean, gid long, n int, pos int")
        .withColumn("least", F.min("gid").over(lists))
        .withColumn("most", F.max("gid").over(lists))
        .where("least < most or spread")
        .drop("least", "most")
        .dropDuplicates(["token", "salt", "gid"]),
        "join-postings",
    )

    heads = nodes.groupBy("gid").agg(F.min("node").alias("head"))
    inside = nodes.join(heads, "gid").where("node <> head")
    stars = (
        _stars(postings)
        .distinct()
        .join(heads.select("gid", F.col("head").alias("a")), "gid")
        .join(heads.select(F.col("gid").alias("leader"), F.col("head").alias("b")), "leader")
        .select("a", "b")
        .unionByName(inside.select(F.col("node").alias("a"), F.col("head").alias("b")))
        .distinct()
    )
    tried = materialize(_ordered(stars).distinct(), "join-candidates")
    proven = _links(tried, docs, nodes)
    for k in range(MORE_ROUNDS):
        rows, labelled = _open_lists(postings, nodes, components(proven))
        fresh_pairs = _leaders(rows, k).join(tried, ["a", "b"], "left_anti")
        fresh_pairs = materialize(fresh_pairs, "join-candidates")
        found = _links(fresh_pairs, docs, nodes)
        tried, proven = tried.unionByName(fresh_pairs), proven.unionByName(found)
        if FEW * found.count() < labelled.select("comp").distinct().count():
            break
    rows, labelled = _open_lists(postings, nodes, components(proven))
    rest = materialize(_rest(rows, labelled).join(tried, ["a", "b"], "left_anti"), "join-candidates")
    proven = proven.unionByName(_links(rest, docs, nodes))
    classes = components(proven)

    linked = _classed(nodes.select("node", "first"), classes)
    least = linked.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = linked.join(least, "comp").select("node", F.col("comp").alias("class"), "component_id")
    return members.drop("parity", "gid").join(named, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "row",
        F.coalesce("class", F.lit(0)).alias("class"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, that with the smallest id, and all its columns.

    Texts without shingles are linked with nothing and stay; of rows with one id and text, one
    stays. Only rows that go, or that occur repeatedly, take part in joins.
    """
    rows = materialize(link_classes(docs), "join-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    kept = rows.where("n_shingles > 0").groupBy("class").agg(first["row"].alias("stays"))
    gone = rows.where("n_shingles > 0").join(kept, "class").where("row <> stays").select("row").distinct()
    gone = materialize(gone, "join-gone")
    several = rows.groupBy("row").count().where("count > 1").select("row")
    several = materialize(several.join(gone, "row", "left_anti"), "join-repeated")
    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    stay = keyed.join(gone.withColumnRenamed("row", key), key, "left_anti")
    several = several.withColumnRenamed("row", key)
    single = stay.join(several, key, "left_anti")
    doubled = stay.join(several, key, "left_semi").dropDuplicates([key])
    columns = [col(c) for c in docs.columns]
    return single.select(*columns).unionByName(doubled.select(*columns))


def _sets_of(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, items): the shingle sets of the nodes in ``pairs``, from one text of each."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(nodes.select("node", F.col("first").alias("doc_id")).join(ends, "node", "left_semi"), "join-wanted")
    marks = docs.sparkSession.sparkContext.broadcast(_filter_bits(wanted.select(F.coalesce("doc_id", F.lit(0)))))
    made = docs.mapInArrow(_sets(marks), "node long, items array<long>")
    return materialize(
        made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "join-sets"
    )


def _classed(frame: DataFrame, classes: DataFrame, node: str = "node", out: str = "comp") -> DataFrame:
    """``frame`` with the class of a node; a node without links is a class of its own."""
    names = classes.select(F.col("node").alias(node), F.col("component").alias(out))
    return frame.join(names, node, "left").withColumn(out, F.coalesce(out, node))


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs of nodes that reach the similarity."""
    likely = materialize(_plausible(pairs, nodes), "join-likely")
    return materialize(verified(likely, _sets_of(docs, nodes, likely)), "join-links")


def _open_lists(postings: DataFrame, nodes: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings of lists that hold several classes, a row for each class of a group; and the
    class of every node whose group is in them or holds several classes itself."""
    named = _classed(nodes, classes).select("gid", "node", "n", "comp")
    kinds = named.groupBy("gid", "comp").agg(F.min("node").alias("head"))
    rows = postings.join(kinds, "gid").select("token", "salt", "gid", "n", "pos", "comp", "head")
    several = (
        rows.groupBy("token")
        .agg(F.min("comp").alias("least"), F.max("comp").alias("most"))
        .where("least < most")
        .select("token")
    )
    rows = materialize(rows.join(several, "token", "left_semi"), "join-rest")
    mixed = kinds.groupBy("gid").count().where("count > 1").select("gid")
    wanted = rows.select("gid").unionByName(mixed).distinct()
    return rows, materialize(named.join(wanted, "gid", "left_semi"), "join-classed")


def _leaders(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of one node of each group and class with one leader of another class per list.

    The leader is drawn by a hash of its group, the list and the turn, so a group meets a different
    one in each of its lists: of a family that is held together by few links, others than before.
    """
    lists = Window.partitionBy("token", "salt")
    drawn = F.struct(F.xxhash64("gid", "token", F.lit(turn)).alias("draw"), "n", "pos", "comp", "head")
    met = (
        rows.withColumn("lead", F.min(drawn).over(lists))
        .where(F.col("comp") != F.col("lead.comp"))
        .where(_may_fit(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos")))
        .select(F.col("head").alias("a"), F.col("lead.head").alias("b"))
    )
    return _ordered(met).distinct()


def _meetings(rows: DataFrame) -> DataFrame:
    """(gid, comp, gid2, comp2): classes of groups that meet in a list where they can be similar.

    The shingle they meet at has to allow the similarity as the first that they share, as it does
    for similar sets where they first meet. So of sets with a common passage, which comes last in
    the order, only those meet that the passage alone can make similar.
    """
    other = rows.select(
        "token",
        F.col("gid").alias("gid2"),
        F.col("n").alias("m"),
        F.col("pos").alias("j"),
        F.col("comp").alias("comp2"),
    )
    return (
        rows.join(other, "token")
        .where("comp < comp2")
        .where(_fits(F.col("n"), F.col("pos"), F.col("m"), F.col("j")))
        .select("gid", "comp", "gid2", "comp2")
    )


def _rest(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """All candidate pairs of nodes in different classes."""
    groups = _meetings(rows).distinct()
    a = labelled.select("gid", "comp", F.col("node").alias("a"))
    b = labelled.select(F.col("gid").alias("gid2"), F.col("comp").alias("comp2"), F.col("node").alias("b"))
    between = groups.join(a, ["gid", "comp"]).join(b, ["gid2", "comp2"]).select("a", "b")
    # Members of one group share their whole prefix, which need not be in a list of several groups.
    inside = labelled.withColumn("most", F.max("comp").over(Window.partitionBy("gid"))).withColumn(
        "least", F.min("comp").over(Window.partitionBy("gid"))
    ).where("least < most")
    within = (
        inside.select("gid", "comp", F.col("node").alias("a"))
        .join(inside.select("gid", F.col("comp").alias("comp2"), F.col("node").alias("b")), "gid")
        .where("comp < comp2")
        .select("a", "b")
    )
    return _ordered(between.unionByName(within)).distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each pair with its smaller node first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
