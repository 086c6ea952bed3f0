"""Operator 2: benchmark passages in documents, by fingerprints of item-sized windows.

A window has as many words as the benchmark item that it is compared with. It and the item are
similar if the weighted Jaccard similarity of their five-word shingles, which counts
repetitions, reaches 0.8. The steps:

1. The places of a text whose shingle an item has bound from above what a window has in common
   with it. Windows that can reach the similarity by this bound get a SimHash.
2. Every item's fingerprint is indexed in eight blocks of eight bits: for each block, the set of
   values within two bits of the item's. Two fingerprints that differ in at most 23 bits differ
   in at most two bits of some block, so the blocks find all windows within that radius, and
   the whole distance is then tested.
3. What is left is measured exactly.

The bound and the blocks lose nothing; the radius may: of pairs just at the similarity it loses
about 1 in 100,000, of closer ones fewer.

Everything is DataFrame functions. The items'
shingles are broadcast only up to a checked number of rows; beyond it the join is shuffled.
Equal texts are examined once, so groups of copies cost one text.

Edge cases: null and empty texts are clean; case and punctuation are ignored; a text shorter
than an item is one window; items of fewer than five words are too short to be told from chance
and match nothing; several windows of one text and item give the best one, the first of equals;
repeated rows are reported alike; a null id is reported as null; empty tables give no rows;
further columns are ignored, or kept by ``decontaminate``. Items may have up to 16,000 words.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjectseries.llm.common import col, fresh
from subjectseries.session import materialize

WORDS = 5
PERCENT = 80
#: Shingles of the benchmark that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Largest number of differing bits between the fingerprints of an item and of a similar window.
RADIUS = 23
_BLOCKS = 8
_BLOCK_BITS = 8
#: Of more differing bits than this in every block, the whole would differ in more than the radius.
_NEAR = RADIUS // _BLOCKS
_LANES = 0x0001000100010001


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words: runs of letters and digits, in lower case."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: Column) -> Column:
    """Hashes of all runs of five words; empty if there are fewer."""
    last = F.size(words) - WORDS
    return F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WORDS))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _vote(k: int, votes: Column, shingle: Column) -> Column:
    return votes + F.shiftrightunsigned(shingle, k).bitwiseAND(F.lit(_LANES))


def simhash(shingles: Column) -> Column:
    """The 64 majority bits of an array of hashes.

    Votes for the bits k, k + 16, k + 32 and k + 48 are counted in the four quarters of a long.    """
    size = F.size(shingles)
    half = F.shiftright(size, 1).cast("long")
    fingerprint = F.lit(0).cast("long")
    for k in range(16):
        votes = F.aggregate(shingles, F.lit(0).cast("long"), functools.partial(_vote, k))
        # A quarter with more votes than half of them carries into its bit 14.
        carried = (votes + (F.lit(0x3FFF).cast("long") - half) * F.lit(_LANES)).bitwiseAND(
            F.lit(0x4000400040004000)
        )
        fingerprint = fingerprint.bitwiseOR(F.shiftleft(F.shiftrightunsigned(carried, 14), k))
    return fingerprint


def _block(fingerprint: Column, block: Column) -> Column:
    shift = (block * _BLOCK_BITS).cast("int")
    return F.call_function("shiftrightunsigned", fingerprint, shift).bitwiseAND(F.lit(2**_BLOCK_BITS - 1))


def block_index(fingerprint: Column) -> Column:
    """The values near a fingerprint's blocks: for each block 256 bits, in four longs."""

    def quarter(n: Column) -> Column:
        value = _block(fingerprint, F.floor(n / 4))
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(63)),
            F.lit(0).cast("long"),
            lambda bits, bit: F.when(
                F.bit_count(value.bitwiseXOR((n % 4) * 64 + bit)) <= _NEAR,
                bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit)),
            ).otherwise(bits),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(4 * _BLOCKS - 1)), quarter)


def in_some_block(index: Column, fingerprint: Column) -> Column:
    """Whether a block of ``fingerprint`` has a value of the index."""

    def hit(block: int) -> Column:
        value = _block(fingerprint, F.lit(block))
        quarter = F.get(index, (4 * block + F.shiftright(value, 6)).cast("int"))
        bit = value.bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftrightunsigned", quarter, bit).bitwiseAND(F.lit(1)) == 1

    return functools.reduce(Column.__or__, map(hit, range(_BLOCKS)))


def within_radius(mine: Column, theirs: Column) -> Column:
    return F.bit_count(mine.bitwiseXOR(theirs)) <= RADIUS


def numbered(ordered: Column) -> Column:
    """Hashes of the elements of a sorted array with their number among equal ones.

    Repetitions become distinct, so the intersection of two such arrays counts them.
    """
    size = F.size(ordered)
    first = F.filter(
        F.sequence(F.lit(0), size - 1),
        lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
    )
    runs = F.transform(
        F.arrays_zip(first.alias("at"), F.concat(F.slice(first, 2, size), F.array(size)).alias("until")),
        lambda run: F.transform(
            F.sequence(F.lit(1), run["until"] - run["at"]), lambda k: F.xxhash64(F.get(ordered, run["at"]), k)
        ),
    )
    return F.when(size > 0, F.flatten(runs)).otherwise(F.array().cast("array<bigint>"))


def items_table(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, width, shingles, fingerprint) of the items that are long enough.

    ``item`` numbers them; ``shingles`` are sorted.
    """
    words = benchmark.select("item_id", word_hashes(F.col("text").cast("string")).alias("words"))
    return (
        words.select(
            "item_id",
            F.size("words").alias("width"),
            F.array_sort(shingle_hashes(F.col("words"))).alias("shingles"),
        )
        .where(F.col("width") >= WORDS)
        .withColumn("fingerprint", simhash(F.col("shingles")))
        .withColumn("item", F.monotonically_increasing_id())
    )


def _index(items: DataFrame) -> DataFrame:
    """(item, index, theirs): the blocks of the items and their numbered shingles."""
    return items.select(
        "item",
        "item_id",
        F.col("fingerprint").alias("item_fingerprint"),
        block_index(F.col("fingerprint")).alias("index"),
        numbered(F.col("shingles")).alias("theirs"),
    )


def _enough(common: Column, sizes: Column) -> Column:
    """Whether so many common shingles of two sets of ``sizes`` together reach the similarity."""
    return 100 * common >= PERCENT * (sizes - common)


def _part(start: Column, width: Column) -> Column:
    return F.slice("shingles", start + 1, width - WORDS + 1)


def _windows(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The item-sized windows that may be similar to the item, and the texts they are of.

    The windows are (key, item, start, width, fingerprint), the texts (key, shingles).
    """
    entries = items.select("item", F.explode("shingles").alias("hash")).distinct()
    if entries.count() <= BROADCAST_ROWS:
        entries = F.broadcast(entries)
    # Words are a column of their own, since every shingle uses them.
    texts = docs.select(
        F.md5(F.col("text").cast("binary")).alias("key"), word_hashes(F.col("text")).alias("words")
    ).select("key", shingle_hashes(F.col("words")).alias("shingles"))
    # The outer form keeps the optimizer from testing for emptiness by making the shingles again.
    anchors = (
        texts.select("key", F.posexplode_outer("shingles").alias("pos", "hash"))
        .join(entries, "hash")
        .select("key", "item", "pos")
        .distinct()
    )
    anchors = materialize(anchors, "leak-anchors")
    # Even if a window has no other shingles, it needs this share of the item's.
    sizes = items.select("item", "width", F.size("shingles").alias("size"))
    hit = (
        anchors.groupBy("key", "item")
        .agg(F.count("*").alias("places"))
        .join(sizes, "item")
        .where(100 * F.col("places") >= PERCENT * F.col("size"))
        .select("key", "item", "width", "size")
    )
    hit = materialize(hit, "leak-hits")
    # Written first, so its size is known: the texts stay where they are if it is small.
    keys = materialize(hit.select("key").distinct(), "leak-keys")
    wanted = docs.withColumn("key", F.md5(F.col("text").cast("binary"))).join(keys, "key", "left_semi")
    wanted = (
        wanted.dropDuplicates(["key"])
        .select("key", word_hashes(F.col("text")).alias("words"))
        .select("key", F.size("words").alias("length"), shingle_hashes(F.col("words")).alias("shingles"))
    )
    wanted = materialize(wanted, "leak-wanted")
    last = F.greatest(F.col("length") - F.col("width"), F.lit(0))
    low = F.greatest(F.col("pos") - F.col("width") + WORDS, F.lit(0))
    starts = (
        anchors.join(hit, ["key", "item"])
        .join(wanted.select("key", "length"), "key")
        .withColumn("start", F.explode(F.sequence(F.least(low, last), F.least("pos", last))))
        .groupBy("key", "item", "start", "width", "size", "length")
        .agg(F.count("*").alias("most"))
        .where(_enough(F.col("most"), F.col("size") + F.least("width", "length") - (WORDS - 1)))
    )
    texts = wanted.select("key", "shingles")
    # Written, so that no filter on a fingerprint makes it again.
    windows = materialize(
        starts.join(texts, "key").select(
            "key",
            "item",
            "start",
            "width",
            simhash(_part(F.col("start"), F.col("width"))).alias("fingerprint"),
        ),
        "leak-windows",
    )
    return windows, texts


def contaminated_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_id, start, width, similarity): the best window of a text for each item it holds.

    ``key`` is the text's md5, ``start`` and ``width`` count words.
    """
    items = materialize(items_table(benchmark), "leak-items")
    index = materialize(_index(items), "leak-index")
    windows, texts = _windows(docs, items)
    near = (
        windows.join(index, "item")
        .where(in_some_block(F.col("index"), F.col("fingerprint")))
        .where(within_radius(F.col("fingerprint"), F.col("item_fingerprint")))
        .drop("index", "fingerprint", "item_fingerprint")
    )
    sorted_parts = near.join(texts, "key").withColumn(
        "mine", F.array_sort(_part(F.col("start"), F.col("width")))
    )
    measured = sorted_parts.select(
        "key",
        "item_id",
        "start",
        "width",
        F.size(F.array_intersect(numbered(F.col("mine")), "theirs")).alias("common"),
        (F.size("mine") + F.size("theirs")).alias("sizes"),
    )
    return (
        measured.where(_enough(F.col("common"), F.col("sizes")))
        .withColumn("similarity", F.col("common") / (F.col("sizes") - F.col("common")))
        .groupBy("key", "item_id")
        .agg(
            F.max_by(F.struct("start", "width", "similarity"), F.struct("similarity", -F.col("start"))).alias("best")
        )
        .select("key", "item_id", "best.start", "best.width", "best.similarity")
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, start, width, similarity."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = materialize(contaminated_texts(texts, benchmark), "leak-found")
    keyed = texts.select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))
    return keyed.join(found, "key").drop("key")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns are kept."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    found = materialize(contaminated_texts(texts, benchmark).select("key").distinct(), "leak-found")
    key = fresh(docs, "leak_key")
    text = col("text").cast("string").cast("binary")
    marked = docs.withColumn(key, F.coalesce(F.md5(text), F.lit("")))
    return marked.join(found.withColumnRenamed("key", key), key, "left_anti").select(*map(col, docs.columns))
