"""What keeps the join of op 4 from growing with the square of a family of texts."""

import tracemalloc

import numpy as np

from subjectseries.llm import ngram_join
from subjectseries.llm.shingles import shingle_sets

from .conftest import documents, prose

ROWS = "token long, salt int, spread boolean, gid long, n int, pos int, comp long, head long"


def test_groups_meet_only_where_the_similarity_is_possible(spark):
    # 48 shingles: two such sets need 43 common ones, so the first common one is at place 5 or before.
    family = [(1, 0, False, k, 48, 8, k, k) for k in range(60)]
    near = [(2, 0, False, 100 + k, 48, 5, k, k) for k in range(3)]
    found = ngram_join._meetings(spark.createDataFrame(family + near, ROWS)).collect()
    assert {(r.gid, r.gid2) for r in found} == {(100, 101), (100, 102), (101, 102)}


def test_common_shingles_come_last_whatever_their_buckets_say(spark, empty_docs):
    passage = prose(500, 20)
    rows = [(i, f"{prose(i, 30)} {passage}") for i in range(300)]
    rarity = ngram_join.rarity(documents(spark, rows))
    (shared,) = shingle_sets([passage])
    assert set(shared) <= set(rarity.common)
    assert (np.diff(rarity.common) > 0).all()
    full = rarity._replace(buckets=np.full(1 << ngram_join.BUCKET_BITS, 500))
    for found in shingle_sets([text for _, text in rows]):
        prefix, _ = ngram_join._prefix(found, full)
        assert not set(prefix) & set(shared)
    none = ngram_join.rarity(empty_docs)
    assert not len(none.common) and not none.buckets.any()


def test_the_order_of_shingles_takes_little_of_the_driver(spark):
    passage = prose(500, 4000)
    docs = documents(spark, [(i, f"{prose(i, 800)} {passage}") for i in range(200)])
    ngram_join.rarity(docs.limit(1))
    tracemalloc.start()
    found = ngram_join.rarity(docs)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert (found.buckets > 0).sum() > 100_000 and len(found.common) > 3000
    assert most < 8 << 20


def test_near_copies_are_led_by_the_one_with_the_fewest_changes(spark):
    # Group 5 is not the smallest one, but the shared shingle is its rarest.
    rows = [(1, 0, False, k, 140 + k, 12 if k != 5 else 0, k, k) for k in range(8)]
    tried = ngram_join._stars(spark.createDataFrame(rows, ROWS)).collect()
    assert {r.gid for r in tried if r.leader == 5} == {0, 1, 2, 3, 4, 6, 7}


def test_shingles_of_many_texts_need_little_memory():
    texts = [prose(i, 1000) for i in range(400)]
    list(shingle_sets(texts[:1]))
    tracemalloc.start()
    kept, most = tracemalloc.get_traced_memory()
    for found in shingle_sets(texts):
        del found
    kept, most = (x - kept for x in tracemalloc.get_traced_memory())
    tracemalloc.stop()
    assert most < 40 << 20 and kept < 12 << 20


def test_filter_bits_mark_what_the_sets_are_read_by(spark):
    ids = list(range(-50, 3000, 7))
    bits = ngram_join._filter_bits(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    slots = ngram_join._filter_slots(np.array(ids))
    assert np.unpackbits(bits).sum() == len(np.union1d(*slots))
    for at in slots:
        assert (np.unpackbits(bits)[at] == 1).all()
