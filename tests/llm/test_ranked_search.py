"""Lexical search, periodic runs and the metric tree against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from subjectseries.llm import lexical, metric_tree, periodic
from tests.llm.conftest import documents, prose

# ---- lexical search


def ranked(docs, items, places):
    """The contract, row by row."""
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

    def cut(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return pattern.findall(lower)

    texts = [(i, cut(t)) for i, t in docs]
    n_docs = sum(bool(t) for _, t in texts)
    n_terms = sum(len(t) for _, t in texts)
    holds = Counter(w for _, t in texts for w in set(t))
    out = []
    wanted = {}
    for name, text in items:
        wanted.setdefault(name, set()).update(cut(text))
    for name, own in wanted.items():
        rows = []
        for i, t in texts:
            if i is None or name is None:
                continue
            tf = Counter(t)
            m = 100 - 50 + (50 * len(t) * n_docs) // max(1, n_terms)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holds[w] + 1)))
                * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 20 * m))
                for w in own
            )
            if score > 0:
                rows.append((-score, i))
        out += [(name, k + 1, i, -s) for k, (s, i) in enumerate(sorted(rows)[:places])]
    return sorted(out)


def test_lexical_search_ranks_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    monkeypatch.setattr(lexical, "SCORED", 3)
    draw = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["Ärger", "été", "ÉTÉ", "a-b", "x_y"]
    rows = [(i, " ".join(draw.choices(words, [1 / (k + 1) for k in range(len(words))], k=draw.randrange(1, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " ,.; "), (203, rows[0][1]), (203, rows[0][1]), (None, rows[1][1])]
    items = [(k, " ".join(draw.choices(words, k=draw.randrange(1, 90)))) for k in range(12)]
    items += [(20, None), (21, "unknown words"), (22, "w1"), (22, "W2 w50"), (None, "w1 w2")]
    found = lexical.search(
        documents(spark, rows).repartition(3), spark.createDataFrame(items, "item_id long, text string"), places=7, block_terms=40
    )
    assert sorted(map(tuple, found.collect())) == ranked(rows, items, 7)


def test_lexical_search_of_an_item_with_more_terms_than_a_word_has_bits(spark):
    rows = [(i, prose(i, 30)) for i in range(40)]
    items = [(1, " ".join(t for _, t in rows[:20]))]
    found = lexical.search(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), places=5)
    assert sorted(map(tuple, found.collect())) == ranked(rows, items, 5)


def test_lexical_search_of_empty_tables(spark, empty_docs):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(empty_docs, items).count() == 0
    assert lexical.search(documents(spark, [(1, "a")]), items.limit(0)).count() == 0


def test_terms_of_a_long_text_are_not_cut(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 10)
    text = "ab cdefghijklmnopq r " * 5 + "s" * 40
    assert [t for part in lexical.terms(text) for t in part] == text.encode().split()


# ---- periodic runs


def brute_runs(words):
    """All runs by trying every period and every stretch."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 12)), max_size=12))
def test_runs_as_by_brute_force(parts):
    texts = [np.array(base * times + [k % 4], np.int64) for k, (base, times) in enumerate(parts)]
    texts.append(np.concatenate([np.zeros(0, np.int64), *texts]))
    found = periodic.find_runs(texts, 4)
    assert [[tuple(r) for r in runs.tolist()] for runs in found] == [brute_runs(t.tolist()) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=300), st.integers(1, 60))
def test_extension_as_by_comparing(words, period):
    base = (words * 300)[:300] if len(words) and len(words) < 60 else words
    text = np.array([*base, 9], np.int64)
    if len(text) <= period + 1:
        return
    extend = periodic.Extension(text)
    a = np.arange(len(text) - period)
    want = []
    for i in a:
        k = 0
        while i + period + k < len(text) and text[i + k] == text[i + period + k]:
            k += 1
        want.append(k)
    assert extend(a, a + period).tolist() == want


def test_difference_cover_is_perfect():
    differences = Counter((a - b) % periodic.MODULUS for a in periodic.COVER for b in periodic.COVER if a != b)
    assert sorted(differences) == list(range(1, periodic.MODULUS)) and set(differences.values()) == {1}


def contract_row(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    text = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, text)))


def test_periodic_rows_follow_the_contract(spark, monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK_WORDS", 500)
    draw = random.Random(8)
    rows = [(i, prose(i, draw.randrange(1, 200))) for i in range(60)]
    rows += [(100 + i, " ".join(draw.choices("ab", k=150))) for i in range(10)]
    rows += [(120, "x " * 200), (121, None), (122, ""), (123, " \t\n"), (124, "a\x0bb c d " * 30), (0, rows[0][1])]
    rows += [(125, (prose(1, 40) + "\n") * 4), (125, (prose(1, 40) + "\n") * 4)]
    from pyspark.sql import functions as F

    docs = documents(spark, rows)
    texts = docs.withColumn("text", periodic.planted(F.col("doc_id"), F.col("text")))
    found = periodic.digest(periodic.periodic_runs(texts)).collect()
    key = lambda r: (r[0], r[-1])
    assert sorted(map(tuple, found), key=key) == sorted((contract_row(*r) for r in rows), key=key)


def test_periodic_runs_of_null_ids_long_and_no_texts(spark, empty_docs, monkeypatch):
    monkeypatch.setattr(periodic, "_PIECE", 50)
    base = prose(5, 7_000)
    rows = [(None, "a b " * 20), (1, f"{base} {base} {base} tail")]
    found = {r["doc_id"]: r for r in periodic.periodic_runs(documents(spark, rows)).collect()}
    assert found[None]["collapsed"] == "a b" and [tuple(r) for r in found[None]["runs"]] == [(0, 40, 2)]
    assert [tuple(r) for r in found[1]["runs"]] == [(0, 21_000, 7_000)]
    assert found[1]["collapsed"] == f"{base} tail" and found[1]["n_words"] == 21_001
    assert periodic.periodic_runs(empty_docs).count() == 0


# ---- metric tree


TOP = (1 << 63) - 1


def nearest_by_all(rows, every, k):
    out = []
    for q, x in rows:
        if q % every == 0:
            scored = sorted((-min(TOP, sum(a * b for a, b in zip(x, y))), i) for i, y in rows if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def whole(v):
    return [math.floor(64 * float(np.float32(x))) for x in v]


def test_tree_search_as_by_all_pairs(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(6, 8)) * 2
    rows = [(i, (centres[i % 6] + 0.05 * draw.normal(size=8)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(60)]
    rows += [(400, [0.0] * 8), (420, (-np.array(rows[0][1])).tolist())]
    bad = [(500, None), (520, [1.0] * 7 + [float("nan")]), (540, [1.0] * 7 + [None]), (560, [float("inf")] * 8), (580, [1.0] * 3), (None, [1.0] * 8), (40, rows[40][1])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, score string")
    found = metric_tree.search(table, every=20, nearest=7, shard_rows=50)
    assert sorted(map(tuple, found.collect())) == nearest_by_all([(i, whole(v)) for i, v in rows], 20, 7)
    few = metric_tree.search(table.where("vec_id < 4"), every=2, nearest=20)
    assert sorted(map(tuple, few.collect())) == nearest_by_all([(i, whole(v)) for i, v in rows[:4]], 2, 20)
    assert metric_tree.search(table.limit(0)).count() == 0


def test_tree_of_empty_vectors_and_of_large_ones(spark):
    none = spark.createDataFrame([(i, []) for i in range(5)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, metric_tree.search(none, every=4, nearest=3).collect())) == [
        (0, 1, 1, 0), (0, 2, 2, 0), (0, 3, 3, 0), (4, 1, 0, 0), (4, 2, 1, 0), (4, 3, 2, 0),
    ]
    rows = [(i, [float(3 * 10**7 + i), float(i)]) for i in range(30)] + [(31, [1e300, 0.0]), (50, [1e300, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = metric_tree.search(table, every=10, nearest=3)
    held = [(i, [min(TOP, int(64 * x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, found.collect())) == nearest_by_all(held, 10, 3)


def test_tree_leaves_most_rows_of_clustered_data_out():
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(40, 16)) * 60
    rows = np.unique((centres[draw.integers(0, 40, 4000)] + 3 * draw.normal(size=(4000, 16))).astype(np.int64), axis=0)
    tree = metric_tree.Tree(rows, [np.array([i]) for i in range(len(rows))], page=32)
    for name in range(0, len(rows), 100):
        found = tree.search(rows[name], name, 5)
        scores = rows @ rows[name]
        scores[name] = scores.min() - 1
        assert [-s for s, _ in found] == sorted(scores.tolist(), reverse=True)[:5]
    assert tree.computed < 0.3 * len(rows) * len(range(0, len(rows), 100))


@pytest.mark.parametrize("least", [None, 0, 10**9])
def test_tree_starts_from_a_given_last_score(least):
    rows = np.random.default_rng(6).integers(-50, 50, (500, 4))
    tree = metric_tree.Tree(rows, [np.array([i]) for i in range(500)], page=16)
    scores = rows @ rows[0]
    want = sorted((-int(s), i) for i, s in enumerate(scores) if i and (least is None or s >= least))[:9]
    assert tree.search(rows[0], 0, 9, -np.inf if least is None else least) == want
