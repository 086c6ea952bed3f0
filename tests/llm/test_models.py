"""Toxicity, quality and language: held-out accuracy, edge cases, and the model's arithmetic."""

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from subjectseries.llm import language, quality, toxicity

from .conftest import documents

ORDINARY = "the river runs past old stone houses while people walk home in the evening light".split()
TOXIC = "idiot moron scum trash".split()


def _texts(n=240):
    draw = random.Random(1)
    rows = []
    for i in range(n):
        words = [draw.choice(ORDINARY) for _ in range(60)]
        bad = i % 3 == 0
        if bad:
            for _ in range(6):
                words[draw.randrange(60)] = draw.choice(TOXIC)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_grams_follow_words():
    codes, owner = toxicity.grams(["ab", "", "C"])
    mask = (1 << toxicity.BITS) - 1
    assert [chr(c & mask) if c & mask else "$" for c in codes] == ["a", "b", "$", "c", "$"]
    assert owner.tolist() == [0, 0, 0, 2, 2]
    assert codes[1] >> toxicity.BITS == ord("a")


def test_model_matches_plain_formula():
    """The log-ratio of every n-gram against Kneser-Ney written out with dictionaries."""
    codes, _ = toxicity.grams([t for _, t, _ in _texts(30)])
    found, inverse = np.unique(codes, return_inverse=True)
    toxic = np.bincount(inverse, np.arange(len(codes)) % 3 == 0, len(found)).astype(float)
    plain = np.bincount(inverse, minlength=len(found)) - toxic
    model = toxicity.build(found, toxic, plain, 0.5)
    bits, order = toxicity.BITS, toxicity.ORDER

    def discount(values):
        one, two = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return one / (one + 2 * two) if one and two else 0.5

    def shared(grams, n):
        kinds = Counter(g & ((1 << bits * n) - 1) for g in grams)
        if n == 1:
            total = sum(kinds.values()) + 0.5 * (len(kinds) + 1)
            return {g: (c + 0.5) / total for g, c in kinds.items()}
        lower, cut = shared(list(kinds), n - 1), discount(kinds.values())
        total, many = Counter(), Counter()
        for g, c in kinds.items():
            total[g >> bits] += c
            many[g >> bits] += 1
        short = (1 << bits * (n - 1)) - 1
        return {
            g: (max(c - cut, 0) + cut * many[g >> bits] * lower[g & short]) / total[g >> bits]
            for g, c in kinds.items()
        }

    short = (1 << bits * (order - 1)) - 1
    lower = shared(found.tolist(), order - 1)
    tables = [dict(zip(found.tolist(), c)) for c in (toxic + plain, toxic, plain)]

    def probability(counts, backoff, g):
        seen = {k: v for k, v in counts.items() if v > 0 and k >> bits == g >> bits}
        total, cut = sum(seen.values()), discount(counts.values())
        if not total:
            return backoff(g)
        return (max(counts[g] - cut, 0) + cut * len(seen) * backoff(g)) / total

    def pooled(g):
        return probability(tables[0], lambda h: lower[h & short], g)

    some = found[:: max(1, len(found) // 40)]
    got = model.grams.get(some)[0]
    want = [np.log(probability(tables[1], pooled, g)) - np.log(probability(tables[2], pooled, g)) for g in some.tolist()]
    assert np.allclose(got, want, atol=1e-4)


def test_toxicity_held_out(spark, empty_docs, no_labels):
    rows = _texts()
    extra = [(900, None), (901, ""), (902, "123 !!"), (903, "idiot moron " * 3000), (None, "the river"), (5, rows[5][1])]
    docs = documents(spark, [(i, t) for i, t, _ in rows] + extra)
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, labels).collect()
    assert len(out) == len(rows) + len(extra)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
    held = {r.doc_id: r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900}
    assert np.mean([held[i].predicted == y for i, _, y in rows if i in held]) > 0.95
    by_id = {r.doc_id: r for r in out}
    assert by_id[903].predicted == 1
    assert by_id[900].score == by_id[901].score == by_id[902].score
    assert toxicity.score(empty_docs, no_labels).count() == 0
    assert {r.score for r in toxicity.score(docs, no_labels).collect()} == {0.0}


def test_quality_held_out(spark, empty_docs, no_labels):
    rows = [(i, t if not y else t.upper().replace(" ", "!! "), 1 - y) for i, t, y in _texts()]
    extra = [(900, None), (901, ""), (902, rows[0][1] * 200), (None, "x")]
    docs = documents(spark, [(i, t) for i, t, _ in rows] + extra)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows[:200]], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(out) == len(rows) + len(extra)
    assert np.mean([out[i].predicted == y for i, _, y in rows if out[i].held_out]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())
    assert quality.score(empty_docs, no_labels).count() == 0


def test_surest_rows_share_the_last_margin():
    assert quality.surest(np.array([2, 0, 3, 4]), 4).tolist() == [1, 0, 2 / 3, 0]
    assert quality.surest(np.array([9, 1]), 3).tolist() == [1 / 3, 0]
    assert quality.surest(np.array([1, 1]), 5).tolist() == [1, 1]


def test_quality_learns_from_all_unlabelled_rows(spark):
    """Every round picks anew from all rows, at most its share of them, and treats copies alike."""
    rows = [(i, t if not y else t.upper().replace(" ", "!! "), 1 - y) for i, t, y in _texts(1200)]
    docs = documents(spark, [(i, t) for i, t, _ in rows] + [(i, rows[0][1]) for i in range(5000, 5400)])
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows[:150]], "doc_id long, quality int, toxic int")
    views = quality.features(docs.repartition(7))
    model = quality.fit(views, labels)
    assert len(model.rounds) == quality.ROUNDS
    held = {r.doc_id: r for r in views.collect()}
    out = [i for i in held if i >= 150 and not held[i].held_out]
    pool = [np.array([np.frombuffer(held[i][v], np.float32) for i in out], float) for v in ("text_view", "meta_view")]
    taken = [np.zeros(len(out)), np.zeros(len(out))]
    for n in range(quality.ROUNDS):
        _, last = quality.picked(model.rounds[: n + 1], pool)
        weight = min(1, quality.ADDED * sum(i < 150 and not held[i].held_out and zlib.crc32(str(i).encode()) // 4 % 5 != 0 for i in held) / (quality.SHARE * len(out)))
        for k, (good, bad) in enumerate(last):
            assert not (taken[k] * (good + bad)).any()
            assert (good.sum() + bad.sum()) / weight <= quality.SHARE * len(out) + 1e-6
            taken[k] += good + bad
    assert (taken[0] > 0).any()
    # Copies share one margin: all are picked in the same round with the same weight, or none.
    copies = [n for n, i in enumerate(out) if i >= 5000]
    assert len({round(t, 9) for t in taken[0][copies]}) == 1


def test_language_profiles(spark, empty_docs):
    samples = {"en": "the shining thing with other", "de": "der schöne Übergang zwischen", "fr": "où l'été près forêt être"}
    draw = random.Random(2)
    rows = []
    for i in range(90):
        lang = list(samples)[i % 3]
        words = samples[lang].split()
        rows.append((i, " ".join(draw.choice(words) for _ in range(40)), lang, "s", 0))
    rows += [(100, None, "en", "s", 0), (101, "12 !", "de", "s", 0), (102, "the thing", None, "s", 0), (103, "der " * 30000, "de", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang, *_ in rows[:90])
    assert out[100].lang_pred == out[101].lang_pred == "und" and out[100].score == 0
    assert out[102].lang_pred == "en" and out[103].lang_pred == "de"
    assert language.identify(empty_docs).count() == 0


def test_profile_is_the_sum_of_bound_vectors():
    size, text = 64, "aba c"
    letters = language.letter_vectors(size).astype(int)
    padded = [0, 97, 98, 97, 0, 99, 0]
    want = np.zeros(size, int)
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        want += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    codes, counts = language.gram_counts([text, ""])
    got = language.bundle(codes, counts, size)
    assert got[0].tolist() == want.tolist() and not got[1].any()


def test_toxicity_keeps_all_ngrams(spark):
    draw = np.random.default_rng(5)
    letters = draw.integers(97, 123, (120, 25_000), dtype=np.uint8)
    rows = [(i, bytes(row).decode()) for i, row in enumerate(letters)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learned = toxicity.training_rows(docs, labels, "toxic", 200).where("fold > 0").collect()
    want = np.unique(np.concatenate([toxicity.grams([r.text])[0] for r in learned]))
    model = toxicity.fit(docs, labels)
    assert sum((keys >= 0).sum() for keys, _, _ in model.grams.levels) == len(want) > 1_000_000


def _counted(rows):
    texts, labels = zip(*rows)
    sums = Counter()
    for part in toxicity._count(iter([pa.RecordBatch.from_arrays([pa.array(texts), pa.array(labels)], names=["text", "label"])])):
        for code, bad, plain in zip(*(c.to_pylist() for c in part.columns)):
            sums[code, 1] += bad
            sums[code, 0] += plain
    return +sums


def test_ngrams_of_a_class_are_counted_whatever_is_held_at_a_time(monkeypatch):
    text = "ΟΔΟΣ ὈΔΥΣΣΕΎΣ. idiot\n" * 40
    rows = [(t, b) for _, t, b in _texts(40)] + [("", 1), (text, 0), (text.replace(" ", "_"), 1)]
    want = Counter((c, b) for t, b in rows for c in toxicity.grams([t])[0].tolist())
    assert _counted(rows) == want
    for chars, held in ((100, 1 << 18), (1, 50), (300, 1)):
        monkeypatch.setattr(toxicity, "_CHARS", chars)
        monkeypatch.setattr(toxicity, "_HELD", held)
        assert _counted(rows) == want


def test_long_texts_weigh_the_same_in_pieces(monkeypatch):
    rows = _texts(60)
    codes, owner = toxicity.grams([t for _, t, _ in rows])
    bad = np.array([b for *_, b in rows])[owner]
    found, at = np.unique(codes, return_inverse=True)
    model = toxicity.build(found, np.bincount(at, bad), np.bincount(at, 1 - bad), 0.3)
    texts = ["", " ".join(t for _, t, _ in rows), "idiot", rows[0][1] * 9, "a" * 5000]
    want = model.evidence(texts)
    monkeypatch.setattr(toxicity, "_CHARS", 64)
    got = model.evidence(texts)
    assert np.allclose(got[0], want[0], rtol=1e-12) and (got[1] == want[1]).all()


def test_counting_needs_little_memory():
    words = np.random.default_rng(3).integers(0, 5000, (400, 2000))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([" ".join(f"w{chr(97 + w % 26)}{w * 7919 % 5000:x}" for w in row) for row in words]), pa.array([0] * 400)],
        names=["text", "label"],
    )
    long = pa.RecordBatch.from_arrays([pa.array(["".join(batch.column(0).to_pylist())]), pa.array([1])], names=["text", "label"])
    for given in (batch, long):
        tracemalloc.start()
        for part in toxicity._count(iter([given])):
            del part
        _, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert most < 40 << 20


def test_letters_of_all_planes_have_codes():
    text = "a\U00010330\U00020000\U00010400\U0001F600 1\u4e2d"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    assert (toxicity.letter_codes(points) > 0).tolist() == [True, True, True, True, False, False, False, True]
    assert len(toxicity.grams(["\U00010330\U00010331"])[0]) and language.gram_counts(["\U00010330\U00010331"])[1].sum() > 0
