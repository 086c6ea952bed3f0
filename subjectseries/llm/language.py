"""Operator 6: language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector is the product of its
letters' vectors, each rotated by its distance from the n-gram's end; a text's profile is the
sum over its n-grams (letters and the gaps between words). A language's prototype is the sum
over its training texts, each at unit length, and a text gets the language whose prototype has the largest cosine
with its profile.

Since sums are linear, training counts the n-grams of each language in a task and makes one
vector per language and task of them; only those are shuffled, as sums by dimension. All texts
that may be learned from take part, and all texts are classified in whole. A task holds the
vectors of at most ``BLOCK`` n-grams at a time.

Edge cases: a text that is null or has no letter is ``und`` with score 0, as is every text if
no language can be learned; rows whose language is null teach nothing; ties go to the smallest
language; a negative cosine scores 0; repeated rows are classified alike; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjectseries.llm.common import held_out, small_batches
from subjectseries.llm.toxicity import BITS, letter_codes

SIZE = 1024
GRAM = 3
SEED = 20
BLOCK = 4096
UNKNOWN = "und"
_CHARS = 1 << 20

_vectors: dict[int, np.ndarray] = {}


def letter_vectors(size: int) -> np.ndarray:
    """The +1/-1 vector of every letter code; row 0 stands for a gap."""
    if size not in _vectors:
        bits = np.random.default_rng(SEED).integers(0, 2, (1 << BITS, size), dtype=np.int8)
        _vectors[size] = bits * 2 - 1
    return _vectors[size]


def gram_vectors(codes: np.ndarray, size: int) -> np.ndarray:
    """Bound vectors of n-gram codes; the last letter is in the lowest bits."""
    letters, out = letter_vectors(size), np.ones((len(codes), size), np.float32)
    for place in range(GRAM):
        letter = (codes >> (BITS * place)) & ((1 << BITS) - 1)
        out *= np.roll(letters[letter], place, axis=1)
    return out


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of ``texts`` and their counts, a row per text."""
    lowered = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = letter_codes(points)
    ends = np.cumsum([len(t) for t in lowered])
    where = np.flatnonzero((codes > 0) | np.concatenate(([True], codes[:-1] > 0)))
    codes = codes[where]
    owner = np.searchsorted(ends, where, side="right")
    used = np.flatnonzero(np.bincount(codes, minlength=1))
    small = np.searchsorted(used, codes)
    wide = np.zeros(max(0, len(codes) - GRAM + 1), np.int64)
    inside = np.ones(len(wide), bool)
    middle = np.zeros(len(wide), bool)
    for place in range(GRAM):
        stop = len(codes) - (GRAM - 1 - place)
        wide = wide * len(used) + small[place:stop]
        inside &= owner[place:stop] == owner[GRAM - 1 :]
        middle |= codes[place:stop] > 0
    chosen = inside & middle
    wide, owner = wide[chosen], owner[GRAM - 1 :][chosen]
    if len(used) ** GRAM <= 1 << 22:
        present = np.bincount(wide, minlength=1) > 0
        found = np.flatnonzero(present)
        column = (np.cumsum(present) - 1)[wide]
    else:
        found, column = np.unique(wide, return_inverse=True)
    counts = np.bincount(owner * len(found) + column, minlength=len(texts) * len(found))
    full, rest = np.zeros(len(found), np.int64), found.copy()
    for place in range(GRAM):
        full |= used[rest % len(used)] << (BITS * place)
        rest //= len(used)
    return full, counts.reshape(len(texts), len(found)).astype(np.float32)


def bundle(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Profiles: a row of ``counts`` times the vectors of ``codes``, a block at a time."""
    out = np.zeros((len(counts), size), np.float32)
    for start in range(0, len(codes), BLOCK):
        part = slice(start, start + BLOCK)
        out += counts[:, part] @ gram_vectors(codes[part], size)
    return out


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about a million characters, so that long batches need little memory."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= _CHARS:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Blocks of bounded characters and rows, so that count matrices stay small."""
    for start, block in _blocks(texts):
        for k in range(0, len(block), 250):
            yield start + k, block[k : k + 250]


def _train(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            texts = batch.column(0).to_pylist()
            for start, block in _groups(texts):
                codes, counts = gram_counts(block)
                mine = langs[start : start + len(block)]
                names = sorted(set(mine))
                # Every text counts alike, however long it is.
                counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1)
                rows = np.stack([counts[mine == n].sum(0) for n in names])
                for name, vector in zip(names, bundle(codes, rows, size)):
                    sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        for name, vector in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * size), pa.array(range(size), pa.int32()), pa.array(vector)],
                names=["lang", "dimension", "value"],
            )

    return run


def prototypes(docs: DataFrame, size: int = SIZE) -> tuple[list[str], np.ndarray]:
    """Sorted languages and their unit vectors, from the rows that may be learned from."""
    small_batches(docs.sparkSession)
    rows = (
        docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("text").cast("string"), F.col("lang").cast("string"))
        .mapInArrow(_train(size), "lang string, dimension int, value double")
        .groupBy("lang", "dimension")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    langs = sorted({r["lang"] for r in rows})
    out = np.zeros((len(langs), size))
    for r in rows:
        out[langs.index(r["lang"]), r["dimension"]] = r["value"]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return langs, out / np.where(norms > 0, norms, 1)


def classify(texts: list[str], langs: list[str], unit: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language and the cosine of each text."""
    found, cosines = [UNKNOWN] * len(texts), np.zeros(len(texts))
    for start, block in _groups(texts):
        if not langs:
            break
        codes, counts = gram_counts(block)
        profile = bundle(codes, counts, unit.shape[1]).astype(np.float64)
        norms = np.linalg.norm(profile, axis=1)
        cosine = (profile @ unit.T) / np.where(norms > 0, norms, 1)[:, None]
        best = cosine.argmax(1)
        for k in np.flatnonzero(counts.sum(1) > 0):
            found[start + k] = langs[best[k]]
            cosines[start + k] = min(1.0, max(0.0, cosine[k, best[k]]))
    return found, cosines


def identify(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the cosine, 0 if negative)."""
    langs, unit = prototypes(docs, size)
    shared = docs.sparkSession.sparkContext.broadcast((langs, unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            found, cosines = classify(texts, *shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(cosines)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
