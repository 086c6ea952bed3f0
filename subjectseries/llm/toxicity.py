"""Operator 1: toxicity by class-conditional Kneser-Ney models.

Letters of words are predicted from the four before them in the word. Each class has its own
counts of the longest n-grams; the mass that the discount takes from them goes to one backoff
distribution that both classes share, a Kneser-Ney model over the rows of both. So an expression
that is rare in a class weighs as it does in general. A text's evidence is the log-likelihood
under the toxic model minus that under the ordinary one, divided by its number of predictions;
``PAD`` predictions of average evidence are added, since a few letters prove little. A logistic
curve, fitted on training rows that the models did not see, turns it into a score.

Counting runs where the texts are read, some 130,000 characters at a time; n-grams are summed in
each task before they are shuffled, and a task that holds many distinct ones hands them on meanwhile. Labels are learned from at most ``most_labels`` labelled rows (those with the
smallest hash of the id). The model keeps all their n-grams, as the smoothing rests on the rare
ones, so it grows with what these rows hold. All texts are scored in whole.

Edge cases: null and empty texts, and texts without a letter, have average evidence and so the
low score of an ordinary text; labels that are null are no labels, an id with several labels takes
the largest; without labels of both classes every score is the share of toxic labels (0 if
there are none); repeated rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjectseries.llm.common import col, held_out, small_batches

ORDER = 5
BITS = 12
MOST_LABELS = 200_000
#: Scores from here on are predicted toxic.
THRESHOLD = 0.3
#: One training row in so many is kept from the models to fit the curve.
FOLDS = 5
_BINS, _RANGE = 2000, 2.0
#: Predictions of average evidence that every text is given besides its own.
PAD = 100
#: Characters that are cut into n-grams at a time; what a worker needs for them is some hundred times as much.
_CHARS = 1 << 17
#: Distinct n-grams by class that a counting task holds before it hands on its sums.
_HELD = 1 << 18

_letters: np.ndarray | None = None


def _letter_codes() -> np.ndarray:
    """12-bit codes of the letters of the basic plane, 0 for other characters."""
    global _letters
    if _letters is None:
        points = np.arange(0x10000, dtype=np.uint32)
        alpha = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)
        high = 0x800 + ((points * np.uint32(2654435761)) >> np.uint32(21)) % 0x7FF
        _letters = np.where(alpha, np.where(points < 0x800, points, high), 0).astype(np.int64)
    return _letters


def letter_codes(points: np.ndarray) -> np.ndarray:
    """The code of every code point; letters beyond the basic plane share the upper codes."""
    codes = _letter_codes()[np.where(points < 0x10000, points, 0)]
    far = np.flatnonzero(points >= 0x10000)
    if len(far):
        some, which = np.unique(points[far], return_inverse=True)
        alpha = np.fromiter((chr(c).isalpha() for c in some.tolist()), bool, len(some))
        high = 0x800 + ((some * np.uint32(2654435761)) >> np.uint32(21)) % 0x7FF
        codes[far] = np.where(alpha, high, 0).astype(np.int64)[which]
    return codes


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram codes of all texts and the text that each belongs to.

    A code holds the letter predicted in its lowest bits (0 is the end of a word) and those
    before it above; places before the word's first letter are 0.
    """
    lowered = [t.lower() for t in texts]
    joined = " ".join(lowered) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = letter_codes(points)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    before = np.concatenate(([0], codes[:-1]))
    keep = (codes > 0) | (before > 0)  # letters, and the place after a word's last one
    where = np.flatnonzero(keep)
    codes = codes[where]
    out, ok = codes.copy(), np.ones(len(codes), bool)
    for back in range(1, ORDER):
        previous = np.zeros_like(codes)
        previous[back:] = codes[:-back]
        ok &= previous > 0
        out |= np.where(ok, previous, 0) << (BITS * back)
    return out, np.searchsorted(ends, where, side="right")


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``_CHARS`` characters and the index of the first, so that little memory is needed.

    A text that is longer by itself comes in pieces, each a run of its own. They are cut before
    spaces, which end words and lower-case alike, so they hold the n-grams of the whole text.
    """
    start = size = 0
    for i, text in enumerate(texts):
        if len(text) > _CHARS:
            if start < i:
                yield start, texts[start:i]
            at = 0
            while at < len(text):
                stop = text.find(" ", at + _CHARS)
                stop = len(text) if stop < 0 else stop
                yield i, [text[at:stop]]
                at = stop
            start, size = i + 1, 0
            continue
        size += len(text)
        if size >= _CHARS:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


class Table:
    """Values by code: hash tables of falling size, each with what did not fit in the former."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        while len(codes):
            bits = max(8, int(2 * len(codes) - 1).bit_length())
            at = self._slot(codes, bits)
            _, first = np.unique(at, return_index=True)
            keys = np.full(1 << bits, -1, np.int64)
            kept = np.zeros(1 << bits, np.float32)
            keys[at[first]], kept[at[first]] = codes[first], values[first]
            self.levels.append((keys, kept, bits))
            rest = np.ones(len(codes), bool)
            rest[first] = False
            codes, values = codes[rest], values[rest]

    def _slot(self, codes: np.ndarray, bits: int) -> np.ndarray:
        turn = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.levels))
        return ((codes.astype(np.uint64) * turn) >> np.uint64(64 - bits)).astype(np.int64)

    def get(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, 0 where there is none, and which codes have none."""
        out, left = np.zeros(len(codes), np.float32), np.arange(len(codes))
        for n, (keys, values, bits) in enumerate(self.levels):
            turn = np.uint64(0x9E3779B97F4A7C15 + 2 * n)
            now = codes[left]
            at = ((now.astype(np.uint64) * turn) >> np.uint64(64 - bits)).astype(np.int64)
            hit = keys[at] == now
            out[left[hit]] = values[at[hit]]
            left = left[~hit]
        return out, left


def _sums(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    found, inverse = np.unique(keys, return_inverse=True)
    return found, inverse, [np.bincount(inverse, w, len(found)) for w in weights]


def _discount(counts: np.ndarray) -> float:
    ones, twos = float((counts == 1).sum()), float((counts == 2).sum())
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def _shared(codes: np.ndarray, order: int) -> np.ndarray:
    """Kneser-Ney probability of each distinct ``order``-gram of ``codes`` by continuations.

    ``codes`` are the distinct n-grams one longer, cut to ``order``; the result is aligned.
    """
    grams_, back, (continuations,) = _sums(codes, np.ones(len(codes)))
    if order == 1:
        size = len(grams_) + 1
        return ((continuations + 0.5) / (continuations.sum() + 0.5 * size))[back]
    lower = _shared(grams_ & ((1 << (BITS * (order - 1))) - 1), order - 1)
    _, at, (total, kinds) = _sums(grams_ >> BITS, continuations, np.ones(len(grams_)))
    cut = _discount(continuations)
    p = (np.maximum(continuations - cut, 0) + cut * kinds[at] * lower) / total[at]
    return p[back]


@dataclass
class Model:
    """Log-ratios of the n-grams met in training and of the contexts; the curve; the prior."""

    grams: Table
    contexts: Table
    prior: float
    average: float = 0.0
    slope: float = 0.0
    offset: float = 0.0
    usable: bool = False

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Length-normalised log-ratio of each text and its number of predictions."""
        totals, counts = np.zeros(len(texts)), np.zeros(len(texts))
        for start, block in _pieces(texts):
            codes, owner = grams(block)
            ratio, missing = self.grams.get(codes)
            ratio[missing] = self.contexts.get(codes[missing] >> BITS)[0]
            size = len(block)
            totals[start : start + size] += np.bincount(owner, ratio, size)[:size]
            counts[start : start + size] += np.bincount(owner, minlength=size)[:size]
        return (totals + PAD * self.average) / (counts + PAD), counts

    def scores(self, texts: list[str]) -> np.ndarray:
        ratio, _ = self.evidence(texts)
        curve = 1 / (1 + np.exp(-np.clip(self.slope * ratio + self.offset, -50, 50)))
        return curve if self.usable else np.full(len(texts), self.prior)


def build(codes: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, prior: float) -> Model:
    """The model of n-gram counts by class."""
    if not len(codes) or not toxic.sum() or not ordinary.sum():
        return Model(Table(codes[:0], toxic[:0]), Table(codes[:0], toxic[:0]), prior)
    shorter = _shared(codes & ((1 << (BITS * (ORDER - 1))) - 1), ORDER - 1)
    contexts, at = np.unique(codes >> BITS, return_inverse=True)
    both = toxic + ordinary
    cut, total = _discount(both), np.bincount(at, both)[at]
    shared = (np.maximum(both - cut, 0) + cut * np.bincount(at)[at] * shorter) / total
    logs, backoffs = [], []
    for counts in (toxic, ordinary):
        cut = _discount(counts)
        total = np.bincount(at, counts, len(contexts))
        kinds = np.bincount(at, counts > 0, len(contexts))
        backoff = np.where(total > 0, cut * kinds / np.maximum(total, 1), 1.0)
        p = np.maximum(counts - cut, 0) / np.maximum(total[at], 1) + backoff[at] * shared
        logs.append(np.log(p))
        backoffs.append(np.log(backoff))
    ratio = logs[0] - logs[1]
    return Model(
        Table(codes, ratio),
        Table(contexts, backoffs[0] - backoffs[1]),
        prior,
        average=float((ratio * ordinary).sum() / ordinary.sum()),
        usable=True,
    )


def _logistic(x: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a curve through counts at ``x``, by Newton steps with a weak prior."""
    scale = float(np.sqrt(np.average(x * x, weights=positive + negative))) or 1.0
    z = np.stack([x / scale, np.ones_like(x)])
    total, w = positive + negative, np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ z, -30, 30)))
        slope = z @ (positive - total * p) - 1e-3 * w
        bend = (z * (total * p * (1 - p))) @ z.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """Texts with the label of their id, for at most ``most`` ids that may be learned from.

    The ids come to every task, so their number is what ``most`` bounds.
    """
    chosen = (
        labels.where(col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(col(label)).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    fold = (F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 4) % FOLDS).cast("int")
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "label", fold.alias("fold"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of n-grams by class, merged while a task runs; the texts themselves go no further.

    An n-gram and the class of its text are one key. Blocks are merged when they hold as many
    keys as the sums so far, so merging takes no longer when the sums are large.
    """
    sums: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    parts, waiting = [], 0
    for batch in batches:
        texts, toxic = batch.column(0).to_pylist(), (batch.column(1).to_numpy() > 0).astype(np.int64)
        for start, block in _pieces(texts):
            codes, owner = grams(block)
            parts.append(np.unique(codes << 1 | toxic[start + owner], return_counts=True))
            waiting += len(parts[-1][0])
            if waiting >= max(_CHARS, len(sums[0])):
                sums, parts, waiting = _merged([sums, *parts]), [], 0
                if len(sums[0]) >= _HELD:
                    yield from _rows(*sums)
                    sums = (sums[0][:0], sums[1][:0])
    yield from _rows(*_merged([sums, *parts]))


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of their counts."""
    keys, _, (counts,) = _sums(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    return keys, counts.astype(np.int64)


def _rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(keys), 100_000):
        key, n = keys[start : start + 100_000], counts[start : start + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(key >> 1), pa.array(n * (key & 1)), pa.array(n * (1 - (key & 1)))],
            names=["code", "toxic", "ordinary"],
        )


def _curve(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, _BINS), np.int64)
        for batch in batches:
            ratio, counts = model.value.evidence(batch.column(0).to_pylist())
            bins = np.clip((ratio + _RANGE) / (2 * _RANGE) * _BINS, 0, _BINS - 1).astype(int)
            for label in (0, 1):
                chosen = (counts > 0) & ((batch.column(1).to_numpy() > 0) == bool(label))
                sums[label] += np.bincount(bins[chosen], minlength=_BINS)
        used = np.flatnonzero(sums.sum(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(sums[1, used]), pa.array(sums[0, used])],
            names=["bin", "toxic", "ordinary"],
        )

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    most_labels: int = MOST_LABELS,
) -> Model:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, ``label``)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = training_rows(docs, labels, label, most_labels)
    sums = rows.groupBy("fold").agg(F.sum("label"), F.count("*")).collect()
    toxic, total = sum(r[1] or 0 for r in sums), sum(r[2] for r in sums)
    prior = float(toxic / total) if total else 0.0
    counted = (
        rows.where("fold > 0")
        .select("text", "label")
        .mapInArrow(_count, "code long, toxic long, ordinary long")
        .groupBy("code")
        .agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
        .toArrow()
    )
    order = np.argsort(counted["code"].to_numpy())
    model = build(
        counted["code"].to_numpy()[order],
        counted["toxic"].to_numpy()[order].astype(np.float64),
        counted["ordinary"].to_numpy()[order].astype(np.float64),
        prior,
    )
    if model.usable:
        shared = spark.sparkContext.broadcast(model)
        curve = (
            rows.where("fold = 0")
            .select("text", "label")
            .mapInArrow(_curve(shared), "bin long, toxic long, ordinary long")
            .groupBy("bin")
            .agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
            .toPandas()
        )
        if curve["toxic"].sum() and curve["ordinary"].sum():
            middle = ((curve["bin"].to_numpy() + 0.5) / _BINS * 2 - 1) * _RANGE
            model.slope, model.offset = _logistic(
                middle, curve["toxic"].to_numpy(float), curve["ordinary"].to_numpy(float)
            )
        else:
            model.slope, model.offset = 10.0, float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))
    return model


def scorer(model: Model, docs: DataFrame):
    """A function from a text column to a score column between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores([t or "" for t in texts.to_pylist()]))

    return lambda text: score(text.cast("string"))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    of: Column = scorer(fit(docs, labels), docs)(F.col("text"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), of.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
