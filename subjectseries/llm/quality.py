"""Operator 3: document quality by co-training on two views.

One view is the text: shares of signs, digits, capitals and repeated words, word lengths and the
like, and the shapes of its words, hashed. The other is the metadata of the document: its source, language and
length. Each view has a logistic classifier, fitted on labelled rows. In each round both score
all unlabelled rows; those that a view is surest of, a fixed share of all rows and of each class
as many as its share among the labels asks, join the rows that the other view learns from. Then
each view's score is calibrated on labelled rows kept aside, and a logistic combination of both
scores every document.

Both views' features are made once and written to a table that all later steps read. Labels are
learned from at most ``MOST_LABELS`` rows (those with the smallest hash of the id); unlabelled
rows have no bound and never reach the driver. Which rows are surest follows from counts per
margin, added up over tasks; rows of the last margin that is needed, however many, share what is
left of the weight. Newton steps add up gradients and curvatures of tasks. The pseudo-labels of a
round weigh at most a fixed share of the labelled rows, so they do not drown them in a large table.

Edge cases: null or empty texts, sources and languages are values like others; null labels are no
labels, an id with several takes the largest; without labels of both classes every score is the
share of good labels (0 if there are none); without unlabelled rows the labelled ones alone
teach; repeated rows are scored alike; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjectseries.llm.common import held_out, small_batches
from subjectseries.session import materialize

MOST_LABELS = 12_000
ROUNDS = 4
#: Rows that each view labels in a round, as a share of all unlabelled ones.
SHARE = 0.05
#: Weight of a view's pseudo-labels of a round at most, as a share of the labelled rows.
ADDED = 0.1
#: Margins from -40 to 40 are counted in steps of 1 / 64.
STEPS, EDGE = 64, 40
MARGINS = 2 * EDGE * STEPS + 1
#: A pseudo-label is surer than nine to one.
SURE = 9
#: Sums of tasks are added up in so many tasks before they reach the driver.
SUMMED = 8
FOLDS = 5
HASHED = 128
STATS = 12
TEXT = STATS + HASHED
SOURCES = 64
META = SOURCES + 16 + 3
_RUN = re.compile(r"\w+")
_SIGN = re.compile(r"[^\w\s]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


@lru_cache(maxsize=200_000)
def _bucket(word: str) -> int:
    """The bucket of a word's shape, in which a run of letters and digits is one sign."""
    return zlib.crc32(_RUN.sub("w", word).encode("utf-8", "surrogatepass")) % HASHED


def text_features(text: str) -> np.ndarray:
    """The text view: shares and moments, then the share of words in each hash bucket."""
    out = np.zeros(TEXT, np.float32)
    words = text.split()
    if not words:
        return out
    n, chars = len(words), len(text)
    distinct = len(set(words))
    lengths = [len(w) for w in words]
    lines = text.split("\n")
    signs = _SIGN.findall(text)
    common = max(Counter(signs).values(), default=0)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    letters = sum(map(str.isalpha, words))
    out[:STATS] = (
        1.0,
        len(signs) / chars,
        common / chars,
        len(_UPPER.findall(text)) / chars,
        distinct / n,
        repeats / n,
        letters / n,
        sum(lengths) / n / 10,
        max(lengths) / 50,
        len(set(lines)) / len(lines),
        np.log1p(n) / 10,
        text.count("|") / n,
    )
    seen = np.zeros(HASHED, np.float32)
    for word, times in Counter(words).items():
        seen[_bucket(word)] += times
    out[STATS:] = seen / max(1.0, seen.sum())
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """The metadata view: one place each for source and language by hash, and length."""
    out = np.zeros(META, np.float32)
    out[zlib.crc32(f"{source}".encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32(f"{lang}".encode()) % 16] = 1
    size = np.log1p(max(0, n_chars or 0)) / 10
    out[-3:] = (1, size, size * size)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _bend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of weighted rows at the weights ``w``."""
    p = _sigmoid(x @ w)
    return x.T @ (weight * (y - p)), (x * (weight * p * (1 - p))[:, None]).T @ x


def _step(gradient: np.ndarray, curve: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    """A bounded Newton step."""
    return np.clip(np.linalg.solve(curve + ridge * np.eye(len(w)), gradient - ridge * w), -10, 10)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic classifier by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        step = _step(*_bend(x, y, np.ones(len(y)), w), w, ridge)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Round(NamedTuple):
    """Who labels what in a round: per view its weights, and the weight that a row of each margin
    gets as a good and as a bad example (0 for rows that are not picked)."""

    weights: list[np.ndarray]
    good: list[np.ndarray]
    bad: list[np.ndarray]


def _margins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return ((np.clip(x @ w, -EDGE, EDGE) + EDGE) * STEPS).astype(np.int64)


def surest(counts: np.ndarray, wanted: float) -> np.ndarray:
    """The share taken of the rows of each margin, the surest margin being the first, so that
    ``wanted`` rows are taken in all; the rows of one margin share alike."""
    before = np.cumsum(counts) - counts
    return np.where(counts > 0, np.clip((wanted - before) / np.maximum(counts, 1), 0, 1), 0)


def picked(rounds: list[Round], views: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Which rows no round picked, and by view the weights as good and bad examples that the last
    round gives to rows that no earlier one picked."""
    still = np.ones(len(views[0]), bool)
    last: list[tuple[np.ndarray, np.ndarray]] = []
    for r in rounds:
        places = [_margins(x, w) for x, w in zip(views, r.weights)]
        last = [(g[at] * still, b[at] * still) for at, g, b in zip(places, r.good, r.bad)]
        for good, bad in last:
            still = still & (good + bad == 0)
    return still, last


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width).astype(np.float64)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x.astype(np.float32)], pa.binary())


def _added(frame: DataFrame, task_sum, size: int) -> np.ndarray:
    """The sum over all tasks of ``task_sum(batches)``, an array of ``size`` numbers."""

    def batch(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield batch(task_sum(batches))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for some in batches:
            total += some.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).sum(0)
        yield batch(total)

    schema = "sums array<double>"
    done = frame.mapInArrow(by_task, schema).repartition(SUMMED).mapInArrow(together, schema)
    return reduce(np.add, (np.array(r.sums) for r in done.toLocalIterator()), np.zeros(size))


def _counted(pool: DataFrame, rounds: list[Round], weights: list[np.ndarray]) -> np.ndarray:
    """Rows that no round picked, by view and margin."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((2, MARGINS))
        for batch in batches:
            views = [_matrix(batch.column(c), n) for c, n in (("text_view", TEXT), ("meta_view", META))]
            still, _ = picked(rounds, views)
            for k in (0, 1):
                total[k] += np.bincount(_margins(views[k][still], weights[k]), minlength=MARGINS)
        return total.ravel()

    return _added(pool, count, 2 * MARGINS).reshape(2, MARGINS)


def _examples(pool: DataFrame, rounds: list[Round]) -> DataFrame:
    """(learner, label, weight, x): what the last round teaches, in the features of who learns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = [_matrix(batch.column(c), n) for c, n in (("text_view", TEXT), ("meta_view", META))]
            _, last = picked(rounds, views)
            for teacher, weights in enumerate(last):
                learner = 1 - teacher
                for label, weight in zip((1.0, 0.0), weights):
                    at = np.flatnonzero(weight)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), learner, np.int32)),
                            pa.array(np.full(len(at), label)),
                            pa.array(weight[at]),
                            _packed(views[learner][at]),
                        ],
                        names=["learner", "label", "weight", "x"],
                    )

    return pool.mapInArrow(run, "learner int, label double, weight double, x binary")


def _taught(examples: DataFrame, known: list[np.ndarray], y: np.ndarray, start: list[np.ndarray]) -> list[np.ndarray]:
    """Both views' weights from the labelled rows and the examples, from ``start`` on."""
    widths = (TEXT, META)
    weights = [w.copy() for w in start]
    cuts = np.cumsum([n for d in widths for n in (d, d * d)])
    for _ in range(12):
        now = [w.copy() for w in weights]

        def bends(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            parts = [np.zeros(n) for d in widths for n in (d, d * d)]
            for batch in batches:
                learner = batch.column("learner").to_numpy()
                for k, d in enumerate(widths):
                    mine = batch.filter(pa.array(learner == k))
                    if mine.num_rows:
                        label, weight = mine.column("label").to_numpy(), mine.column("weight").to_numpy()
                        gradient, curve = _bend(_matrix(mine.column("x"), d), label, weight, now[k])
                        parts[2 * k] += gradient
                        parts[2 * k + 1] += curve.ravel()
            return np.concatenate(parts)

        parts = np.split(_added(examples, bends, int(cuts[-1])), cuts[:-1])
        size = 0.0
        for k, d in enumerate(widths):
            gradient, curve = _bend(known[k], y, np.ones(len(y)), now[k])
            step = _step(gradient + parts[2 * k], curve + parts[2 * k + 1].reshape(d, d), now[k], 1.0)
            weights[k] = np.round(now[k] + step, 9)
            size = max(size, np.abs(step).max())
        if size < 1e-3:
            break
    return weights


class CoTrained:
    """Both views' classifiers and their combination."""

    def __init__(self, prior: float):
        self.prior, self.usable, self.rounds = prior, False, []

    def fit(self, views: list[np.ndarray], y: np.ndarray, aside: np.ndarray, pool: DataFrame) -> None:
        """``aside`` marks labelled rows kept for the calibration; ``pool`` holds all unlabelled rows."""
        if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
            return
        known, given = [v[~aside] for v in views], y[~aside]
        self.weights = [np.round(logistic(v, given), 9) for v in known]
        rows, taught = 0, None
        sure = int((EDGE + np.log(SURE)) * STEPS) + 1
        for _ in range(ROUNDS):
            counts = _counted(pool, self.rounds, self.weights)
            rows = rows or counts[0].sum()
            wanted = SHARE * rows
            if not rows:
                break
            weight = min(1.0, ADDED * len(given) / wanted)
            good, bad = [], []
            for c in counts:
                best, worst = c.copy(), c.copy()
                best[:sure] = 0
                worst[MARGINS - sure :] = 0
                good.append(weight * surest(best[::-1], wanted * self.prior)[::-1])
                bad.append(weight * surest(worst, wanted * (1 - self.prior)))
            self.rounds.append(Round(self.weights, good, bad))
            new = materialize(_examples(pool, self.rounds), "quality-examples")
            taught = new if taught is None else taught.unionByName(new)
            self.weights = _taught(taught, known, given, self.weights)
        margins = np.stack([np.ones(aside.sum()), *(v[aside] @ w for v, w in zip(views, self.weights))], 1)
        self.curves = [logistic(margins[:, [0, k]], y[aside], 0.01) for k in (1, 2)]
        self.combined = logistic(self._logits(margins), y[aside], 0.01)
        self.usable = True

    def _logits(self, margins: np.ndarray) -> np.ndarray:
        calibrated = [margins[:, [0, k + 1]] @ c for k, c in enumerate(self.curves)]
        return np.stack([margins[:, 0], *calibrated], 1)

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined score and the calibrated scores of the text and the metadata view."""
        if not self.usable:
            flat = np.full(len(text), self.prior)
            return flat, flat, flat
        margins = np.stack([np.ones(len(text)), text @ self.weights[0], meta @ self.weights[1]], 1)
        logits = self._logits(margins)
        return _sigmoid(logits @ self.combined), _sigmoid(logits[:, 1]), _sigmoid(logits[:, 2])


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars"))))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([text_features(t or "").tobytes() for t, *_ in rows], pa.binary()),
                    pa.array([meta_features(*rest).tobytes() for _, *rest in rows], pa.binary()),
                ],
                names=["doc_id", "held_out", "text_view", "meta_view"],
            )


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, text_view, meta_view) of ``docs`` (doc_id, text, source, lang, n_chars)."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.col("n_chars").cast("long").alias("n_chars"),
    ).mapInArrow(_featurize, "doc_id long, held_out boolean, text_view binary, meta_view binary")


def fit(views: DataFrame, labels: DataFrame, label: str = "quality") -> CoTrained:
    """The classifiers from the stored ``features`` of documents and ``labels`` (doc_id, ``label``)."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELS)
    fold = (F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 4) % FOLDS).cast("int")
    # Bounded by its limit; a label counts once however often its row is repeated.
    rows = (
        views.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")
        .agg(F.first("label").alias("label"), F.min(F.struct("text_view", "meta_view")).alias("v"))
        .orderBy("doc_id")
        .select("label", fold.alias("fold"), "v.text_view", "v.meta_view")
        .toArrow()
        .combine_chunks()
    )
    y = rows.column("label").to_numpy().astype(float)
    learned = [_matrix(rows.column(c), n) for c, n in (("text_view", TEXT), ("meta_view", META))]
    pool = materialize(
        views.where(~F.col("held_out") & F.col("doc_id").isNotNull())
        .join(known.select("doc_id"), "doc_id", "left_anti")
        .select("text_view", "meta_view"),
        "quality-pool",
    )
    model = CoTrained(float(y.mean()) if len(y) else 0.0)
    model.fit(learned, y, rows.column("fold").to_numpy() == 0, pool)
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, text_score, meta_score."""
    views = materialize(features(docs), "quality-features")
    shared = docs.sparkSession.sparkContext.broadcast(fit(views, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                both, text, meta = shared.value.scores(
                    _matrix(batch.column("text_view"), TEXT), _matrix(batch.column("meta_view"), META)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("held_out"),
                        pa.array(both),
                        pa.array((both >= 0.5).astype(np.int32)),
                        pa.array(text),
                        pa.array(meta),
                    ],
                    names=["doc_id", "held_out", "score", "predicted", "text_score", "meta_score"],
                )

    return views.mapInArrow(
        run,
        "doc_id long, held_out boolean, score double, predicted int, text_score double, meta_score double",
    )
