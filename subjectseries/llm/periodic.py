"""Operator 12: runs of periodic words, found on a harmonic grid with a difference-cover LCE.

A run is a stretch of words with smallest period q and at least max(24, 3 q) words that no
neighbouring word extends. In a run of period p, the words that equal the word p places on form a
stretch of at least max(24, 3 p) - p places, so a grid of that step meets it. For every p the
grid's words are compared with those p places on; where they are equal, the common extension
to both sides gives the whole stretch. Of several periods of one stretch the smallest counts.

The common extension of two places needs no order of all suffixes: the places whose remainder is
in a difference cover are sampled, only their suffixes are sorted (by packed words first, then
by doubling over the sample), and a sparse table over the common prefixes of neighbours answers
any two in constant time. From two places, at most as many words as the cover's modulus are
compared before both are sampled. All steps are array operations over many texts at a time;
texts without an equal stretch of eight words on the grid are set aside before any sorting.

Edge cases: a null, empty or white text has no words, no runs and an empty collapsed text; a
text of any length is worked on whole, by itself; repeated rows are returned once each; null
ids are kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjectseries.llm.common import col, small_batches

LEAST_WORDS = 24
LEAST_POWER = 3
#: A perfect difference cover: every remainder is a difference of two members.
MODULUS = 31
COVER = (0, 1, 3, 8, 12, 18)
#: Words that are worked on together; a longer text stands alone.
BLOCK_WORDS = 200_000
#: Equal words on one side of a grid place that every run has.
SIDE = 8
_PIECE = 1 << 20
_GRID = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")
SCHEMA = "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string"

_IN_COVER = np.isin(np.arange(MODULUS), COVER)
#: Steps after which places of two remainders are both sampled.
_STEPS = np.array(
    [
        [next(d for d in range(MODULUS) if _IN_COVER[(a + d) % MODULUS] and _IN_COVER[(b + d) % MODULUS]) for b in range(MODULUS)]
        for a in range(MODULUS)
    ],
    np.int64,
)


class Extension:
    """Common extensions of places of ``words``, whose last one occurs nowhere else."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.sample = np.flatnonzero(_IN_COVER[np.arange(len(words)) % MODULUS])
        self.number = np.full(len(words), -1, np.int64)
        self.number[self.sample] = np.arange(len(self.sample))
        levels = self._sort()
        self._common(levels)

    def _sort(self) -> list[tuple[int, np.ndarray]]:
        """Rank the sampled suffixes; returns the ranks by every known number of first words."""
        bits = max(1, int(self.words.max()).bit_length())
        each = max(1, 62 // bits)
        padded = np.concatenate((self.words, np.zeros(MODULUS + each, np.int64)))
        rank = np.zeros(len(self.sample), np.int64)
        open_ = np.arange(len(self.sample))
        for first in range(0, MODULUS, each):
            if not len(open_):
                break
            key = np.zeros(len(open_), np.int64)
            for k in range(first, min(first + each, MODULUS)):
                key = (key << bits) | padded[self.sample[open_] + k]
            open_ = self._refine(rank, open_, key)
        levels, known = [(MODULUS, rank.copy())], MODULUS
        while len(open_):
            key = rank[self.number[self.sample[open_] + known]]
            open_ = self._refine(rank, open_, key)
            known *= 2
            levels.append((known, rank.copy()))
        self.rank = rank
        return levels

    @staticmethod
    def _refine(rank: np.ndarray, open_: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Order the suffixes of equal rank by ``key``; returns those that are still equal."""
        order = np.lexsort((key, rank[open_]))
        some, key, old = open_[order], key[order], rank[open_[order]]
        place = np.arange(len(some))
        fresh = np.concatenate(([True], old[1:] != old[:-1]))
        split = fresh | np.concatenate(([True], key[1:] != key[:-1]))
        within = place - np.maximum.accumulate(np.where(fresh, place, 0))
        rank[some] = np.maximum.accumulate(np.where(split, old + within, 0))
        alone = split & np.append(split[1:], True)
        return some[~alone]

    def _common(self, levels: list[tuple[int, np.ndarray]]) -> None:
        """The sparse table over the common prefixes of neighbours in the order."""
        order = np.empty(len(self.sample), np.int64)
        order[self.rank] = self.sample
        left, right = order[:-1], order[1:]
        common = np.zeros(len(left), np.int64)
        for known, rank in reversed(levels):
            same = rank[self.number[left + common]] == rank[self.number[right + common]]
            common[same] += known
        common += self._direct(left + common, right + common, np.full(len(left), MODULUS))[0]
        table = [common.astype(np.int32)]
        step = 1
        while 2 * step <= len(common):
            table.append(np.minimum(table[-1][:-step], table[-1][step:]))
            step *= 2
        self.table = table

    def _direct(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words from two places, up to ``most`` of them, and which pairs got that far."""
        found = np.zeros(len(a), np.int64)
        going, reached = np.arange(len(a)), np.zeros(len(a), bool)
        k = 0
        while len(going):
            done = most[going] == k
            reached[going[done]] = True
            going = going[~done]
            going = going[self.words[a[going] + k] == self.words[b[going] + k]]
            k += 1
            found[going] = k
        return found, reached

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of equal words from the places ``a`` and ``b`` on; no pair is equal."""
        steps = _STEPS[a % MODULUS, b % MODULUS]
        found, reached = self._direct(a, b, steps)
        at = np.flatnonzero(reached)
        if len(at):
            x = self.rank[self.number[a[at] + steps[at]]]
            y = self.rank[self.number[b[at] + steps[at]]]
            low, high = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            common = np.empty(len(at), np.int64)
            for k in np.unique(level):
                own = level == k
                row = self.table[k]
                common[own] = np.minimum(row[low[own]], row[high[own] - (1 << k)])
            found[at] += common
        return found


def _grid(words: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places on the grid whose word occurs again one period on, with their periods."""
    places, periods, size = [], [], 0
    for p in range(1, longest // LEAST_POWER + 1):
        step = max(LEAST_WORDS, LEAST_POWER * p) - p
        same = np.flatnonzero(words[: len(words) - p : step] == words[p::step])
        if len(same):
            places.append(same * step)
            periods.append(np.full(len(same), p, np.int64))
            size += len(same)
            if size >= _GRID:
                yield np.concatenate(places), np.concatenate(periods)
                places, periods, size = [], [], 0
    if size:
        yield np.concatenate(places), np.concatenate(periods)


def _suspect(words: np.ndarray, place: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which grid places have SIDE equal words to the right, their own first, or to the left.

    A run's stretch is twice that long, so one of its sides is."""
    hopeful = np.zeros(len(place), bool)
    for sign, first in ((1, 1), (-1, 1)):
        going = np.arange(len(place))
        for k in range(first, first + (SIDE - 1 if sign > 0 else SIDE)):
            a = place[going] + sign * k
            b = a + period[going]
            inside = (a >= 0) & (b < len(words))
            going, a, b = going[inside], a[inside], b[inside]
            going = going[words[a] == words[b]]
        hopeful[going] = True
    return hopeful


def find_runs(texts: list[np.ndarray], names: int) -> list[np.ndarray]:
    """For each text of word numbers below ``names``: its runs, rows of (start, length, period)."""
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    words, starts = _joined(texts, names)
    longest = max((len(t) for t in texts), default=0)
    suspects: set[int] = set()
    for place, period in _grid(words, longest):
        hit = place[_suspect(words, place, period)]
        suspects.update(np.unique(np.searchsorted(starts, hit, "right") - 1).tolist())
    own = sorted(k for k in suspects if 0 <= k < len(texts))
    if not own:
        return out
    some = [texts[k] for k in own]
    words, starts = _joined(some, names)
    ahead, back, last = Extension(words), Extension(words[::-1].copy()), len(words) - 1
    found = []
    for place, period in _grid(words, max(map(len, some))):
        keep = _suspect(words, place, period)
        place, period = place[keep], period[keep]
        right = ahead(place, place + period)
        left = back(last - place + 1, last - place - period + 1)
        need = np.maximum(LEAST_WORDS, LEAST_POWER * period) - period
        good = left + right >= need
        found.append(np.stack((place - left, left + right + period, period), 1)[good])
    runs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    # Rows are in order, so the first of equal stretches has the smallest period.
    runs = runs[np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(1)))] if len(runs) else runs
    which = np.searchsorted(starts, runs[:, 0], "right") - 1
    for k, at in enumerate(own):
        mine = runs[which == k] - np.array([starts[k], 0, 0])
        out[at] = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
    return out


def _joined(texts: list[np.ndarray], names: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one array, before, between and after them a word that occurs only there."""
    parts, starts, at = [np.array([names])], [], 1
    for k, text in enumerate(texts):
        starts.append(at)
        parts += [text, np.array([names + k + 1])]
        at += len(text) + 1
    return np.concatenate(parts), np.array(starts, np.int64)


def _numbers(text: str | None, known: defaultdict) -> np.ndarray:
    """The words of a text as numbers."""
    data = (text or "").encode("utf-8", "surrogatepass")
    parts, start = [np.zeros(0, np.int64)], 0
    while start < len(data):
        cut = _SPACE.search(data, start + _PIECE)
        stop = cut.start() if cut else len(data)
        found = data[start:stop].split()
        parts.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
        start = stop
    return np.concatenate(parts)


def _collapsed(text: np.ndarray, runs: np.ndarray, names: list[bytes]) -> str:
    """The words that no run holds after its first period, joined by one space."""
    kept = np.ones(len(text), bool)
    for start, length, period in runs.tolist():
        kept[start + period : start + length] = False
    return b" ".join([names[k] for k in text[kept]]).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per document: its number of words, its runs by start and period, its collapsed text."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def rows(ids: list, texts: list[np.ndarray], known: defaultdict) -> pa.RecordBatch:
        names = list(known)
        runs = find_runs(texts, len(names))
        flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
        ends = np.cumsum([0, *map(len, runs)])
        lists = pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()),
            pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind.value_type)),
        )
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                lists,
                pa.array([_collapsed(t, r, names) for t, r in zip(texts, runs)], pa.string()),
            ],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, known = [], [], 0, defaultdict(count().__next__)
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                numbers = _numbers(value.as_py(), known)
                ids.append(key.as_py())
                texts.append(numbers)
                size += len(numbers) + 1
                if size >= BLOCK_WORDS:
                    yield rows(ids, texts, known)
                    ids, texts, size, known = [], [], 0, defaultdict(count().__next__)
        if ids:
            yield rows(ids, texts, known)

    return docs.select(
        col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text")
    ).mapInArrow(run, SCHEMA)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, in which one document of ten repeats some of its words to its end.

    With h the crc32 of the id, those with h % 10 = 0 and n words: from place a = (h / 10) % n on,
    the first 1 + (n - a) / (3 + (h / 10) % 8) words repeat (all divisions rounded down)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")

    def repeat(held: Column) -> Column:
        n = F.size(held).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.transform(
            held,
            lambda w, i: F.when(i < a, w).otherwise(F.get(held, (a + F.pmod(i - a, p)).cast("int"))),
        )

    # One array per text: bound to a variable, it is not split again for every word.
    changed = F.element_at(F.transform(F.array(words), lambda held: F.array_join(repeat(held), " ")), 1)
    hit = (F.pmod(h, F.lit(10)) == 0) & F.coalesce(text, F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    return F.when(hit, changed).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """The number of runs, the run of the greatest exponent, and checksums of runs and text."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate(
        "runs",
        none,
        lambda best, r: F.when(
            best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
        ).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
