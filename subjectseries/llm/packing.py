"""Operator 8: best-fit packing of tokenized documents into fixed-length sequences.

Bounded-space online best-fit: every task keeps a fixed number of open sequences. A bitset
keyed by free space says which amounts of free space occur; a piece goes to the open sequence
with the least space that still holds it. When none does and all places are taken, the fullest
open sequence is closed to make room. Documents are packed where they are read, so nothing is
shuffled, and a task that is run again makes the same rows.

Edge cases: a null or empty text is a document of the end id alone; a document longer than a
sequence is cut into full pieces and a shorter last one; repeated rows are packed once each, so
their (doc_id, piece) repeats; null ids are kept; an empty table gives no rows; further columns
are ignored. The caches of the tokenizer are bounded and only save time;
a long text is split into words piece by piece.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjectseries.llm.common import col, small_batches

SEQUENCE = 2048
OPEN = 4096
END_ID = 0
ID_BYTES = 4
SCHEMA = (
    "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
)
#: Words and parts of words kept by the tokenizer's caches in each Python worker, twice as many at most.
CACHED_WORDS = 250_000
CACHED_PARTS = 150_000
#: Characters of a text that are split into words at a time.
TEXT_PIECE = 1 << 20

#: Python splits words at these, the tokenizer does not.
_NO_SPACE = "\x1c\x1d\x1e\x1f"
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
#: How the vocabulary file cuts lower-cased words; in _PLAIN words \w is letters, digits and "_".
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: its own if it prints."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: b if b in prints else next(others) for b in range(256)}


_LETTERS = _byte_letters()


class Recent(dict):
    """Values made on demand; of two generations of at most ``size`` the older is dropped."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 32:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordTokenizer:
    """Ids of the word tokenizer, which drops white space and so works word by word.

    Ids are little-endian unsigned 32-bit numbers. Words of plain Latin letters, digits and signs
    are cut as the vocabulary file says and their parts cached; any other word goes to the
    tokenizer as it is.
    """

    def __init__(self, path: str | None = None, words: int = CACHED_WORDS, parts: int = CACHED_PARTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.parts = Recent(self._word, words), Recent(self._part, parts)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word):
            return self._direct(word)
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(word.lower())))

    def _piece(self, text: str) -> bytes:
        if any(s in text for s in self.special) or any(c in text for c in _NO_SPACE):
            return self._direct(text)
        return b"".join(map(self.words.__getitem__, text.split()))

    def ids(self, text: str) -> bytes:
        if len(text) <= TEXT_PIECE:
            return self._piece(text)
        parts, start = [], 0
        while start < len(text):
            stop = text.find(" ", start + TEXT_PIECE)
            stop = len(text) if stop < 0 else stop
            parts.append(self._piece(text[start:stop]))
            start = stop
        return b"".join(parts)


_tokenizers: dict[tuple[str | None, int, int], WordTokenizer] = {}


def tokenizer(path: str | None, words: int = CACHED_WORDS, parts: int = CACHED_PARTS) -> WordTokenizer:
    """One tokenizer for each Python worker, so that its cache lives over tasks."""
    key = (path, words, parts)
    if key not in _tokenizers:
        _tokenizers[key] = WordTokenizer(*key)
    return _tokenizers[key]


class BestFit:
    """The open sequences of one task."""

    def __init__(self, size: int = SEQUENCE, places: int = OPEN):
        self.size, self.places = size, places
        self.free = 0  # bit n is set if an open sequence has n places left
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.open = self.made = 0

    def _take(self, left: int) -> int:
        which = self.by_free[left].pop()
        if not self.by_free[left]:
            self.free ^= 1 << left
        self.open -= 1
        return which

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset of a piece of 1 to ``size`` ids."""
        fits = self.free >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            which = self._take(left)
        else:
            if self.open >= self.places:
                self._take((self.free & -self.free).bit_length() - 1)
            which, left = self.made, self.size
            self.made += 1
        rest = left - length
        if rest:
            self.by_free[rest].append(which)
            self.free |= 1 << rest
            self.open += 1
        return which, self.size - left


def pack(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    path: str | None = None,
    size: int = SEQUENCE,
    places: int = OPEN,
    words: int = CACHED_WORDS,
    parts: int = CACHED_PARTS,
) -> DataFrame:
    """One row per piece; ``ids`` holds its token ids as little-endian unsigned 32-bit numbers.

    ``sequence_id`` is the task's number in the upper bits and a counter in the lower ones.
    ``path`` names a tokenizer file that works word by word (by default the public one);
    ``words`` and ``parts`` bound its caches, which trade memory for time and change no row.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, words, parts).ids
        end = END_ID.to_bytes(ID_BYTES, "little")
        bins, base = BestFit(size, places), TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[tuple] = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(value or "") + end
                for n, start in enumerate(range(0, len(ids) // ID_BYTES, size)):
                    part = ids[ID_BYTES * start : ID_BYTES * (start + size)]
                    length = len(part) // ID_BYTES
                    which, offset = bins.place(length)
                    out.append((key, n, start, length, part, base + which, offset))
                if len(out) >= 2000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return docs.select(
        col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text")
    ).mapInArrow(run, SCHEMA)


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW
    )


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "sequence_id",
        "offset",
    )
