"""Word shingles as 64-bit hashes, made in bulk from the bytes of many texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

WORDS = 5
_SEED = np.random.default_rng(11)
_BYTE = _SEED.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _SEED.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that are hashed at a time; what a worker keeps and needs besides is some sixty times as much.
_BLOCK = 1 << 18
_SPACE = re.compile(rb"[ \t-\r]")

_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; tables of more than two blocks are not kept."""
    global _powers
    if _powers is not None and len(_powers[0]) >= n:
        return _powers
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    made = np.cumprod(up), np.cumprod(down)
    if n <= 2 * _BLOCK:
        _powers = made
    return made


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of all words of ``data``, which starts and ends with a space."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])))
    return mix((total[ends] - total[starts]) * down[starts]), starts


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, for each text, the index of its first word (one more at the end).

    Words are runs of bytes other than space and U+0009 to U+000D, with A-Z in lower case. A long
    text is hashed in pieces cut at white space.
    """
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    if len(encoded) == 1 and len(encoded[0]) > _BLOCK:
        text, parts, start = encoded[0], [], 0
        while start < len(text):
            cut = _SPACE.search(text, start + _BLOCK)
            stop = cut.start() if cut else len(text)
            parts.append(_hashed(np.frombuffer(b" " + text[start:stop] + b" ", np.uint8))[0])
            start = stop
        hashes = np.concatenate(parts)
        return hashes, np.array([0, len(hashes)])
    hashes, starts = _hashed(np.frombuffer(b" ".join([b"", *encoded, b""]), np.uint8))
    begins = np.cumsum([1, *(len(e) + 1 for e in encoded)])
    return hashes, np.searchsorted(starts, begins)


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, as signed numbers.

    A text of fewer words than a shingle has its whole sequence as the one shingle.
    """
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (size < _BLOCK or stop == start):
            size += len(texts[stop])
            stop += 1
        words, first = word_hashes(texts[start:stop])
        n = len(words) - WORDS + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for j in range(WORDS):
            rolled += mix(words[j : j + max(n, 0)] * _PLACE[j])
        rolled = mix(rolled + np.uint64(WORDS))
        for k in range(stop - start):
            a, b = first[k], first[k + 1]
            if b - a >= WORDS:
                part = np.unique(rolled[a : b - WORDS + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for j in range(b - a):
                    whole = mix((whole + words[a + j : a + j + 1]) * _PLACE[j])[0]
                part = np.array([whole], np.uint64)
            else:
                part = np.zeros(0, np.uint64)
            yield part.view(np.int64)
        start = stop
