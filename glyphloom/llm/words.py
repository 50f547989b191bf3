"""Words and word shingles of many texts at once, as 64-bit hashes, by array operations on the raw bytes.

A word is a run of bytes other than blank and tab to carriage return, with A-Z lower-cased. A word's hash is a
polynomial over its bytes modulo 2**64, taken from running sums and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32
_VALUE = mix((_LOWER.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
_STEP = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        with np.errstate(over="ignore"):
            _powers[base] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base, dtype=np.uint64))])
    return _powers[base][:n]


def word_runs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word of ``raw`` (bytes)."""
    word = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def word_hashes(raw: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from ``at`` to ``to``, with A-Z as a-z."""
    n = len(raw)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUE[raw] * _power(_BASE, n), out=sums[1:])
    own = (sums[to] - sums[at]) * _power(_INVERSE, n + 1)[at]
    return mix(own + (to - at).astype(np.uint64))


class Words:
    """The words of a list of texts: ``begin`` (first word of each text, and the end), ``hashes``, ``at``, ``to`` (bytes)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n = len(raw)
        word = ~_SPACE[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        self.raw, self.offsets = raw, offsets
        self.at = np.flatnonzero(word & ~(before & ~edge[:-1]))
        self.to = np.flatnonzero(word & ~(after & ~edge[1:])) + 1
        self.begin = np.searchsorted(self.at, offsets)
        self.hashes = word_hashes(raw, self.at, self.to)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def shingles(self) -> Iterator[np.ndarray]:
        """Of each text the hashes of its shingles in order; one for all words if there are fewer than five."""
        h = self.hashes
        if len(h) >= SHINGLE:
            runs = np.zeros(len(h) - SHINGLE + 1, dtype=np.uint64)
            for k in range(SHINGLE):
                runs += h[k : len(runs) + k] * _STEP[k]
            runs = mix(runs)
        for a, b in zip(self.begin[:-1].tolist(), self.begin[1:].tolist()):
            if b - a >= SHINGLE:
                yield runs[a : b - SHINGLE + 1]
            elif b > a:
                yield mix(np.array([(h[a:b] * _STEP[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)


def chunks(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """``texts`` (strings; null counts as empty) in runs of about ``CHUNK`` bytes: the first row, and the words.

    A longer text is a run by itself, so memory follows the longest text, not the number of rows.
    """
    if not len(texts):
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        yield row, Words(raw[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row])
        row = to


def of_text(text: str | None) -> Words:
    """The words of one text."""
    return next(chunks(pa.array([text], pa.string())))[1]
