"""Hashed word features in numpy, and a table that keeps the features' sums of words that come again."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BASE = 1_000_003


def bucket(codes: np.ndarray, kind: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (codes + np.uint64(kind * 0x51ED270B + 1)) * MULTIPLIER
        x ^= x >> np.uint64(29)
        return ((x * MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int64)


def by_width(words: Sequence[bytes], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, lengths, byte matrix) of words of like length; at most about `most` bytes a matrix."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = np.maximum(8, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        step = max(1, most // int(w))
        for i in range(0, len(at), step):
            rows = at[i : i + step]
            flat = b"".join(words[r].ljust(int(w), b"\0") for r in rows)
            yield rows, lengths[rows], np.frombuffer(flat, np.uint8).reshape(len(rows), int(w)).astype(np.uint64)


def word_codes(words: Sequence[bytes]) -> np.ndarray:
    """A 64-bit code of each whole word."""
    out = np.zeros(len(words), np.uint64)
    for rows, lengths, chars in by_width(words):
        code = lengths.astype(np.uint64)
        with np.errstate(over="ignore"):
            for j in range(chars.shape[1]):
                code = np.where(j < lengths, code * np.uint64(BASE) + chars[:, j] + np.uint64(1), code)
        out[rows] = code
    return out


def features(words: Sequence[bytes], bits: int, grams: Sequence[int] = (), affixes: Sequence[int] = (), whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and the word each belongs to: byte n-grams, affixes of so many bytes, the whole word."""
    found, owner = [], []
    if whole:
        found.append(bucket(word_codes(words), 0, bits))
        owner.append(np.arange(len(words)))
    for rows, lengths, chars in by_width(words):
        for n in grams:
            if chars.shape[1] < n:
                continue
            with np.errstate(over="ignore"):
                code = np.zeros((len(rows), chars.shape[1] - n + 1), np.uint64)
                for j in range(n):
                    code = code * np.uint64(257) + chars[:, j : chars.shape[1] - n + 1 + j]
            i, j = np.nonzero(np.arange(code.shape[1])[None, :] + n <= lengths[:, None])
            found.append(bucket(code[i, j], n, bits))
            owner.append(rows[i])
        for n in affixes:
            i = np.flatnonzero(lengths >= n)
            for kind, start in ((100 + n, np.zeros(len(i), np.int64)), (200 + n, lengths[i] - n)):
                code = np.zeros(len(i), np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(n):
                        code = code * np.uint64(257) + chars[i, start + j]
                found.append(bucket(code, kind, bits))
                owner.append(rows[i])
    return np.concatenate(found) if found else np.zeros(0, np.int64), np.concatenate(owner) if owner else np.zeros(0, np.int64)


class WordTable:
    """Row numbers of words and arrays of what `compute` makes of them; begun anew once over `most` words are held."""

    def __init__(self, compute: Callable[[list[bytes]], Sequence[np.ndarray]], most: int = 300_000):
        self.compute, self.most = compute, most
        self._begin()

    def _begin(self) -> None:
        self.ids: defaultdict = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.arrays: list[np.ndarray] | None = None

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self.ids) > self.most:
            self._begin()
        before = len(self.ids)
        at = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if len(self.ids) > before:
            new = self.compute(list(islice(self.ids, before, None)))
            if self.arrays is None:
                self.arrays = [np.array(x) for x in new]
            else:
                for i, x in enumerate(new):
                    held = self.arrays[i]
                    if len(held) < len(self.ids):
                        grown = np.zeros((max(2 * len(held), len(self.ids)), *held.shape[1:]), held.dtype)
                        grown[: len(held)] = held
                        held = self.arrays[i] = grown
                    held[before : len(self.ids)] = x
        return at


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of so many rows; an empty run sums to zero."""
    out = np.zeros((len(lengths), *values.shape[1:]))
    filled = lengths > 0
    if filled.any():
        starts = np.concatenate(([0], np.cumsum(lengths[filled])[:-1]))
        out[filled] = np.add.reduceat(values, starts, axis=0)
    return out
