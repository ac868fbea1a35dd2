"""Hashes of words and of runs of words, over whole arrays of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SEED = 20240607
# Odd multipliers, drawn once. A run's hash is a polynomial in its words' hashes,
# which are random 64-bit values: texts cannot be chosen to make them agree.
_RUN = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n at least."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[base] = tuple(both)
    return _POWERS[base][0][:n], _POWERS[base][1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of many texts: ``first[d]:first[d + 1]``
    are the words of text d, ``start`` and ``end`` their bytes in its own text."""

    def __init__(self, texts: list[bytes], seeds: int = 1):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        space = _SPACE[data]
        edge = np.diff(np.concatenate([[True], space]).view(np.int8))
        start = np.flatnonzero(edge == -1)
        end = np.flatnonzero(edge == 1)
        self.first = np.searchsorted(start, begin)
        self.n = len(start)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.position = np.arange(self.n) - np.repeat(self.first[:-1], np.diff(self.first))
        self.counts = np.diff(self.first)
        self.left = self.counts[self.doc] - self.position  # words from here to the end of the text
        offset = begin[self.doc]
        self.start, self.end = start - offset, end - offset
        self.hashes = self._hash(data[~space], end - start, seeds)
        self._sums = {}

    @staticmethod
    def _hash(letters: np.ndarray, lengths: np.ndarray, seeds: int) -> list[np.ndarray]:
        """xxh3-128 of each distinct word: its halves are the words' hashes."""
        places = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(places), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        both = b"".join([xxhash.xxh3_128_digest(w, _SEED) for w in coded.dictionary.to_pylist()])
        halves = np.frombuffer(both, "<u8").reshape(-1, 2)
        at = coded.indices.to_numpy(zero_copy_only=False)
        return [halves[at, k] for k in range(seeds)]

    def runs(self, at: np.ndarray, length, k: int = 0) -> np.ndarray:
        """Hash of the ``length`` words from each word ``at`` on."""
        power, back = _powers(_RUN[k], self.n + 1)
        if k not in self._sums:
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(self.hashes[k] * power[:self.n], out=sums[1:])
            self._sums[k] = sums
        sums = self._sums[k]
        return mix((sums[at + length] - sums[at]) * back[at])
