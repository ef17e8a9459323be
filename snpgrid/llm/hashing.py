"""Vectorised word hashing over Arrow batches (numpy, no per-word Python).

A chunk of texts is laid out as one byte buffer; word boundaries come from a 256-entry byte-class table and
word hashes from one prefix sum of a polynomial over the bytes (``sum T[b_j] * P**j`` modulo 2**64, shifted back
by the inverse power at the word's start), finished by a 64-bit mix.  Memory per chunk is a small multiple of
``CHUNK_BYTES``; one text longer than that is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: For steps that hold many arrays beside a piece: their memory, and what a worker keeps of it afterwards, is a quarter of that of whole chunks.
PIECE_BYTES = 1 << 18

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_TABLE = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64)

#: Bytes that separate words under ``[^\x20\x09-\x0D]+``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that are no part of ``[0-9a-z]`` (after lower-casing A-Z) or of a character beyond ASCII.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[128:] = False
NOT_ALNUM[ord("0") : ord("9") + 1] = NOT_ALNUM[ord("a") : ord("z") + 1] = NOT_ALNUM[ord("A") : ord("Z") + 1] = False
#: A-Z to a-z, everything else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply) on a uint64 array; returns a new array."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p = np.full(n + 1, _P, np.uint64)
    q = np.full(n + 1, _P_INV, np.uint64)
    p[0] = q[0] = 1
    return np.cumprod(p), np.cumprod(q)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    for size in (CHUNK_BYTES // 2, 2 * CHUNK_BYTES):  # small pieces need small tables
        if n <= size:
            return _powers(size)
    return _powers.__wrapped__(n)


class Words:
    """Words of a chunk: byte ``start``/``end`` in ``buf``, ``hash`` and, per text, ``first`` (index of its first word; length texts + 1)."""

    __slots__ = ("buf", "start", "end", "hash", "first", "_total", "_down")

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACES, lower: bool = True):
        joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.buf = LOWER[joined] if lower else joined
        inside = (~separators[self.buf]).view(np.int8)
        edge = np.diff(inside, prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.first = np.searchsorted(self.start, np.concatenate([[0], np.cumsum(sizes)]))
        up, down = powers(len(self.buf))
        total = _TABLE[self.buf]
        total *= up[: len(self.buf)]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(total)])
        self._total, self._down = total, down
        self.hash = self._spans(self.start, self.end)

    def _spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self._total[end] - self._total[start]
        h *= self._down[start]
        return mix(h ^ (end - start).astype(np.uint64))

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, hashes) of the first n bytes of the words longer than that."""
        longer = np.flatnonzero(self.end - self.start > n)
        return longer, self._spans(self.start[longer], self.start[longer] + n)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


_ROLL = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (runs may cross texts: callers mask those)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _ROLL[0]
    for i in range(1, k):
        out += h[i : i + n] * _ROLL[i]
    return mix(out)


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, texts) of consecutive slices of about ``limit`` bytes at most, never splitting a text."""
    texts = batch.column(batch.schema.get_field_index(column))
    at, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if i > at and held + n > limit:
            yield at, i, binary(texts.slice(at, i - at))
            at, held = i, 0
        held += n + 1
    if at < len(texts):
        yield at, len(texts), binary(texts.slice(at))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
