"""Periodic runs in word sequences, by online dyadic square catching.

Words are appended from left to right.  For each level k a catcher stands on every completed block of b = 2**k words that starts at a multiple of b.  A
square of period q with 2b - 1 <= q <= 4b - 2 holds such a block in its first half, and the block returns q words later.  So each
window of b words that an appended word completes meets exactly the two catchers that stand between 2b - 1 and 4b - 2 words before it.  A catcher that
has met as many successive blocks at one distance as any long enough run holds reports a square: its first and last
words are then found by comparing words, and while new words continue the period the run stays open.  A square inside a known run whose period divides its own is
that run.  Windows are compared by hashes built level by level from two halves; every reported run is compared word by word.

Documents are appended to one stream, each ended by a word of its own that occurs nowhere else, so no square crosses documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix, pieces

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Words that one step appends: a bound of the arrays of a step, not of a text.
STEP = 1 << 16
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _same_to_left(w: np.ndarray, i: int, q: int, floor: int) -> int:
    """Smallest s >= floor so that w[s:i] equals w[s+q:i+q]."""
    step = 16
    while i > floor:
        lo = max(floor, i - step)
        unequal = np.flatnonzero(w[lo:i] != w[lo + q : i + q])
        if len(unequal):
            return lo + int(unequal[-1]) + 1
        i, step = lo, 2 * step
    return i


def _same_to_right(w: np.ndarray, e: int, q: int, n: int) -> int:
    """Largest e' <= n so that w[e:e'] equals w[e-q:e'-q]."""
    step = 16
    while e < n:
        hi = min(n, e + step)
        unequal = np.flatnonzero(w[e:hi] != w[e - q : hi - q])
        if len(unequal):
            return e + int(unequal[0])
        e, step = hi, 2 * step
    return e


class SquareCatcher:
    """Runs (start, end, period) of a word stream with ``end - start >= max(least, exponent * period)``; ``longest``: words of the longest document to come."""

    def __init__(self, longest: int, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT):
        if exponent < 2:
            raise ValueError("a run holds a square: exponent is 2 at least")
        self.least, self.exponent = least, exponent
        self.words = np.zeros(1024, np.int64)
        self.n = 0
        # a run of period q needs exponent * q words, and level k has periods from 2b - 1 on
        self.levels = 0
        while exponent * (2 * (1 << self.levels) - 1) <= max(longest, 0):
            self.levels += 1
        #: per level: hashes of the windows from start ``base`` on
        self.hashes = [np.zeros(0, np.uint64) for _ in range(self.levels)]
        self.base = [0] * self.levels
        self.open: list[list[int]] = []
        self.runs: list[tuple[int, int, int]] = []

    def append(self, ids: np.ndarray) -> None:
        for at in range(0, len(ids), STEP):
            self._append(ids[at : at + STEP])

    def _append(self, ids: np.ndarray) -> None:
        n = self.n + len(ids)
        if n > len(self.words):
            self.words = np.concatenate([self.words, np.zeros(max(n, 2 * len(self.words)) - len(self.words), np.int64)])
        self.words[self.n : n] = ids
        self.n = n
        still = []
        for run in self.open:  # the open runs go on as far as the new words continue them
            run[1] = _same_to_right(self.words, run[1], run[2], n)
            (still if run[1] == n else self.runs).append(run)
        known = list(still)
        for k in range(self.levels):
            b = 1 << k
            old = self.base[k] + len(self.hashes[k])  # the first window start that is new
            if k == 0:
                new = mix(self.words[old:n].astype(np.uint64) + _LEFT)
            else:
                lower, at = self.hashes[k - 1], old - self.base[k - 1]
                m = n - b + 1 - old
                h = b >> 1
                new = mix(lower[at : at + m] * _LEFT + lower[at + h : at + h + m] * _RIGHT) if m > 0 else np.zeros(0, np.uint64)
            self.hashes[k] = np.concatenate([self.hashes[k], new])
            if len(new):
                self._catch(k, b, old, known, still)
        # of each level only what later windows meet, or the next level's windows are made of, stays
        for k in range(self.levels):
            keep = self.n - 8 * self._chain(1 << k) * (1 << k) - 8 * (1 << k)
            if keep - self.base[k] > STEP:
                self.hashes[k] = self.hashes[k][keep - self.base[k] :].copy()
                self.base[k] = keep
        self.open = still

    def _chain(self, b: int) -> int:
        """Successive aligned blocks that the repeated part of any long enough run of this level holds at least."""
        return max(1, ((self.exponent - 1) * (2 * b - 1) - (b - 1)) // b)

    def _catch(self, k: int, b: int, new: int, known: list[list[int]], still: list[list[int]]) -> None:
        h, base, chain = self.hashes[k], self.base[k], self._chain(b)
        at = np.arange(new, base + len(h))
        for nearer in (0, 1):
            block = (at - (2 * b - 1)) // b * b - nearer * b
            first = block - (chain - 1) * b
            ok = first >= base
            w, c = at[ok], block[ok]
            met = h[w - base] == h[c - base]
            w, c = w[met], c[met]
            for i in range(1, chain):  # the catchers before, at the same distance
                met = h[w - i * b - base] == h[c - i * b - base]
                w, c = w[met], c[met]
            before = c - chain * b
            # only the first time: had the block before met as well, this square was reported then
            fresh = (before < base) | (h[np.maximum(w - chain * b - base, 0)] != h[np.maximum(before - base, 0)])
            w, c = w[fresh], c[fresh]
            q = w - c
            order = np.argsort(q, kind="stable")
            c, q = c[order] - (chain - 1) * b, q[order]
            end = c + chain * b + q
            for run in known:
                c, q, end = self._beside(run, c, q, end)
            while len(c):
                run = self._extend(int(c[0]), int(q[0]), int(end[0]))
                c, q, end = c[1:], q[1:], end[1:]
                if run:
                    known.append(run)
                    (still if run[1] == self.n else self.runs).append(run)
                    c, q, end = self._beside(run, c, q, end)

    @staticmethod
    def _beside(run: list[int], c: np.ndarray, q: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Squares that are not part of ``run``."""
        if not len(c):
            return c, q, end
        own = (c >= run[0]) & (end <= run[1]) & (q % run[2] == 0)
        return c[~own], q[~own], end[~own]

    def _extend(self, c: int, q: int, end: int) -> list[int] | None:
        """The stretch of period q around the square, by words; none where only hashes agreed."""
        if not np.array_equal(self.words[c : end - q], self.words[c + q : end]):
            return None
        s, e = _same_to_left(self.words, c, q, 0), _same_to_right(self.words, end, q, self.n)
        return [s, e, q]

    def finish(self) -> list[tuple[int, int, int]]:
        """All runs of the stream, by start, then period: of stretches with equal bounds the smallest period."""
        best: dict[tuple[int, int], int] = {}
        for s, e, q in [*self.runs, *self.open]:
            if e - s >= max(self.least, self.exponent * q):
                best[s, e] = min(q, best.get((s, e), q))
        return sorted(((s, e, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def word_runs(sequences: list[np.ndarray], least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Per sequence of word numbers (0 or more) its runs as (start, length, period)."""
    catcher = SquareCatcher(max(map(len, sequences), default=0), least, exponent)
    starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in sequences])]).astype(np.int64)
    held, size = [], 0
    for i, s in enumerate(sequences):
        held += [s, np.array([-1 - i], np.int64)]
        size += len(s) + 1
        if size >= STEP or i == len(sequences) - 1:
            catcher.append(np.concatenate(held))
            held, size = [], 0
    out: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    for s, e, q in catcher.finish():
        i = int(np.searchsorted(starts, s, "right")) - 1
        out[i].append((s - int(starts[i]), e - s, q))
    return out


class _Vocabulary(defaultdict):
    """Numbers of words in order of their first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


#: Bytes of a text that are split into words at a time.
_SLICE = 1 << 20


def _numbers(text: bytes, vocabulary: _Vocabulary) -> np.ndarray:
    out, at = [], 0
    while at < len(text):
        end = at + _SLICE
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        words = text[at:end].split()
        out.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def planted(ids: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The word sequence that is judged: in one of ten documents, by the checksum of the id, all words from one on repeat a few of them."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(ids)
    if h % 10 or not n:
        return ids
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([ids[:a], ids[a + np.arange(n - a) % p]])


SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, n_dropped long, collapsed_sha256 string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _run(plant: bool, least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, end, texts in pieces(batch):
                vocabulary = _Vocabulary()
                seqs = [_numbers(t, vocabulary) for t in texts]
                if plant:
                    seqs = [planted(s, i) for s, i in zip(seqs, ids[at:end], strict=True)]
                names, rows = list(vocabulary), word_runs(seqs, least, exponent)
                dropped, digests = [], []
                for s, found in zip(seqs, rows, strict=True):
                    if found:
                        edge = np.zeros(len(s) + 1, np.int64)
                        for start, length, q in found:
                            edge[start + q] += 1
                            edge[start + length] -= 1
                        gone = np.cumsum(edge)[:-1] > 0
                        kept = s[~gone]
                    else:
                        kept = s
                    dropped.append(len(s) - len(kept))
                    sha = hashlib.sha256()
                    for i in range(0, len(kept), STEP):
                        sha.update((b" " if i else b"") + b" ".join(map(names.__getitem__, kept[i : i + STEP].tolist())))
                    digests.append(sha.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), pa.array(map(len, seqs), pa.int64()), pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in rows], pa.list_(_RUN)), pa.array(dropped, pa.int64()), pa.array(digests)],
                    ["doc_id", "n_words", "runs", "n_dropped", "collapsed_sha256"],
                )

    return run


def periodic_runs(docs: DataFrame, plant: bool = False, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, runs (start, length, period; by start, then period), n_dropped and collapsed_sha256.

    A run is a stretch with smallest period q, ``max(least, exponent * q)`` words or more, that no neighbouring word extends.  A word is dropped where any
    run holds it after the run's first q words; ``collapsed_sha256`` is of the words kept, joined by one space.  ``plant`` rewrites one of ten documents first.
    Null, empty or word-less texts have no words, no runs and the digest of the empty text; whole texts of any length are read.  Runs that tie on start are ordered
    by period.  Repeated rows and null ids give a row each (a null id is planted as an empty number).  Other columns are ignored, whatever their names; an empty table
    gives an empty result.  Documents are independent, so nothing is shuffled.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_run(plant, least, exponent), SCHEMA)
