"""Search for many patterns of mixed lengths at once, on both strands: Aho-Corasick automata over overlapping tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import expand_degenerate, revcomp

#: Bases of a tile, letters of the words of an automaton, bytes of tiles that meet one automaton at a time beyond ``BROADCAST`` letters of words.
TILE, SHARD, PORTION, BROADCAST = 1 << 16, 1 << 18, 1 << 25, 1 << 20
#: Bases that one lane of the scan owns; all lanes of a batch advance together.
LANE = 512
_CODE = np.full(256, 4, np.int8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i


class Automaton:
    """Words over A, C, G and T.  States are made level by level; failure links are folded into complete transitions, a character that is no base leads to the root."""

    def __init__(self, words: list[str]):
        self.length = np.array([len(w) for w in words], np.int64)
        letters = [_CODE[np.frombuffer(w.encode(), np.uint8)] for w in words]
        if any((x > 3).any() for x in letters):
            raise ValueError("words of an automaton are made of A, C, G and T")
        at = np.zeros(len(words), np.int64)
        child = [np.full(4, -1, np.int64)]
        levels: list[np.ndarray] = [np.zeros(1, np.int64)]
        total = 1
        for d in range(int(self.length.max(initial=0))):
            live = np.flatnonzero(self.length > d)
            code = np.fromiter((letters[i][d] for i in live), np.int64, len(live))
            keys, back = np.unique(at[live] * 4 + code, return_inverse=True)
            table = np.concatenate(child) if len(child) > 1 else child[0]
            table[keys] = total + np.arange(len(keys))
            child = [table, np.full(4 * len(keys), -1, np.int64)]
            levels.append(total + np.arange(len(keys)))
            at[live] = total + back
            total += len(keys)
        self.next = np.zeros((total, 5), np.int32)
        self.next[:, :4] = np.concatenate(child).reshape(total, 4)
        #: the word that ends in a state, and the nearest state along the failure links in which one ends (0: none)
        self.own, self.link = np.full(total, -1, np.int64), np.zeros(total, np.int64)
        ends = np.flatnonzero(self.length > 0)
        self.own[at[ends]] = ends
        fail = np.zeros(total, np.int64)
        for level in levels:
            for c in range(4):
                to = self.next[level, c].astype(np.int64)
                through = self.next[fail[level], c].astype(np.int64) if level[0] else np.zeros(1, np.int64)
                new = to >= 0
                fail[to[new]] = through[new]
                self.next[level[~new], c] = through[~new]
            self.link[level] = np.where(self.own[fail[level]] >= 0, fail[level], self.link[fail[level]])
        self.link[0] = 0
        self.ends = (self.own >= 0) | (self.link > 0)

    def scan(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, ends (exclusive)) of all occurrences in ``codes``; lanes of ``LANE`` characters, each begun a longest word early, advance together."""
        before = int(self.length.max(initial=1)) - 1
        n = len(codes)
        lanes = -(-n // LANE)
        padded = np.full(before + lanes * LANE, 4, np.int8)
        padded[before : before + n] = codes
        steps = np.ascontiguousarray(sliding_window_view(padded, before + LANE)[::LANE].T) if n else np.zeros((0, 0), np.int8)
        flat, state = self.next.ravel(), np.zeros(lanes, np.int64)
        words, ends, start = [], [], np.arange(lanes) * LANE - before
        for t, code in enumerate(steps):
            state = flat[state * 5 + code].astype(np.int64)
            if t < before:
                continue
            lane = np.flatnonzero(self.ends[state])
            s = state[lane]
            while len(lane):
                w = self.own[s]
                found = w >= 0
                words.append(w[found])
                ends.append(start[lane[found]] + t + 1)
                s = self.link[s]
                on = s > 0
                lane, s = lane[on], s[on]
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(words), np.concatenate(ends)


def _hits(automaton: Automaton, owners: list[np.ndarray], ids: list[str], strands: list[str], tiles: pd.DataFrame) -> pd.DataFrame:
    """Hits that end in the part that a tile owns.  ``owners``: targets of each word."""
    columns = ["pattern_id", "seq_id", "start", "end", "strand"]
    if not len(tiles) or not len(automaton.length):
        return pd.DataFrame({"pattern_id": pd.Series(dtype=str), "seq_id": pd.Series(dtype=str), "start": pd.Series(dtype="int64"), "end": pd.Series(dtype="int64"), "strand": pd.Series(dtype=str)})
    parts = [x.encode("ascii", "replace") for x in tiles["bases"]]
    offset = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    words, ends = automaton.scan(_CODE[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)])
    row = np.searchsorted(offset, ends - 1, "right") - 1
    ends = ends - offset[row] + tiles["first"].to_numpy(np.int64)[row]
    own = ends > tiles["own"].to_numpy(np.int64)[row]
    words, ends, row = words[own], ends[own], row[own]
    times = np.fromiter((len(owners[w]) for w in words), np.int64, len(words))
    target = np.concatenate([owners[w] for w in words]) if len(words) else np.zeros(0, np.int64)
    ends, row, length = np.repeat(ends, times), np.repeat(row, times), np.repeat(automaton.length[words], times)
    names = tiles["seq_id"].to_numpy(object)
    return pd.DataFrame({"pattern_id": [ids[i] for i in target], "seq_id": names[row], "start": ends - length, "end": ends, "strand": [strands[i] for i in target]}, columns=columns)


def _loaded(targets: pd.DataFrame) -> tuple[Automaton, list[np.ndarray], list[str], list[str]]:
    words, back = np.unique(targets["word"].to_numpy(str), return_inverse=True)
    owners = [np.zeros(0, np.int64)] * len(words)
    order = np.argsort(back, kind="stable")
    for w, rows in zip(np.unique(back), np.split(order, np.flatnonzero(np.diff(back[order])) + 1) if len(order) else [], strict=True):
        owners[w] = rows
    return Automaton(list(words)), owners, list(targets["pattern_id"]), list(targets["strand"])


def sequence_tiles(seqs: DataFrame, before: int, tile: int = TILE) -> DataFrame:
    """(seq_id, first, own, bases): each tile with ``before`` bases ahead of the part from ``own`` on that is its own.  Null and empty sequences have none."""
    first = lambda t: F.greatest(t * tile - before, F.lit(0))
    cut = lambda t: F.struct(first(t).alias("first"), (t * tile).alias("own"), F.substring("seq", first(t).cast("int") + 1, (t * tile - first(t) + tile).cast("int")).alias("bases"))
    numbers = F.sequence(F.lit(0).cast("long"), F.floor((F.length("seq") - 1) / tile))
    return seqs.where(F.length("seq") > 0).select(F.col("seq_id").cast("string").alias("seq_id"), F.explode(F.transform(numbers, cut)).alias("t")).select("seq_id", "t.*")


def pattern_targets(patterns: DataFrame) -> DataFrame:
    """(word, pattern_id, strand): the plain words of each pattern (pattern_id, pattern; IUPAC codes, gaps left out) and their reverse complements.

    A word that is its own reverse complement stands for both strands.  Patterns that are null, empty or hold other letters stand for nothing.
    """
    clean = F.upper(F.replace("pattern", F.lit("-"), F.lit("")))
    good = patterns.select(F.col("pattern_id").cast("string").alias("pattern_id"), clean.alias("clean")).where(F.col("clean").rlike("^[ACGTRYSWKMBDHVN]+$"))
    words = good.select("pattern_id", F.explode(expand_degenerate(F.col("clean"))).alias("plain"))
    both = F.array(F.struct(F.col("plain").alias("word"), F.lit("+").alias("strand")), F.struct(revcomp(F.col("plain")).alias("word"), F.lit("-").alias("strand")))
    return words.select("pattern_id", F.explode(both).alias("t")).select("t.word", "pattern_id", "t.strand").distinct()


def search_patterns(seqs: DataFrame, patterns: DataFrame, tile: int = TILE, shard: int = SHARD, portion: int = PORTION, broadcast: int = BROADCAST) -> DataFrame:
    """(pattern_id, seq_id, start, end, strand): every occurrence, 0-based and end exclusive, of patterns (pattern_id, pattern) in seqs (seq_id, seq).

    Up to ``broadcast`` letters of words go to the tasks that read the tiles, so sequences are not shuffled.  Beyond that words are dealt into shards of about
    ``shard`` letters, tiles into portions of about ``portion`` bytes, and each shard meets each portion in one task.  Repeated ids of sequences or patterns give
    their hits each; letters are compared in either case, and a character that is no base matches nothing.
    """
    spark = seqs.sparkSession
    targets = pattern_targets(patterns)
    words = targets.select("word").distinct()
    sums = words.agg(F.sum(F.length("word")).alias("letters"), F.max(F.length("word")).alias("longest")).first()
    letters, longest = sums["letters"] or 0, sums["longest"] or 1
    tiles = sequence_tiles(seqs, longest - 1, tile)
    schema = "pattern_id string, seq_id string, start long, end long, strand string"
    if letters <= broadcast:
        rows = spark.sparkContext.broadcast(targets.toPandas())  # at most ``broadcast`` letters, once a pattern

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded = _loaded(rows.value)
            for batch in batches:
                yield from pa.Table.from_pandas(_hits(*loaded, batch.to_pandas()), schema=_ARROW, preserve_index=False).to_batches()

        return tiles.mapInArrow(run, schema)
    shards = -(-letters // shard)
    size = tiles.agg(F.sum(F.length("bases"))).first()[0] or 0
    portions = size // portion + 1
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    left = tiles.withColumn("portion", F.pmod(F.xxhash64("seq_id", "first"), F.lit(portions)).cast("int")).withColumn("shard", spread(shards))
    right = targets.withColumn("shard", F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int")).withColumn("portion", spread(portions))
    meet = lambda t, w: _hits(*_loaded(w), t) if len(t) and len(w) else _hits(Automaton([]), [], [], [], t[:0])
    return left.groupBy("shard", "portion").cogroup(right.groupBy("shard", "portion")).applyInPandas(meet, schema)


_ARROW = pa.schema([("pattern_id", pa.string()), ("seq_id", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strand", pa.string())])
