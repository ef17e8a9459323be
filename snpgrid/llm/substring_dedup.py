"""Repeated passages by prefix-partitioned suffix trees.

Only suffixes that can repeat are made: a window's minimiser (smallest of its 8-word shingle hashes) occurs twice wherever the
window does, so windows whose minimiser is unique in the corpus are left out exactly.  The windows that share a minimiser are a group; each
occurrence ships the words of its windows once.  A group that fits ``MEMORY_ROWS`` occurrences is one subtree: its suffixes are put in order by
prefix doubling, neighbours' common-prefix lengths follow from the ranks, and the runs of neighbours that share ``window`` words or more
are its deep internal nodes, whose leaves are the occurrences of a repeat as long as the node is deep.  A group that does not fit gets a longer prefix,
the whole window: such a prefix is a deep node itself if it occurs twice and is settled by its count, so no group is ever gathered in one task.
Documents with the same word sequence are one class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_rows, join_unique
from .hashing import Words, grams, mix, pieces, signed

#: Words a window, words a seed, occurrences that a task may hold of one group, and that it puts in order at a time.
WINDOW, SEED_WORDS, MEMORY_ROWS, BATCH_ROWS = 35, 8, 20_000, 4096

def _argmin(g: np.ndarray, w: int) -> np.ndarray:
    """Leftmost place of the smallest value in each run of w values."""
    best, span = np.arange(len(g)), 1

    def merged(by: int) -> np.ndarray:
        a, b = best[: len(best) - by], best[by:]
        return np.where(g[b] < g[a], b, a)

    while span * 2 <= w:
        best = merged(span)
        span *= 2
    return merged(w - span) if w > span else best


def _digest(h: np.ndarray) -> bytes:
    """128-bit digest of a word sequence."""
    at = np.arange(1, len(h) + 1, dtype=np.uint64)
    x = mix(h + at * np.uint64(0x9E3779B97F4A7C15))
    two = np.array([x.sum(dtype=np.uint64) ^ np.uint64(len(h)), mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64)
    return two.tobytes()


class _Layout:
    """Windows of a chunk: ``least`` is each window's minimiser; ``range(d)`` the window starts of text d."""

    def __init__(self, texts: list[bytes], window: int, seed: int):
        self.words, self.window, self.seed = Words(texts, lower=False), window, seed
        g = grams(self.words.hash, seed)
        w = window - seed + 1
        self.least = _argmin(g, w) if len(g) >= w else np.zeros(0, np.int64)

    def range(self, d: int) -> tuple[int, int]:
        a, b = int(self.words.first[d]), int(self.words.first[d + 1])
        return a, max(a, b - self.window + 1)


def _scan(window: int, seed: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, end, texts in pieces(batch):
                lay = _Layout(texts, window, seed)
                w = lay.words
                g = signed(grams(w.hash, seed))
                c, hs, ps, kept = [], [], [], []
                for d, t in enumerate(texts):
                    a, b = lay.range(d)
                    p = lay.least[a:b]
                    p = p[np.flatnonzero(np.diff(p, prepend=-1))]
                    hs.append(g[p])
                    ps.append((p - a).astype(np.int32))
                    c.append(_digest(w.hash[a : int(w.first[d + 1])]))
                    flat = b" ".join(t.split())
                    kept.append(hashlib.sha256(flat).hexdigest() if digest else flat.decode())
                off = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in hs])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, end - at), batch.column(1).slice(at, end - at), pa.array(np.diff(w.first), pa.int64()), pa.array(c, pa.binary()), pa.array(kept, pa.string()),
                     pa.ListArray.from_arrays(off, pa.array(np.concatenate(hs))), pa.ListArray.from_arrays(off, pa.array(np.concatenate(ps)))],
                    ["doc_id", "th", "n_words", "c", "kept", "h", "p"],
                )

    return run


CONTEXT = "key long, c binary, s int, n int, deep boolean, words array<long>"


def _contexts(window: int, seed: int):
    """An occurrence of a seed a row: where its first window starts, how many windows, and their words (of deep ones: a row a window, with three labels)."""
    one, two = (window + 2) // 3, (window + 1) // 3
    parts = (0, one), (one, two), (one + two, window - one - two)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in pieces(batch):
                lay = _Layout(texts, window, seed)
                h = signed(lay.words.hash)
                labels = [signed(grams(lay.words.hash, n)) for _, n in parts]
                key, owner, start, count, deep, words = [], [], [], [], [], []
                for d in range(len(texts)):
                    a, b = lay.range(d)
                    places, seeds, deeps = (batch.column(x)[at + d].values.to_numpy(zero_copy_only=False) for x in ("ps", "hs", "ds"))
                    least = lay.least[a:b] - a
                    order = np.argsort(places, kind="stable")
                    for p, k, is_deep in zip(places[order].tolist(), seeds[order].tolist(), deeps[order].tolist(), strict=True):
                        low, high = np.searchsorted(least, p), np.searchsorted(least, p, side="right")
                        if is_deep:
                            for s in range(a + low, a + high):
                                key.append(k), owner.append(at + d), start.append(s - a), count.append(1), deep.append(True)
                                words.append(np.array([x[s + o] for x, (o, _) in zip(labels, parts, strict=True)]))
                        else:
                            key.append(k), owner.append(at + d), start.append(low), count.append(high - low), deep.append(False)
                            words.append(h[a + low : a + high + window - 1])
                if key:
                    off = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key, pa.int64()), batch.column("c").take(pa.array(owner)), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(deep), pa.ListArray.from_arrays(off, pa.array(np.concatenate(words)))],
                        [f.split()[0] for f in CONTEXT.split(", ")],
                    )

    return run


def _number(keys: np.ndarray) -> np.ndarray:
    """Ranks of values."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.append(0, ranked[1:] != ranked[:-1]))
    return out


def deep_nodes(group: np.ndarray, words: np.ndarray, begin: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leaves below the deep internal nodes of each group's suffix tree: (context, place in it, depth of the node).

    Contexts are slices of ``words`` from ``begin`` (length contexts + 1); the first ``n`` places of each start suffixes that end with the context.  A node is deep from
    ``window`` words on; its depth is the length that all its leaves share, so it is the length of a repeat that no longer one to the right shares among all of them.
    """
    size = np.diff(begin)
    context = np.repeat(np.arange(len(size)), size)
    left = begin[1:][context] - np.arange(len(words))  # words to the context's end
    rank = _number(words)
    rank = _number(group[context] * (len(words) + 1) + rank)
    ranks, span = [rank], 1
    while 2 * span <= window:
        after = np.where(left > span, np.append(ranks[-1], np.zeros(span, np.int64))[span:][: len(words)] + 1, 0)
        ranks.append(_number(ranks[-1] * (len(words) + 2) + after))
        span *= 2
    place = np.arange(len(words)) - begin[:-1][context]
    suffix = np.flatnonzero(place < n[context])
    # suffix order: by the first span words, then by those that end the window (they overlap)
    order = suffix[np.lexsort((ranks[-1][suffix + window - span], ranks[-1][suffix]))]
    # common-prefix lengths of neighbours, from the longest equal spans down
    x, y = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(x), np.int64)
    for level in [len(ranks) - 1, *range(len(ranks) - 1, -1, -1)]:
        step = 1 << level
        ok = (np.minimum(left[np.minimum(x, len(words) - 1)], left[np.minimum(y, len(words) - 1)]) >= step) & (x < begin[1:][context[order[:-1]]]) & (y < begin[1:][context[order[1:]]])
        same = np.zeros(len(x), bool)
        same[ok] = ranks[level][x[ok]] == ranks[level][y[ok]]
        common += same * step
        x, y = x + same * step, y + same * step
    deep = common >= window
    node = np.cumsum(np.append(0, ~deep))
    many = np.bincount(node, minlength=1)[node] > 1 if len(order) else np.zeros(0, bool)
    depth = np.full(int(node[-1]) + 1 if len(order) else 0, np.iinfo(np.int64).max)
    np.minimum.at(depth, node[1:][deep], common[deep])
    leaf = order[many]
    return context[leaf], place[leaf], depth[node[many]]


def _trees(window: int):
    """Rows come in order of their group; gives (c, from, to) of the repeats in each occurrence, merged where they overlap."""

    def repeats(rows: pa.Table) -> pa.RecordBatch:
        words = rows["words"].combine_chunks()
        begin = words.offsets.to_numpy().astype(np.int64)
        flat = words.values.to_numpy()[begin[0] : begin[-1]]
        context, place, depth = deep_nodes(_number(rows["key"].to_numpy()), flat, begin - begin[0], rows["n"].to_numpy().astype(np.int64), window)
        order = np.lexsort((place, context))
        context, place, end = context[order], place[order], (place + depth)[order]
        # places follow each other within a context, so an interval ends where the next start lies beyond all ends before
        width = int(begin.max()) + 1
        reach = np.maximum.accumulate(context * width + end) if len(context) else context
        new = np.append(True, context[1:] * width + place[1:] > reach[:-1]) if len(context) else np.zeros(0, bool)
        first, last = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True)) if len(new) else np.zeros(0, np.int64)
        start = rows["s"].to_numpy().astype(np.int64)[context[first]]
        return pa.RecordBatch.from_arrays([rows["c"].combine_chunks().take(pa.array(context[first])), pa.array((start + place[first]).astype(np.int32)), pa.array((start + reach[last] - context[first] * width).astype(np.int32))], ["c", "a", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH_ROWS:
                rows = pa.Table.from_batches(held)
                key = rows["key"].to_numpy()
                whole = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
                if whole:
                    yield repeats(rows.slice(0, whole).combine_chunks())
                    held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            yield repeats(pa.Table.from_batches(held))

    return run


def _rewrite(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, kept = [], []
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for i, t in enumerate(texts):
                w = (t or b"").split()
                cover = np.zeros(len(w) + 1, np.int32)
                np.add.at(cover, batch.column("from")[i].values.to_numpy(), 1)
                np.add.at(cover, batch.column("to")[i].values.to_numpy(), -1)
                drop = np.cumsum(cover)[:-1] > 0
                flat = b" ".join(x for x, d in zip(w, drop, strict=True) if not d)
                gone.append(int(drop.sum()))
                kept.append(hashlib.sha256(flat).hexdigest() if digest else flat.decode())
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["c", "gone", "rewritten"])

    return run


def drop_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, memory_rows: int = MEMORY_ROWS, digest: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept.

    ``kept`` is the text of the words that stay, joined by one space (``digest``: its lower-case SHA-256).  A word goes if a run of
    ``window`` words that covers it also starts anywhere else, in the same document or another; runs are judged on the
    input.  Null and short texts lose nothing; texts of any length are read whole.  Repeated rows count as copies of each other, also under one id or a null
    id.  Ties do not arise.  Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    base = scratch.cut(docs.mapInArrow(_scan(window, seed, digest), "doc_id long, th long, n_words long, c binary, kept string, h array<bigint>, p array<int>"), "base")
    classes = base.where(F.size("h") > 0).groupBy("c").agg(F.min(F.struct("doc_id", "th")).alias("row"), F.count("*").alias("size"), F.first(F.arrays_zip("h", "p")).alias("hp"))
    classes = scratch.cut(classes, "classes")
    total = classes.count()

    # minimisers that occur twice, and the classes and places that hold them
    anchors = classes.select("c", F.explode("hp").alias("a")).select("c", "a.h", "a.p")
    twice = anchors.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    held = join_unique(anchors, twice, ["h"], F.col("k") >= hot_rows(total)).where("k IS NOT NULL")
    lists = held.groupBy("c").agg(F.collect_list(F.struct("p", "h", (F.col("k") > memory_rows).alias("deep"))).alias("x"))
    lists = lists.select("c", F.col("x.p").alias("ps"), F.col("x.h").alias("hs"), F.col("x.deep").alias("ds"))
    row_of = lambda rows: rows.join(classes.select("c", F.col("row.doc_id").alias("d"), F.col("row.th").alias("t")), "c")

    def with_text(rows: DataFrame) -> DataFrame:
        """Rows (c, …) with the text of one document of the class."""
        rows = row_of(rows).hint("merge")
        columns = [x for x in rows.columns if x not in ("d", "t")]
        return docs.join(rows, docs["doc_id"].eqNullSafe(rows["d"]) & (docs["th"] == rows["t"])).select(*columns, "text").dropDuplicates(["c"])

    met = scratch.cut(with_text(lists).mapInArrow(_contexts(window, seed), CONTEXT), "contexts")
    group = met.where("NOT deep").repartition("key").sortWithinPartitions("key")
    repeats = group.mapInArrow(_trees(window), "c binary, a int, z int")
    # groups too large for a task: the prefix is the whole window, and its count settles it
    deep = met.where("deep").select("c", "s", F.col("words")[0].alias("b1"), F.col("words")[1].alias("b2"), F.col("words")[2].alias("b3"))
    nodes = deep.groupBy("b1", "b2", "b3").agg(F.count("*").alias("k")).where("k > 1")
    deep = join_unique(deep, nodes, ["b1", "b2", "b3"], F.col("k") >= hot_rows(total)).where("k IS NOT NULL").select("c", F.col("s").alias("a"), (F.col("s") + window).alias("z"))
    found = repeats.unionByName(deep).groupBy("c").agg(F.collect_list(F.struct("a", "z")).alias("x"))
    found = scratch.cut(found.select("c", F.col("x.a").alias("from"), F.col("x.z").alias("to")), "found")
    scratch.drop("contexts")

    new = scratch.cut(with_text(found).mapInArrow(_rewrite(digest), "c binary, gone long, rewritten string"), "new")
    scratch.drop("found")
    changes = classes.join(new, "c", "left").where("size > 1 OR gone IS NOT NULL").select("c", "size", "gone", "rewritten")
    nothing = F.lit(hashlib.sha256(b"").hexdigest() if digest else "")
    out = join_unique(base.select("doc_id", "n_words", "c", "kept"), changes, ["c"], F.col("size") >= hot_rows(total))
    whole = F.coalesce(F.col("size") > 1, F.lit(False))
    removed = F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long")
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.when(whole, nothing).otherwise(F.coalesce("rewritten", "kept")).alias("kept"))
