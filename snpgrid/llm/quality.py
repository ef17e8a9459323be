"""Quality selection by importance resampling over hashed n-gram models.

Two generative models, bags of hashed word 1- and 2-grams with add-one smoothing, are counted in full: the target over every document labelled
good, the raw one over every document.  A document's log weight is the sum of the log-ratios of its n-grams, i.e. the ratio of the two models.  Adding
seeded Gumbel noise and keeping the ``k`` largest draws without replacement in proportion to the weights.  The models' buckets grow with the
square root of the corpus's words (``buckets_for``), so they grow with the input and a task can still hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .hashing import Words, grams, pieces

LEAST_BUCKETS, KEEP, SEED = 1 << 14, 0.5, "resample-1"


def buckets_for(words: int) -> int:
    """The power of two next above four times the square root of the corpus's words (counted by their separators), ``LEAST_BUCKETS`` at least."""
    return max(LEAST_BUCKETS, 1 << int(np.ceil(np.log2(4 * np.sqrt(max(words, 1))))))


def _buckets(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every 1- and 2-gram."""
    w = Words(texts)
    owner = w.doc_of_word()
    pair = grams(w.hash, 2)
    inside = owner[1:] == owner[:-1]
    one = (w.hash % np.uint64(buckets // 2)).astype(np.int64)
    two = (pair % np.uint64(buckets // 2)).astype(np.int64) + buckets // 2
    return np.concatenate([owner, owner[1:][inside]]), np.concatenate([one, two[inside]])


def _count(buckets: int):
    """Partial counts of a partition: one row a bucket that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            for at, _, texts in pieces(batch):
                owner, b = _buckets(texts, buckets)
                raw += np.bincount(b, minlength=buckets)
                target += np.bincount(b[good[at + owner]], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"])

    return run


def _weigh(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in pieces(batch):
                owner, b = _buckets(texts, len(ratio))
                n = np.bincount(owner, minlength=len(texts))
                weight = np.bincount(owner, weights=ratio[b], minlength=len(texts)).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), pa.array(n, pa.int64()), pa.array(weight)], ["doc_id", "th", "n_grams", "log_weight"])

    return run


def log_weights(docs: DataFrame, good_ids: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, th (hash of the text), n_grams, log_weight per row of ``docs`` (doc_id, text); ``good_ids`` (doc_id) names the target documents; ``buckets``: None to follow the corpus."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    good = good_ids.select(F.col("doc_id").cast("long").alias("g")).where("g IS NOT NULL").distinct()
    if buckets is None:
        buckets = buckets_for(docs.agg(F.sum(F.length("text") - F.length(F.translate("text", " \t\n\r", "")) + 1)).first()[0] or 0)
    # the target texts are counted apart, by a shuffle join at every size
    named = docs.join(good.hint("merge"), F.col("doc_id") == F.col("g"), "left_semi")
    counts = "bucket long, raw long, target long"
    target = named.select(F.lit(True).alias("good"), "text").mapInArrow(_count(buckets), counts).withColumn("raw", F.lit(0).cast("long"))
    raw = docs.select(F.lit(False).alias("good"), "text").mapInArrow(_count(buckets), counts)
    both = raw.unionByName(target).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    p, q = np.ones(buckets), np.ones(buckets)
    counted = both.toArrow()  # at most ``buckets`` rows, by the square root of the corpus
    at = counted["bucket"].to_numpy()
    p[at] += counted["target"].to_numpy()
    q[at] += counted["raw"].to_numpy()
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    return docs.select("doc_id", "th", "text").mapInArrow(_weigh(ratio), "doc_id long, th long, n_grams long, log_weight double")


def largest(scratch: Scratch, rows: DataFrame, key: str, tie: list[Column], k: int, name: str = "largest") -> DataFrame:
    """The k rows of largest ``key`` (ties: smallest ``tie``), exactly, without gathering them.

    The threshold is narrowed by histograms of 4096 cells (all that reaches the driver) until one cell holds it; only rows in that
    cell are ordered, and by then they are few or equal.
    """
    lo, hi = rows.agg(F.min(key), F.max(key)).first()
    if lo is None or k <= 0:
        return rows.limit(0)
    above, cells = 0, 4096
    while True:
        width = (hi - lo) / cells
        if width <= 0 or lo + width == lo:
            break
        cell = F.least(F.floor((F.col(key) - lo) / F.lit(width)), F.lit(cells - 1))
        found = {r[0]: r[1] for r in rows.where(F.col(key).between(lo, hi)).groupBy(cell.alias("cell")).count().collect()}
        at, total = cells - 1, above
        while at > 0 and total + found.get(at, 0) < k:
            total += found.get(at, 0)
            at -= 1
        inside = found.get(at, 0)
        new = rows.where(F.col(key).between(lo, hi) & (cell == at)).agg(F.min(key), F.max(key)).first()
        above, same = total, (lo, hi) == (new[0], new[1])
        if new[0] is None:
            return rows
        lo, hi = new
        if inside <= 2000 or same:
            break
    rest = k - above
    sure = rows.where(F.col(key) > hi)
    edge = rows.where(F.col(key).between(lo, hi)).orderBy(F.col(key).desc(), *tie).limit(rest)
    return sure.unionByName(edge)


def resample(docs: DataFrame, good_ids: DataFrame, keep: float = KEEP, seed: str = SEED, buckets: int | None = None) -> DataFrame:
    """The ``keep`` share of the rows of ``docs`` drawn by importance: doc_id, n_grams, log_weight, gumbel_key, kept (true).

    Null or word-less texts have weight 0 and draw like any other.  Equal keys are settled by doc_id, then text hash.
    Repeated rows draw alike and count each.  Labels of unknown ids do nothing; without labels all weights follow the raw
    model alone.  Texts of any length are weighed whole.  Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    rows = log_weights(docs, good_ids, buckets)
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("th").cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = scratch.cut(rows.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))), "weights")
    total = rows.count()
    k = int(keep * total + 0.5)
    drawn = largest(scratch, rows, "gumbel_key", [F.col("doc_id").asc_nulls_last(), F.col("th")], k)
    return drawn.select("doc_id", "n_grams", "log_weight", "gumbel_key", F.lit(True).alias("kept"))
