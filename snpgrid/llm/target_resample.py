"""Importance resampling towards a target distribution, drawn by an exact distributed ranking.

Every run of one or two words is a feature, hashed by CRC-32 into ``buckets``.  Counts of all documents and of all target texts give each bucket a gain (an
array of bounded size); a document's weight is the mean gain of its features, and seeded Gumbel noise is added to it.

The scores are ranked by parallel sorting by regular sampling: rows are dealt to ``p`` runs, each run is sorted where it lies, ``p`` regularly spaced rows of
each run are the sample, ``p - 1`` regularly spaced rows of the sorted sample are the splitters, each run's segments go to the tasks of their numbers, which
order what they got, and the sizes of the segments before give every row its exact rank.  Run and position in it are the last part of the order, so
there are no equal rows and no segment holds more than about twice its share, however many rows have one score and id.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .hashing import LOWER, NOT_ALNUM, pieces

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, "7"
#: Most runs (and segments) of the ranking: the driver holds the square of it, as sampled rows of five numbers.
MOST_RUNS = 256
#: Longest word, in bytes, whose checksum is appended by table; longer ones are computed one by one.
_TABLED = 24


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


@lru_cache(maxsize=1)
def _shift_tables() -> np.ndarray:
    """[n, byte, value]: what a register's byte becomes after n zero bytes: appending is linear."""
    t = _crc_table()
    out = np.zeros((_TABLED + 2, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, _TABLED + 2):
        out[n] = t[out[n - 1] & np.uint32(255)] ^ (out[n - 1] >> np.uint32(8))
    return out


def word_checksums(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned CRC-32 of each word, and of each word, a space and the next one (one fewer), all words at a time."""
    t, shift = _crc_table(), _shift_tables()
    space = t[np.uint32(0x20)]  # register of a space from zero
    alone = np.full(len(start), 0xFFFFFFFF, np.uint32)
    bare = np.full(len(start), space, np.uint32)  # a space and the word, from a register of zero: the linear part
    length = end - start
    active = np.arange(len(start))
    for j in range(int(length.max(initial=0))):
        active = active[length[active] > j]
        byte = buf[start[active] + j].astype(np.uint32)
        for crc in (alone, bare):
            c = crc[active]
            crc[active] = t[(c ^ byte) & np.uint32(255)] ^ (c >> np.uint32(8))
    if len(start) < 2:
        return ~alone, np.zeros(0, np.uint32)
    first, n = alone[:-1], length[1:] + 1
    pair = np.empty(len(first), np.uint32)
    short = n < len(shift)
    f, m = first[short], n[short]
    moved = shift[m, 0, f & np.uint32(255)] ^ shift[m, 1, (f >> np.uint32(8)) & np.uint32(255)] ^ shift[m, 2, (f >> np.uint32(16)) & np.uint32(255)] ^ shift[m, 3, f >> np.uint32(24)]
    pair[short] = moved ^ bare[1:][short]
    for i in np.flatnonzero(~short):  # a long word: byte by byte
        c = int(first[i])
        for byte in (0x20, *buf[start[i + 1] : end[i + 1]].tolist()):
            c = int(t[(c ^ byte) & 255]) ^ (c >> 8)
        pair[i] = c
    return ~alone, ~pair


def _features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text number of each feature, its bucket)."""
    buf = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    edge = np.diff((~NOT_ALNUM[buf]).view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    words = np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)])))
    owner = np.repeat(np.arange(len(texts)), words)
    one, two = word_checksums(buf, start, end)
    inside = owner[1:] == owner[:-1]
    return words, np.concatenate([owner, owner[1:][inside]]), np.concatenate([one, two[inside]]).astype(np.int64) % buckets


def _count(buckets: int):
    """One row a task: the counts of all buckets, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, texts in pieces(batch):
                counts += np.bincount(_features(texts, buckets)[2], minlength=buckets)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket, over all rows; ``buckets`` numbers reach the driver."""
    rows = texts.mapInArrow(_count(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the two smoothed models) of each bucket."""
    s, t = (raw + 1).astype(float), (target + 1).astype(float)
    top, low = t * float(raw.sum() + len(raw)), s * float(target.sum() + len(raw))
    return np.array([math.floor(1000 * math.log(x)) for x in top / low], np.int64)


def _noise(seed: str, doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gain: np.ndarray, seed: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, end, texts in pieces(batch):
                words, owner, bucket = _features(texts, len(gain))
                n = np.bincount(owner, minlength=len(texts))
                total = np.zeros(len(texts) + 1, np.int64)
                np.add.at(total, owner, gain[bucket])
                weight = total[:-1] // np.maximum(n, 1)
                noise = np.fromiter((_noise(seed, i) for i in ids[at:end]), np.int64, end - at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight), pa.array(weight + noise)],
                    ["doc_id", "th", "n_words", "n_features", "weight", "score"],
                )

    return run


Key = tuple[int, int, int, int, int]


def _key(row) -> Key:
    """The order: score down, then doc_id (null last), hash of the text, run, position in it."""
    return (-row["score"], (1 << 63) if row["doc_id"] is None else row["doc_id"], row["th"], row["run"], row["at"])


def _segments(splitters: list[Key]):
    """Adds the number of the segment that each row falls into; the rows of a run are in order, so each splitter is looked up once a batch and run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["score", "doc_id", "th", "run", "at"]).to_pylist() if batch.num_rows else []
            part, edges = np.zeros(len(rows), np.int64), [0, *(i for i in range(1, len(rows)) if rows[i]["run"] != rows[i - 1]["run"] or rows[i]["at"] < rows[i - 1]["at"]), len(rows)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                cuts = [bisect_left(rows, s, a, b, key=_key) for s in splitters]
                part[a:b] = np.searchsorted(np.array(cuts, np.int64), np.arange(a, b), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], [*batch.schema.names, "part"])

    return run


def ranked(scratch: Scratch, rows: DataFrame, runs: int | None = None) -> tuple[DataFrame, int]:
    """(``rows`` (doc_id, th, score, ...) with their exact ``rank`` from 1, in the order of ``_key``; how many there are)."""
    spark = rows.sparkSession
    p = min(MOST_RUNS, runs or int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("th")]
    low = F.lit((1 << 33) - 1)
    local = rows.repartitionById(p, F.pmod(F.xxhash64("th", "doc_id", F.monotonically_increasing_id()), F.lit(p)).cast("int")).sortWithinPartitions(*order)
    local = scratch.cut(local.withColumn("run", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(low)), "runs")
    sizes = {r["run"]: r["n"] for r in local.groupBy("run").agg(F.count("*").alias("n")).collect()}  # a number a run
    total = sum(sizes.values())
    step = F.lit(max(1, math.ceil(max(sizes.values(), default=0) / p)))
    sample = sorted(map(_key, local.where(F.col("at") % step == 0).select("score", "doc_id", "th", "run", "at").collect()))  # p rows a run at most
    splitters = [sample[len(sample) * i // p] for i in range(1, p)] if sample else []
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in local.schema)
    segments = local.mapInArrow(_segments(splitters), f"{schema}, part int")
    merged = segments.repartitionById(p, F.col("part")).sortWithinPartitions(*order, "run", "at").drop("run", "at")
    merged = scratch.cut(merged.withColumn("within", F.monotonically_increasing_id().bitwiseAND(low)), "segments")
    before, at = [], 0
    for r in merged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        before.append((r["part"], at))
        at += r["n"]
    offsets = spark.createDataFrame(before or [(0, 0)], "part int, before long")  # a row a segment
    scratch.drop("runs")
    return merged.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("within") + 1).drop("part", "within", "before"), total


def target_resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, runs: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_features, weight, score and rank (null where it isn't drawn); ``target`` (text) is the target distribution.

    Of the rows with ``least_words`` words or more the ``percent`` of highest score are drawn (rounded down), ranked from 1; ties go to the smaller doc_id, null last,
    then to the smaller hash of the text.  Null, empty or word-less texts have no features, weight 0 and are never drawn.  Repeated rows have one score
    and are ranked each; null ids draw as an empty id.  Texts of any length are read whole.  Other columns are ignored, whatever their names; an empty table gives an
    empty result, an empty target a model without counts.
    """
    scratch = Scratch(docs.sparkSession, "target")
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    gain = gains(bucket_counts(docs.select("text"), buckets), bucket_counts(target.select(text.alias("text")), buckets))
    scored = scratch.cut(docs.mapInArrow(_score(gain, seed), "doc_id long, th long, n_words long, n_features long, weight long, score long"), "scored")
    in_order, n = ranked(scratch, scored.where(F.col("n_words") >= least_words), runs)
    drawn = F.when(F.col("rank") <= n * percent // 100, F.col("rank"))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return in_order.withColumn("rank", drawn).select(*columns).unionByName(rest.select(*columns))
