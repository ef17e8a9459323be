"""Exact duplicates through a log-structured merge index of text digests (DataFrame operations only).

The rows are dealt in memtables (slices by a hash of the digest's row).  Each memtable is flushed as a run: its distinct digests with the kept identifier and
their number, sorted by digest, and a filter, a bitmap of about ``FILTER_BITS`` bits a digest in pieces of 32,768 bits whose
number follows the run's counted digests.  ``FANOUT`` runs of a level are merged into one of the next; merging keeps one
identifier a digest.  A lookup asks the runs from the newest on, each through its filter first, so a run is joined only with digests that it may
hold.  Every hit is compared byte by byte with the text it hits; where a digest were shared by different texts, those are
grouped again by the text itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hot_rows, join_unique, lower_az

MEMTABLES, FANOUT, FILTER_BITS, PIECE = 5, 4, 10, 32_768


class Run:
    """A sorted table (digest, id, n) and its filter (piece, bitmap)."""

    def __init__(self, level: int, name: str, rows: DataFrame, filters: DataFrame, pieces: int):
        self.level, self.name, self.rows, self.filters, self.pieces = level, name, rows, filters, pieces

    @staticmethod
    def cell(digest: str, pieces: int) -> tuple[Column, Column]:
        """Piece and bit of a digest."""
        h = F.xxhash64(digest)
        return F.pmod(F.shiftrightunsigned(h, 15), F.lit(pieces)).alias("piece"), h.bitwiseAND(F.lit(PIECE - 1))

    def may_hold(self, probes: DataFrame) -> DataFrame:
        """The rows of ``probes`` (digest, …) that the filter lets through: all that the run holds, and few others."""
        piece, bit = self.cell("digest", self.pieces)
        # pieces are dealt evenly by the hash, so no piece is hot as long as digests are distinct
        met = probes.withColumn("piece", piece).withColumn("bit", bit).join(self.filters.hint("merge"), "piece")
        byte = F.conv(F.hex(F.expr("substring(bitmap, cast(bit div 8 AS int) + 1, 1)")), 16, 10).cast("int")
        return met.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 AS int))")) != 0).select(*probes.columns)


class DigestIndex:
    """Levels of runs; ``keep`` says whether merging retains the smallest or the largest identifier."""

    def __init__(self, spark: SparkSession, scratch: Scratch, keep: str = "min"):
        self.spark, self.scratch = spark, scratch
        self.best = {"min": F.min, "max": F.max}[keep]
        self.runs: list[Run] = []
        self.made = 0

    def _write(self, level: int, entries: DataFrame) -> Run:
        name = f"run{self.made}"
        self.made += 1
        sorted_run = entries.repartition("digest").sortWithinPartitions("digest")
        rows = self.scratch.cut(sorted_run, name)
        pieces = 1 + rows.count() * FILTER_BITS // PIECE
        piece, bit = Run.cell("digest", pieces)
        bits = rows.select(piece, bit.alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        return Run(level, name, rows, self.scratch.cut(bits, f"{name}-filter"), pieces)

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(self.best("id").alias("id"), F.sum("n").alias("n"))

    def flush(self, entries: DataFrame) -> None:
        """Adds a memtable of (digest, id) as a run; full levels are compacted."""
        self.runs.append(self._write(0, entries.groupBy("digest").agg(self.best("id").alias("id"), F.count("*").alias("n"))))
        while len(full := [r for r in self.runs if r.level == self.runs[-1].level]) >= FANOUT:
            union = reduce(DataFrame.unionByName, (r.rows for r in full))
            merged = self._write(full[0].level + 1, self._merged(union))
            self.runs = [r for r in self.runs if r not in full] + [merged]
            self.scratch.drop(*(x for r in full for x in (r.name, f"{r.name}-filter")))

    def lookup(self, probes: DataFrame) -> DataFrame:
        """(digest, id, n) over all runs for the distinct digests of ``probes`` (digest) that the index holds."""
        found = []
        for run in reversed(self.runs):
            found.append(run.may_hold(probes).join(run.rows.hint("merge"), "digest").select("digest", "id", "n"))
        if not found:
            return probes.select("digest", F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("n")).limit(0)
        return self._merged(reduce(DataFrame.unionByName, found))


def exact_duplicates(docs: DataFrame, keep: str = "min", digest_bytes: int = 32, memtables: int = MEMTABLES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty.  Of equal texts the row with the
    smallest (``keep="max"``: largest) doc_id stays.  Null ids lose to any other; where a group has only null ids keep_id is null
    and its rows are kept.  Repeated rows of the kept id are all marked kept (they are one row to any reader by id), so ties do not arise.
    Texts of any length are compared whole.  Other columns are ignored, whatever their names; an empty table gives an empty result.  ``digest_bytes`` shortens the
    index digest (for tests of the byte verification); results depend neither on it nor on ``memtables``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    text = lower_az(F.coalesce(F.col("text").cast("string"), F.lit("")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).withColumn("sha", F.unhex(F.sha2("t", 256)))
    base = base.withColumn("digest", F.substring("sha", 1, digest_bytes) if digest_bytes < 32 else F.col("sha"))

    index = DigestIndex(spark, scratch, keep)
    entries = scratch.cut(base.select("digest", F.col("doc_id").alias("id"), F.pmod(F.xxhash64("doc_id", "sha"), F.lit(memtables)).alias("memtable")), "entries")
    total, repeats = entries.count(), []
    for m in range(memtables):
        batch = entries.where(F.col("memtable") == m)
        twice = batch.groupBy("digest").agg((F.count("*") > 1).alias("twice"))
        # hits: digests that an earlier run holds, or that the memtable itself holds twice
        seen = index.lookup(twice.select("digest")).select("digest")
        repeats.append(scratch.cut(seen.unionByName(twice.where("twice").select("digest")), f"seen{m}"))
        index.flush(batch.select("digest", "id"))
    again = reduce(DataFrame.unionByName, repeats).distinct()
    repeated = scratch.cut(index.lookup(again).select("digest", F.col("id").alias("keep_id"), "n"), "repeated")
    scratch.drop("entries", *(f"seen{m}" for m in range(memtables)), *(x for r in index.runs for x in (r.name, f"{r.name}-filter")))

    # byte verification: the kept text meets its group in portions of about a thousand rows
    hits = join_unique(base, repeated, ["digest"], F.col("n") >= hot_rows(total))
    hits = scratch.cut(hits.withColumn("t", F.when(F.col("n").isNotNull(), F.col("t"))), "hits")
    group = hits.where("n IS NOT NULL")
    portions = F.floor(1 + F.col("n") / 1024)
    kept = group.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["digest"])
    kept = kept.select("digest", F.col("t").alias("kept_t"), F.explode(F.sequence(F.lit(0).cast("long"), portions - 1)).alias("portion"))
    group = group.withColumn("portion", F.pmod(F.xxhash64("doc_id"), portions))
    held = group.join(kept, ["digest", "portion"], "left").withColumn("same", F.coalesce(F.col("t") == F.col("kept_t"), F.lit(False)))
    held = scratch.cut(held.select("doc_id", "sha", "digest", "keep_id", "n", F.when(~F.col("same"), F.col("t")).alias("other")), "held")
    if held.where("other IS NOT NULL").limit(1).count():
        again = held.groupBy("digest", "other").agg(index.best("doc_id").alias("keep_id"), F.count("*").alias("n"))
        held = join_unique(held.drop("keep_id", "n"), again, ["digest", "other"], F.col("n") >= hot_rows(total))
    single = hits.where("n IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"), "sha")
    out = single.unionByName(held.select("doc_id", "keep_id", "n", "sha"))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
