"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

``halves`` short keys of ``rows`` minhashes are made on each of two sides; a table key is a pair (left i, right j), so
``halves**2`` tables cost only ``2 * halves * rows`` minhashes.  A link of similarity s is a candidate unless no left or no
right key agrees: with 10 halves of 2 rows a link of 0.75 is missed with probability 0.0005, a higher one less often.

Steps: documents with equal sets become one class (copies are never paired); only halves that two classes share are
combined into table keys; in each bucket the members are held against the bucket's smallest member, components are
formed, and buckets that still hold several components compare the members outside the bucket's largest component with all of
other components.  So no pairs are made within what is already linked, and no pair that shares a bucket and could change a component is left out.
Buckets, hubs and components of any size are dealt in portions of about ``PORTION`` rows.

Before full sets are fetched a pair passes two exact bounds: sizes, and the parity bitmap (the parity of the number of
shingles in each of ``CELLS`` cells).  The bitmaps of two sets differ in at most as many cells as the sets differ in elements, so
a pair whose bitmaps differ more than a link allows is no link.  A pair is made only in the first table that it shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, counted, hot_rows, join_unique
from .hashing import PIECE_BYTES, Words, grams, mix, pieces, signed

WORDS, PERCENT, HALVES, ROWS, CELLS, PORTION = 5, 75, 10, 2, 1024, 1000


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(texts)
    g = grams(w.hash, k)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        else:
            out.append(grams(w.hash[a:b], b - a)[:1] ^ np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _class(s: np.ndarray) -> bytes:
    """128-bit digest of a set."""
    h = mix(s)
    return np.array([h.sum(dtype=np.uint64) ^ np.uint64(len(s)), mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)], np.uint64).tobytes()


def _signatures(k: int, halves: int, rows: int):
    n = 2 * halves * rows
    mult = np.random.default_rng(99).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, end, texts in pieces(batch, limit=PIECE_BYTES):
                sets = _sets(texts, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = np.zeros((len(sets), 2 * halves), np.uint64)
                if full:
                    flat = np.concatenate([sets[i] for i in full])
                    off = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])])[:-1]
                    for h in range(2 * halves):
                        key = np.full(len(full), h + 1, np.uint64)
                        for r in range(rows):
                            x = flat * mult[h * rows + r]
                            x ^= x >> np.uint64(31)
                            key = mix(key * np.uint64(31) + np.minimum.reduceat(x, off))
                        keys[full, h] = key
                bits = np.zeros((len(sets), CELLS // 64), np.int64)
                if full:
                    owner = np.repeat(np.arange(len(full)), [len(sets[i]) for i in full])
                    odd = np.bincount(owner * CELLS + ((flat >> np.uint64(17)) % np.uint64(CELLS)).astype(np.int64), minlength=len(full) * CELLS) & 1
                    bits[full] = np.packbits(odd.astype(np.uint8).reshape(len(full), CELLS), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, end - at), batch.column(1).slice(at, end - at), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) if len(s) else None for s in sets], pa.binary()),
                     pa.FixedSizeListArray.from_arrays(pa.array(signed(keys.ravel())), 2 * halves).cast(pa.list_(pa.int64())),
                     pa.FixedSizeListArray.from_arrays(pa.array(bits.ravel()), CELLS // 64).cast(pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "n_shingles", "c", "halves", "bits"],
                )

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in pieces(batch, limit=PIECE_BYTES):
                sets = [s for s in _sets(texts, k) if len(s)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([_class(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["c", "set"])

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text).

    Null, empty or word-less texts have no shingles, are linked with nothing and keep their own id.  Ties cannot arise: a
    component's id is its smallest doc_id.  Repeated rows share a class, so each returns the same ids (and is kept
    alike); a component with null ids only has a null id and is kept.  Texts of any length are read whole, one text's set being what a task must hold.
    Other columns of ``docs`` are ignored, whatever their names.  An empty table gives an empty result.  Sets hold 64-bit hashes of shingles, classes 128-bit digests of sets.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    base = scratch.cut(docs.mapInArrow(_signatures(words, halves, rows), "doc_id long, text_hash long, n_shingles long, c binary, halves array<bigint>, bits array<bigint>"), "base")

    first_of = F.min(F.struct("doc_id", "text_hash"))
    known = base.where("c IS NOT NULL")
    classes = known.groupBy("c").agg(F.min("doc_id").alias("rep"), first_of.alias("row"), F.count("*").alias("size"), F.first(F.struct(F.col("n_shingles").alias("n"), "halves", "bits")).alias("v"))
    classes = scratch.cut(classes.select("c", "rep", "row", "size", "v.*"), "classes")
    total = classes.count()

    # halves shared by two classes or more, then the tensor of the shared ones
    half = classes.select("c", "n", F.posexplode("halves").alias("i", "h"))
    shared = half.groupBy("h").count().where("count > 1").select("h", "count")
    mine = join_unique(half, shared, ["h"], F.col("count") >= hot_rows(total)).where("count IS NOT NULL")
    side = lambda own: F.collect_list(F.when(own, F.struct("i", "h")))
    mine = mine.groupBy("c", "n").agg(side(F.col("i") < halves).alias("us"), side(F.col("i") >= halves).alias("vs"))
    mine = mine.select("c", "n", F.explode("us").alias("u"), "vs").select("c", "n", "u", F.explode("vs").alias("v"))
    keyed = scratch.cut(mine.select(F.xxhash64("u.h", "v.h").alias("key"), F.col("u.i").alias("i"), F.col("v.i").alias("j"), "c", "n"), "keyed")
    buckets = keyed.groupBy("key").agg(F.min(F.struct("c", "n")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    members = scratch.cut(join_unique(keyed, buckets, ["key"], F.col("members") >= hot_rows(total)).where("members IS NOT NULL"), "members")
    scratch.drop("keyed")

    # full sets of the classes that share a bucket, from one row of each
    wanted = members.select("c").distinct().join(classes.select("c", "row"), "c").select(F.col("row.doc_id").alias("d"), F.col("row.text_hash").alias("h"))
    text = docs.join(wanted.hint("merge"), docs["doc_id"].eqNullSafe(F.col("d")) & (docs["text_hash"] == F.col("h")), "left_semi").select("text")
    sets = scratch.cut(text.mapInArrow(_full_sets(words), "c binary, set array<bigint>").groupBy("c").agg(F.first("set").alias("set")), "sets")

    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent

    def near(x: str, y: str, n: Column) -> Column:
        """The parity bound: bitmaps differ in no more cells than a link of sets of ``n`` elements together allows."""
        differ = reduce(lambda p, q: p + q, (F.bit_count(F.get(x, F.lit(w)).bitwiseXOR(F.get(y, F.lit(w)))) for w in range(CELLS // 64)))
        return differ * (100 + percent) <= n * (100 - percent)

    def portions(rows: DataFrame, key: str, unique: DataFrame, name: str, value: str, as_: str) -> DataFrame:
        """``rows`` with ``value`` of their ``key``; rows of a frequent key are dealt in portions, each with its own copy of the value."""
        many = counted(rows, key, unique.select(F.col("c").alias(key), F.col(value).alias(as_)), key, scratch, name)
        parts = F.floor(1 + F.col("_n") / PORTION)
        dealt = join_unique(rows, many.select(key, "_n"), [key], F.col("_n") >= hot_rows(rows.count()))
        dealt = dealt.withColumn("_p", F.pmod(F.xxhash64(*rows.columns), parts)).drop("_n")
        copies = many.select(key, as_, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_p"))
        return dealt.join(copies.hint("merge"), [key, "_p"]).drop("_p")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, linked) for the written pairs (a, na, b, nb), on the full sets of their classes."""
        held = scratch.cut(portions(pairs, "b", sets, f"{name}-b", "set", "set_b"), f"{name}-half")
        both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        held = portions(held, "a", sets, f"{name}-a", "set", "set_a").select("a", "b", (100 * both >= percent * (F.col("na") + F.col("nb") - both)).alias("linked"))
        held = scratch.cut(held, name)
        scratch.drop(f"{name}-a", f"{name}-b", f"{name}-half")
        return held

    star = members.where(F.col("c") != F.col("hub.c")).where(fits(F.col("n"), F.col("hub.n")))
    star = scratch.cut(star.select(F.col("hub.c").alias("a"), F.col("hub.n").alias("na"), F.col("c").alias("b"), F.col("n").alias("nb")).distinct(), "spokes")
    hubs = counted(star, "a", classes.select(F.col("c").alias("a"), F.col("bits").alias("x")), "a", scratch, "hubs")
    near_star = star.join(classes.select(F.col("c").alias("b"), F.col("bits").alias("y")), "b")
    near_star = join_unique(near_star, hubs, ["a"], F.col("_n") >= hot_rows(total)).where(near("x", "y", F.col("na") + F.col("nb")))
    first = confirmed(scratch.cut(near_star.select("a", "na", "b", "nb"), "star"), "first")
    links = first.where("linked").select("a", "b")
    labels = components(scratch, links, "a", "b")

    # buckets that still hold several components: members outside the largest one against those of other components, as far as not yet held
    now = members.join(labels.withColumnRenamed("node", "c"), "c", "left").select("key", "i", "j", "c", "n", F.coalesce("label", "c").alias("label"))
    now = scratch.cut(now, "now")
    size_of = now.groupBy("key", "label").agg(F.count("*").alias("m"))
    mixed = size_of.groupBy("key").agg(F.max(F.struct("m", "label"))["label"].alias("main"), F.sum("m").alias("members"), F.count("*").alias("labels")).where("labels > 1")
    left = join_unique(now, mixed.select("key", "main", "members"), ["key"], F.col("members") >= hot_rows(total)).where("main IS NOT NULL")
    left = scratch.cut(left.join(classes.select("c", "halves", "bits"), "c"), "mixed")
    parts = F.floor(1 + F.col("members") / PORTION)
    x = left.where("label <> main").withColumn("p", F.pmod(F.xxhash64("c"), parts))
    x = x.select("key", "p", "i", "j", F.col("c").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("halves").alias("hx"), F.col("bits").alias("x"))
    y = left.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    y = y.select(F.col("key").alias("key_y"), F.col("p").alias("q"), F.col("c").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), (F.col("label") == F.col("main")).alias("other"), F.col("halves").alias("hy"), F.col("bits").alias("y"))

    def agreeing(lo: int) -> Column:
        """The first of a side's halves that the pair shares."""
        return F.coalesce(*(F.when(F.get("hx", F.lit(q)) == F.get("hy", F.lit(q)), F.lit(q)) for q in range(lo, lo + halves)))

    ok = (F.col("la") != F.col("lb")) & (F.col("other") | (F.col("a") < F.col("b"))) & fits(F.col("na"), F.col("nb"))
    # a pair of a large bucket mostly shares many tables: bitmaps are compared in the first one alone
    ok = ok & (agreeing(0) == F.col("i")) & (agreeing(halves) == F.col("j")) & near("x", "y", F.col("na") + F.col("nb"))
    pairs = x.join(y, (x["key"] == y["key_y"]) & (x["p"] == y["q"]) & ok).select("a", "na", "b", "nb")
    low = F.col("a") < F.col("b")
    pairs = pairs.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(low, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("b"), F.when(low, F.col("nb")).otherwise(F.col("na")).alias("nb"))
    second = confirmed(scratch.cut(pairs.join(first.select("a", "b"), ["a", "b"], "left_anti"), "pairs"), "second").where("linked")

    # the second links join components of the first: contracted to those, then both steps put together
    label_of = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}"))
    ends = second.select("a", "b").join(label_of("a"), "a", "left").join(label_of("b"), "b", "left")
    joined = components(scratch, ends.select(F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y")), "x", "y")
    named = classes.select("c", "rep", "size").join(labels, F.col("c") == F.col("node"), "left").select("c", "rep", "size", F.coalesce("label", "c").alias("label"))
    named = scratch.cut(named, "labelled")
    reach = counted(named, "label", joined.withColumnRenamed("label", "final"), "node", scratch, "reach").withColumnRenamed("node", "label")
    named = scratch.cut(join_unique(named, reach, ["label"], F.col("_n") >= hot_rows(total)).select("c", "rep", "size", F.coalesce("final", "label").alias("label")), "final")
    ids = named.groupBy("label").agg(F.min("rep").alias("component"), F.count("*").alias("_n"))
    named = scratch.cut(join_unique(named, ids, ["label"], F.col("_n") >= hot_rows(total)).select("c", "component", "size"), "named")
    scratch.drop("members", "sets", "spokes", "hubs", "star", "now", "mixed", "pairs", "first", "second", "classes", "labelled", "reach", "final")
    out = join_unique(base.select("doc_id", "text_hash", "n_shingles", "c"), named, ["c"], F.col("size") >= hot_rows(total))
    own = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "text_hash")
