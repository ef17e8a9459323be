"""Benchmark decontamination by a prefix-filtered set join (DataFrame operations only).

The windows of an item are sets of word shingles; for full containment the necessary prefix is one shingle, the window's
rarest, with frequencies counted over all documents.  Documents' shingles meet the prefixes in a hash join; the
prefix's place in its window fixes where the window would start (positional bound) and its length whether it fits (length bound);
what is left is compared word by word.  The benchmark is the stated query set: its windows are broadcast in
blocks of bounded size, and each block is held against all documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_rows, join_unique, lower_az, null_safe, words_of

WINDOW, SHINGLE, BLOCK = 10, 3, 100_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return words_of(lower_az(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS)


def _gram(words: str, at: str, k: int) -> Column:
    return F.xxhash64(F.lit(k), *(F.get(F.col(words), F.col(at) + i) for i in range(k)))


def item_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, win, len): the distinct windows of each item; an item of fewer words is one window, one without words none."""
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), _words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - window + 1))
    wins = items.select("item", "ws", F.explode(starts).alias("at")).select("item", F.slice("ws", F.col("at"), F.lit(window)).alias("wa"))
    return wins.select("item", F.array_join("wa", " ").alias("win"), F.size("wa").alias("len")).distinct()


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash (xxhash64 of the text).

    A document word is hit if it lies inside any occurrence of a window.  Null texts have no words; texts of any length are read whole.  Ties of the rarest shingle go to the leftmost.  Items are named by
    item_id as text (null: the empty string); items with equal ids count once.  Rows of ``docs`` with equal ids are told apart by
    their texts, repeated rows get equal results.  Empty tables: no hits, or no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text"))
    words = base.select("doc_id", "th", _words(F.col("text")).alias("ws"))

    owners = scratch.cut(item_windows(bench, window), "owners")
    block = F.pmod(F.xxhash64("win"), F.lit(1 + owners.count() // BLOCK))
    wins = owners.select("win", "len").distinct().withColumn("ws", F.split("win", " ")).withColumn("block", block)
    wins = scratch.cut(wins.withColumn("k", F.least("len", F.lit(SHINGLE))), "wins")
    blocks = [r[0] for r in wins.select("block").distinct().collect()]
    ks = {b: sorted(r[0] for r in wins.where(F.col("block") == b).select("k").distinct().collect()) for b in blocks}

    def grams(b: int, k: int) -> DataFrame:
        own = wins.where((F.col("block") == b) & (F.col("k") == k))
        own = own.select("win", "len", "ws", F.explode(F.sequence(F.lit(0), F.col("len") - k)).alias("off"))
        return own.select("win", "len", "off", _gram("ws", "off", k).alias("h"))

    places = words.where(F.size("ws") > 0).select("doc_id", "th", "ws", F.posexplode("ws").alias("p", "w"))
    counts = []
    for b in blocks:
        for k in ks[b]:
            seen = places.select(_gram("ws", "p", k).alias("h")).join(F.broadcast(grams(b, k).select("h").distinct()), "h")
            counts.append(seen.groupBy("h").agg(F.count("*").alias("freq")))
    hits = []
    if counts:
        freq = scratch.cut(reduce(DataFrame.union, counts), "freq")
        for b in blocks:
            for k in ks[b]:
                ranked = grams(b, k).join(freq, "h", "left").groupBy("win", "len").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)), "off", "h")).alias("m"))
                prefix = ranked.select("win", "len", F.col("m.off").alias("off"), F.col("m.h").alias("h"))
                found = places.withColumn("h", _gram("ws", "p", k)).join(F.broadcast(prefix), "h").withColumn("s", F.col("p") - F.col("off"))
                found = found.where((F.col("s") >= 0) & (F.col("s") + F.col("len") <= F.size("ws")))
                hits.append(found.where(F.array_join(F.slice("ws", F.col("s") + 1, F.col("len")), " ") == F.col("win")).select("doc_id", "th", "s", "len", "win"))
    if not hits:
        hits = [words.limit(0).select("doc_id", "th", F.lit(0).alias("s"), F.lit(0).alias("len"), F.lit("").alias("win"))]
    hits = scratch.cut(reduce(DataFrame.union, hits).distinct(), "hits")

    covered = hits.select("doc_id", "th", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("len") - 1)).alias("p")).distinct()
    covered = covered.groupBy("doc_id", "th").agg(F.count("*").alias("n_hit"))
    # windows that stand for the same items are one; a popular window is a hot key
    sets = owners.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("set", F.xxhash64("items"))
    sets = scratch.cut(sets.join(hits.groupBy("win").agg(F.count("*").alias("_n")), "win"), "sets")
    total = hits.count()
    named = join_unique(hits.select("doc_id", "th", "win"), sets.select("win", "set", "_n"), ["win"], F.col("_n") >= hot_rows(total)).select("doc_id", "th", "set").distinct()
    lists = sets.groupBy("set").agg(F.first("items").alias("items"), F.sum("_n").alias("_n"))
    named = join_unique(named, lists, ["set"], F.col("_n") >= hot_rows(total)).groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    both = covered.join(named.withColumnRenamed("doc_id", "d").withColumnRenamed("th", "t"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).drop("d", "t")
    both = scratch.cut(both.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "n_hit", "items"), "both")
    scratch.drop("hits", "freq", "wins", "owners", "sets")
    out = words.select("doc_id", "th", F.size("ws").cast("long").alias("n_words"))
    out = out.join(both.hint("merge"), null_safe(out, both, [("doc_id", "d"), ("th", "t")]), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.col("th").alias("text_hash"))
