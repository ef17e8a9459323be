"""Set similarity join on word n-grams by a token-group matrix.

1. Documents with equal sets become one class, so copies are never compared.  A class links only if at most the share of its tokens that a link may lose occurs in no
   other class; tokens of a class alone are counted first in a fixed part of the token universe (enough to drop most classes), then, among those left, in all of it.
2. Classes with one smallest token are similar; each is held against the most typical of them, and components are formed.
3. Groups are components, or the classes of one smallest token that are in none, in portions of ``GROUP``.  The matrix holds each group's token union, one row per token and
   group, with the group's sizes and a bitmap of the union.
4. A query class orders its tokens by rarity.  A link of it shares at least one of its first tokens, as many as it may lose and one, so only groups that the matrix
   names for those are looked at; of these, groups of the query's own component, of no fitting size, or whose union lacks more of the query's tokens than a link loses (those
   in no other class, and of the others as many as the bitmaps show) are not opened.
5. Opened groups compare the query with members of other components, within the bounds of sizes and parity bitmaps, and on full sets.  So no pairs are made within what is
   linked already, and no link between different components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, counted, hot_rows, join_unique
from .hashing import pieces, signed
from .near_dedup import _class, _sets

WORDS, PERCENT, GROUP = 3, 90, 32
#: One in so many tokens belongs to the part of the universe in which single tokens are counted first.
UNIVERSE, CELLS, PORTION = 4, 1024, 1000


def _classes(k: int, universe: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in pieces(batch):
                sets = _sets(texts, k)
                part = [s[(s >> np.uint64(20)) % np.uint64(universe) == 0] for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in part])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) if len(s) else None for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(np.concatenate(part))))],
                    ["doc_id", "text_hash", "n_shingles", "c", "some"],
                )

    return run


def _odd(s: np.ndarray) -> np.ndarray:
    """Bitmap of the cells that hold an odd number of tokens."""
    n = np.bincount(((s >> np.uint64(7)) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
    return np.packbits((n & 1).astype(np.uint8))


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in pieces(batch):
                sets = [s for s in _sets(texts, k) if len(s)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
                odd = pa.array(np.concatenate(list(map(_odd, sets))).view(np.int64) if sets else np.zeros(0, np.int64))
                odd = pa.FixedSizeListArray.from_arrays(odd, CELLS // 64).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([_class(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), odd], ["c", "set", "odd"])

    return run


def _cells(f) -> Column:
    """Sum over the words of two bitmaps."""
    return reduce(lambda x, y: x + y, (F.bit_count(f(w)) for w in range(CELLS // 64)))


def single_tokens(rows: DataFrame, tokens: str) -> DataFrame:
    """(k, single): how many of a class's ``tokens`` occur in no other class, however many rows the class has.  Copies and frequent tokens combine before the shuffle."""
    each = rows.select("k", F.explode(tokens).alias("h"))
    return each.groupBy("h").agg(F.min("k").alias("k"), F.max("k").alias("other")).where("k = other").groupBy("k").agg(F.count("*").alias("single"))


def _portions(scratch: Scratch, rows: DataFrame, key: str, unique: DataFrame, name: str, value: str, as_: str, total: int) -> DataFrame:
    """``rows`` with ``value`` of the class in ``key``; rows of a frequent class are dealt in portions, each with its own copy of the value."""
    many = counted(rows, key, unique.select(F.col("c").alias(key), F.col(value).alias(as_)), key, scratch, name)
    parts = F.floor(1 + F.col("_n") / PORTION)
    dealt = join_unique(rows, many.select(key, "_n"), [key], F.col("_n") >= hot_rows(total))
    dealt = dealt.withColumn("_p", F.pmod(F.xxhash64(*rows.columns), parts)).drop("_n")
    copies = many.select(key, as_, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_p"))
    return dealt.join(copies.hint("merge"), [key, "_p"]).drop("_p")


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, n_links (links of the row's set to different sets that were needed to form its component) and text_hash.

    Two rows link when 100 times the size of the intersection of their sets is at least ``percent`` times that of the union; component_id is the smallest doc_id
    reachable by links.  Null, empty or word-less texts have an empty set, are linked with nothing and keep their own id.  Repeated rows share a class and
    return the same ids; a component of null ids only has a null id; ties cannot arise.  Texts of any length are read whole, one text's set being what a
    task must hold.  Other columns are ignored, whatever their names; an empty table gives an empty result.  Sets hold 64-bit hashes of shingles, classes 128-bit digests of sets.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    base = scratch.cut(docs.mapInArrow(_classes(words, UNIVERSE), "doc_id long, text_hash long, n_shingles long, c binary, some array<bigint>"), "base")
    known = base.where("c IS NOT NULL")
    classes = known.groupBy("c").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.count("*").alias("size"), F.max("n_shingles").alias("n"))
    classes = scratch.cut(classes.withColumn("k", F.xxhash64("c")), "classes")
    total = classes.count()
    loses = F.floor(F.col("n") * (100 - percent) / 100)  # tokens that a link may lose of n, rounded down

    # classes of which too many tokens occur nowhere else are linked with nothing
    alone = scratch.cut(single_tokens(known.withColumn("k", F.xxhash64("c")), "some"), "single")
    left = classes.join(alone, "k", "left").where(F.coalesce("single", F.lit(0)) <= loses)
    wanted = scratch.cut(left.select(F.col("row.doc_id").alias("d"), F.col("row.text_hash").alias("h")), "wanted")
    text = docs.join(wanted.hint("merge"), docs["doc_id"].eqNullSafe(F.col("d")) & (docs["text_hash"] == F.col("h")), "left_semi").select("text")
    full = text.mapInArrow(_full_sets(words), "c binary, set array<bigint>, odd array<bigint>")
    full = full.groupBy("c").agg(F.first(F.struct("set", "odd")).alias("v")).select("c", F.xxhash64("c").alias("k"), F.size("v.set").cast("long").alias("n"), "v.*")
    full = scratch.cut(full, "full")
    alone = scratch.cut(single_tokens(full, "set"), "single-2")
    sets = full.join(alone, "k", "left").withColumn("single", F.coalesce("single", F.lit(0).cast("long"))).where(F.col("single") <= loses)
    sets = scratch.cut(sets.withColumn("key", F.array_min("set")), "sets")
    scratch.drop("single", "single-2", "wanted", "full")

    # keys of similar classes: the smallest token of the set
    keys = sets.groupBy("key").agg(F.count("*").alias("m"))
    keyed = scratch.cut(join_unique(sets.select("c", "k", "n", "key"), keys, ["key"], F.col("m") >= hot_rows(total)), "keyed")

    # rarity of the tokens that several classes hold, with each of its classes
    each = sets.select("k", "n", F.explode("set").alias("h"))
    df = scratch.cut(each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "df")
    held = join_unique(each, df, ["h"], F.col("df") >= hot_rows(total)).where("df IS NOT NULL")
    held = scratch.cut(held, "held")
    # bitmaps of the tokens that several classes hold
    cell = F.pmod(F.shiftrightunsigned("h", 7), F.lit(CELLS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64).cast("int"))
    words_of_map = F.array(*(F.bit_or(F.when(F.floor(cell / 64) == w, bit).otherwise(F.lit(0).cast("long"))) for w in range(CELLS // 64)))
    maps = held.groupBy("k").agg(words_of_map.alias("any"))

    # each class against the most typical one of its key: the one whose tokens most classes hold
    typical = held.groupBy("k").agg(F.sum("df").alias("w"))
    several = keyed.where("m > 1")
    hubs = several.join(typical, "k", "left").groupBy("key").agg(F.max_by(F.struct("c", "n"), F.struct(F.coalesce("w", F.lit(0)) / F.col("n"), "c")).alias("hub"), F.count("*").alias("members"))
    star = join_unique(several.select("key", "c", "n"), hubs, ["key"], F.col("members") >= hot_rows(total)).where(F.col("c") != F.col("hub.c"))
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    star = star.where(fits(F.col("n"), F.col("hub.n"))).select(F.col("hub.c").alias("a"), F.col("hub.n").alias("na"), F.col("c").alias("b"), F.col("n").alias("nb"))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """(a, b) of the written pairs that link, on the full sets of their classes."""
        half = scratch.cut(_portions(scratch, pairs, "b", sets, f"{name}-b", "set", "set_b", total), f"{name}-half")
        both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        out = _portions(scratch, half, "a", sets, f"{name}-a", "set", "set_a", total).where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")
        out = scratch.cut(out, name)
        scratch.drop(f"{name}-a", f"{name}-b", f"{name}-half")
        return out

    first = confirmed(scratch.cut(star, "star"), "first")
    labels = components(scratch, first, "a", "b")
    # groups: a component of several classes, else the classes of one key, in portions of about ``group``
    linked = labels.groupBy("label").agg(F.count("*").alias("together"))
    mine = keyed.drop("m").join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    mine = scratch.cut(join_unique(mine, linked, ["label"], F.col("together") >= hot_rows(total)).withColumn("kind", F.when(F.col("together") > 1, F.xxhash64("label")).otherwise(F.col("key"))), "mine")
    kinds = mine.groupBy("kind").agg(F.count("*").alias("m"))
    mine = join_unique(mine, kinds, ["kind"], F.col("m") >= hot_rows(total))
    mine = mine.select("c", "k", "n", "label", F.xxhash64("kind", F.pmod(F.xxhash64("c"), F.ceil(F.col("m") / group))).alias("g"))
    nothing = F.array(*(F.lit(0).cast("long") for _ in range(CELLS // 64)))
    members = mine.join(sets.select("c", "odd", "single"), "c").join(maps, "k", "left").withColumn("any", F.coalesce("any", nothing))
    members = scratch.cut(members, "members")
    union = F.array(*(F.bit_or(F.get("any", F.lit(w))) for w in range(CELLS // 64)))
    groups = members.groupBy("g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("label").alias("l0"), F.max("label").alias("l1"), union.alias("union"))
    groups = scratch.cut(groups.select("g", "least", "most", F.when(F.col("l0") == F.col("l1"), F.col("l0")).alias("one"), "union"), "groups")

    # of each query the first tokens in order of rarity; the smaller set of a link is the query, so a share of 2 * percent / (100 + percent) of its tokens is common
    lost = lambda n: n - F.ceil(n * (2 * percent) / (100 + percent))
    own = held.groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("ranked"))
    # tokens of no other class come first of all and lead nowhere
    first_tokens = F.slice("ranked", F.lit(1), F.greatest(F.lit(0), lost(F.col("n")) + 1 - (F.col("n") - F.size("ranked"))).cast("int"))
    probes = scratch.cut(own.select("k", F.explode(F.transform(first_tokens, lambda t: t["h"])).alias("h")), "probes")

    # the matrix, as far as queries name its tokens
    asked_for = probes.groupBy("h").agg(F.count("*").alias("_n"))
    matrix = join_unique(held.select("h", "k"), asked_for, ["h"], F.col("_n") >= hot_rows(total)).where("_n IS NOT NULL").select("h", "k")
    matrix = scratch.cut(matrix.join(members.select("k", "g"), "k").select("h", "g").distinct(), "matrix")
    sizes = matrix.groupBy("h").agg(F.count("*").alias("gf"))
    # groups of a frequent token are dealt in portions, each of which meets a copy of the token's queries
    parts = F.floor(1 + F.col("gf") / PORTION)
    rows = join_unique(matrix, sizes, ["h"], F.col("gf") >= hot_rows(total)).withColumn("q", F.pmod(F.xxhash64("g"), parts)).select("h", "q", "g").join(groups, "g")
    asked = members.select("k", F.col("n").alias("na"), F.col("label").alias("la"), "single", F.col("any").alias("xa"))
    queries = join_unique(probes, sizes, ["h"], F.col("gf") >= hot_rows(total)).where("gf IS NOT NULL")
    queries = queries.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).select(F.col("h").alias("qh"), "p", "k").join(asked, "k")
    lacking = _cells(lambda w: F.get("xa", F.lit(w)).bitwiseAND(F.bitwise_not(F.get("union", F.lit(w)))))
    fitting = (F.col("most") >= F.col("na")) & (F.col("least") * percent <= F.col("na") * 100)
    qualifies = fitting & ~F.col("la").eqNullSafe(F.col("one")) & (lacking + F.col("single") <= lost(F.col("na")))
    seen = queries.join(rows, (F.col("qh") == F.col("h")) & (F.col("p") == F.col("q")) & qualifies).select("k", "g").distinct()
    seen = scratch.cut(seen, "seen")
    opened = seen.join(members.select("k", F.col("c").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("odd").alias("x")), "k").drop("k")
    inside = members.select(F.col("g").alias("gy"), F.col("c").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("odd").alias("y"))
    total_n = F.col("na") + F.col("nb")
    differ = _cells(lambda w: F.get("x", F.lit(w)).bitwiseXOR(F.get("y", F.lit(w))))
    near = differ * (100 + percent) <= total_n * (100 - percent)
    order = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = opened.join(inside, (F.col("g") == F.col("gy")) & (F.col("la") != F.col("lb")) & order & fits(F.col("na"), F.col("nb")) & near).select("a", "na", "b", "nb")
    second = confirmed(scratch.cut(pairs, "pairs"), "second")

    # the second links join components of the first
    label_of = lambda k: members.select(F.col("c").alias(k), F.col("label").alias(f"l{k}"))
    ends = second.join(label_of("a"), "a").join(label_of("b"), "b")
    joined = components(scratch, ends.select(F.col("la").alias("x"), F.col("lb").alias("y")), "x", "y")
    links = first.unionByName(second)
    links = links.select("a").union(links.select("b")).groupBy("a").agg(F.count("*").alias("n_links"))
    named = classes.select("c", "rep", "size").join(members.select("c", "label"), "c", "left").join(links.withColumnRenamed("a", "c"), "c", "left")
    named = scratch.cut(named.select("c", "rep", "size", F.coalesce("label", "c").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "labelled")
    reach = counted(named, "label", joined.withColumnRenamed("label", "final"), "node", scratch, "reach").withColumnRenamed("node", "label")
    named = scratch.cut(join_unique(named, reach, ["label"], F.col("_n") >= hot_rows(total)).select("c", "rep", "size", "n_links", F.coalesce("final", "label").alias("label")), "final")
    ids = named.groupBy("label").agg(F.min("rep").alias("component"), F.count("*").alias("_n"))
    named = scratch.cut(join_unique(named, ids, ["label"], F.col("_n") >= hot_rows(total)).select("c", "component", "size", "n_links"), "named")
    scratch.drop("sets", "keyed", "df", "held", "star", "first", "mine", "members", "groups", "matrix", "probes", "seen", "pairs", "second", "labelled", "reach", "final", "classes")
    out = join_unique(base.select("doc_id", "text_hash", "n_shingles", "c"), named, ["c"], F.col("size") >= hot_rows(total))
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_hash")
