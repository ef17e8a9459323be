"""Trees as tables of (child, parent): paths by pointer doubling, deepest shared ancestors and leaf distances by a sparse table over the pre-order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .distance import SIDE, STRIP
from .lineage import cut, ranked


def tree_paths(edges: DataFrame) -> DataFrame:
    """(node, path, depth, length) of every node: path from the root to the node, both included, depth 0 and length 0.0 of a root, length the sum of the branches.

    ``edges`` (child, parent[, length]) has one row a child; a node that is a parent only, or whose parent is null, is a root, and several roots are a forest.  Every round joins each
    unfinished path with the path of the node above its top, so the rounds grow with the logarithm of the depth.  A child with two parents is an error, and so is a cycle, noticed
    as soon as a path meets its own node again.
    """
    length = F.col("length").cast("double") if "length" in edges.columns else F.lit(0.0)
    rows = edges.select(F.col("child").cast("string").alias("node"), F.col("parent").cast("string").alias("up"), length.alias("length")).where("node IS NOT NULL").distinct()
    tops = rows.where("up IS NOT NULL").select(F.col("up").alias("node")).distinct().join(rows.select("node"), "node", "left_anti")
    start = rows.unionByName(tops.select("node", F.lit(None).cast("string").alias("up"), F.lit(0.0).alias("length")))
    now = cut(start.select("node", "up", F.array("node").alias("path"), F.when(F.col("up").isNull(), 0.0).otherwise(F.coalesce("length", F.lit(0.0))).alias("length")))
    if again := now.groupBy("node").count().where("count > 1").select("node").limit(1).collect():
        raise ValueError(f"{again[0][0]} has more than one parent")
    now = now.withColumn("loop", F.lit(False))
    while True:
        left, loop = now.agg(F.count("up"), F.coalesce(F.bool_or("loop"), F.lit(False))).first()
        if loop:
            raise ValueError("the edges hold a cycle")
        if not left:
            return now.select("node", "path", (F.size("path") - 1).cast("long").alias("depth"), "length")
        above = now.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("length").alias("_length"))
        moved = now.where("up IS NOT NULL").join(above, "up")
        moved = moved.select("node", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"), (F.col("_length") + F.col("length")).alias("length"), F.array_contains("_path", F.col("node")).alias("loop"))
        now = cut(now.where("up IS NULL").unionByName(moved))


def preorder(paths: DataFrame) -> DataFrame:
    """``paths`` with ``at``, the node's place in the pre-order in which children are ordered by name."""
    return ranked(paths, [F.col("path")], "at")


def sparse_table(ordered: DataFrame) -> tuple[DataFrame, int]:
    """((level, at, low): the shallowest node among places at .. at + 2**level - 1 as a struct (depth, parent), the levels).

    Each level comes from two rows of the level before, by an equi-join.
    """
    parent = F.when(F.size("path") > 1, F.element_at("path", -2))
    level = cut(ordered.select("at", F.struct("depth", parent.alias("parent")).alias("low")))
    n = level.count()
    tables, j = [level.withColumn("level", F.lit(0))], 0
    while (2 << j) <= n:
        right = level.select((F.col("at") - (1 << j)).alias("at"), F.col("low").alias("_low"))
        level = cut(level.join(right, "at").select("at", F.least("low", "_low").alias("low")))
        j += 1
        tables.append(level.withColumn("level", F.lit(j)))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.select("level", "at", "low"), j


def shared_ancestors(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """(a, b, ancestor, dist) for pairs (a, b) of nodes: their deepest shared ancestor (null between trees of a forest) and the length of the way between them.

    Between two different nodes in pre-order the shallowest node after the first one, up to the second, is a child of their deepest shared ancestor.
    So a pair looks up two rows of the sparse table, whatever the depth.  A node's ancestor with itself is itself; pairs with unknown nodes are left out.
    """
    ordered = cut(preorder(paths))
    table, _ = sparse_table(ordered)
    end = lambda k: ordered.select(F.col("node").alias(k), F.col("at").alias(f"{k}_at"), F.col("length").alias(f"{k}_length"), F.get("path", F.lit(0)).alias(f"{k}_root"))
    both = pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).join(end("a"), "a").join(end("b"), "b")
    first, last = F.least("a_at", "b_at") + 1, F.greatest("a_at", "b_at")
    size = last - first + 1
    # floor(log2(size)) without rounding
    level = F.when(size > 0, F.length(F.bin(size)) - 1).otherwise(F.lit(-1))
    both = both.withColumns({"_level": level, "_l": first, "_r": last - F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(level, F.lit(0))) + 1})
    left = table.select(F.col("level").alias("_level"), F.col("at").alias("_l"), F.col("low").alias("_x"))
    right = table.select(F.col("level").alias("_level"), F.col("at").alias("_r"), F.col("low").alias("_y"))
    met = both.join(left, ["_level", "_l"], "left").join(right, ["_level", "_r"], "left")
    above = F.when(F.col("a") == F.col("b"), F.col("a")).when(F.col("a_root") == F.col("b_root"), F.least("_x", "_y")["parent"])
    met = met.select("a", "b", "a_length", "b_length", above.alias("ancestor"))
    top = ordered.select(F.col("node").alias("ancestor"), F.col("length").alias("_top"))
    return met.join(top, "ancestor", "left").select("a", "b", "ancestor", (F.col("a_length") + F.col("b_length") - 2 * F.col("_top")).alias("dist"))


def _low(keys: np.ndarray, between: int, others: np.ndarray | None) -> np.ndarray:
    """Of each two leaves the smallest key from the first one up to the one before the second: of one block (``others`` is None), or of two blocks with ``between`` for those in between."""
    if others is not None:
        first = np.minimum.accumulate(keys[::-1])[::-1]
        before = np.append(between, np.minimum.accumulate(others)[:-1])
        return np.minimum(first[:, None], np.minimum(before, between))
    out = np.full((len(keys), len(keys)), -1, np.int64)
    for r in range(len(keys) - 1):
        out[r, r + 1 :] = np.minimum.accumulate(keys[r:-1])
    return out


def _leaf_pairs(left: pa.StructArray, right: pa.StructArray, between: dict | None, diagonal: bool, digits: int | None) -> Iterator[pa.RecordBatch]:
    depth = [b.field("depth").to_numpy() for b in (left, right)]
    n, m = len(left), len(right)
    most = np.iinfo(np.int64).max
    keys = [d << 32 | (np.arange(len(d)) + at) for d, at in zip(depth, (0, n), strict=True)]
    low = _low(keys[0], most if between is None else between["depth"] << 32 | (n + m), None if diagonal else keys[1])
    own = pa.array([between], left.type.field("low").type)
    table = pa.concat_arrays([left.field("low"), right.field("low"), own])
    names, length = pa.concat_arrays([left.field("node"), right.field("node")]), np.append(left.field("length").to_numpy(), right.field("length").to_numpy())
    top = table.field("top").to_numpy(zero_copy_only=False)
    rank = np.unique(np.array(names.to_pylist(), object), return_inverse=True)[1]
    for at in range(0, n, STRIP):
        i, j = np.nonzero(low[at : at + STRIP] >= 0)
        of = low[at : at + STRIP][i, j] & 0xFFFFFFFF
        x, y = i + at, j + (0 if diagonal else n)
        turned = rank[y] < rank[x]
        a, b = np.where(turned, y, x), np.where(turned, x, y)
        dist = length[a] + length[b] - 2 * top[of]
        dist = dist if digits is None else np.round(dist, digits)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), table.field("ancestor").take(pa.array(of)), pa.array(dist, mask=np.isnan(dist))], ["a", "b", "ancestor", "dist"])


def _met_blocks(batches: Iterator[pa.RecordBatch], digits: int | None) -> Iterator[pa.RecordBatch]:
    """Rows come in order of the pair of blocks, the first block's before the second's."""
    first, between = None, None
    for batch in batches:
        for r, (i, j, side) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("i", "j", "side")), strict=True)):
            head = batch.column("head")[r].values
            if side == 0:
                first, between = pa.concat_arrays([head]), batch.column("between")[r].as_py()
            else:
                yield from _leaf_pairs(first, pa.concat_arrays([head]), between, i == j, digits)


def leaf_distances(edges: DataFrame, digits: int | None = None) -> DataFrame:
    """(a, b, ancestor, dist) of all pairs of leaves with a before b by name, rounded if asked for.  Quadratic in the leaves by definition.

    Leaves are in pre-order, each with the ancestor that it shares with the next one; what two leaves share is the shallowest of those from the first to the second.  Two blocks
    of leaves meet in one task, which needs of the blocks in between one row, and writes the pairs where it finds them.
    """
    paths = cut(tree_paths(edges))
    inner = edges.where("parent IS NOT NULL").select(F.col("parent").cast("string").alias("node")).distinct()
    leaves = cut(ranked(paths.join(inner, "node", "left_anti"), [F.col("path")], "at"))
    blocks = -(-leaves.count() // SIDE)
    after = leaves.select((F.col("at") - 1).alias("at"), F.col("path").alias("_next"))
    common = F.size(F.filter(F.zip_with("path", "_next", lambda x, y: x == y), lambda same: same))
    met = leaves.join(after, "at", "left").withColumn("depth", F.coalesce(F.when(F.col("_next").isNotNull(), common), F.lit(0)).cast("long"))
    met = met.withColumn("ancestor", F.when(F.col("depth") > 0, F.get("path", (F.col("depth") - 1).cast("int"))))
    met = met.join(paths.select(F.col("node").alias("ancestor"), F.col("length").alias("top")), "ancestor", "left")
    met = met.select(F.floor(F.col("at") / SIDE).cast("int").alias("block"), "at", "node", "length", "depth", F.struct("depth", "ancestor", "top").alias("low"))
    heads = cut(met.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "node", "length", "depth", "low"))).alias("head"), F.min("low").alias("low")))
    sides = heads.select(F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(max(blocks, 1) - 1))).alias("j"), F.lit(0).alias("side"), "head")
    rights = heads.select(F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "head", "low")
    over = Window.partitionBy("i").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    between = rights.select("i", "j", F.min(F.when(F.col("j") > F.col("i"), F.col("low"))).over(over).alias("between"))
    rows = sides.join(between, ["i", "j"]).unionByName(rights.drop("low"), allowMissingColumns=True)
    dealt = rows.repartition(min(max(blocks * (blocks + 1) // 2, 1), 2000), "i", "j").sortWithinPartitions("i", "j", "side")
    return dealt.mapInArrow(lambda b: _met_blocks(b, digits), "a string, b string, ancestor string, dist double")
