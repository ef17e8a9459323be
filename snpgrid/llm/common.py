"""Shared pieces: shared-folder scratch tables, hot-key joins, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Share of the largest heap that a driver must have taken for its garbage to be collected after a written table, and seconds between two collections at least.
TAKEN, PAUSE = 0.4, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.  Where that is unset a local session gets a temporary one; a cluster must name it."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="snpgrid-"))
        root = sc.getCheckpointDir()
    return root


class Scratch:
    """Written tables that cut lineage.  They lie in the shared folder, so a lost executor loses nothing; ``drop`` removes one that no later step reads.

    A driver with a small heap collects its garbage between them: each stage, scan and broadcast join of a written query leaves buffers of some MB, and Spark
    frees broadcasts and shuffles, on executors too, only once the driver's JVM has collected what refers to them.
    """

    collected = 0.0  # when that was last, for all: they share the driver

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """The table, written and read again.  The shuffle files of the write go with its end: no later step reads them."""
        with self.passing():
            df.write.mode("overwrite").parquet(self.path(name))
        self.collect()
        return self.read(name, df)

    def collect(self) -> None:
        """Collects the driver's garbage if its heap is large for its limit; the JVM gives back what it has taken beyond its needs."""
        if time.monotonic() - Scratch.collected < PAUSE:
            return
        jvm = self.spark.sparkContext._jvm
        runtime = jvm.java.lang.Runtime.getRuntime()
        if runtime.totalMemory() >= TAKEN * runtime.maxMemory():
            gc.collect()  # frames that nothing uses any more hold their plans in the JVM
            jvm.java.lang.System.gc()
            Scratch.collected = time.monotonic()

    @contextmanager
    def passing(self) -> Iterator[None]:
        """The shuffle files of the writes within go with their end."""
        conf, held = self.spark.conf, self.spark.conf.get(CLEANUP)
        conf.set(CLEANUP, "true")
        try:
            yield
        finally:
            conf.set(CLEANUP, held)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(sc.hadoopConfiguration()).delete(p, True)


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z only; the built-in lower() is exact for that where the text is ASCII, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Equality of column pairs, null being a value like any other."""
    return reduce(lambda x, y: x & y, (left[a].eqNullSafe(right[b]) for a, b in pairs))


def hot_rows(total: int, least: int = 1000, parts: int = 2000) -> int:
    """Rows from which a key counts as hot: at most ``parts`` keys can reach it, so a table with one narrow row for each is small at every size."""
    return max(least, total // parts)


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """Left join (null-safe) with a side that has one narrow row a key; ``hot`` marks the right rows whose key may be frequent on the left.

    Hot rows are at most ``parts`` by the caller's threshold (``hot_rows``), so they are broadcast and their
    left rows never meet in one task; the rest is a shuffle join at every size, for which the left hot rows carry a spread-out key.
    """
    values = [c for c in right.columns if c not in keys]
    names = [f"_k{i}" for i in range(len(keys))]
    pairs = list(zip(keys, names, strict=True))
    r = right.select(*(F.col(k).alias(n) for k, n in pairs), F.struct(*values).alias("_v"), F.coalesce(hot, F.lit(False)).alias("_hot"))
    h = r.where("_hot").select(*names, F.col("_v").alias("_h"))
    out = left.join(F.broadcast(h), null_safe(left, h, pairs), "left").drop(*names)
    out = out.withColumn("_s", F.when(F.col("_h").isNull(), 0).otherwise(1 + F.abs(F.xxhash64(F.monotonically_increasing_id())) % 1_000_003).cast("long"))
    c = r.where("NOT _hot").drop("_hot").withColumn("_z", F.lit(0).cast("long"))
    joined = out.join(c.hint("merge"), null_safe(out, c, pairs) & (out["_s"] == c["_z"]), "left").drop(*names, "_z", "_s")
    v = F.coalesce("_h", "_v")
    return joined.select(*left.columns, *(v[c].alias(c) for c in values))


def join_still(left: DataFrame, right: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """As ``join_unique``, but left rows with a hot key are not moved at all: only the rows of rarer keys are shuffled.  Reads ``left`` twice."""
    names = [f"_k{i}" for i in range(len(keys))]
    pairs = list(zip(keys, names, strict=True))
    values = [c for c in right.columns if c not in keys]
    r = right.select(*(F.col(k).alias(n) for k, n in pairs), *values, F.coalesce(hot, F.lit(False)).alias("_hot"))
    h, c = r.where("_hot"), r.where("NOT _hot")
    mine = left.join(F.broadcast(h), null_safe(left, h, pairs)).select(*left.columns, *values)
    rest = left.join(F.broadcast(h.select(*names)), null_safe(left, h, pairs), "left_anti")
    return mine.unionByName(rest.join(c.hint("merge"), null_safe(rest, c, pairs), "left").select(*left.columns, *values))


def counted(rows: DataFrame, key: str, unique: DataFrame, unique_key: str, scratch: Scratch, name: str) -> DataFrame:
    """Rows of ``unique`` whose key occurs in ``rows``, with ``_n``, how often: a written table."""
    n = rows.groupBy(F.col(key).alias("_c")).agg(F.count("*").alias("_n"))
    return scratch.cut(unique.join(n, unique[unique_key] == n["_c"]).drop("_c"), name)


def words_of(text: Column, separators: str = r"[\x20\x09-\x0D]+") -> Column:
    """Words between separators, null as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def components(scratch: Scratch, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) of the nodes of ``edges``: label is the smallest node reachable.

    Minimum propagation with pointer jumping, so the rounds grow with the logarithm of a path's length; each round is a written table.  Nodes of many
    links and labels of many nodes are hot keys of ``join_unique``, so a hub's or a giant component's rows never meet in one task.
    """
    tag = f"cc-{uuid.uuid4().hex[:6]}"
    links = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    links = scratch.cut(links.union(links.select("y", "x")).distinct(), f"{tag}-links")
    degrees = links.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("label"), F.count("*").alias("degree"))
    labels = scratch.cut(degrees, f"{tag}-0")
    hot, n = hot_rows(links.count()), 0
    while True:
        far = join_unique(links, labels.select(F.col("node").alias("y"), "label", "degree"), ["y"], F.col("degree") >= hot)
        own = labels.select("node", "label", "degree", F.col("label").alias("was"))
        both = own.unionByName(far.select(F.col("x").alias("node"), "label", F.lit(0).cast("long").alias("degree"), F.lit(None).cast("binary").alias("was")))
        step = scratch.cut(both.groupBy("node").agg(F.min("label").alias("label"), F.max("degree").alias("degree"), F.max("was").alias("was")), f"{tag}-step{n}")
        members = step.groupBy(F.col("label").alias("l")).agg(F.count("*").alias("_n"))
        up = step.select(F.col("node").alias("t"), F.col("label").alias("u")).join(members, F.col("t") == F.col("l")).select(F.col("t").alias("label"), "u", "_n")
        new = join_unique(step, up, ["label"], F.col("_n") >= hot).select("node", F.coalesce("u", "label").alias("label"), "degree", "was")
        new = scratch.cut(new, f"{tag}-{n + 1}")
        done = new.where("label <> was").limit(1).count() == 0
        scratch.drop(f"{tag}-{n}", f"{tag}-step{n}")
        n, labels = n + 1, new.select("node", "label", "degree")
        if done:
            scratch.drop(f"{tag}-links")
            return labels.select("node", "label")
