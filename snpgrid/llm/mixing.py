"""Mixing sources to target weights (DataFrame operations only).

Tokens are aggregated per source; targets follow the weights, stop at ``cap`` times a source's size, and the excess is shared
again by weight until none is above.  A document is emitted floor(rate) times plus one more with the probability of the
rate's fraction, decided by a seeded hash of its id against a limit of its source and size.  The limits follow a systematic sample over the sizes of a
source, so that its words come within about a document of the target, and reruns agree.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, hot_rows, join_still, words_of

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, scratch: Scratch | None = None) -> DataFrame:
    """(source, source_size, n, target) from (source, size).  Sources take the weights in turn by code point, null last.

    Ranks and prefix sums are distributed: range partitions, then offsets of partitions, of which the driver holds a row each.
    """
    scratch = scratch or Scratch(sizes.sparkSession, "mix")
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = [F.col("source").isNull(), F.col("source")]
    ranked = by.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = ranked.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranked = scratch.cut(ranked, "ranked")
    # one row a partition, so their number is bounded by the shuffle partitions
    parts = {r["part"]: r["c"] for r in ranked.groupBy("part").agg(F.count("*").alias("c")).collect()}
    offsets, at = [], 0
    for part in sorted(parts):
        offsets.append((part, at))
        at += parts[part]
    spark = sizes.sparkSession
    ranked = ranked.join(F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "part int, offset long")), "part")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.col("at") + F.col("offset")) % len(weights) + 1).cast("int"))
    ranked = scratch.cut(ranked.select("source", "source_size", "n", weight.cast("long").alias("w")), "weighed")

    # sources in order of size over weight: the first ones stop at the cap, and prefix sums say from which one on the rest is shared by weight
    big = lambda c: c.cast("decimal(38,0)")
    ratio = [F.col("source_size").cast("double") / F.col("w"), F.col("source").isNull(), F.col("source")]
    ordered = ranked.repartitionByRange(*ratio).sortWithinPartitions(*ratio).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    ordered = scratch.cut(ordered, "ordered")
    sums = sorted(ordered.groupBy("part").agg(F.sum(big(F.col("source_size"))).alias("s"), F.sum("w").alias("w")).collect())  # a row a partition
    total, weighing = sum(int(r["s"]) for r in sums), sum(r["w"] for r in sums)
    before, held, lighter = [], 0, 0
    for r in sums:
        before.append((r["part"], Decimal(total - cap * held), weighing - lighter))
        held, lighter = held + int(r["s"]), lighter + r["w"]
    before = spark.createDataFrame(before or [(0, Decimal(0), 0)], "part int, rest decimal(38,0), weighs long")
    here = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    run = ordered.join(F.broadcast(before), "part")
    run = run.withColumn("rest", F.col("rest") - F.coalesce(F.sum(big(F.col("source_size") * cap)).over(here), none)).withColumn("weighs", F.col("weighs") - F.coalesce(F.sum("w").over(here), none))
    fits = F.col("w").cast("decimal(12,0)") * F.col("rest").cast("decimal(25,0)") <= F.col("source_size").cast("decimal(22,0)") * (F.col("weighs") * cap).cast("decimal(15,0)")
    first = run.where(fits).agg(F.min(F.struct("at", "rest", "weighs")).alias("v")).first()["v"]
    capped = (F.col("source_size") * cap).cast("double")
    if first is None:  # all stop at the cap, or there are none
        return ranked.select("source", "source_size", "n", capped.alias("target"))
    shared = (F.col("w") * F.lit(int(first["rest"]))).cast("double") / F.lit(float(first["weighs"]))
    return ordered.select("source", "source_size", "n", F.when(F.col("at") < first["at"], capped).otherwise(shared).alias("target"))


def _uniform(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def extra_copies(rows: DataFrame, seed: str, scratch: Scratch) -> DataFrame:
    """(source, size, n, limit) from (source, size, draw, part): rows of a source and size whose draw is at most ``limit`` get a copy more; ``part`` is the source's fractional rate.

    Sizes of a source are taken in order, and each of them is given as many copies as a seeded systematic sample of the rate takes there; its rows of smallest draws get them.  So every row has the
    chance ``part``, and a source's extra words miss their mean by about one document at most.
    """
    kinds = rows.groupBy("source", "size").agg(F.count("*").alias("n"), F.max("part").alias("part"))
    w = Window.partitionBy("source").orderBy("size")  # a row a distinct size
    upto = F.sum("n").over(w)
    offset = _uniform(F.concat(F.lit(f"{seed}:source:"), F.coalesce("source", F.lit("null"))))
    kinds = kinds.withColumns({"upto": upto, "offset": offset})
    taken = F.floor(F.col("upto") * F.col("part") + F.col("offset")) - F.floor((F.col("upto") - F.col("n")) * F.col("part") + F.col("offset"))
    kinds = scratch.cut(kinds.select("source", "size", "n", taken.alias("k")), "kinds")
    total = kinds.agg(F.sum("n")).first()[0] or 0
    some = join_still(rows.select("source", "size", "draw"), kinds.where("k > 0 AND k < n"), ["source", "size"], F.col("n") >= hot_rows(total)).where("k IS NOT NULL")
    at = Window.partitionBy("source", "size").orderBy("draw")
    limits = some.withColumn("at", F.row_number().over(at)).where("at = k").select("source", "size", F.col("draw").alias("limit"))
    joined = kinds.join(limits.select(F.col("source").alias("s"), F.col("size").alias("z"), "limit"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left")
    return joined.select("source", "size", "n", F.when(F.col("k") >= F.col("n"), 2.0).when(F.col("k") <= 0, -1.0).otherwise(F.col("limit")).alias("limit"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """All columns of ``docs`` as struct ``row``, with size, source_size, target and copies (0 to ``cap``) of each row.

    A null text has size 0; null is a source of its own, the last.  A source without words has target 0 and its rows no
    copies.  Rows with the same doc_id draw alike, also repeated ones; ties do not arise.  Texts of any length count whole.  An empty table gives an empty result; columns of any name may be there.
    Sources that hold 1/2000 of the rows or more (so at most 2000) are broadcast and their rows stay where they are; rows of rarer ones are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    size = F.size(words_of(F.col("text").cast("string"))).cast("long")
    draw = _uniform(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    narrow = scratch.cut(docs.select(F.col("source").cast("string").alias("source"), size.alias("size"), draw.alias("draw")), "sizes")
    targets = scratch.cut(source_targets(narrow.select("source", "size"), weights, cap, scratch), "targets")
    total = targets.agg(F.sum("n")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    hot = F.col("n") >= hot_rows(total, least=1)
    parts = join_still(narrow, targets.select("source", "n", (rate - F.floor(rate)).alias("part")), ["source"], hot).drop("n")
    limits = scratch.cut(extra_copies(parts, seed, scratch), "limits")
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    rows = docs.select(whole, docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), size.alias("size"), draw.alias("draw"))
    out = join_still(rows, targets, ["source"], hot).drop("n")
    out = join_still(out, limits, ["source", "size"], F.col("n") >= hot_rows(total))
    copies = F.floor(rate) + F.when(F.col("draw") <= F.col("limit"), 1).otherwise(0)
    return out.select("row", "doc_id", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as the plan says, in no order."""
    plan = mix_plan(docs, weights, cap, seed).where("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
