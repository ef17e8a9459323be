"""Clade-defining SNPs: carriers of a base against the members of every clade."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import fisher_greater, odds_ratio
from .hierarchy import membership
from .sites import called


def clade_overlaps(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """Per (site, base, clade) with a common sample: overlap, carriers, called members and called samples.

    An equi-join on the sample and counts replace sets: a base is canonical where overlap = carriers = called members.
    """
    good = calls.where(called(F.col("base")))
    member = membership(samples)
    sizes = member.groupBy("clade").agg(F.count("*").alias("n_members"), F.min(F.struct("ord", "depth")).alias("clade_ord"))
    by_base = good.join(member.select("sample_id", "clade"), "sample_id").groupBy("chrom", "pos", "base", "clade").agg(F.count("*").alias("overlap"), F.max((F.col("base") == F.col("ref")).cast("int")).alias("is_ref"))
    site_clade = Window.partitionBy("chrom", "pos", "clade")
    by_base = by_base.withColumn("n_clade", F.sum("overlap").over(site_clade))
    carriers = good.groupBy("chrom", "pos", "base").agg(F.count("*").alias("carriers"))
    site = Window.partitionBy("chrom", "pos")
    carriers = carriers.withColumn("n_called", F.sum("carriers").over(site))
    return by_base.join(carriers, ["chrom", "pos", "base"]).join(sizes, "clade")


def canonical_snps(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """(chrom, pos, base, clade, num_clade_members, num_members, is_ref): the first clade, in order of appearance, that a base defines exactly."""
    rows = clade_overlaps(calls, samples).where("overlap = carriers AND overlap = n_clade")
    first = rows.groupBy("chrom", "pos", "base").agg(F.min_by(F.struct("clade", "n_clade", "n_members", "is_ref"), "clade_ord").alias("v"))
    return first.select("chrom", "pos", "base", F.col("v.clade").alias("clade"), F.col("v.n_clade").alias("num_clade_members"), F.col("v.n_members").alias("num_members"), (F.col("v.is_ref") == 1).alias("is_ref"))


def assigned_snps(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """Every (site, base) with its clade: the first canonical one, else the best that holds all carriers, else none.

    The best is an ordered fold: a clade replaces the held one if its odds ratio is larger or its p-value smaller.  The
    test's cells count carriers in the clade, samples outside it, clade members, and non-carriers outside plus carriers.
    """
    rows = clade_overlaps(calls, samples).where(F.col("overlap") * 2 >= F.col("carriers"))
    rows = rows.where("overlap = carriers").withColumn("outside", F.col("n_called") - F.col("n_clade"))
    a, b, c, d = F.col("overlap"), F.col("outside"), F.col("n_clade"), F.col("outside") + F.col("overlap")
    rows = rows.withColumn("oddsr", odds_ratio(a, b, c, d)).withColumn("p", fisher_greater(a, b, c, d))
    row = F.struct("clade_ord", "clade", "oddsr", "p", "n_clade", "n_members", (F.col("overlap") == F.col("n_clade")).alias("canonical"))
    held = rows.groupBy("chrom", "pos", "base").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = "struct<clade:string,oddsr:double,p:double,n_clade:bigint,n_members:bigint,canonical:boolean>"
    none = F.lit(None).cast(kind)
    start = F.struct(F.lit(None).cast("string").alias("clade"), F.lit(0.0).alias("oddsr"), F.lit(1.0).alias("p"), F.lit(0).cast("long").alias("n_clade"), F.lit(0).cast("long").alias("n_members"), F.lit(False).alias("canonical"))
    take = lambda x: F.struct(x["clade"], x["oddsr"], x["p"], x["n_clade"], x["n_members"], x["canonical"])
    better = lambda acc, x: ~acc["canonical"] & (x["canonical"] | (x["oddsr"] > acc["oddsr"]) | (x["p"] < acc["p"]))
    best = F.aggregate("rows", F.coalesce(none, start), lambda acc, x: F.when(better(acc, x), take(x)).otherwise(acc))
    out = calls.where(called(F.col("base"))).select("chrom", "pos", "base").distinct().join(held.withColumn("v", best).drop("rows"), ["chrom", "pos", "base"], "left")
    return out.select("chrom", "pos", "base", F.col("v.clade").alias("clade"), F.coalesce("v.canonical", F.lit(False)).alias("is_canonical"), F.coalesce("v.n_clade", F.lit(0)).alias("num_clade_members"), F.coalesce("v.n_members", F.lit(0)).alias("num_members"), F.coalesce("v.oddsr", F.lit(0.0)).alias("oddsr"), F.coalesce("v.p", F.lit(1.0)).alias("p_value"))


def snp_validity(snps: DataFrame, max_states: int = 6, min_members: int = 1) -> DataFrame:
    """``snps`` (chrom, pos, base, is_canonical, num_members, ...) with is_valid: false at positions of more than ``max_states`` bases and for canonical bases of fewer than ``min_members`` samples."""
    states = snps.groupBy("chrom", "pos").agg(F.countDistinct("base").alias("_states"))
    few = F.col("is_canonical") & (F.col("num_members") < min_members)
    return snps.join(states, ["chrom", "pos"]).withColumn("is_valid", (F.col("_states") <= max_states) & ~few).drop("_states")


def snp_summary(snps: DataFrame) -> DataFrame:
    """Positions, those with a canonical base and those with a valid one (``snps`` without is_valid are all valid)."""
    valid = F.col("is_valid") if "is_valid" in snps.columns else F.lit(True)
    by = snps.groupBy("chrom", "pos").agg(F.max("is_canonical").alias("c"), F.max(valid).alias("v"))
    return by.agg(F.count("*").alias("n_positions"), F.coalesce(F.sum(F.col("c").cast("long")), F.lit(0)).alias("n_canonical"), F.coalesce(F.sum(F.col("v").cast("long")), F.lit(0)).alias("n_valid"))


def clade_snps(canonical: DataFrame) -> DataFrame:
    """Each clade's SNPs in site order, as text, and their number."""
    rows = canonical.groupBy("clade").agg(F.array_sort(F.collect_list(F.struct("chrom", "pos", "base"))).alias("s"))
    return rows.select("clade", F.size("s").cast("long").alias("n_snps"), F.array_join(F.transform("s", lambda x: F.concat(x["pos"].cast("string"), x["base"])), ",").alias("snps"))


def prune_snps(canonical: DataFrame, most: int) -> DataFrame:
    """At most ``most`` SNPs a clade, the first by site (a deterministic cap)."""
    w = Window.partitionBy("clade").orderBy("chrom", "pos", "base")
    return canonical.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def remove_snps(canonical: DataFrame, positions: DataFrame) -> DataFrame:
    """SNPs but those at ``positions`` (pos)."""
    return canonical.join(positions.select("pos").distinct(), "pos", "left_anti").select(*canonical.columns)


def valid_nodes(canonical: DataFrame, samples: DataFrame, min_members: int = 1, min_snps: int = 1) -> DataFrame:
    """Clades with enough members and SNPs."""
    n = canonical.groupBy("clade").agg(F.count("*").alias("n_snps"))
    m = membership(samples).groupBy("clade").agg(F.count("*").alias("num_members"))
    return m.join(n, "clade", "left").where((F.col("num_members") >= min_members) & (F.coalesce("n_snps", F.lit(0)) >= min_snps)).select("clade", "num_members", "n_snps")
