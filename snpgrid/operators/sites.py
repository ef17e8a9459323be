"""Sites and alleles: normalisation, filters, base counts, consensus, alternative bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import iupac_code

BASES = ("A", "C", "G", "T")


def decode_allele(gt: Column, ref: Column, alt: Column) -> Column:
    """Base of a genotype field: a number indexes REF and ALT, A/C/G/T/- stay, * is -, all else (also longer alleles) is N."""
    picked = F.get(F.concat(F.array(ref), F.split(alt, ",")), F.when(gt.rlike("^[0-9]{1,4}$"), gt).cast("int"))
    base = F.when(gt.rlike("^[0-9]{1,4}$"), picked).otherwise(gt)
    return F.when(base.isin(*BASES, "-"), base).when(base == "*", F.lit("-")).otherwise(F.lit("N"))


def called(base: Column) -> Column:
    return base.isin(*BASES)


def base_counts(calls: DataFrame) -> DataFrame:
    """Counts of each base per site; N holds everything that is no base."""
    one = lambda b: F.count(F.when(F.col("base") == b, 1)).alias(f"n_{b.lower()}")
    return calls.groupBy("chrom", "pos").agg(*(one(b) for b in BASES), F.count(F.when(~called(F.col("base")), 1)).alias("n_n"))


def site_states(calls: DataFrame, n_samples: int | None = None) -> DataFrame:
    """(chrom, pos, missing, states): share of samples without a base and the number of distinct bases.  ``n_samples`` counts absent cells as missing."""
    total = F.lit(n_samples) if n_samples is not None else F.count("*")
    return calls.groupBy("chrom", "pos").agg((1 - F.count(F.when(called(F.col("base")), 1)) / total).alias("missing"), F.countDistinct(F.when(called(F.col("base")), F.col("base"))).alias("states"))


def filter_sites(calls: DataFrame, max_states: int = 6, max_missing: float = 0.25, n_samples: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept calls, removed sites): removed are sites with too much missing, with exactly one state or with too many."""
    bad = site_states(calls, n_samples).where((F.col("missing") > max_missing) | (F.col("states") == 1) | (F.col("states") > max_states)).select("chrom", "pos")
    return calls.join(bad, ["chrom", "pos"], "left_anti"), bad


def variant_positions(calls: DataFrame) -> DataFrame:
    return site_states(calls).where("states > 1").select("chrom", "pos")


def consensus(calls: DataFrame) -> DataFrame:
    """IUPAC code of the bases present at each site."""
    return calls.groupBy("chrom", "pos").agg(iupac_code(F.array_sort(F.collect_set(F.when(called(F.col("base")), F.col("base"))))).alias("code"))


def alternative_bases(calls: DataFrame, positions: DataFrame) -> DataFrame:
    """A base that at most one sample carries, the first in alphabetical order, per position."""
    counts = base_counts(calls).join(positions, ["chrom", "pos"], "left_semi")
    free = F.filter(F.array(*(F.when(F.col(f"n_{b.lower()}") <= 1, F.lit(b)) for b in BASES)), lambda b: b.isNotNull())
    return counts.select("chrom", "pos", F.get(free, F.lit(0)).alias("alt_base"), F.array_join(free, "").alias("candidates"))


def sparse_variants(calls: DataFrame) -> DataFrame:
    """Calls that differ from the reference."""
    return calls.where("base <> ref")
