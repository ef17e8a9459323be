"""K-mers of samples that are a reference with sparse variants; no sample's genome is ever built.

A sample's windows differ from the reference's only over its own variants.  So the reference is cut into windows once, each
sample adds the windows over its variants, and hits are kept as the reference's number and each sample's difference from it.  Calls that are
no base are N in a window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import revcomp
from . import kmers, rules

#: Starts that a row of the cut reference spans.
CHUNK = 1000


def reference_windows(spark: SparkSession, genome: str, k: int) -> DataFrame:
    """(at, window) of every start of one reference record."""
    chunks = [(i, genome[i : i + CHUNK + k - 1]) for i in range(0, len(genome) - k + 1, CHUNK)]
    rows = spark.createDataFrame(chunks, "first int, seq string")
    starts = F.explode(F.sequence(F.lit(0), F.least(F.lit(CHUNK - 1), F.length("seq") - k))).alias("i")
    return rows.select("first", "seq", starts).select((F.col("first") + F.col("i")).alias("at"), F.substring("seq", F.col("i") + 1, F.lit(k)).alias("window"))


def changed_windows(windows: DataFrame, variants: DataFrame, k: int) -> DataFrame:
    """(sample_id, at, was, window): the windows over each sample's variants (sample_id, pos, base), before and after."""
    over = variants.select("sample_id", "pos", "base", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - k + 1), F.col("pos"))).alias("at"))
    over = over.groupBy("sample_id", "at").agg(F.collect_list(F.struct((F.col("pos") - F.col("at")).alias("i"), "base")).alias("changes"))
    changed = F.aggregate("changes", F.col("window"), lambda w, c: F.overlay(w, c["base"], c["i"] + 1, F.lit(1)))
    return over.join(windows, "at").select("sample_id", "at", F.col("window").alias("was"), changed.alias("window"))


def target_kmers(windows: DataFrame, changed: DataFrame, positions: DataFrame, n_samples: int, k: int, max_ambiguous: int = 0) -> DataFrame:
    """(kmer, start, end, pos, base): the k-mers of all samples in which a target position (pos) with a base is not the first, with all targets that they show.

    Targets on the last base of a k-mer are not its own.  A k-mer found at several places keeps the last one.
    """
    own = positions.select("pos", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - k + 1), F.col("pos"))).alias("at"))
    starts = own.select("at").distinct()
    others = changed.groupBy("at").agg(F.count("*").alias("n"))
    plain = windows.join(starts, "at").join(others, "at", "left").where(F.coalesce("n", F.lit(0)) < n_samples).select("at", "window")
    every = plain.unionByName(changed.join(starts, "at").select("at", "window")).distinct()
    ambiguous = F.length("window") - F.length(F.replace("window", F.lit("N")))
    met = every.where(ambiguous <= max_ambiguous).join(own, "at").withColumn("base", F.substring("window", F.col("pos") - F.col("at") + 1, F.lit(1))).where(F.col("base").isin(*"ACGT"))
    place = met.where("pos > at").groupBy("window").agg(F.max("at").alias("at"))
    shown = met.join(place, ["window", "at"]).where(F.col("pos") < F.col("at") + k - 1)
    return shown.select(F.col("window").alias("kmer"), F.col("at").alias("start"), (F.col("at") + k).alias("end"), "pos", "base").distinct()


@dataclass
class Hits:
    """``reference``: kmer, n; ``differences``: kmer, sample_id, n (of the reference), d (the sample has n + d)."""

    reference: DataFrame
    differences: DataFrame


def search(windows: DataFrame, changed: DataFrame, found: DataFrame) -> Hits:
    """Hits of each k-mer on either strand, in the reference and by difference in each sample."""
    both = found.select("kmer").distinct().select("kmer", F.explode(F.array_distinct(F.array(F.col("kmer"), revcomp(F.col("kmer"))))).alias("window"))
    reference = both.join(windows, "window", "left").groupBy("kmer").agg(F.count("at").alias("n"))
    moves = changed.select("sample_id", "window", F.lit(1).alias("one")).unionByName(changed.select("sample_id", F.col("was").alias("window"), F.lit(-1).alias("one")))
    moves = moves.join(both, "window").groupBy("kmer", "sample_id").agg(F.sum("one").alias("d")).where("d <> 0")
    return Hits(reference, moves.join(reference, "kmer"))


def multi_hits(hits: Hits, n_samples: int) -> DataFrame:
    """K-mers found more than once in some sample."""
    moved = hits.differences.groupBy("kmer").agg(F.count("*").alias("moved"), F.max(F.col("n") + F.col("d")).alias("most"))
    rows = hits.reference.join(moved, "kmer", "left")
    same = F.coalesce("moved", F.lit(0)) < n_samples
    return rows.where((F.coalesce("most", F.lit(0)) > 1) | (same & (F.col("n") > 1))).select("kmer")


def genotype_presence(hits: Hits, genotypes: DataFrame) -> DataFrame:
    """(kmer, genotype, n, size): samples of each genotype with the k-mer, where there are any."""
    size = genotypes.groupBy("genotype").agg(F.count("*").alias("size"))
    change = (F.col("n") + F.col("d") > 0).cast("long") - (F.col("n") > 0).cast("long")
    change = hits.differences.join(genotypes.select("sample_id", "genotype"), "sample_id").groupBy("kmer", "genotype").agg(F.sum(change).alias("change"))
    # a k-mer of the reference is in every genotype but where a sample lost it: k-mers x genotypes is the result itself
    whole = hits.reference.where("n > 0").select("kmer").crossJoin(size.select("genotype", F.col("size").alias("change")))
    n = whole.unionByName(change).groupBy("kmer", "genotype").agg(F.sum("change").alias("n")).where("n > 0")
    return n.join(size, "genotype").select("kmer", "genotype", "n", "size")


def rules_of(presence: DataFrame, shown: DataFrame, min_fraction: float = 0.1) -> DataFrame:
    """(pos, base, positive, partial): genotypes in which at least ``min_fraction`` of the samples have one of the k-mers of a base, and the rest with any."""
    rows = presence.join(shown.select("kmer", "pos", "base"), "kmer").groupBy("pos", "base", "genotype").agg(F.max((F.col("n") >= F.lit(min_fraction) * F.col("size")).cast("int")).alias("full"))
    names = lambda full: F.array_sort(F.collect_list(F.when(F.col("full") == full, F.col("genotype"))))
    return rows.groupBy("pos", "base").agg(names(1).alias("positive"), names(0).alias("partial"))


@dataclass
class KmerScheme:
    """``extracted``: a row a k-mer and genotype (the report's columns); ``chosen``: pos, base, start, end, kmer, is_unique, positive, partial; ``missing``: pos, base without a k-mer."""

    extracted: DataFrame
    chosen: DataFrame
    missing: DataFrame


def select(spark: SparkSession, genome: str, variants: DataFrame, calls: DataFrame, genotypes: DataFrame, positions: DataFrame, k: int, cut: Callable[[DataFrame, str], DataFrame], max_ambiguous: int = 0, min_fraction: float = 0.1) -> KmerScheme:
    """The k-mers that show the states of ``positions``: extraction, search, validity, rules, and of each state the start with most telling k-mers.

    A k-mer is valid if no sample has it twice and no genotype has it that never shows its bases.  calls: sample_id, pos, base of the positions; genotypes: sample_id,
    genotype.  ``cut`` writes a table under a name and reads it again, so plans stay short.
    """
    n = genotypes.count()
    windows = reference_windows(spark, genome, k)
    changed = cut(changed_windows(windows, variants, k), "changed")
    found = cut(target_kmers(windows, changed, positions, n, k, max_ambiguous), "found")
    hits = search(windows, changed, found)
    hits = Hits(cut(hits.reference, "reference"), cut(hits.differences, "differences"))
    presence = cut(genotype_presence(hits, genotypes), "presence")
    states = cut(rules.genotype_states(calls, genotypes), "states")
    bad = multi_hits(hits, n).unionByName(kmers.unspecific(presence, found, states)).distinct()
    flagged = found.join(bad.withColumn("bad", F.lit(True)), "kmer", "left").withColumn("is_valid", F.col("bad").isNull()).drop("bad")
    flagged = cut(flagged, "flagged")
    targets = flagged.groupBy("kmer", "start", "end", "is_valid").agg(F.array_join(F.transform(F.array_sort(F.collect_set("pos")), lambda p: p.cast("string")), ";").alias("target_positions"))
    extracted = targets.join(presence, "kmer").select(F.col("kmer").alias("kseq"), F.col("start").alias("aln_start"), F.col("end").alias("aln_end"), "is_valid", "target_positions", "genotype", F.col("n").alias("genotype_count"))

    valid = flagged.where("is_valid")
    missing = cut(kmers.positions_without_kmer(states, valid), "missing")
    kept = valid.join(missing.select("pos").distinct(), "pos", "left_anti")
    fallback = states.select("genotype", "pos", F.substring("bases", 1, 1).alias("base")).where("base <> ''")
    refined = kmers.refine_rules(rules_of(presence, kept, min_fraction), genotypes, fallback)
    telling = presence.groupBy("kmer").agg(F.sum((F.col("n") >= F.lit(min_fraction) * F.col("size")).cast("int")).alias("n_positive"))
    ranked = kmers.best_starts(kept.join(telling, "kmer").withColumn("kidx", F.struct("start", "kmer")))
    chosen = kept.join(ranked.select("pos", "base", "start"), ["pos", "base", "start"]).join(refined, ["pos", "base"])
    chosen = chosen.select("pos", "base", "start", "end", "kmer", F.lit(True).alias("is_unique"), "positive", "partial")
    return KmerScheme(extracted, cut(chosen, "chosen"), missing)


def probe_pairs(spark: SparkSession, genome: str, codes: DataFrame, snps: DataFrame, k: int) -> DataFrame:
    """(name, target_pos, target_base, sequence): a positive probe of k + 1 bases of each SNP (pos, base, path), and a negative one of each other base seen there.

    Probes are cut from the consensus (codes: pos, code of variable positions), the target next to last, and named by their start; ``target_base`` is the positive's
    in both; positions are 0-based.
    """
    span = k + 1
    windows = reference_windows(spark, genome, span)
    variants = codes.select(F.lit("").alias("sample_id"), "pos", F.col("code").alias("base"))
    start = F.greatest(F.lit(0), F.col("pos") - k + 1)
    rows = snps.select("pos", "base", "path", "others").withColumn("at", F.least(start, F.lit(max(0, len(genome) - span))))
    wanted = windows.join(rows.select("at").distinct(), "at", "left_semi")
    coded = changed_windows(wanted, variants, span).select("at", F.col("window").alias("coded"))
    rows = rows.join(wanted.join(coded, "at", "left").select("at", F.coalesce("coded", "window").alias("window")), "at")
    one = lambda label, base: F.struct(label.alias("name"), F.col("base").alias("target_base"), F.overlay("window", base, F.col("pos") - F.col("at") + 1, F.lit(1)).alias("sequence"))
    label = F.concat(F.col("at").cast("string"), F.lit("-"), F.col("path"))
    pairs = F.concat(F.array(one(label, F.col("base"))), F.transform("others", lambda b: one(F.concat(F.lit("negative"), label), b)))
    return rows.select(F.col("pos").alias("target_pos"), F.explode(pairs).alias("p")).select("p.name", "target_pos", "p.target_base", "p.sequence")
