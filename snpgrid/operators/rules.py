"""Genotype rules from base counts, and genotype calling with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sites import called


def genotype_base_counts(calls: DataFrame, genotypes: DataFrame) -> DataFrame:
    return calls.where(called(F.col("base"))).join(genotypes.select("sample_id", "genotype"), "sample_id").groupBy("genotype", "pos", "base").agg(F.count("*").alias("n"))


def base_rules(calls: DataFrame, genotypes: DataFrame, min_fraction: float = 1.0) -> DataFrame:
    """(pos, base, positive, partial): genotypes that carry the base in at least ``min_fraction`` of their samples, and in fewer."""
    size = genotypes.groupBy("genotype").agg(F.count("*").alias("size"))
    share = genotype_base_counts(calls, genotypes).join(size, "genotype").withColumn("full", F.col("n") >= F.lit(min_fraction) * F.col("size"))
    names = lambda own: F.array_sort(F.collect_list(F.when(own, F.col("genotype"))))
    return share.groupBy("pos", "base").agg(names(F.col("full")).alias("positive"), names(~F.col("full")).alias("partial"))


def genotype_states(calls: DataFrame, genotypes: DataFrame) -> DataFrame:
    """Bases observed per genotype and position."""
    return genotype_base_counts(calls, genotypes).groupBy("genotype", "pos").agg(F.array_join(F.array_sort(F.collect_set("base")), "").alias("bases"))


def allowed_bases(rules: DataFrame) -> DataFrame:
    """(genotype, pos, allowed): positive and partial bases, or every state of the position where a genotype has none."""
    states = rules.groupBy("pos").agg(F.array_sort(F.collect_set("base")).alias("states"))
    named = rules.select("pos", "base", F.explode(F.array_union("positive", "partial")).alias("genotype"))
    own = named.groupBy("genotype", "pos").agg(F.array_sort(F.collect_set("base")).alias("own"))
    every = named.select("genotype").distinct().crossJoin(states)  # genotypes x scheme positions, both of scheme size
    return every.join(own, ["genotype", "pos"], "left").select("genotype", "pos", F.coalesce("own", "states").alias("allowed"))


def score_genotypes(calls: DataFrame, allowed: DataFrame) -> DataFrame:
    """(sample_id, genotype, matches, mismatches, dist) over the called scheme positions.

    ``allowed`` has a row for every genotype and scheme position.  Calls meet only the genotypes that forbid them, and a base that the position
    never shows is forbidden to all; matches are what remains of a sample's calls.
    """
    states = allowed.select("pos", F.explode("allowed").alias("base")).distinct()
    forbidden = states.join(allowed, "pos").where(~F.array_contains("allowed", F.col("base"))).select("pos", "base", "genotype")
    usable = calls.where(called(F.col("base"))).select("sample_id", "pos", "base").join(allowed.select("pos").distinct(), "pos", "left_semi")
    known = usable.join(states.withColumn("known", F.lit(1)), ["pos", "base"], "left")
    totals = known.groupBy("sample_id").agg(F.count("*").alias("n"), (F.count("*") - F.count("known")).alias("strange"))
    misses = usable.join(forbidden, ["pos", "base"]).groupBy("sample_id", "genotype").agg(F.count("*").alias("forbidden"))
    # samples x genotypes is the size of the result
    pairs = totals.join(allowed.select("genotype").distinct()).join(misses, ["sample_id", "genotype"], "left")
    wrong = F.coalesce("forbidden", F.lit(0)) + F.col("strange")
    return pairs.select("sample_id", "genotype", (F.col("n") - wrong).alias("matches"), wrong.alias("mismatches"), (1 - (F.col("n") - wrong) / F.col("n")).alias("dist"))


def call_genotypes(calls: DataFrame, allowed: DataFrame, samples: DataFrame, max_dist: float = 0.0) -> DataFrame:
    """(sample_id, genotypes, dist): all genotypes at a sample's best distance, if within ``max_dist``; samples without calls have none at distance 1."""
    w = Window.partitionBy("sample_id").orderBy("dist")
    best = score_genotypes(calls, allowed).withColumn("rk", F.rank().over(w)).where("rk = 1").groupBy("sample_id").agg(F.min("dist").alias("dist"), F.array_sort(F.collect_list(F.when(F.col("dist") <= max_dist, F.col("genotype")))).alias("genotypes"))
    return samples.select("sample_id").join(best, "sample_id", "left").select("sample_id", F.coalesce("genotypes", F.array().cast("array<string>")).alias("genotypes"), F.coalesce("dist", F.lit(1.0)).alias("dist"))


def alt_mutations(calls: DataFrame, features: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """(sample_id, n_detected, mutations): scheme positions with a base, and the alternative mutations found there, sorted.

    ``features``: pos, ref_state, alt_state, mutation_key; ``positions`` (pos) are the scheme's, by default those of the features.
    """
    positions = features.select("pos").distinct() if positions is None else positions
    usable = calls.where(called(F.col("base"))).join(positions, "pos", "left_semi")
    found = usable.join(features.select("pos", F.col("alt_state").alias("base"), "mutation_key").distinct(), ["pos", "base"])
    n = usable.groupBy("sample_id").agg(F.countDistinct("pos").alias("n_detected"))
    names = found.groupBy("sample_id").agg(F.array_join(F.array_sort(F.collect_set("mutation_key")), ";").alias("mutations"))
    return n.join(names, "sample_id", "left").select("sample_id", "n_detected", F.coalesce("mutations", F.lit("")).alias("mutations"))


def call_report(calls: DataFrame, rules: DataFrame, features: DataFrame, samples: DataFrame, max_missing: int = 0, max_dist: float = 0.0) -> DataFrame:
    """One row a sample: predicted genotype(s), distance, detected positions and mutations, QC status and message."""
    positions = rules.select("pos").distinct()
    called_rows = call_genotypes(calls.join(positions, "pos", "left_semi"), allowed_bases(rules), samples, max_dist)
    n_positions = positions.agg(F.count("*").alias("n_positions"))
    out = called_rows.join(alt_mutations(calls, features, positions), "sample_id", "left").join(n_positions)
    n, detected = F.size("genotypes"), F.coalesce("n_detected", F.lit(0))
    short = detected < F.col("n_positions") - max_missing
    status = F.when(short, "Fail").when(n == 1, "Pass").otherwise("Warning")
    message = F.when(short, "too few positions detected").when(n == 1, "").when(n > 1, "ambiguous genotype").otherwise("no genotype")
    return out.select("sample_id", F.array_join("genotypes", ";").alias("predicted_genotype"), F.round("dist", 9).alias("predicted_genotype_distance"), detected.cast("long").alias("num_detected_positions"), status.alias("qc_status"), message.alias("qc_messages"), F.coalesce("mutations", F.lit("")).alias("detected_alt_mutations"))
