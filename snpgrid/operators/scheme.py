"""Typing schemes: annotation with coding features and the fixed-width scheme table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import longest_homopolymer, mutation_name, translate_codon

# fixed values: the columns of a scheme table, in order
SCHEME_COLUMNS = (
    "key", "mutation_key", "mutation_type", "dna_name", "gene_name", "gene_start", "gene_end", "cds_start", "cds_end", "aa_name", "aa_start", "aa_end", "is_silent", "is_cds", "is_frame_shift",
    "variant_start", "variant_end", "kmer_start", "kmer_end", "target_variant", "target_variant_len", "state", "ref_state", "alt_state", "kseq", "klen", "homopolymer_len", "kmer_entropy",
    "positive_genotypes", "partial_genotypes", "is_ambig_ok", "is_kmer_found", "is_kmer_length_ok", "is_kmer_unique", "is_valid",
)


def overlapping_feature(places: DataFrame, features: DataFrame, key: list[str]) -> DataFrame:
    """First coding feature, in file order, with a segment that holds [start, end] of a place.

    places: key columns, start, end; features: ord, gene_name, gene_start, gene_end, dna_seq, seg_start, seg_end.  Both meet in blocks of
    ten thousand bases, so a large feature table needs no broadcast.
    """
    block = 10_000
    spread = features.withColumn("block", F.explode(F.sequence(F.floor(F.col("seg_start") / block), F.floor(F.col("seg_end") / block))))
    hit = places.withColumn("block", F.floor(F.col("start") / block)).join(spread, "block").where("start >= seg_start AND end <= seg_end")
    first = hit.groupBy(*key).agg(F.min_by(F.struct("gene_name", "gene_start", "gene_end", "dna_seq"), "ord").alias("f"))
    return places.join(first, key, "left")


def codon_annotation(pos: Column, gene_start: Column, dna: Column, ref: Column, alt: Column) -> dict[str, Column]:
    """Amino-acid index, codon start within the gene, residues of both states and silence of a base in a coding sequence (forward strand)."""
    rel = F.abs(pos - gene_start)
    aa = F.floor(rel / 3)
    codon = F.substring(dna, 3 * aa + 1, F.lit(3))
    place = (rel % 3 + 1).cast("int")
    one = lambda base: translate_codon(F.overlay(codon, base, place, F.lit(1)))
    return {"aa_start": aa.cast("long"), "cds_start": (3 * aa + 1).cast("long"), "cds_end": (3 * aa + 3).cast("long"), "ref_aa": one(ref), "alt_aa": one(alt), "is_silent": one(ref) == one(alt)}


def snp_scheme(rules: DataFrame, ref_states: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """The scheme rows of SNP rules: for every position and alternative base one row a state, ref and alt.

    rules: pos, base, positive, partial; ref_states: pos, ref.  Mutations without any positive genotype are dropped; entropy is the
    logarithm of the number of genotypes of a row, the most over all rows where it has none.
    """
    r = rules.join(ref_states, "pos")
    alts = r.where("base <> ref").select("pos", "ref", F.col("base").alias("alt"))
    states = alts.withColumn("state", F.explode(F.array(F.lit("ref"), F.lit("alt")))).withColumn("base", F.when(F.col("state") == "alt", F.col("alt")).otherwise(F.col("ref")))
    empty = F.array().cast("array<string>")
    rows = states.join(rules, ["pos", "base"], "left").withColumn("positive", F.coalesce("positive", empty)).withColumn("partial", F.coalesce("partial", empty))
    some = rows.groupBy("pos", "alt").agg(F.max((F.size("positive") > 0).cast("int")).alias("any")).where("any = 1").select("pos", "alt")
    rows = rows.join(some, ["pos", "alt"], "left_semi")
    n = F.size(F.array_union("positive", "partial"))
    most = rows.agg(F.max(F.when(n > 0, F.ln(n))).alias("most"))
    rows = rows.join(most).withColumn("kmer_entropy", F.when(n > 0, F.ln(n)).otherwise(F.coalesce("most", F.lit(-1.0))))
    places = rows.select("pos", "alt", "state", "ref", "base", "positive", "partial", "kmer_entropy", F.col("pos").alias("start"), F.col("pos").alias("end"))
    if features is not None:
        marked = overlapping_feature(places, features, ["pos", "alt", "state"])
    else:
        marked = places.withColumn("f", F.lit(None).cast("struct<gene_name:string,gene_start:int,gene_end:int,dna_seq:string>"))
    a = codon_annotation(F.col("pos"), F.col("f.gene_start"), F.col("f.dna_seq"), F.col("ref"), F.col("alt"))
    inside = F.col("f").isNotNull()
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    out = {
        "mutation_key": mutation_name(F.col("ref"), F.col("pos"), F.col("alt")), "mutation_type": F.lit("snp"), "dna_name": F.concat("ref", (F.col("pos") + 1).cast("string"), "base"),
        "gene_name": text(F.col("f.gene_name")), "gene_start": text(F.col("f.gene_start") + 1), "gene_end": text(F.col("f.gene_end")), "cds_start": text(a["cds_start"]), "cds_end": text(a["cds_end"]),
        "aa_name": F.when(inside, F.concat(a["ref_aa"], (a["aa_start"] + 1).cast("string"), F.when(F.col("state") == "alt", a["alt_aa"]).otherwise(a["ref_aa"]))).otherwise(""), "aa_start": text(a["aa_start"] + 1), "aa_end": text(a["aa_start"] + 1),
        "is_silent": F.when(inside, a["is_silent"]).otherwise(True), "is_cds": inside, "is_frame_shift": F.lit(False), "variant_start": F.col("pos") + 1, "variant_end": F.col("pos") + 1, "kmer_start": F.lit(-1), "kmer_end": F.lit(-1),
        "target_variant": F.col("base"), "target_variant_len": F.lit(1), "state": F.col("state"), "ref_state": F.col("ref"), "alt_state": F.col("alt"), "kseq": F.lit(""), "klen": F.lit(0), "homopolymer_len": longest_homopolymer(F.lit("")),
        "kmer_entropy": F.col("kmer_entropy"), "positive_genotypes": F.array_join("positive", ","), "partial_genotypes": F.array_join("partial", ","),
        "is_ambig_ok": F.lit(True), "is_kmer_found": F.lit(True), "is_kmer_length_ok": F.lit(True), "is_kmer_unique": F.lit(True), "is_valid": F.lit(True),
    }
    return marked.select(*(c.alias(k) for k, c in out.items()))


def numbered(scheme: DataFrame) -> DataFrame:
    """Adds ``key``, the row number from 0 in order of position, alternative and state (ref first), as a table that is written once."""
    from pyspark.sql import Window

    order = Window.orderBy("variant_start", "alt_state", F.col("state").desc())  # scheme size: thousands of rows
    return scheme.withColumn("key", F.row_number().over(order) - 1).select(*SCHEME_COLUMNS)


def kmer_scheme(scheme: DataFrame, kmers: DataFrame, max_homopolymer: int = 5) -> DataFrame:
    """Scheme rows with the k-mers (pos, base, start, end, kmer, is_unique, positive, partial) that show their state."""
    rows = scheme.drop("kmer_start", "kmer_end", "kseq", "klen", "homopolymer_len", "is_kmer_unique", "positive_genotypes", "partial_genotypes")
    k = kmers.select((F.col("pos") + 1).alias("variant_start"), F.col("base").alias("target_variant"), F.col("start").alias("kmer_start"), F.col("end").alias("kmer_end"), F.col("kmer").alias("kseq"), F.length("kmer").alias("klen"), longest_homopolymer(F.col("kmer")).alias("homopolymer_len"), F.col("is_unique").alias("is_kmer_unique"), F.array_join("positive", ",").alias("positive_genotypes"), F.array_join("partial", ",").alias("partial_genotypes"))
    return rows.join(k, ["variant_start", "target_variant"]).withColumn("is_valid", F.col("is_kmer_unique") & (F.col("homopolymer_len") <= max_homopolymer))


def scheme_summary(scheme: DataFrame) -> DataFrame:
    """Rows, distinct positions and distinct mutations."""
    return scheme.agg(F.count("*").alias("n_features"), F.countDistinct("variant_start").alias("n_positions"), F.countDistinct("mutation_key").alias("n_mutations"))


def scheme_rules(scheme: DataFrame) -> DataFrame:
    """Rules (pos, base, positive, partial) read back from scheme rows."""
    parts = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    flat = scheme.select((F.col("variant_start").cast("int") - 1).alias("pos"), F.col("target_variant").alias("base"), parts("positive_genotypes").alias("p"), parts("partial_genotypes").alias("q"))
    both = flat.groupBy("pos", "base").agg(F.flatten(F.collect_list("p")).alias("p"), F.flatten(F.collect_list("q")).alias("q"))
    return both.select("pos", "base", F.array_sort(F.array_distinct("p")).alias("positive"), F.array_sort(F.array_distinct("q")).alias("partial"))
