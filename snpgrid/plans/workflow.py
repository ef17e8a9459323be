"""The four commands as plans: create, genotype, benchmark, namer."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import troughs
from ..operators import associate, canonical, cluster, distance, evaluate, hierarchy, local_kmers, rules, scheme, sites
from ..sources import genbank, newick, pseudo, tables, vcf
from . import compression, reports


@dataclass
class Create:
    in_var: str
    in_meta: str
    outdir: str
    reference: str
    in_nwk: str | None = None
    in_groups: str | None = None
    root_name: str | None = None
    root_method: str | None = None  # outgroup (where a root is named) or midpoint (else)
    delim: str | None = None
    prefix: str = "scheme"
    min_members: int = 1
    min_snp_count: int = 1
    max_snp_count: int = -1
    max_states: int = 6
    max_site_ambig: float = 0.25
    min_inter_clade_dist: int = 1
    min_perc: float = 0.1  # share of a genotype's samples that must have a k-mer; SNP rules take all of them
    rcor_thresh: float = 0.4
    no_compression: bool = False
    klen: int = 18  # 0: no k-mer scheme
    max_ambig: int = 0
    keep_tmp: bool = False
    force: bool = False


@dataclass
class Genotype:
    in_var: str
    in_scheme: str
    outfile: str
    sample_meta: str | None = None
    genotype_meta: str | None = None
    max_missing_positions: int = 1


@dataclass
class Benchmark:
    in_var: str
    in_scheme: str
    in_genotype: str
    outdir: str
    submitted_genotype_col: str
    predicted_genotype_col: str
    prefix: str = "scheme"


@dataclass
class Namer:
    in_scheme: str
    in_names: str
    outfile: str


def create(spark: SparkSession, c: Create) -> dict[str, DataFrame]:
    """Builds a scheme from variants, a hierarchy, metadata and an annotated reference, and writes the reports."""
    for path in filter(None, (c.in_var, c.in_meta, c.in_nwk or c.in_groups, c.reference)):
        tables.check_file(path)
    if c.root_method not in (None, "outgroup", "midpoint") or (c.root_method == "outgroup" and not c.root_name):
        raise ValueError("root_method is outgroup, with a root_name, or midpoint")
    if not c.force and tables.exists(spark, f"{c.outdir}/{c.prefix}-params.log"):
        raise ValueError(f"{c.outdir} holds results of {c.prefix}; force writes over them")
    features, accession, genome = genbank.read_features(spark, c.reference)
    meta = tables.read_metadata(spark, c.in_meta)
    if c.in_nwk:
        outgroup = None if c.root_method == "midpoint" else c.root_name
        samples = newick.read_tree(spark, c.in_nwk, outgroup, at_midpoint=not outgroup)
    else:
        samples, _ = tables.read_groups(spark, c.in_groups, c.delim)
    missing = evaluate.missing_ids({"hierarchy": samples, "variants": spark.createDataFrame([(s,) for s in vcf.sample_ids(spark, c.in_var)], "sample_id string"), "metadata": meta})
    if offenders := missing.limit(20).collect():
        raise ValueError("ids are missing: " + ", ".join(f"{r['sample_id']} in {r['input']}" for r in offenders))
    if c.in_nwk and samples.where(F.col("sample_id").rlike(r"^\s*[+-]?[0-9]+\s*$")).limit(1).count():
        raise ValueError("sample ids must not be integers")
    # samples are in the order of the variants' columns from here on
    order = [(s, i) for i, s in enumerate(vcf.sample_ids(spark, c.in_var))]
    samples = samples.drop("ord").join(spark.createDataFrame(order, "sample_id string, ord long"), "sample_id")

    calls, removed = sites.filter_sites(vcf.read_calls(spark, c.in_var), c.max_states, c.max_site_ambig)
    held = [calls.persist()]
    dist = distance.snp_distances(calls, samples).persist()
    assigned = canonical.assigned_snps(calls, samples).persist()
    exact = canonical.canonical_snps(calls, samples)
    n_snps = exact.groupBy("clade").agg(F.count("*").alias("n_snps"))
    nodes = hierarchy.node_counts(samples).join(n_snps, "clade", "left").join(distance.within_clades(calls, samples), "clade", "left").join(distance.outside_clades(calls, samples), "clade", "left").persist()
    held += [dist, assigned, nodes]
    clades = {r["clade"]: compression.Clade(r["num_members"], r["n_snps"] or 0, r["ave_within"] or 0.0, r["closest_sample_dist"] if r["closest_sample_dist"] is not None else 0, r["closest_clade_id"]) for r in nodes.collect()}
    paths = {r["sample_id"]: r["path"] for r in samples.orderBy("ord").select("sample_id", "path").collect()}
    picked = compression.select(paths, clades, c.min_members, c.min_snp_count, c.min_inter_clade_dist, compress=not c.no_compression)

    table = lambda d: spark.createDataFrame(list(d.items()) or [("", "")], "sample_id string, genotype string")
    genotypes = table(picked.genotypes)
    flags = spark.createDataFrame([(n, n in picked.valid, n in picked.selected) for n in clades], "clade string, is_valid boolean, is_selected boolean")
    kept = exact.join(flags.where("is_valid"), "clade", "left_semi")
    at = lambda snps: calls.join(snps.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")
    found = None

    def cut(df: DataFrame, name: str) -> DataFrame:
        """The table, written beside the reports and read again."""
        path = f"{c.outdir}/{c.prefix}-tmp/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    if c.klen:
        found = local_kmers.select(spark, genome, sites.sparse_variants(calls).select("sample_id", "pos", "base"), at(kept), genotypes, kept.select("pos").distinct(), c.klen, cut, c.max_ambig, c.min_perc)
        # positions without a k-mer leave the scheme, and nodes that lose all their SNPs the genotypes
        before = cut(kept, "before")
        kept = canonical.remove_snps(before, found.missing)
        lost = before.select("clade").distinct().join(kept.select("clade").distinct(), "clade", "left_anti")
        named = hierarchy.membership(samples).select("clade").distinct().join(spark.createDataFrame([(n,) for n in picked.valid], "clade string"), "clade", "left_semi")
        left_nodes = cut(named.join(lost, "clade", "left_anti"), "nodes")
        genotypes = cut(hierarchy.genotypes(samples, left_nodes), "genotypes")
    if c.max_snp_count > 0:
        kept = canonical.prune_snps(kept, c.max_snp_count)
    chosen = at(kept)
    snp_rules = rules.base_rules(chosen, genotypes)
    snp_rows = scheme.snp_scheme(snp_rules, chosen.select("pos", "ref").distinct(), features.where("type = 'CDS'"))
    rows = scheme.numbered(snp_rows)

    cuts = sorted((r[0] for r in troughs(distance.histogram(calls, samples)).collect()), reverse=True)
    labels = cluster.cluster_table(spark, dist, samples, [float(t) for t in cuts])
    clusters = labels.select("sample_id", F.explode(F.split("labels", r"\.")).alias("cluster"))
    nomenclature = cluster.nomenclature(labels, cluster.best_fit(clusters, hierarchy.membership(samples)))
    fields = [f for f in meta.columns if f not in ("sample_id", "year")]
    with_meta = samples.join(meta, "sample_id")
    fisher = associate.fisher_associations(with_meta, fields) if fields else None
    # years are held against distances in the nodes that selection left
    left = with_meta.drop("path").join(genotypes.select("sample_id", F.split("genotype", r"\.").alias("path")), "sample_id")
    temporal = associate.temporal_signal(calls, left.withColumn("year", F.expr("try_cast(year AS double)")).where("year IS NOT NULL"), c.rcor_thresh) if "year" in meta.columns else None

    out, base = {}, f"{c.outdir}/{c.prefix}"
    # the root's marker lies in the middle of the longest conserved stretch
    root = samples.select(F.get("path", F.lit(0))).first()[0]
    gap = distance.conserved_gap(calls, len(genome)).first()
    marker = [(root, gap["pos"], genome[gap["pos"]])] if gap["pos"] is not None and gap["pos"] < len(genome) else []
    marked = exact.select("clade", F.col("pos").cast("long").alias("pos"), "base").unionByName(spark.createDataFrame(marker, "clade string, pos long, base string"))
    root_flags = flags.withColumns({x: F.col(x) | ((F.col("clade") == root) & F.lit(bool(marker))) for x in ("is_valid", "is_selected")})
    out["clades.info"] = reports.clade_report(nodes, marked, root_flags, temporal, fisher, reports.last_value(meta, fields), root)
    out["snps.info"] = reports.snp_report(assigned, calls)
    out["genotypes.raw"], out["genotypes.supported"], out["genotypes.selected"] = samples.select("sample_id", F.array_join("path", ".").alias("genotype")), table(picked.supported), genotypes
    out["genotypes.distance"] = labels.withColumnRenamed("labels", "thresh-" + ";".join(map(str, cuts)) if cuts else "labels")
    out["genotypes.nomenclature"] = nomenclature
    out["snp.scheme"] = rows
    if found is not None:
        out["kmer.scheme"] = scheme.numbered(scheme.kmer_scheme(snp_rows, found.chosen))
        out["extracted.kmers"] = found.extracted
        seen = chosen.where(sites.called(F.col("base"))).groupBy("pos").agg(F.array_sort(F.collect_set("base")).alias("seen"))
        snps = kept.select("clade", "pos", "base").join(hierarchy.node_paths(hierarchy.reduced(samples, left_nodes)), "clade").join(seen, "pos")
        snps = snps.select("pos", "base", "path", F.array_except("seen", F.array("base")).alias("others"))
        # the root's marker has a positive probe alone
        snps = snps.unionByName(spark.createDataFrame([(p, b, n, []) for n, p, b in marker], "pos int, base string, path string, others array<string>"))
        probes = local_kmers.probe_pairs(spark, genome, sites.consensus(calls).select("pos", "code"), snps, c.klen).persist()
        held.append(probes)
        tables.write_fasta(probes.coalesce(1), f"{base}-probes.fasta", "name", "sequence")
        out["probes.meta"] = probes.select(F.col("name").alias("kmername"), "target_pos", "target_base")
    variants = sites.sparse_variants(vcf.read_calls(spark, c.in_var)).select("sample_id", "pos", "base")
    pseudo.write_pseudo_fasta(samples, variants, genome, f"{base}-pseudo.seqs.fasta")
    altered = pseudo.alternative_sequence(genome, sites.alternative_bases(calls, kept.select("chrom", "pos").distinct()))
    tables.write_fasta(spark.createDataFrame([(accession, altered)], "seq_id string, seq string"), f"{base}-altseq.fasta")
    if fisher is not None:
        out["associations"] = fisher
    for name, df in out.items():
        tables.write_tsv(df, f"{base}-{name}.txt")
    tables.write_distances(dist, samples, f"{base}-dist.mat.txt")
    tables.write_histogram_html(spark, distance.histogram(calls, samples), f"{base}-dist.histo.html")
    vcf.filter_file(spark, c.in_var, removed, f"{base}-filtered.vcf")
    tables.write_params(spark, asdict(c) | {"reference_accession": accession, "reference_length": len(genome)}, f"{base}-params.log")
    for df in held:
        df.unpersist()
    if not c.keep_tmp:
        # the tables of the k-mer half live on as what was written
        out = {name: tables.read_tsv(spark, f"{base}-{name}.txt") for name in out}
        tables.remove(spark, f"{c.outdir}/{c.prefix}-tmp")
    return out


def _scheme(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    tables.check_file(path)
    s = tables.read_tsv(spark, path)
    features = s.select((F.col("variant_start").cast("int") - 1).alias("pos"), "ref_state", "alt_state", "mutation_key").distinct()
    return s, scheme.scheme_rules(s), features


def genotype(spark: SparkSession, c: Genotype) -> DataFrame:
    """Calls genotypes of the samples of a VCF with a scheme; metadata of samples and genotypes is joined on."""
    tables.check_file(c.in_var)
    s, snp_rules, features = _scheme(spark, c.in_scheme)
    positions = features.select("pos").distinct()
    calls = vcf.read_calls(spark, c.in_var, positions)
    samples = spark.createDataFrame([(x,) for x in vcf.sample_ids(spark, c.in_var)], "sample_id string")
    if c.sample_meta:
        meta = tables.read_metadata(spark, c.sample_meta)
        samples = samples.join(meta.select("sample_id"), "sample_id", "left_semi")
    report = rules.call_report(calls, snp_rules, features, samples, c.max_missing_positions).join(scheme.scheme_summary(s))
    report = report.withColumns({"scheme": F.lit(os.path.basename(c.in_scheme)), "analysis_date": reports.now(), "total_scheme_features": F.col("n_features"), "unique_scheme_positions": F.col("n_positions")}).select(*reports.CALL)
    if c.sample_meta:
        report = report.join(meta, "sample_id", "left")
    if c.genotype_meta:
        g = tables.read_metadata(spark, c.genotype_meta, "key")
        taken = set(report.columns)
        g = g.select(F.col("key").alias("predicted_genotype"), *(F.col(x).alias(f"{x}_genotype" if x in taken else x) for x in g.columns if x != "key"))
        report = report.join(g, "predicted_genotype", "left")
    report = report.select(*reports.CALL, *(x for x in report.columns if x not in reports.CALL))
    tables.write_tsv(report, c.outfile)
    return report


def benchmark(spark: SparkSession, c: Benchmark) -> tuple[DataFrame, DataFrame]:
    """Scores predicted against submitted labels and lists the bases that speak against the submitted ones."""
    _, snp_rules, _ = _scheme(spark, c.in_scheme)
    g = tables.read_tsv(spark, c.in_genotype).select("sample_id", F.coalesce(F.col(c.submitted_genotype_col), F.lit("")).alias("submitted"), F.coalesce(F.col(c.predicted_genotype_col), F.lit("")).alias("predicted"))
    scores = evaluate.f1_scores(g)
    calls = vcf.read_calls(spark, c.in_var, snp_rules.select("pos").distinct())
    bad = evaluate.problem_bases(g, calls, rules.allowed_bases(snp_rules))
    run = {"scheme": F.lit(os.path.basename(c.in_scheme)), "analysis_date": reports.now()}
    scores = scores.withColumns(run).orderBy(F.col("label") != "overall", "label").select(*reports.SCORE)
    each = g.withColumns({**run, "is_match": reports.truth(F.col("submitted") == F.col("predicted"))}).join(bad, "sample_id", "left")
    names = {"submitted_genotype": "submitted", "predicted_genotype": "predicted", "problem_feature(s)": "problem_features"}
    each = each.orderBy("sample_id").select(*(F.col(names.get(x, x)).alias(x) for x in reports.RESULT))
    tables.write_tsv(scores, f"{c.outdir}/{c.prefix}-scheme.scores.txt")
    tables.write_tsv(each, f"{c.outdir}/{c.prefix}-sample.results.txt")
    return scores, each


def namer(spark: SparkSession, c: Namer) -> DataFrame:
    """Renames nodes in the genotype columns of a scheme by a table of node and name."""
    s = tables.read_tsv(spark, c.in_scheme).withColumn("_at", F.monotonically_increasing_id())
    names = tables.read_metadata(spark, c.in_names, "node").select("node", "name")
    columns = s.columns
    for column in ("positive_genotypes", "partial_genotypes"):
        s = evaluate.rename(s.withColumn(column, F.coalesce(column, F.lit(""))), column, "_at", names)
    out = s.orderBy("_at").select(*columns).drop("_at")
    tables.write_tsv(out, c.outfile)
    return out
