"""Layouts of the report files: fixed columns, values as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: columns of the clade report, the SNP report, the calls, the scores and the results by sample
CLADE = (
    "clade_id", "pos", "base", "min_dist", "max_dist", "ave_dist", "num_members", "is_valid", "is_selected", "total_within_clade_dist",
    "num_comparisons_within_clade_dist", "ave_within_clade_dist", "closest_clade_id", "closest_clade_dist", "closest_sample_id", "closest_sample_dist",
    "clade_sample_id", "spearmanr", "spearmanr_pvalue", "pearsonr", "pearsonr_pvalue", "is_temporal_signal_present", "field_name", "fisher_oddsr", "fisher_p",
)
SNP = ("chrom", "pos", "base", "clade_id", "is_canonical", "num_positive_clade_members", "num_total_clade_members", "is_ref", "oddsr", "p_value")
CALL = ("sample_id", "scheme", "analysis_date", "total_scheme_features", "unique_scheme_positions", "num_detected_positions", "predicted_genotype", "predicted_genotype_distance", "qc_status", "qc_messages", "detected_alt_mutations")
SCORE = ("label", "scheme", "analysis_date", "num_submitted", "num_predicted", "f1_score")
RESULT = ("sample_id", "scheme", "analysis_date", "submitted_genotype", "predicted_genotype", "is_match", "problem_feature(s)")


def now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def truth(c: str | Column) -> Column:
    """True or False as a word."""
    return F.initcap(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False)).cast("string"))


def _or(c: str, default: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(default)).alias(c)


def last_value(meta: DataFrame, fields: list[str]) -> tuple[str, str] | None:
    """(field, value) that the clade report shows: of the last field the value that appears last for the first time."""
    if not fields:
        return None
    seen = meta.withColumn("_at", F.monotonically_increasing_id()).groupBy(F.col(fields[-1]).alias("v")).agg(F.min("_at").alias("at"))
    row = seen.orderBy(F.col("at").desc()).limit(1).collect()
    return (fields[-1], row[0]["v"]) if row else None


def clade_report(nodes: DataFrame, snps: DataFrame, flags: DataFrame, temporal: DataFrame | None, fisher: DataFrame | None, shown: tuple[str, str] | None, root: str) -> DataFrame:
    """A row a clade and SNP (clade, pos 0-based, base) in the fixed columns; the root is compared with nothing outside it."""
    rows = snps.join(nodes, "clade").join(flags, "clade", "left")
    if temporal is not None:
        rows = rows.join(temporal.select("clade", "pearson", "pearson_p", "spearman", "spearman_p", "is_temporal"), "clade", "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("pearson", "pearson_p", "spearman", "spearman_p")}).withColumn("is_temporal", F.lit(False))
    if fisher is not None and shown is not None:
        rows = rows.join(fisher.where((F.col("field") == shown[0]) & (F.col("value") == shown[1])).select("clade", "oddsr", "p"), "clade", "left")
    else:
        rows = rows.withColumns({"oddsr": F.lit(None).cast("double"), "p": F.lit(None).cast("double")})
    none = lambda c: F.when(F.col("clade") == root, F.lit("None")).otherwise(F.coalesce(F.col(c), F.lit("None")))
    odds = F.when(F.col("oddsr") == float("inf"), "inf").when(F.isnan("oddsr"), "nan").otherwise(F.col("oddsr").cast("string"))
    values = {
        "clade_id": F.col("clade"), "pos": F.col("pos") + 1, "min_dist": F.lit(0), "max_dist": F.lit(0), "ave_dist": F.lit(0),
        "is_valid": truth("is_valid"), "is_selected": truth("is_selected"), "total_within_clade_dist": _or("total_within", "0"), "num_comparisons_within_clade_dist": _or("n_within", "0"),
        "ave_within_clade_dist": _or("ave_within", "0"), "closest_clade_id": none("closest_clade_id"), "closest_clade_dist": _or("closest_sample_dist", "0"),
        "closest_sample_id": none("closest_sample_id"), "closest_sample_dist": _or("closest_sample_dist", "0"), "clade_sample_id": none("clade_sample_id"),
        "spearmanr": _or("spearman", "0"), "spearmanr_pvalue": _or("spearman_p", "1"), "pearsonr": _or("pearson", "0"), "pearsonr_pvalue": _or("pearson_p", "1"),
        "is_temporal_signal_present": truth("is_temporal"), "field_name": F.lit(shown[1] if shown else ""), "fisher_oddsr": F.coalesce(odds, F.lit("nan" if shown else "")), "fisher_p": F.coalesce(F.col("p").cast("string"), F.lit("1" if shown else "")),
    }
    return rows.orderBy("clade", "pos").select(*(values.get(c, F.col(c)).alias(c) for c in CLADE))


def snp_report(assigned: DataFrame, refs: DataFrame) -> DataFrame:
    rows = assigned.join(refs.select("chrom", "pos", "ref").distinct(), ["chrom", "pos"], "left").orderBy("chrom", "pos", "base")
    values = {"pos": F.col("pos") + 1, "clade_id": F.coalesce("clade", F.lit("")), "is_canonical": truth("is_canonical"), "num_positive_clade_members": F.col("num_clade_members"), "num_total_clade_members": F.col("num_members"), "is_ref": truth(F.col("base") == F.col("ref"))}
    return rows.select(*(values.get(c, F.col(c)).alias(c) for c in SNP))
