"""Genotyping tables derived from the star-schema tables by integer arithmetic, and the same as SQL for the oracles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Domain:
    """samples(sample_id, ord, path, host, location, year), calls(chrom, pos, ref, sample_id, base), seqs(seq_id, seq).

    ``calls`` is of a scheme's size, 200 positions and the clades' marks; ``all_calls`` has a position for each part, so sites grow with the tables.
    """

    samples: DataFrame
    calls: DataFrame
    seqs: DataFrame
    all_calls: DataFrame


#: First position of the parts in ``all_calls``, behind those of the clades' marks.
PARTS_FROM = 3000


def load(spark: SparkSession, sf_dir: str) -> Domain:
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    s = _table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    text = lambda *parts: F.concat(*(F.col(p).cast("string") if p in ("n_regionkey", "s_nationkey", "parity") else F.lit(p) for p in parts))
    s = s.withColumn("parity", F.col("s_suppkey") % 2)
    path = F.array(F.lit("0"), text("r", "n_regionkey"), text("n", "s_nationkey"), text("b", "s_nationkey", "_", "parity"))
    samples = s.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sample_id"), F.col("s_suppkey").alias("ord"), path.alias("path"), F.col("s_nationkey").alias("nation"), F.col("n_regionkey").alias("region"),
        (F.col("s_suppkey") % 4).cast("string").alias("host"), F.col("r_name").alias("location"), (2010 + F.col("s_suppkey") % 11).cast("int").alias("year"),
    )

    letter = lambda n: F.substring(F.lit("ACGT"), (1 + n % 4).cast("int"), F.lit(1))
    def noise(pos: Column) -> DataFrame:
        rows = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey", pos.cast("int").alias("pos")).agg(F.sum("l_linenumber").alias("n"))
        return rows.select(F.lit("1").alias("chrom"), "pos", letter(F.col("pos")).alias("ref"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("sample_id"), letter(F.col("n")).alias("base"))

    marks = nation.select((1000 + F.col("n_nationkey")).cast("int").alias("pos"), F.lit("A").alias("ref"), F.lit("T").alias("alt"), F.col("n_nationkey").alias("own"), F.lit(True).alias("by_nation"))
    marks = marks.union(region.select((2000 + F.col("r_regionkey")).cast("int"), F.lit("C"), F.lit("G"), F.col("r_regionkey"), F.lit(False)))
    own = F.when(F.col("by_nation"), F.col("nation")).otherwise(F.col("region")) == F.col("own")
    signal = samples.crossJoin(marks).select(F.lit("1").alias("chrom"), "pos", "ref", "sample_id", F.when(own, F.col("alt")).otherwise(F.col("ref")).alias("base"))

    kept = F.regexp_replace(F.upper("text"), "[^ACGT]+", "")
    seqs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), kept.alias("seq"))
    return Domain(samples, noise(F.col("l_partkey") % 200).unionByName(signal), seqs, noise(F.col("l_partkey") + PARTS_FROM).unionByName(signal))


#: The same tables for DuckDB; oracles append their own CTEs.
CTE = """
WITH samples AS (
  SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS sample_id, s_suppkey AS ord,
         ['0', 'r' || n_regionkey, 'n' || s_nationkey, 'b' || s_nationkey || '_' || (s_suppkey % 2)] AS path, s_nationkey AS nation, n_regionkey AS region,
         CAST(s_suppkey % 4 AS VARCHAR) AS host, r_name AS location, CAST(2010 + s_suppkey % 11 AS INT) AS year
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
calls AS (
  SELECT '1' AS chrom, pos, substr('ACGT', 1 + pos % 4, 1) AS ref, 'S' || CAST(l_suppkey AS VARCHAR) AS sample_id, substr('ACGT', CAST(1 + n % 4 AS INT), 1) AS base
  FROM (SELECT l_suppkey, CAST(l_partkey % 200 AS INT) AS pos, sum(l_linenumber) AS n FROM lineitem GROUP BY 1, 2)
  UNION ALL SELECT '1', CAST(1000 + n_nationkey AS INT), 'A', sample_id, CASE WHEN nation = n_nationkey THEN 'T' ELSE 'A' END FROM samples, nation
  UNION ALL SELECT '1', CAST(2000 + r_regionkey AS INT), 'C', sample_id, CASE WHEN region = r_regionkey THEN 'G' ELSE 'C' END FROM samples, region),
all_calls AS (
  SELECT '1' AS chrom, pos, substr('ACGT', 1 + pos % 4, 1) AS ref, 'S' || CAST(l_suppkey AS VARCHAR) AS sample_id, substr('ACGT', CAST(1 + n % 4 AS INT), 1) AS base
  FROM (SELECT l_suppkey, CAST(l_partkey + 3000 AS INT) AS pos, sum(l_linenumber) AS n FROM lineitem GROUP BY 1, 2) UNION ALL SELECT * FROM calls WHERE pos >= 1000),
seqs AS (SELECT doc_id AS seq_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents),
membership AS (
  SELECT path[d] AS clade, d AS depth, sample_id, ord FROM samples, (SELECT unnest([1, 2, 3, 4]) AS d)),
genotypes AS (SELECT sample_id, ord, array_to_string(path[1:3], '.') AS genotype FROM samples)
"""
