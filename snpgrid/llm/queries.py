"""The registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import oracles
from .archive import read_archive, write_archive
from .common import Scratch
from .decontaminate import contamination
from .exact_dedup import exact_duplicates
from .mixing import mix_plan
from .near_dedup import near_duplicates
from .ngram_join import ngram_join
from .pii import KINDS as PII_KINDS
from .pii import find_pii
from .quality import resample
from .runs import periodic_runs
from .secrets import KINDS as SECRET_KINDS
from .secrets import find_secrets
from .substring_dedup import drop_repeats
from .target_resample import target_resample
from .toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _span_columns(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, a count of base spans per kind, the digest of the base spans and all spans as text."""
    named = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_columns(find_pii(table(spark, sf_dir, "documents")), PII_KINDS)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_columns(find_secrets(table(spark, sf_dir, "documents")), SECRET_KINDS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op3")
    write_archive(table(spark, sf_dir, "pages"), scratch.path("archive"))
    records = read_archive(spark, scratch.path("archive"))
    scratch.drop("archive")  # its candidates are a written table by now
    return records.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return resample(table(spark, sf_dir, "documents"), good)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).drop("n_links", "text_hash")


def op12_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(table(spark, sf_dir, "documents"), plant=True)
    run = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size(run) > 0, F.concat(F.array_join(run, "\n"), F.lit("\n"))).otherwise("")

    def larger(best: Column, r: Column) -> Column:
        """Of two runs the one of larger length/period; the runs come by start, then period."""
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    best = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), larger)
    rows = rows.withColumn("best", best)
    milli = F.expr("best.length * 1000 div best.period")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), "collapsed_sha256")


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_near_dedup": op2_near_dedup,
    "op3_warc": op3_warc,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_secrets": op10_secrets,
    "op11_ngram_join": op11_ngram_join,
    "op12_target_resample": op12_target_resample,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_near_dedup": oracles.OP2,
    "op3_warc": oracles.OP3,
    "op4_exact_dedup": oracles.OP4,
    "op5_decontaminate": oracles.OP5,
    "op7_mixing": oracles.OP7,
    "op9_substring_dedup": oracles.OP9,
    "op11_ngram_join": oracles.OP11,
    "op12_target_resample": oracles.OP12,
    "op13_periodic_runs": oracles.OP13,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
