"""The corpus pipeline: each stage takes the documents that its predecessor kept, and its decisions take effect.

A decision belongs to a row's doc_id together with its text (a hash of it), so rows that share an id, or have none, are judged each by its own text.
All stages but the last return the columns of their input, whatever their names; rows that agree in id and text share their fate;
a null text is an empty one; texts of any length are read whole; an empty table gives an empty result.  Stages are lazy about nothing that a
lost executor could lose: what they decide on is written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from snpgrid.llm.common import Scratch, lower_az
from snpgrid.llm.decontaminate import contamination
from snpgrid.llm.exact_dedup import exact_duplicates
from snpgrid.llm.mixing import mix
from snpgrid.llm.near_dedup import near_duplicates
from snpgrid.llm.toxicity import THRESHOLD, fit, scores


def _whole(docs: DataFrame) -> DataFrame:
    """Each row as one struct, beside its id and text, so that no name of a column can clash with one of ours."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def _dropping(docs: DataFrame, decisions: DataFrame, reject: Column, key: str, text_key: Column) -> DataFrame:
    """Rows of ``docs`` that no rejected decision names; ``key``: the decisions' hash of a text, ``text_key``: the same of a row."""
    scratch = Scratch(docs.sparkSession, "stage")
    gone = scratch.cut(decisions.where(reject).select(F.col("doc_id").alias("_id"), F.col(key).alias("_key")).distinct(), "rejected")
    rows = _whole(docs).withColumn("key", text_key)
    kept = rows.join(gone.hint("merge"), rows["doc_id"].eqNullSafe(gone["_id"]) & (rows["key"] == gone["_key"]), "left_anti")
    return kept.select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  A score depends on the text alone; null and empty texts stay; ties at the threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    # where the row holds its text as a string, tasks get it once
    once = docs.select("text").schema[0].dataType == StringType()
    scored = scores(_whole(docs).select("row") if once else _whole(docs).select("row", "text"), fit(docs, labels))
    return scored.where(F.col("score") < THRESHOLD).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in either case, null as empty) the row of largest doc_id stays; rows without id lose to any other, repeated rows of the largest id all stay."""
    text = F.lower(F.sha2(lower_az(F.coalesce("text", F.lit(""))), 256))
    return _dropping(docs, exact_duplicates(docs, keep="max"), ~F.col("kept"), "text_sha256", text)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of linked documents the one of smallest doc_id stays; documents without words are linked with nothing and stay."""
    return _dropping(docs, near_duplicates(docs), ~F.col("kept"), "text_hash", F.xxhash64("text"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return _dropping(docs, contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), F.col("contaminated"), "text_hash", F.xxhash64("text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's rate says; rows of one id draw alike, a null source is one of its own."""
    return mix(docs)


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminated), ("mixing", mixed)]

#: Toxicity scores and MinHash components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return reduce(lambda d, stage: scratch.cut(stage[1](spark, d, sf_dir), stage[0]), STAGES, docs)
