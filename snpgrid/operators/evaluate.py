"""Scoring calls against known labels; renaming labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sites import called


def about(predicted: Column, submitted: Column, name: Column, mode: str = "substring") -> Column:
    """Whether a row concerns a label: as a substring of either label, or exactly."""
    if mode == "exact":
        return (predicted == name) | (submitted == name)
    return F.contains(predicted, name) | F.contains(submitted, name)


def include(labels: DataFrame, name: str, mode: str = "substring") -> DataFrame:
    return labels.where(about(F.col("predicted"), F.col("submitted"), F.lit(name), mode))


def exclude(labels: DataFrame, name: str, mode: str = "substring") -> DataFrame:
    return labels.where(~about(F.col("predicted"), F.col("submitted"), F.lit(name), mode))


def label_counts(labels: DataFrame, field: str) -> DataFrame:
    return labels.groupBy(field).agg(F.count("*").alias("n"))


def f1_scores(labels: DataFrame, mode: str = "substring") -> DataFrame:
    """(label, num_submitted, num_predicted, f1_score): micro-F1 overall, then over the rows about each label; 0 where a label is missing on either side."""
    right = (F.col("predicted") == F.col("submitted")).cast("double")
    overall = labels.agg(F.lit("overall").alias("label"), F.count("*").alias("num_submitted"), F.count("*").alias("num_predicted"), F.avg(right).alias("f1_score"))
    names = labels.select(F.col("submitted").alias("label")).union(labels.select("predicted")).distinct()
    # label pairs are few; rows are first reduced to counts of (submitted, predicted)
    cells = labels.groupBy("submitted", "predicted").agg(F.count("*").alias("k"))
    rows = names.join(cells, about(F.col("predicted"), F.col("submitted"), F.col("label"), mode))
    each = rows.groupBy("label").agg(F.sum(F.when(F.col("submitted") == F.col("label"), F.col("k")).otherwise(0)).alias("num_submitted"), F.sum(F.when(F.col("predicted") == F.col("label"), F.col("k")).otherwise(0)).alias("num_predicted"), (F.sum(F.when(F.col("submitted") == F.col("predicted"), F.col("k")).otherwise(0)) / F.sum("k")).alias("f1"))
    none = (F.col("num_submitted") == 0) | (F.col("num_predicted") == 0)
    each = each.select("label", F.when(none, 0).otherwise(F.col("num_submitted")).alias("num_submitted"), F.when(none, 0).otherwise(F.col("num_predicted")).alias("num_predicted"), F.when(none, 0.0).otherwise(F.col("f1")).alias("f1_score"))
    return overall.unionByName(each)


def problem_bases(labels: DataFrame, calls: DataFrame, allowed: DataFrame) -> DataFrame:
    """For wrongly predicted samples the called bases that their submitted genotype does not allow, as pos:base, sorted by position."""
    wrong = labels.where("predicted <> submitted").select("sample_id", F.col("submitted").alias("genotype"))
    rows = calls.where(called(F.col("base"))).select("sample_id", "pos", "base").join(wrong, "sample_id").join(allowed, ["genotype", "pos"])
    bad = rows.where(~F.array_contains("allowed", F.col("base"))).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: F.concat((x["pos"] + 1).cast("string"), F.lit(":"), x["base"])), ",")
    return wrong.join(bad, "sample_id", "left").select("sample_id", F.coalesce(text, F.lit("")).alias("problem_features"))


def rename(df: DataFrame, column: str, key: str, names: DataFrame, separator: str = ",") -> DataFrame:
    """Renames each member of a delimited column by ``names`` (node, name); unknown members and their order stay."""
    parts = df.select(key, F.posexplode(F.split(column, separator)).alias("i", "node"))
    one = names.groupBy("node").agg(F.max("name").alias("name"))
    done = parts.join(one, "node", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("name", "node").alias("x")))).alias("p"))
    return df.drop(column).join(done, key, "left").withColumn(column, F.array_join("p.x", separator)).drop("p")


def missing_ids(inputs: dict[str, DataFrame]) -> DataFrame:
    """(input, sample_id): ids that some input has and this one lacks."""
    union = None
    for df in inputs.values():
        own = df.select("sample_id")
        union = own if union is None else union.union(own)
    union = union.distinct()
    out = None
    for name, df in inputs.items():
        gone = union.subtract(df.select("sample_id")).select(F.lit(name).alias("input"), "sample_id")
        out = gone if out is None else out.union(gone)
    return out


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last in file order."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
