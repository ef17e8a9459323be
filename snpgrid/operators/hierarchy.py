"""Hierarchies as path arrays: memberships, genotype strings, adjacency, compression, delimiter detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: candidate delimiters in order of preference
DELIMITERS = ("-", ":", ";", ".", "/", "|", ",", " ")


def membership(samples: DataFrame) -> DataFrame:
    """(clade, depth, sample_id, ord): every sample under every node of its path."""
    return samples.select("sample_id", "ord", F.posexplode("path").alias("p", "clade")).select("clade", (F.col("p") + 1).alias("depth"), "sample_id", "ord")


def prefixes(genotype: Column, delimiter: str = ".") -> Column:
    """All prefixes of a delimited path."""
    parts = F.split(genotype, "\\Q" + delimiter + "\\E")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), delimiter))


def prefix_membership(groups: DataFrame, delimiter: str = ".") -> DataFrame:
    return groups.select("sample_id", F.explode(prefixes(F.col("genotype"), delimiter)).alias("node"))


def delimiter_counts(groups: DataFrame) -> DataFrame:
    """(delimiter, rank, n) of each candidate over all genotypes."""
    sums = groups.agg(*(F.sum(F.length("genotype") - F.length(F.replace("genotype", F.lit(d)))).alias(f"d{i}") for i, d in enumerate(DELIMITERS)))
    rows = F.array(*(F.struct(F.lit(d).alias("delimiter"), F.lit(i).alias("rank"), F.coalesce(f"d{i}", F.lit(0)).alias("n")) for i, d in enumerate(DELIMITERS)))
    return sums.select(F.inline(rows))


def detect_delimiter(groups: DataFrame) -> DataFrame:
    """The most frequent candidate; ties by order of preference."""
    return delimiter_counts(groups).agg(F.max_by("delimiter", F.struct("n", -F.col("rank"))).alias("delimiter"))


def node_counts(samples: DataFrame) -> DataFrame:
    return membership(samples).groupBy("clade").agg(F.count("*").alias("num_members"))


def genotype_of(path: Column, valid: Column, delimiter: str = ".") -> Column:
    """Path filtered to an array of valid nodes, as a string."""
    return F.array_join(F.array_intersect(path, valid), delimiter)


def genotypes(samples: DataFrame, valid: DataFrame, delimiter: str = ".") -> DataFrame:
    """(sample_id, genotype): each path reduced to the nodes in ``valid`` (clade); empty if none is."""
    kept = membership(samples).join(valid.select("clade"), "clade", "left_semi")
    named = kept.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("depth", "clade"))).alias("p"))
    return samples.select("sample_id").join(named, "sample_id", "left").select("sample_id", F.coalesce(F.array_join("p.clade", delimiter), F.lit("")).alias("genotype"))


def reduced(samples: DataFrame, valid: DataFrame) -> DataFrame:
    """(sample_id, path): each path reduced to the nodes in ``valid`` (clade); samples without any are left out."""
    kept = membership(samples).join(valid.select("clade"), "clade", "left_semi")
    return kept.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("depth", "clade"))).alias("p")).select("sample_id", F.col("p.clade").alias("path"))


def node_paths(samples: DataFrame, delimiter: str = ".") -> DataFrame:
    """(clade, path): each node with its ancestors from the root on."""
    steps = F.transform("path", lambda x, i: F.struct(x.alias("clade"), F.array_join(F.slice("path", F.lit(1), i + 1), delimiter).alias("path")))
    return samples.select(F.explode(steps).alias("n")).select("n.clade", "n.path").distinct()


def edges(samples: DataFrame) -> DataFrame:
    """Distinct (parent, child) pairs along the paths."""
    pairs = F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("parent"), F.slice("path", 2, F.size("path")).alias("child"))
    return samples.select(F.explode(pairs).alias("e")).where("e.parent IS NOT NULL AND e.child IS NOT NULL").select("e.parent", "e.child").distinct()


def bifurcating(samples: DataFrame) -> DataFrame:
    return edges(samples).groupBy("parent").agg(F.count("*").alias("n_children")).where("n_children > 1").select(F.col("parent").alias("clade"), "n_children")


def terminal(samples: DataFrame) -> DataFrame:
    return samples.select(F.element_at("path", -1).alias("clade")).distinct()


def distance_bins(nodes: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(bin, threshold, clade): a node is in each bin whose threshold its distance does not exceed."""
    w = Window.orderBy("threshold")
    numbered = thresholds.select("threshold", (F.row_number().over(w) - 1).alias("bin"))  # ten thresholds at most
    return nodes.join(numbered, F.col("dist") <= F.col("threshold")).select("bin", "threshold", "clade")


def partition_thresholds(values: DataFrame, value: str, bins: int = 10, n: str | None = None) -> DataFrame:
    """About ten thresholds of a small value table: a bin closes once it holds more than a tenth of the values and the value rises.

    The fold runs over distinct values with counts, so its length is the number of distinct distances.  Each row of ``values`` stands for as many values as its
    ``n`` says, for one without it.
    """
    counts = values.groupBy(value).agg((F.sum(n) if n else F.count("*")).alias("count"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), F.col("count").alias("n"))))
    got = counts.agg(rows.alias("rows"), F.sum("count").alias("total"))
    start = F.struct(F.array().cast("array<double>").alias("ends"), F.lit(0).cast("long").alias("held"), F.lit(None).cast("double").alias("last"))

    def step(acc: Column, x: Column, target: Column) -> Column:
        full = acc["held"] > target
        ends = F.when(full, F.concat(acc["ends"], F.array(acc["last"]))).otherwise(acc["ends"])
        return F.struct(ends.alias("ends"), (F.when(full, F.lit(0)).otherwise(acc["held"]) + x["n"]).alias("held"), x["v"].alias("last"))

    target = F.floor(F.col("total") / bins)
    folded = got.select(F.aggregate("rows", start, lambda a, x: step(a, x, target), lambda a: F.concat(a["ends"], F.array(a["last"]))).alias("ends"))
    return folded.select(F.explode("ends").alias("threshold")).where("threshold IS NOT NULL").distinct()


def redundant_nodes(samples: DataFrame, bins: DataFrame) -> DataFrame:
    """Children that do not bifurcate and share a bin with their parent."""
    a, b = bins.select("bin", F.col("clade").alias("parent")), bins.select("bin", F.col("clade").alias("child"))
    shared = edges(samples).join(a, "parent").join(b, ["bin", "child"]).select(F.col("child").alias("clade")).distinct()
    return shared.join(bifurcating(samples), "clade", "left_anti")


def close_nodes(nodes: DataFrame, least: int) -> DataFrame:
    """Nodes nearer than ``least`` to another clade, and those clades."""
    near = nodes.where(F.col("closest_clade_dist") < least)
    return near.select("clade").union(near.select("closest_clade_id")).distinct()
