"""Tab-separated inputs: metadata, group manifests, schemes, distance matrices; file checks; sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import last_per_key
from ..operators.hierarchy import detect_delimiter

#: Bytes below which an input file counts as empty.
LEAST_BYTES = 32


def check_file(path: str, least: int = LEAST_BYTES) -> None:
    """An error unless the file exists and holds more than ``least`` bytes (local paths; others are left to Spark)."""
    if "://" in path:
        return
    if not os.path.exists(path) or (os.path.isfile(path) and os.path.getsize(path) <= least):
        raise ValueError(f"{path} is missing or empty")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, so labels such as 0.10 keep their form; empty fields are null."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False)


def read_metadata(spark: SparkSession, path: str, key: str = "sample_id") -> DataFrame:
    """Metadata by key, of equal keys the last row; no rows if the key column is missing.  Missing values are the text ``nan``."""
    df = read_tsv(spark, path)
    if key not in df.columns:
        return df.limit(0)
    held = last_per_key(df.withColumn("_at", F.monotonically_increasing_id()), key, "_at").drop("_at")
    return held.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("nan")).alias(c) if c != key else F.col(c) for c in held.columns))


def read_groups(spark: SparkSession, path: str, delimiter: str | None = None) -> tuple[DataFrame, str]:
    """(samples with paths, delimiter): a manifest of sample_id and genotype; the delimiter is detected unless given."""
    df = read_tsv(spark, path).select("sample_id", "genotype").withColumn("ord", F.monotonically_increasing_id())
    delimiter = delimiter or detect_delimiter(df).first()[0]
    return df.withColumn("path", F.split("genotype", "\\Q" + delimiter + "\\E")), delimiter


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """(s1, s2, d) of a square matrix file, upper triangle in column order."""
    df = read_tsv(spark, path)
    names = df.columns[1:]
    order = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i))) if names else None
    long = df.select(F.col(f"`{df.columns[0]}`").alias("s1"), *(F.col(f"`{n}`").cast("long").alias(n) for n in names)).unpivot(["s1"], names, "s2", "d")
    return long.where(F.element_at(order, F.col("s1")) < F.element_at(order, F.col("s2")))


def write_tsv(df: DataFrame, path: str, single: bool = True) -> None:
    """A table as TSV, by default in one file (reports are of scheme or sample size)."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", nullValue="")


def write_distances(dist: DataFrame, samples: DataFrame, path: str) -> None:
    """The square matrix of a distance table as TSV: a row's cells are one ordered array, so the samples are not columns of a plan."""
    ids = [r[0] for r in samples.orderBy("ord").select("sample_id").collect()]
    both = dist.unionByName(dist.select(F.col("s2").alias("s1"), F.col("s1").alias("s2"), "d")).unionByName(samples.select(F.col("sample_id").alias("s1"), F.col("sample_id").alias("s2"), F.lit(0).cast("long").alias("d")))
    at = samples.select(F.col("sample_id").alias("s2"), F.col("ord").alias("_column"))
    cells = both.join(at, "s2").groupBy("s1").agg(F.array_sort(F.collect_list(F.struct("_column", "d"))).alias("cells"))
    lines = cells.join(samples.select(F.col("sample_id").alias("s1"), F.col("ord").alias("_row")), "s1")
    lines = lines.select("_row", F.concat_ws("\t", "s1", F.array_join(F.transform("cells", lambda c: c["d"].cast("string")), "\t")).alias("value"))
    head = dist.sparkSession.createDataFrame([(-1, "\t".join(["dists", *ids]))], "_row long, value string")
    head.unionByName(lines).coalesce(1).sortWithinPartitions("_row").select("value").write.mode("overwrite").text(path)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def write_params(spark: SparkSession, params: dict[str, object], path: str) -> None:
    rows = [(f"{k}\t{v}",) for k, v in params.items()] or [("",)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(path)


def write_fasta(seqs: DataFrame, path: str, name: str = "seq_id", seq: str = "seq") -> None:
    seqs.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq): the word after ``>`` and the upper-cased sequence without white space."""
    rows = spark.read.text(path, lineSep=">").where(F.length(F.trim("value")) > 0)
    parts = F.split("value", "\n", 2)
    return rows.select(F.get(F.split(F.trim(F.get(parts, F.lit(0))), r"\s+"), F.lit(0)).alias("seq_id"), F.upper(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "")).alias("seq"))


def write_histogram_html(spark: SparkSession, hist: DataFrame, path: str, title: str = "Pairwise distances") -> None:
    """A bar chart of a histogram (d, n) as one HTML file with inline SVG; distinct distances are few."""
    rows = hist.orderBy("d").collect()
    top, last = max((r["n"] for r in rows), default=1), max((r["d"] for r in rows), default=0) + 1
    bars = "".join(f'<rect x="{800 * r["d"] / last:.2f}" y="{300 - 300 * r["n"] / top:.2f}" width="{max(800 / last, 0.5):.2f}" height="{300 * r["n"] / top:.2f}"><title>{r["d"]}: {r["n"]}</title></rect>' for r in rows)
    html = f"<html><head><title>{title}</title></head><body><h1>{title}</h1><svg width='800' height='300'>{bars}</svg></body></html>"
    spark.createDataFrame([(html,)], "value string").coalesce(1).write.mode("overwrite").text(path)
