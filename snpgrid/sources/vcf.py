"""VCF files as long calls, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sites import decode_allele

# fixed values: the columns of a VCF record that are no samples, in order
REQUIRED = ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


def header(spark: SparkSession, path: str) -> list[str]:
    """Fields of the #CHROM line; an error if there is none."""
    row = spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(1).collect()
    if not row:
        raise ValueError(f"{path} has no #CHROM line")
    return row[0][0].rstrip("\r").split("\t")


def sample_ids(spark: SparkSession, path: str) -> list[str]:
    """Sample columns in order, each once."""
    return list(dict.fromkeys(f for f in header(spark, path) if f not in REQUIRED))


def read_calls(spark: SparkSession, path: str, positions: DataFrame | None = None) -> DataFrame:
    """calls(chrom, pos (0-based), ref, sample_id, base): one row per record and sample column; with ``positions`` (pos) only records there are split into cells.

    Sample columns are joined by their number, so the plan does not grow with the samples; of columns with one name the last counts.
    """
    names = header(spark, path)
    at = {n: i for i, n in enumerate(names)}
    if missing := [c for c in ("#CHROM", "POS", "REF", "ALT") if c not in at]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    samples = spark.createDataFrame([(i, n) for n, i in at.items() if n not in REQUIRED], "_column int, sample_id string")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0)).select(F.split(F.rtrim("value"), "\t").alias("f"))
    field = lambda c: F.get("f", F.lit(at[c]))
    rows = rows.select(field("#CHROM").alias("chrom"), (field("POS").cast("int") - 1).alias("pos"), field("REF").alias("ref"), field("ALT").alias("alt"), "f")
    if positions is not None:
        rows = rows.join(positions.select("pos").distinct(), "pos", "left_semi")
    # rows that lack cells at their end have them as missing ones
    cells = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.get("f", i))
    long = rows.select("chrom", "pos", "ref", "alt", F.posexplode(cells).alias("_column", "cell")).join(F.broadcast(samples), "_column")  # a row a column of the header line
    gt = F.split(F.coalesce("cell", F.lit(".")), ":")
    return long.select("chrom", "pos", "ref", "sample_id", decode_allele(F.get(gt, F.lit(0)), F.col("ref"), F.col("alt")).alias("base"))


def filter_file(spark: SparkSession, path: str, removed: DataFrame, out: str) -> None:
    """Writes a file's lines in their order, without the records at the removed sites (chrom, pos 0-based)."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    lines = lines.withColumn("chrom", F.get(parts, F.lit(0))).withColumn("pos", F.get(parts, F.lit(1)).try_cast("int") - 1)
    kept = lines.join(removed.select("chrom", "pos"), ["chrom", "pos"], "left_anti").where(~F.col("value").startswith("#"))
    head = lines.where(F.col("value").startswith("#"))
    head.unionByName(kept.select(*head.columns)).orderBy("at").select("value").write.mode("overwrite").text(out)


def write_calls(calls: DataFrame, samples: list[str], out: str) -> None:
    """Calls as VCF lines in site order; absent cells are ``.``."""
    alts = calls.where("base <> ref AND base IN ('A', 'C', 'G', 'T', '-')").groupBy("chrom", "pos").agg(F.array_sort(F.collect_set("base")).alias("alts"))
    cells = calls.groupBy("chrom", "pos", "ref").agg(F.map_from_entries(F.collect_list(F.struct("sample_id", "base"))).alias("m")).join(alts, ["chrom", "pos"], "left")
    number = lambda s: F.when(F.try_element_at("m", F.lit(s)) == F.col("ref"), "0").when(F.array_position("alts", F.try_element_at("m", F.lit(s))) > 0, F.array_position("alts", F.try_element_at("m", F.lit(s))).cast("string")).otherwise(".")
    alt = F.when(F.size("alts") > 0, F.array_join("alts", ",")).otherwise(".")
    line = F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), F.lit("."), "ref", alt, F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), *(number(s) for s in samples))
    spark = calls.sparkSession
    head = spark.createDataFrame([(0, "", 0, "##fileformat=VCFv4.2"), (0, "", 1, "\t".join([*REQUIRED, *samples]))], "k int, chrom string, pos int, value string")
    head.union(cells.select(F.lit(1), "chrom", "pos", line.alias("value"))).orderBy("k", "chrom", "pos").select("value").write.mode("overwrite").text(out)
