"""Whole sequences from a reference and sparse variants; only sinks need them, and they are never rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bases of a line of FASTA, and of a tile: a whole number of lines.
LINE, TILE = 60, 60 * 1024


def pseudo_tiles(samples: DataFrame, variants: DataFrame, reference: str, tile: int = TILE) -> DataFrame:
    """(ord, sample_id, tile, bases): tiles of the reference with each sample's variants (sample_id, pos 0-based, base) in them.

    Samples (ord, sample_id) without variants give the reference; of several variants at a place the first in alphabetical order counts.  A position at or
    beyond the end of the reference is an error.  A tile's variants are joined by sample and tile, so a row never holds more than a tile.
    """
    spark = samples.sparkSession
    if bad := variants.where((F.col("pos") < 0) | (F.col("pos") >= len(reference))).limit(1).collect():
        raise ValueError(f"position {bad[0]['pos'] + 1} of {bad[0]['sample_id']} is beyond the reference")
    tiles = spark.createDataFrame([(i // tile, reference[i : i + tile]) for i in range(0, len(reference), tile)], "tile long, ref string")
    one = variants.groupBy("sample_id", "pos").agg(F.min("base").alias("base"))
    at = F.struct((F.col("pos") % tile).cast("int").alias("at"), "base")
    own = one.groupBy("sample_id", F.floor(F.col("pos") / tile).alias("tile")).agg(F.array_sort(F.collect_list(at)).alias("v"))
    rows = samples.select("ord", "sample_id").join(tiles).join(own, ["sample_id", "tile"], "left")  # every tile of every sample is written
    after = lambda i: F.when(i > 0, F.col("v")[i - 1]["at"] + 1).otherwise(0)
    parts = F.transform("v", lambda x, i: F.concat(F.substring("ref", after(i) + 1, x["at"] - after(i)), x["base"]))
    tail = F.substring("ref", F.element_at("v", -1)["at"] + 2, F.lit(tile))
    return rows.select("ord", "sample_id", "tile", F.when(F.size("v") > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col("ref")).alias("bases"))


def write_pseudo_fasta(samples: DataFrame, variants: DataFrame, reference: str, path: str, tile: int = TILE) -> None:
    """Pseudo-sequences as FASTA text with lines of ``LINE`` bases: the files of the folder in their order are the samples in theirs.  ``tile`` is a multiple of ``LINE``."""
    if tile % LINE:
        raise ValueError(f"tiles hold whole lines of {LINE} bases")
    lines = F.regexp_replace(F.regexp_replace("bases", f"(.{{{LINE}}})", "$1\n"), "\n$", "")
    value = F.when(F.col("tile") == 0, F.concat(F.lit(">"), F.col("sample_id"), F.lit("\n"), lines)).otherwise(lines)
    rows = pseudo_tiles(samples, variants, reference, tile).repartitionByRange("ord", "tile").sortWithinPartitions("ord", "tile")
    rows.select(value.alias("value")).write.mode("overwrite").text(path)


def alternative_sequence(reference: str, alt: DataFrame) -> str:
    """The reference with an absent base at each selected position; alt (pos, alt_base) is of scheme size."""
    seq = list(reference)
    for r in alt.select("pos", "alt_base").collect():
        if r["alt_base"] and r["pos"] < len(seq):
            seq[r["pos"]] = r["alt_base"]
    return "".join(seq)
