"""Metadata and temporal association of clades."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import correlation_p, fisher_greater, odds_ratio
from . import distance, sites
from .hierarchy import membership
from .lineage import cut


def metadata_long(samples: DataFrame, fields: list[str]) -> DataFrame:
    """(sample_id, field, value), all as text."""
    return samples.select("sample_id", *(F.col(f).cast("string").alias(f) for f in fields)).unpivot(["sample_id"], fields, "field", "value")


def metadata_counts(samples: DataFrame, fields: list[str]) -> DataFrame:
    """Values per clade and field."""
    return membership(samples).select("clade", "sample_id").join(metadata_long(samples, fields), "sample_id").groupBy("clade", "field", "value").agg(F.count("*").alias("n"))


def fisher_tables(samples: DataFrame, fields: list[str], max_outside: float = 0.2) -> DataFrame:
    """(clade, field, value, pp, pn, np, nn): 2x2 cells of a clade against a value; skipped where too many of the value's samples lie outside the clade's size."""
    counts = metadata_counts(samples, fields)
    value = metadata_long(samples, fields).groupBy("field", "value").agg(F.count("*").alias("n_value"))
    clade = membership(samples).groupBy("clade").agg(F.count("*").alias("n_clade"))
    total = samples.agg(F.count("*").alias("n_all"))
    rows = counts.join(value, ["field", "value"]).join(clade, "clade").join(total)
    rows = rows.select("clade", "field", "value", F.col("n").alias("pp"), (F.col("n_value") - F.col("n")).alias("pn"), (F.col("n_clade") - F.col("n")).alias("np"), (F.col("n_all") - F.col("n_value") - F.col("n_clade") + F.col("n")).alias("nn"), "n_clade")
    return rows.where(F.col("pn") <= F.lit(max_outside) * F.col("n_clade")).drop("n_clade")


def fisher_associations(samples: DataFrame, fields: list[str], max_outside: float = 0.2) -> DataFrame:
    """Odds ratio and one-sided p-value of each kept table."""
    cells = [F.col(c) for c in ("pp", "pn", "np", "nn")]
    return fisher_tables(samples, fields, max_outside).withColumn("oddsr", odds_ratio(*cells)).withColumn("p", fisher_greater(*cells))


def _points(left: pa.StructArray, right: pa.StructArray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(shared, d, year, n): how often a distance comes with the second sample's year, either sample being the second, by the nodes both share."""
    starts = [distance.runs(s) for s in (left, right)]
    paths = [s.field("path").take(pa.array(at)).to_pylist() for s, at in zip((left, right), starts, strict=True)]
    known: dict[tuple[str, ...], int] = {}
    shared = np.empty((len(paths[0]), len(paths[1])), np.int64)
    for i, p in enumerate(paths[0]):
        once = list(dict.fromkeys(p))
        for j, q in enumerate(paths[1]):
            own = set(q)
            shared[i, j] = known.setdefault(tuple(x for x in once if x in own), len(known))
    of = [np.searchsorted(at, np.arange(len(s)), "right") - 1 for s, at in zip((left, right), starts, strict=True)]
    pairs = d >= 0
    top = int(d.max(initial=0)) + 1
    base = (shared[of[0][:, None], of[1]] * top + d)[pairs]
    years = pa.concat_arrays([left.field("year"), right.field("year")]).dictionary_encode(null_encoding="encode")
    year, n_years = years.indices.to_numpy(), len(years.dictionary)
    second = np.concatenate([np.broadcast_to(y, d.shape)[pairs] for y in (year[len(left) :], year[: len(left), None])])
    code, n = distance.counted(np.concatenate([base, base]) * n_years + second, len(known) * top * n_years)
    sets = pa.array(list(known), pa.list_(pa.string())).take(pa.array(code // n_years // top))
    yield pa.RecordBatch.from_arrays([sets, pa.array(code // n_years % top), years.dictionary.take(pa.array(code % n_years)), pa.array(n.astype(np.int64))], ["shared", "d", "year", "n"])


def last_points(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """(shared, d, year, n): of each sample the distance to the last other one, with its own year.  The last sample is held against the one before it."""
    s = samples.where("ord IS NOT NULL").select("sample_id", "ord", "path", "year")
    top = s.agg(F.max("ord").alias("top"))
    ends = s.join(F.broadcast(top)).groupBy((F.col("ord") == F.col("top")).alias("is_top")).agg(F.max_by(F.struct("sample_id", "path"), "ord").alias("e"))
    ends = ends.select((~F.col("is_top")).alias("of_top"), F.col("e.sample_id").alias("s2"), F.col("e.path").alias("p2"))
    met = s.join(F.broadcast(top)).withColumn("of_top", F.col("ord") == F.col("top")).join(F.broadcast(ends), "of_top")
    packed = distance.packed_sites(calls)
    bases = [b.lower() for b in sites.BASES]
    other = packed.join(F.broadcast(ends.select(F.col("s2").alias("sample_id"))), "sample_id").select(F.col("sample_id").alias("s2"), "word", *(F.col(b).alias(f"{b}2") for b in bases))
    found = met.select("sample_id", "s2").join(packed, "sample_id").join(other, ["s2", "word"])
    either = lambda of: F.expr(" | ".join(of))
    differ = either(bases).bitwiseAND(either([f"{b}2" for b in bases])).bitwiseAND(F.bitwise_not(either([f"({b} & {b}2)" for b in bases])))
    found = found.groupBy("sample_id").agg(F.sum(F.bit_count(differ)).alias("d"))
    rows = met.join(found, "sample_id", "left")
    return rows.select(F.array_intersect("path", "p2").alias("shared"), F.coalesce("d", F.lit(0)).cast("long").alias("d"), "year", F.lit(1).cast("long").alias("n"))


def temporal_cells(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """(clade, d, year, w): each ordered pair's distance with the second sample's year, in every node both share, plus once more the last pair of each row with the first sample's year.

    Points are counted where two blocks of samples are compared, so a row is a distinct point of a set of nodes and not a pair.
    """
    year = samples.schema["year"].dataType.simpleString()
    s = samples.select("sample_id", F.col("ord").cast("long").alias("ord"), "path", "year").where("path IS NOT NULL")
    rows = distance.over_tiles(calls, s, [F.col("path"), F.col("ord")], _points, f"shared array<string>, d long, year {year}, n long")
    rows = rows.unionByName(last_points(calls, s)).groupBy("shared", "d", "year").agg(F.sum("n").alias("n"))
    return rows.select(F.explode("shared").alias("clade"), "d", "year", "n").groupBy("clade", "d", "year").agg(F.sum("n").alias("w"))


def counted_ranks(cells: DataFrame, by: str, value: str, n: str, name: str) -> DataFrame:
    """(``by``, ``value``, ``name``): the mean rank of a value among rows that ``cells`` counts in ``n``.  Ordered are distinct values, not rows."""
    counts = cells.groupBy(by, value).agg(F.sum(n).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(by, value, (before + (F.col("_n") + 1) / 2.0).alias(name))


def weighted_correlation(cells: DataFrame, by: str, x: str, y: str, n: str, name: str) -> DataFrame:
    """(``by``, ``name``): Pearson's r of cells that count ``n`` rows each, null where a side is constant."""
    mean = lambda c: F.sum(F.col(c) * F.col(n)) / F.sum(n)
    means = cells.groupBy(by).agg(mean(x).alias("_mx"), mean(y).alias("_my"))
    dx, dy, w = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my"), F.col(n)
    sums = cells.join(means, by).groupBy(by).agg(F.sum(w * dx * dy).alias("xy"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dy * dy).alias("yy"))
    return sums.select(by, F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias(name))


def temporal_signal(calls: DataFrame, samples: DataFrame, least_r: float = 0.5) -> DataFrame:
    """Pearson and Spearman of year against distance per clade with three distinct values of each at least.

    Points are counted by clade, distance and year first, so the root clade, which every pair is in, is as many rows as it has distinct points.
    """
    cells = cut(temporal_cells(calls, samples))
    ranked = cells.join(counted_ranks(cells, "clade", "d", "w", "rd"), ["clade", "d"]).join(counted_ranks(cells, "clade", "year", "w", "ry"), ["clade", "year"])
    out = cells.groupBy("clade").agg(F.sum("w").alias("n"), F.countDistinct("d").alias("nd"), F.countDistinct("year").alias("ny")).where("nd >= 3 AND ny >= 3")
    out = out.join(weighted_correlation(cells, "clade", "d", "year", "w", "pearson"), "clade").join(weighted_correlation(ranked, "clade", "rd", "ry", "w", "spearman"), "clade")
    return out.select("clade", "n", "pearson", correlation_p("pearson", "n").alias("pearson_p"), "spearman", correlation_p("spearman", "n").alias("spearman_p"), ((F.col("pearson") > least_r) | (F.col("spearman") > least_r)).alias("is_temporal"))
