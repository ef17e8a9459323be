"""K-mers of samples with sparse variants against whole sequences."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from snpgrid.operators import kmers, local_kmers, rules

K = 9


def flip(s: str) -> str:
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(2600))
    genome = genome[:2000] + genome[90:140] + genome[2050:2300] + flip(genome[300:340]) + genome[2340:]  # a repeat, one on the other strand
    sites = sorted(rng.sample(range(3, 2590), 60)) + [0, 2599, 100, 104, 310, 999, 1000, 1003]
    samples = {f"s{i}": f"g{i % 3}" for i in range(7)}
    calls = [(s, p, rng.choice(["A", "C", "G", "T", genome[p], genome[p], "N"])) for p in sorted(set(sites)) for s in samples]
    seqs = {s: list(genome) for s in samples}
    for s, p, b in calls:
        seqs[s][p] = b
    positions = sorted(set(sites))[::2]
    frame = spark.createDataFrame([("1", p, genome[p], s, b) for s, p, b in calls], "chrom string, pos int, ref string, sample_id string, base string")
    return genome, {s: "".join(x) for s, x in seqs.items()}, samples, positions, frame


@pytest.fixture(scope="module")
def found(spark, small):
    genome, _, samples, positions, calls = small
    windows = local_kmers.reference_windows(spark, genome, K)
    changed = local_kmers.changed_windows(windows, calls.where("base <> ref"), K)
    at = spark.createDataFrame([(p,) for p in positions], "pos int")
    return windows, changed, local_kmers.target_kmers(windows, changed, at, len(samples), K).persist()


def test_target_kmers(small, found):
    _, seqs, _, positions, _ = small
    last: dict[str, int] = {}
    for seq in seqs.values():
        for p in positions:
            if seq[p] in "ACGT":
                for at in range(max(0, p - K + 1), p):
                    if len(w := seq[at : at + K]) == K and "N" not in w:
                        last[w] = max(last.get(w, 0), at)
    expected = {(w, at, at + K, p, w[p - at]) for w, at in last.items() for p in positions if at <= p < at + K - 1}
    assert {tuple(r) for r in found[2].collect()} == expected


def test_hits_presence_and_flags(spark, small, found):
    _, seqs, samples, _, calls = small
    windows, changed, targets = found
    hits = local_kmers.search(windows, changed, targets)
    names = {r[0] for r in targets.select("kmer").distinct().collect()}
    n = {s: Counter(q[i : i + K] for i in range(len(q) - K + 1)) for s, q in seqs.items()}
    count = lambda s, w: sum(n[s][x] for x in {w, flip(w)})
    assert {r[0] for r in local_kmers.multi_hits(hits, len(samples)).collect()} == {w for w in names if any(count(s, w) > 1 for s in seqs)}
    genotypes = spark.createDataFrame(list(samples.items()), "sample_id string, genotype string")
    presence = local_kmers.genotype_presence(hits, genotypes)
    expected = Counter((w, g) for w in names for s, g in samples.items() if count(s, w))
    assert {(r["kmer"], r["genotype"]): r["n"] for r in presence.collect()} == dict(expected)

    bases: dict[tuple[str, int], set[str]] = {}
    for r in calls.collect():
        if r["base"] in "ACGT":
            bases.setdefault((samples[r["sample_id"]], r["pos"]), set()).add(r["base"])
    rows = targets.collect()
    bad = {r["kmer"] for r in rows for g in set(samples.values()) if (r["kmer"], g) in expected and (g, r["pos"]) in bases and r["base"] not in bases[g, r["pos"]]}
    assert {r[0] for r in kmers.unspecific(presence, targets, rules.genotype_states(calls, genotypes)).collect()} == bad


def test_chosen_kmers(spark, small, tmp_path):
    """Every state of a position that keeps its k-mers has some, all of one start, and those without are named."""
    genome, seqs, samples, positions, calls = small
    genotypes = spark.createDataFrame(list(samples.items()), "sample_id string, genotype string")
    at = spark.createDataFrame([(p,) for p in positions], "pos int")
    own = calls.join(at, "pos", "left_semi")

    def cut(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    out = local_kmers.select(spark, genome, calls.where("base <> ref"), own, genotypes, at, K, cut)
    chosen, missing = out.chosen.collect(), {r["pos"] for r in out.missing.collect()}
    states = {(r["pos"], r["base"]) for r in own.collect() if r["base"] in "ACGT"}
    assert {(r["pos"], r["base"]) for r in chosen} == {x for x in states if x[0] not in missing}
    assert chosen and missing
    starts: dict[tuple[int, str], set[int]] = {}
    for r in chosen:
        starts.setdefault((r["pos"], r["base"]), set()).add(r["start"])
        assert r["kmer"][r["pos"] - r["start"]] == r["base"] and any(r["kmer"] in q for q in seqs.values())
        assert set(r["positive"]) | set(r["partial"]) <= set(samples.values()) and not set(r["positive"]) & set(r["partial"])
    assert all(len(x) == 1 for x in starts.values())
    assert {r["kseq"] for r in out.extracted.collect()} >= {r["kmer"] for r in chosen}


def test_probe_pairs(spark):
    genome = "ACGTTGCAACGGTCATTGCA"
    codes = spark.createDataFrame([(8, "R"), (10, "S")], "pos int, code string")
    snps = spark.createDataFrame([(10, "C", "0.a", ["G"]), (18, "C", "0", [])], "pos int, base string, path string, others array<string>")
    rows = {tuple(r) for r in local_kmers.probe_pairs(spark, genome, codes, snps, 6).collect()}
    assert rows == {("5-0.a", 10, "C", "GCARCCG"), ("negative5-0.a", 10, "C", "GCARCGG"), ("13-0", 18, "C", "CATTGCA")}


def test_overlapping_pairs(spark):
    rows = [("A", 0), ("B", 5), ("C", 9), ("D", 30)]
    out = kmers.overlapping_pairs(spark.createDataFrame(rows, "kmer string, start int"), 5).collect()
    assert {(r["k1"], r["k2"]) for r in out} == {("A", "B"), ("B", "C")}
