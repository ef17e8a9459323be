"""Operators against hand-made cases and brute force; registered queries against their SQL."""

from __future__ import annotations

import collections
import itertools
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from snpgrid.functions import sequence, stats
from snpgrid.operators import associate, canonical, cluster, distance, evaluate, hierarchy, kmers, rules, scheme
from snpgrid.plans import compression

DATA = Path("/root/testdata/sf0.001")


def test_sequence_functions(spark):
    df = spark.createDataFrame([("acgtRN",), ("GGGGA",), ("",)], "s string")
    rows = df.select(sequence.revcomp(F.col("s")), sequence.longest_homopolymer(F.col("s"))).collect()
    assert rows[0][0] == "NYacgt" and rows[1][1] == 4 and rows[2][1] == 0
    one = spark.range(1)
    assert sorted(one.select(sequence.expand_degenerate(F.lit("RAY"))).first()[0]) == ["AAC", "AAT", "GAC", "GAT"]
    assert [one.select(sequence.translate_codon(F.lit(c))).first()[0] for c in ("ATG", "TAA", "NNN", "A")] == ["M", "*", "X", "X"]
    assert one.select(sequence.ungapped_positions(F.lit("A-C--G"))).first()[0] == [0, 2, 5]
    assert [one.select(sequence.iupac_code(F.array(*map(F.lit, b)))).first()[0] for b in ("A", "AG", "ACGT")] == ["A", "R", "N"]


def test_fisher_and_correlation(spark):
    tables = [(3, 0, 0, 15), (2, 1, 4, 11), (0, 3, 5, 5), (0, 0, 4, 4)]

    def tail(a, b, c, d):
        if 0 in (a + b, c + d, a + c, b + d):
            return 1.0
        return sum(math.comb(a + b, x) * math.comb(c + d, a + c - x) for x in range(a, min(a + b, a + c) + 1) if a + c - x <= c + d) / math.comb(a + b + c + d, a + c)

    df = spark.createDataFrame(tables, "a long, b long, c long, d long")
    got = df.select(stats.fisher_greater("a", "b", "c", "d"), stats.odds_ratio(*map(F.col, "abcd"))).collect()
    assert [r[0] for r in got] == pytest.approx([tail(*t) for t in tables])
    assert got[0][1] == math.inf and got[1][1] == pytest.approx(22 / 4) and math.isnan(got[3][1])
    # r = 0.5 over 10 points: t = 1.632993 with 8 degrees of freedom
    assert spark.createDataFrame([(0.5, 10)], "r double, n int").select(stats.correlation_p("r", "n")).first()[0] == pytest.approx(0.141111, abs=1e-5)


def test_adjusted_mutual_info(spark):
    same = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", "y")], "p string, q string")
    assert stats.adjusted_mutual_info(same, "p", "q").first()[0] == pytest.approx(1.0)
    apart = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], "p string, q string")
    # expected information: each cell is 0, 1 or 2 with probability 1/6, 2/3, 1/6; only 2 adds, 4 * 1/6 * 1/2 * ln 2
    assert stats.adjusted_mutual_info(apart, "p", "q").first()[0] == pytest.approx(-(math.log(2) / 3) / (math.log(2) - math.log(2) / 3))


def test_troughs(spark):
    counts = {1: 3, 2: 1, 3: 1, 4: 5, 6: 2}
    got = stats.troughs(spark.createDataFrame(list(counts.items()), "d long, n long"))
    assert sorted(r[0] for r in got.collect()) == [2, 5]


CALLS = [(p, s, b) for p, bases in {1: "AATTN", 2: "CCCGG", 3: "GGGGG", 4: "A-TTC"}.items() for s, b in zip("abcde", bases, strict=True)]


@pytest.fixture
def tiny(spark):
    calls = spark.createDataFrame([("1", p, "A", s, b) for p, s, b in CALLS], "chrom string, pos int, ref string, sample_id string, base string")
    samples = spark.createDataFrame([("a", 0, ["0", "x"]), ("b", 1, ["0", "x"]), ("c", 2, ["0", "y"]), ("d", 3, ["0", "y"]), ("e", 4, ["0", "z"])], "sample_id string, ord long, path array<string>")
    return calls, samples


def test_distances(tiny):
    calls, samples = tiny
    by = {(p, s): b for p, s, b in CALLS}
    want = {(s, t, sum(by[p, s] in "ACGT" and by[p, t] in "ACGT" and by[p, s] != by[p, t] for p in (1, 2, 3, 4))) for s, t in itertools.combinations("abcde", 2)}
    assert set(map(tuple, distance.snp_distances(calls, samples).collect())) == want


def test_canonical(tiny):
    calls, samples = tiny
    got = {(r["pos"], r["base"]): (r["clade"], r["num_clade_members"], r["num_members"]) for r in canonical.canonical_snps(calls, samples).collect()}
    # at position 1 sample e has no base, so A marks x and T marks y; at 4 b has none
    assert got == {(1, "A"): ("x", 2, 2), (1, "T"): ("y", 2, 2), (3, "G"): ("0", 5, 5), (4, "A"): ("x", 1, 2), (4, "T"): ("y", 2, 2), (4, "C"): ("z", 1, 1)}
    every = {(r["pos"], r["base"]): (r["clade"], r["is_canonical"]) for r in canonical.assigned_snps(calls, samples).collect()}
    assert every[2, "C"] == ("0", False) and every[1, "A"] == ("x", True)


def test_rules_and_calls(tiny):
    calls, samples = tiny
    g = samples.select("sample_id", F.element_at("path", -1).alias("genotype"))
    r = {(x["pos"], x["base"]): (x["positive"], x["partial"]) for x in rules.base_rules(calls, g).collect()}
    assert r[2, "C"] == (["x"], ["y"]) and r[2, "G"] == (["z"], ["y"]) and r[4, "A"] == ([], ["x"])
    allowed = rules.allowed_bases(rules.base_rules(calls.where("pos IN (1, 4)"), g))
    got = {x["sample_id"]: (x["genotypes"], x["dist"]) for x in rules.call_genotypes(calls.where("pos IN (1, 4)"), allowed, samples).collect()}
    # z has no rule at 1, so any base fits it there; e is called at 4 alone
    assert got["c"] == (["y"], 0.0) and got["e"] == (["z"], 0.0) and got["a"] == (["x"], 0.0) and got["b"] == (["x", "z"], 0.0)


def test_evaluation(spark):
    labels = spark.createDataFrame([("a", "0.1", "0.1"), ("b", "0.1.2", "0.1"), ("c", "0.3", "0.3"), ("d", "0.3", "")], "sample_id string, submitted string, predicted string")
    got = {r["label"]: (r["num_submitted"], r["num_predicted"], r["f1_score"]) for r in evaluate.f1_scores(labels).collect()}
    assert got["overall"] == (4, 4, 0.5) and got["0.1"] == (1, 2, 0.5) and got["0.1.2"] == (0, 0, 0.0) and got["0.3"] == (2, 1, 0.5)
    assert evaluate.include(labels, "0.1").count() == 2 and evaluate.exclude(labels, "0.1", "exact").count() == 2


def test_gapped_kmers_and_search(spark):
    seqs = spark.createDataFrame([("p", "ACGTACG"), ("q", "AC-GTAC")], "seq_id string, seq string")
    at = spark.createDataFrame([(3,)], "pos int")
    got = sorted((r["seq_id"], r["start"], r["end"], r["kmer"]) for r in kmers.extract_kmers(seqs, at, 3).collect())
    assert got == [("p", 1, 4, "CGT"), ("p", 2, 5, "GTA"), ("q", 1, 5, "CGT"), ("q", 2, 6, "GTA")]
    hits = kmers.search_kmers(seqs, spark.createDataFrame([("ACG",), ("GTA",)], "kmer string"), 3)
    assert {(r["kmer"], r["seq_id"]): r["n"] for r in hits.collect()} == {("ACG", "p"): 3, ("GTA", "p"): 2, ("GTA", "q"): 2}


def test_kmers_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(kmers, "TILE", 7)
    rng = random.Random(5)
    seqs = {name: "".join(rng.choices("ACGTN", [6, 6, 6, 6, 1], k=n)) for name, n in (("a", 40), ("b", 21), ("c", 4), ("d", 0))}
    at = [0, 1, 6, 7, 8, 14, 20, 33, 39, 90]
    want = {
        (name, pos, start, s[start : start + 5])
        for name, s in seqs.items() for pos in at if pos < len(s) and s[pos] != "N"
        for start in range(max(0, pos - 4), pos) if start + 5 <= len(s) and s[start : start + 5].count("N") <= 1
    }
    got = kmers.extract_kmers(spark.createDataFrame(list(seqs.items()), "seq_id string, seq string"), spark.createDataFrame([(p,) for p in at], "pos int"), 5, 1).collect()
    assert len(got) == len(want) and {(r["seq_id"], r["pos"], r["start"], r["kmer"]) for r in got} == want


def test_scores_brute_force(spark):
    rng = random.Random(7)
    allowed = [(g, pos, rng.choice([["A"], ["C"], ["A", "C"]])) for g in ("x", "y", "z") for pos in range(6)]
    calls = [(f"s{i}", pos, rng.choice("ACGN")) for i in range(5) for pos in range(8)]
    want = {}
    for s, pos, base in calls:
        for g, p, bases in allowed:
            if p == pos and base != "N":
                hits = want.setdefault((s, g), [0, 0])
                hits[base not in bases] += 1
    got = rules.score_genotypes(spark.createDataFrame(calls, "sample_id string, pos int, base string"), spark.createDataFrame(allowed, "genotype string, pos int, allowed array<string>")).collect()
    assert {(r["sample_id"], r["genotype"]): [r["matches"], r["mismatches"]] for r in got} == want
    assert all(r["dist"] == pytest.approx(r["mismatches"] / (r["matches"] + r["mismatches"])) for r in got)


def test_upgma_brute_force():
    import numpy as np

    rng = random.Random(3)
    pts = [rng.random() for _ in range(12)]
    m = np.array([[abs(x - y) for y in pts] for x in pts])
    groups = [[i] for i in range(12)]
    for _, _, height in cluster.upgma(m):
        (d, a, b) = min((np.mean([m[i, j] for i in x for j in y]), p, q) for p, x in enumerate(groups) for q, y in enumerate(groups) if p < q)
        assert height == pytest.approx(d)
        groups[a] += groups.pop(b)
    labels = cluster.cut(cluster.upgma(m), 12, 0.1)
    assert len(set(labels)) == max(labels) and min(labels) == 1


def test_compression():
    paths = {"a": ["0", "1", "2"], "b": ["0", "1", "2"], "c": ["0", "1", "3"], "d": ["0", "4"]}
    clades = {n: compression.Clade(2, k, d, 5, None) for n, k, d in (("0", 0, 9.0), ("1", 1, 5.0), ("2", 1, 1.0), ("3", 1, 0.0), ("4", 1, 0.0))}
    s = compression.select(paths, clades)
    assert s.supported == {"a": "1.2", "b": "1.2", "c": "1.3", "d": "4"} and "0" in s.valid and s.genotypes["d"].startswith("0")
    assert compression.thresholds([1, 1, 2, 3], 10) == [1, 2, 3] and compression.thresholds([]) == []


def test_scheme_annotation(spark):
    features = spark.createDataFrame([(0, "g", 9, 18, "ATGAAACCC", 9, 17)], "ord int, gene_name string, gene_start int, gene_end int, dna_seq string, seg_start int, seg_end int")
    r = spark.createDataFrame([(13, "A", ["x"], []), (13, "T", ["y"], []), (30, "C", ["x"], []), (30, "G", [], ["y"])], "pos int, base string, positive array<string>, partial array<string>")
    refs = spark.createDataFrame([(13, "A"), (30, "C")], "pos int, ref string")
    rows = {(x["mutation_key"], x["state"]): x for x in scheme.numbered(scheme.snp_scheme(r, refs, features)).collect()}
    assert tuple(next(iter(rows.values())).__fields__) == scheme.SCHEME_COLUMNS
    alt = rows["snp_A_14_T", "alt"]
    assert (alt["aa_name"], alt["is_cds"], alt["is_silent"], alt["cds_start"], alt["positive_genotypes"]) == ("K2I", True, False, "4", "y")
    assert rows["snp_C_31_G", "alt"]["is_cds"] is False and rows["snp_C_31_G", "ref"]["kmer_entropy"] == 0.0


def test_streaming_caller(spark, tiny, tmp_path):
    from snpgrid.streaming.caller import stream_genotypes

    calls, samples = tiny
    calls.write.parquet(str(tmp_path / "in"))
    g = samples.select("sample_id", F.element_at("path", -1).alias("genotype"))
    r = rules.base_rules(calls, g)
    q = stream_genotypes(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in")), r, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


@pytest.mark.skipif(not DATA.exists(), reason="driver tables")
@pytest.mark.parametrize("name", ["genotype_calls", "canonical_snps", "assigned_snps", "snp_rules", "f1_scores", "distance_partitions"])
def test_registered_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = __spark_entry__.queries()[name](spark, str(DATA))
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]}) x").fetchall()
    text = lambda rows: sorted(str([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in rows)
    assert text(map(tuple, got.select(*columns).collect())) == text(want)


def test_entry(spark):
    if DATA.exists():
        assert __spark_entry__.entry(spark).count() > 0


def test_degenerate_expansion_reads_every_window(spark):
    from types import SimpleNamespace

    from snpgrid.plans import catalog

    seqs = {1: "ACGTACGTTGCA", 2: "GGGGG", 3: "ACG"}
    run = catalog.QUERIES["degenerate_expansion"].__closure__
    fn = next(c.cell_contents for c in run if callable(c.cell_contents))
    got = fn(SimpleNamespace(seqs=spark.createDataFrame([*seqs.items()], "seq_id long, seq string"))).collect()
    width = {"A": 2, "C": 2, "G": 4, "T": 1}
    want = []
    for i, s in seqs.items():
        for at in range(len(s) - 4):
            n = 1
            for c in s[at : at + 5]:
                n *= width[c]
            want.append((i, at, s[at : at + 5].translate(str.maketrans("ACGT", "RYNT")), n))
    assert sorted(map(tuple, got)) == want


def test_histogram_report_holds_every_row(spark, tmp_path):
    from snpgrid.sources import tables

    tables.write_histogram_html(spark, spark.range(20_050).selectExpr("id AS d", "1L AS n"), str(tmp_path / "h"))
    assert spark.read.text(str(tmp_path / "h")).first()[0].count("<rect") == 20_050


def test_counted_ranks_and_correlation(spark):
    """Mean ranks and correlations of counted points against those of the points one by one."""
    rng = random.Random(3)
    points = [(c, float(rng.randint(0, 6)), float(rng.randint(2000, 2004))) for c in "ab" for _ in range(80)]
    cells = spark.createDataFrame(points, "clade string, d double, year double").groupBy("clade", "d", "year").count()
    got = {(r["clade"], r["d"]): r["rd"] for r in associate.counted_ranks(cells, "clade", "d", "count", "rd").collect()}
    for c in "ab":
        own = sorted(d for k, d, _ in points if k == c)
        assert all(got[c, d] == pytest.approx(sum(i + 1 for i, x in enumerate(own) if x == d) / own.count(d)) for d in set(own))
    r = {x["clade"]: x["r"] for x in associate.weighted_correlation(cells, "clade", "d", "year", "count", "r").collect()}
    for c in "ab":
        d, y = ([p[i] for p in points if p[0] == c] for i in (1, 2))
        md, my = sum(d) / len(d), sum(y) / len(y)
        want = sum((a - md) * (b - my) for a, b in zip(d, y, strict=True)) / math.sqrt(sum((a - md) ** 2 for a in d) * sum((b - my) ** 2 for b in y))
        assert r[c] == pytest.approx(want)


def test_kmer_numbers(spark, monkeypatch):
    monkeypatch.setattr(kmers, "TILE", 5)
    seqs = {"a": "ACGTACGTTGCA", "b": "AC", "c": "ACG", "d": "ACGTAA"}
    frame = spark.createDataFrame([*seqs.items(), ("e", None)], "seq_id string, seq string")
    got = sorted(map(tuple, kmers.all_windows(frame, 3).select("seq_id", "at", "window").collect()))
    assert got == sorted((s, i, q[i : i + 3]) for s, q in seqs.items() for i in range(len(q) - 2))
    index = kmers.index_kmers(kmers.all_windows(frame, 3).withColumnRenamed("window", "kmer"))
    words = sorted({w for _, _, w in got})
    assert {r["kidx"]: r["kmer"] for r in index.collect()} == dict(enumerate(words))
    asked = spark.createDataFrame([(0,), (len(words),)], "kidx long")
    assert {r["kidx"]: r["kmer"] for r in kmers.kmers_of(asked, index).collect()} == {0: words[0], len(words): ""}
    rows = spark.createDataFrame([(1, True, 7, "A"), (0, True, 7, "A"), (2, False, 7, "A"), (3, True, 7, "N"), (1, True, 8, "C")], "kidx long, is_valid boolean, pos int, base string")
    assert {(r["pos"], r["base"]): r["kidx"] for r in kmers.populate_scheme(rows).collect()} == {(7, "A"): [0, 1], (8, "C"): [1]}


def test_snp_validity(spark):
    rows = [("1", 5, b, False, 3) for b in "ACG"] + [("1", 6, "A", True, 1), ("1", 6, "C", False, 1), ("1", 7, "A", True, 4)]
    snps = canonical.snp_validity(spark.createDataFrame(rows, "chrom string, pos int, base string, is_canonical boolean, num_members long"), max_states=2, min_members=2)
    assert {(r["pos"], r["base"]): r["is_valid"] for r in snps.collect()} == {(5, "A"): False, (5, "C"): False, (5, "G"): False, (6, "A"): False, (6, "C"): True, (7, "A"): True}
    assert tuple(canonical.snp_summary(snps).first()) == (3, 2, 2)


@pytest.fixture
def blocks(spark, monkeypatch):
    """Samples of several blocks with repeated and missing calls, equal and missing ords, and the pairs that they make one by one."""
    monkeypatch.setattr(distance, "SIDE", 5)
    monkeypatch.setattr(distance, "WORDS", 1)
    rng = random.Random(11)
    samples = [(f"s{i}", None if i == 16 else 8 if i == 9 else i, ["0", f"r{i % 2}", f"n{i % 4}"][: 1 + (i * 7) % 3], 2000 + rng.randint(0, 3)) for i in range(17)]
    calls = [("1", pos, s, b) for s, *_ in samples if s != "s3" for pos in range(90) for b in rng.choices("ACGTN", [8, 2, 1, 1, 1], k=rng.choice([0, 1, 1, 1, 2]))]
    states = {}
    for _, pos, s, b in calls:
        if b != "N":
            states.setdefault(s, {}).setdefault(pos, set()).add(b)
    far = lambda a, b: sum(not v & states.get(b, {})[p] for p, v in states.get(a, {}).items() if p in states.get(b, {}))
    pairs = [(x, y, far(x[0], y[0])) for x, y in itertools.permutations([s for s in samples if s[1] is not None], 2) if x[1] != y[1]]
    return (
        spark.createDataFrame(calls, "chrom string, pos int, sample_id string, base string"),
        spark.createDataFrame(samples, "sample_id string, ord long, path array<string>, year int"), pairs,
    )


def test_distances_by_blocks(blocks):
    calls, samples, pairs = blocks
    got = list(map(tuple, distance.snp_distances(calls, samples).collect()))
    assert sorted(got) == sorted((x[0], y[0], d) for x, y, d in pairs if x[1] < y[1])


def test_histogram_and_thresholds_of_counts(blocks):
    calls, samples, pairs = blocks
    want = collections.Counter(d for x, y, d in pairs if x[1] < y[1])
    hist = distance.histogram(calls, samples)
    assert {r["d"]: r["n"] for r in hist.collect()} == want
    one_by_one = distance.snp_distances(calls, samples)
    counted, each = hierarchy.partition_thresholds(hist, "d", n="n"), hierarchy.partition_thresholds(one_by_one, "d")
    assert sorted(counted.collect()) == sorted(each.collect()) and counted.count() > 1


def test_distances_within_and_outside_clades(blocks):
    calls, samples, pairs = blocks
    within, outside = {}, {}
    for x, y, d in pairs:
        for clade in x[2]:
            if clade in y[2]:
                within.setdefault(clade, []).append(d)
            else:
                outside.setdefault(clade, []).append((-d, x[1], y[1], x[2], y[2]))
    got = {r["clade"]: (r["total_within"], r["n_within"], r["ave_within"]) for r in distance.within_clades(calls, samples).collect()}
    assert got == {c: (sum(v) // 2, len(v) // 2, sum(v) / len(v)) for c, v in within.items()}
    by_id = {r["sample_id"]: r for r in samples.collect()}
    got = {r["clade"]: r for r in distance.outside_clades(calls, samples).collect()}
    assert set(got) == set(outside)
    for clade, rows in outside.items():
        r, (d, o1, o2, p, q) = got[clade], min(rows, key=lambda x: x[:3])
        ends = by_id[r["clade_sample_id"]]["ord"], by_id[r["closest_sample_id"]]["ord"]
        assert (r["closest_sample_dist"], *ends, r["nearest_dist"]) == (-d, o1, o2, -max(x[0] for x in rows))
        met = by_id[r["clade_sample_id"]]["path"], by_id[r["closest_sample_id"]]["path"]
        assert r["closest_clade_id"] == met[0][sum(x == y for x, y in zip(*met)) - 1]  # noqa: B905


def test_temporal_cells(blocks):
    """Points of each pair both ways and each sample's last pair; of two samples of one ord, which is last is open, so ords differ here."""
    calls, samples, _ = blocks
    samples = samples.where("sample_id <> 's9'")
    rows = [r for r in samples.collect() if r["ord"] is not None]
    by_id = {r["sample_id"]: r for r in rows}
    far = {(r["s1"], r["s2"]): r["d"] for r in distance.snp_distances(calls, samples).collect()}
    far |= {(b, a): d for (a, b), d in far.items()}
    points = [(by_id[a], by_id[b], d, by_id[b]["year"]) for (a, b), d in far.items()]
    for a in rows:
        b = max((r for r in rows if r["ord"] != a["ord"]), key=lambda r: r["ord"])
        points.append((a, b, far[a["sample_id"], b["sample_id"]], a["year"]))
    want = collections.Counter((c, d, year) for a, b, d, year in points for c in a["path"] if c in b["path"])
    assert {(r["clade"], r["d"], r["year"]): r["w"] for r in associate.temporal_cells(calls, samples).collect()} == want


@pytest.mark.skipif(not DATA.exists(), reason="driver tables")
@pytest.mark.parametrize("name", ["distance_histogram", "distance_troughs", "distance_partitions", "within_clade_distances", "distance_bins", "outside_clade_distances", "temporal_signal"])
def test_reductions_make_no_row_a_pair(spark, monkeypatch, name):
    monkeypatch.setattr(distance, "snp_distances", None)
    assert __spark_entry__.queries()[name](spark, str(DATA)).count() > 0


def _sequences():
    rng = random.Random(17)
    seqs = [(f"q{i % 20}" if i else None, "".join(rng.choices("ACGTN", [6, 4, 4, 3, 1], k=rng.choice([0, 2, 3, 30, 700])))) for i in range(25)]
    return [*seqs, ("q1", None), ("q2", "acgtnRYé-ACGT"), ("q3", "ACGTACGT")]


def _hits(seqs, k):
    """Windows of each id, and the same by what a k-mer or its reverse complement meets."""
    windows = {}
    for name, s in seqs:
        for i in range(len(s or "") - k + 1):
            windows.setdefault(name, collections.Counter())[s[i : i + k]] += 1
    back = str.maketrans(sequence.CODES + sequence.CODES.lower(), sequence.COMPLEMENTS + sequence.COMPLEMENTS.lower())
    return {(w, name): sum(own[x] for x in {w, w.translate(back)[::-1]}) for name, own in windows.items() for w in {y for v in own for y in (v, v.translate(back)[::-1])}}


@pytest.mark.parametrize("k", [3, 4, 20, 33])
def test_search_of_all_kmers(spark, k):
    """Repeated, missing and short sequences, letters beyond A, C, G and T, and k-mers of one and of several words."""
    seqs = _sequences()
    frame = spark.createDataFrame(seqs, "seq_id string, seq string")
    want = _hits(seqs, k)
    asked = spark.createDataFrame([(w,) for w, _ in want] + [("",), ("ACG",)], "kmer string")
    got = [tuple(r) for r in kmers.search_kmers(frame, asked, k).select("kmer", "seq_id", "n").collect()]
    assert len(got) == len(want) and {(w, s): n for w, s, n in got} == want


def test_portions_of_a_long_sequence(monkeypatch):
    import pyarrow as pa

    seqs = [("a", "ACGGT" * 9), ("b", "AACC"), ("c", "ACGGTTTACCGTA" * 3)]
    batch = pa.RecordBatch.from_arrays([pa.array([n for n, _ in seqs]), pa.array([[s, s[::-1]] for _, s in seqs])], ["label", "seqs"])
    rows = lambda fold: sorted(str(list(r.values())) for b in kmers._counts(iter([batch]), 4, fold) for r in b.to_pylist())
    whole = {fold: rows(fold) for fold in ("each", "label")}
    twice = {r for b in kmers._counts(iter([batch]), 4, "twice") for r in b.column("kmer").to_pylist()}
    monkeypatch.setattr(kmers, "PORTION", 7)
    assert all(rows(fold) == whole[fold] for fold in whole)
    assert {r for b in kmers._counts(iter([batch]), 4, "twice") for r in b.column("kmer").to_pylist()} == twice


def test_multi_hits_and_rules_of_kmers(spark):
    seqs = _sequences()
    frame = spark.createDataFrame(seqs, "seq_id string, seq string")
    want = _hits(seqs, 4)
    asked = spark.createDataFrame([(w,) for w, _ in want], "kmer string")
    got = [r[0] for r in kmers.multi_hits(frame, asked, 4).collect()]
    assert sorted(got) == sorted({w for (w, _), n in want.items() if n > 1})
    own = {f"q{i}": f"g{i % 3}" for i in range(20)}
    genotypes = spark.createDataFrame(list(own.items()), "sample_id string, genotype string")
    held = collections.Counter((w, own[s]) for w, s in want if s)
    hits = kmers.genotype_hits(frame, genotypes, asked, 4)
    assert {(r["kmer"], r["genotype"]): r["k"] for r in hits.collect()} == held
    size = collections.Counter(own.values())
    for r in kmers.kmer_rules(hits, genotypes, 0.5).collect():
        assert r["positive"] == sorted(g for g in size if held.get((r["kmer"], g), 0) >= 0.5 * size[g])
        assert r["partial"] == sorted(g for g in size if 0 < held.get((r["kmer"], g), 0) < 0.5 * size[g])


def test_counted_kmers_around_positions(spark, monkeypatch):
    monkeypatch.setattr(kmers, "TILE", 16)
    monkeypatch.setattr(kmers, "STRIP", 4)
    rng = random.Random(5)
    seqs = {name: "".join(rng.choices("ACGTN", [6, 6, 6, 6, 1], k=n)) for name, n in (("a", 40), ("b", 21), ("c", 4), ("d", 0), ("e", 40))}
    frame, at = spark.createDataFrame([*seqs.items(), ("f", None)], "seq_id string, seq string"), spark.createDataFrame([(p,) for p in [0, 1, 4, 15, 16, 17, 20, 33, 39, 90]], "pos int")
    want = collections.Counter((r["pos"], r["start"], r["end"], r["kmer"]) for r in kmers.extract_kmers(frame.where("seq IS NOT NULL"), at, 5, gapped=False).collect())
    got = kmers.count_kmers(frame, at, 5).collect()
    assert len(got) == len(want) and {(r["pos"], r["start"], r["end"], r["kmer"]): r["n"] for r in got} == want
