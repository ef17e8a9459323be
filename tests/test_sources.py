"""Readers and writers."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from snpgrid.operators import sites
from snpgrid.sources import genbank, newick, pseudo, tables, vcf, vcf_source

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3\ts4
1\t10\t.\tA\tT,G\t.\tPASS\t.\tGT\t0\t1\t2\t.
1\t20\t.\tC\tG\t.\tPASS\t.\tGT\tA\t*\t0/1\t1:7
1\t30\t.\tG\tGA\t.\tPASS\t.\tGT\t0\t1\t0\t-
1\t40\t.\tT\tA\t.\tPASS\t.\tGT\t0\t0\t0\t0
"""


@pytest.fixture
def vcf_file(tmp_path):
    p = tmp_path / "x.vcf"
    p.write_text(VCF)
    return str(p)


def test_vcf(spark, vcf_file, tmp_path):
    calls = vcf.read_calls(spark, vcf_file)
    got = {(r["pos"], r["sample_id"]): r["base"] for r in calls.collect()}
    assert [got[9, s] for s in ("s1", "s2", "s3", "s4")] == ["A", "T", "G", "N"]
    assert [got[19, s] for s in ("s1", "s2", "s3", "s4")] == ["A", "-", "N", "G"]
    assert [got[29, s] for s in ("s1", "s2", "s3", "s4")] == ["G", "N", "G", "-"]
    assert vcf.sample_ids(spark, vcf_file) == ["s1", "s2", "s3", "s4"]
    some = vcf.read_calls(spark, vcf_file, spark.createDataFrame([(19,), (19,), (500,)], "pos int"))
    assert {(r["pos"], r["sample_id"]): r["base"] for r in some.collect()} == {k: v for k, v in got.items() if k[0] == 19} and some.count() == 4
    kept, bad = sites.filter_sites(calls, max_states=3, max_missing=0.5)
    assert sorted(r["pos"] for r in bad.collect()) == [29, 39]
    vcf.filter_file(spark, vcf_file, bad, str(tmp_path / "f"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "f")).collect()]
    assert lines == [x for i, x in enumerate(VCF.splitlines()) if i not in (4, 5)]
    vcf.write_calls(kept.where("base <> '-'"), ["s1", "s2", "s3", "s4"], str(tmp_path / "w"))
    again = {(r["pos"], r["sample_id"]): r["base"] for r in vcf.read_calls(spark, str(tmp_path / "w")).collect()}
    assert again[9, "s3"] == "G" and again[19, "s4"] == "G" and again[19, "s2"] == "N"


def test_vcf_without_header(spark, tmp_path):
    (tmp_path / "bad.vcf").write_text("1\t2\t3\n")
    with pytest.raises(ValueError, match="CHROM"):
        vcf.read_calls(spark, str(tmp_path / "bad.vcf"))


def test_tables(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("sample_id\tyear\thost\na\t2010\t\nb\t0.10\tcow\na\t2011\tpig\n")
    rows = {r["sample_id"]: r.asDict() for r in tables.read_metadata(spark, str(tmp_path / "m.tsv")).collect()}
    assert rows["a"]["year"] == "2011" and rows["b"]["year"] == "0.10"
    assert tables.read_metadata(spark, str(tmp_path / "m.tsv"), "none").count() == 0
    (tmp_path / "g.tsv").write_text("sample_id\tgenotype\na\t0|1|2\nb\t0|1\n")
    samples, delimiter = tables.read_groups(spark, str(tmp_path / "g.tsv"))
    assert delimiter == "|" and sorted(r["path"] for r in samples.collect()) == [["0", "1"], ["0", "1", "2"]]
    (tmp_path / "d.tsv").write_text("x\ta\tb\tc\na\t0\t1\t2\nb\t1\t0\t3\nc\t2\t3\t0\n")
    dist = tables.read_distances(spark, str(tmp_path / "d.tsv"))
    assert sorted(map(tuple, dist.collect())) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 3)]
    order = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "sample_id string, ord long")
    tables.write_distances(dist, order, str(tmp_path / "o"))
    assert sorted(map(tuple, tables.read_distances(spark, str(tmp_path / "o")).collect())) == sorted(map(tuple, dist.collect()))
    with pytest.raises(ValueError, match="missing or empty"):
        tables.check_file(str(tmp_path / "none"))
    tables.write_histogram_html(spark, dist.groupBy("d").count().withColumnRenamed("count", "n"), str(tmp_path / "h"))
    assert "<svg" in spark.read.text(str(tmp_path / "h"), wholetext=True).first()[0]


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one\nacg\nT\n>b\nGG\n")
    assert sorted(map(tuple, tables.read_fasta(spark, str(tmp_path / "x.fa")).collect())) == [("a", "ACGT"), ("b", "GG")]


def test_newick(spark):
    root = newick.normalise("((a:1,b:2,c:3,d:1):1,(e:1,f:1):2);")
    assert sorted(n.name for n in root.leaves()) == list("abcdef") and all(len(n.children) in (0, 2) for n in root.preorder())
    by = {leaf: path for _, leaf, path in newick.paths(root)}
    assert by["e"][-1] == by["f"][-1] and by["e"][0] == "0"
    rooted = newick.paths(newick.normalise("((a,b),(c,d));", "c"))
    assert rooted[0] == (0, "c", ["0"]) and {x[1] for x in rooted} == set("abcd")
    assert newick.parse("('x y':1,b)r;").children[0].name == "x y"
    for bad in ("((a,b);", "a,b);"):
        with pytest.raises(ValueError, match="unbalanced"):
            newick.parse(bad)
    got = newick.leaf_distances(spark, newick.normalise("((a:1,b:2):1,c:4);")).collect()
    assert {(r["a"], r["b"]): r["dist"] for r in got} == {("a", "b"): 3.0, ("a", "c"): 6.0, ("b", "c"): 7.0}
    assert newick.internal_clades(newick.normalise("((a,b),c);")) == {"0": ["c", "a", "b"], "1": ["a", "b"]}
    assert newick.nested(newick.parse("(a,b)r;")) == {"name": "r", "children": [{"name": "a"}, {"name": "b"}]}
    kept = newick.remove_clades(newick.normalise("(((a,b),c),d);"), {"0"})
    assert {n.name for n in kept.children} == set("abcd")


GBK = """LOCUS       chr1                      30 bp
VERSION     chr1.2
FEATURES             Location/Qualifiers
     source          1..30
     CDS             join(1..3,7..9)
                     /gene="x"
                     /locus_tag="L1"
                     /translation="MK
                     L"
     CDS             complement(<10..>15)
                     /gene="y"
ORIGIN
        1 atgaaacccg ggtttaaacc cgggtttaaa
//
"""


def test_genbank(spark, tmp_path):
    (tmp_path / "r.gbk").write_text(GBK)
    features, accession, seq = genbank.read_features(spark, str(tmp_path / "r.gbk"))
    rows = features.orderBy("ord", "seg_start").collect()
    assert accession == "chr1" and len(seq) == 30 and [r["gene_name"] for r in rows] == ["L1", "L1", "y"]
    assert rows[0]["dna_seq"] == "ATGCCC" and rows[0]["aa_seq"] == "MKL" and rows[2]["dna_seq"] == "AAACCC" and (rows[2]["seg_start"], rows[2]["seg_end"]) == (9, 14)


def test_pseudo_sequences(spark, tmp_path):
    rng = random.Random(4)
    reference = "".join(rng.choices("ACGT", k=1000))
    variants = [(s, p, rng.choice("ACGTN-")) for s in ("a", "b") for p in rng.sample(range(1000), 300)] + [("b", 0, "T"), ("b", 999, "G"), ("c", 119, "-"), ("c", 120, "N")]
    want = {}
    for sample in "bacd":  # d has no variants
        seq = list(reference)
        for p in range(1000):
            if own := sorted(b for s, q, b in variants if (s, q) == (sample, p)):
                seq[p] = own[0]
        want[sample] = "".join(seq)
    samples = spark.createDataFrame([(i, s) for i, s in enumerate("bacd")], "ord long, sample_id string").repartition(3)
    frame = spark.createDataFrame(variants, "sample_id string, pos int, base string")
    pseudo.write_pseudo_fasta(samples, frame, reference, str(tmp_path / "f"), tile=120)
    lines = [x for f in sorted((tmp_path / "f").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x for x in lines if x.startswith(">")] == [">b", ">a", ">c", ">d"]
    assert {len(x) for x in lines if not x.startswith(">")} == {60, 40}
    got, name = {}, ""
    for x in lines:
        name = x[1:] if x.startswith(">") else name
        got[name] = got.get(name, "") + ("" if x.startswith(">") else x)
    assert got == want
    with pytest.raises(ValueError, match="beyond"):
        pseudo.pseudo_tiles(samples, spark.createDataFrame([("a", 1000, "T")], "sample_id string, pos int, base string"), reference)


def test_alternative_sequence(spark):
    alt = spark.createDataFrame([(0, "C")], "pos int, alt_base string")
    assert pseudo.alternative_sequence("ACGT", alt) == "CCGT"
    assert alt.select(F.col("pos")).count() == 1


def ways(root):
    """Lengths of the ways between leaves, by walking from each."""
    out = {}
    for a in root.leaves():
        _, _, far = newick._sweep(root, a)
        out |= {frozenset((a.name, b.name)): far[id(b)] for b in root.leaves() if b is not a}
    return out


@pytest.mark.parametrize("seed", range(40))
def test_midpoint_rooting(seed):
    rng = random.Random(seed)

    def subtree(n):
        if n == 1:
            return f"x{next(names)}:{rng.randint(0, 8)}"
        parts, left = [], n
        while left:
            k = rng.randint(1, max(1, min(left, n - 1)))
            parts.append(subtree(k))
            left -= k
        return f"({','.join(parts)}):{rng.randint(0, 8)}"

    names = itertools.count()
    text = subtree(rng.randint(2, 14)).rpartition(":")[0] + ";"
    before = newick.normalise(text)
    lengths = ways(before)
    longest = max(lengths.values())
    root = newick.normalise(text, at_midpoint=True)
    after = ways(root)
    assert set(after) == set(lengths) and all(after[k] == pytest.approx(lengths[k]) for k in lengths)
    assert all(len(n.children) != 1 for n in root.preorder())
    if longest:
        # the middle of a longest way lies on the two branches at the root
        left, right = root.children
        depth = lambda top: max(newick._sweep(top, top)[2].values())
        left.parent = right.parent = None
        reach = [depth(left), depth(right)]
        assert sum(reach) + left.dist + right.dist == pytest.approx(longest)
        assert max(reach) <= longest / 2 + 1e-9 and left.dist == right.dist


def test_rooting_beside_an_old_root_of_two():
    root = newick.normalise("((a:1,b:1):2,c:5);", "c")
    assert [c.name for c in root.children] == ["c", "1"] and root.children[0].dist == root.children[1].dist == 3.5
    assert newick.midpoint(newick.parse("(a:0,b:0);")) is None


def test_wide_distance_matrix(spark, tmp_path):
    samples = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "sample_id string, ord long")
    dist = spark.createDataFrame([("b", "a", 3), ("b", "c", 1), ("a", "c", 2)], "s1 string, s2 string, d long")
    tables.write_distances(dist, samples, str(tmp_path / "m"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "m")).collect()] == ["dists\tb\ta\tc", "b\t0\t3\t1", "a\t3\t0\t2", "c\t1\t2\t0"]
    assert {tuple(r) for r in tables.read_distances(spark, str(tmp_path / "m")).collect()} == {("b", "a", 3), ("b", "c", 1), ("a", "c", 2)}


@pytest.mark.parametrize("size", [10_000, 64, 7])
def test_vcf_data_source(spark, vcf_file, size):
    """Every partition size gives the calls of the text scan; filters reach the reader and are gone from the plan."""
    vcf_source.register(spark)
    read = lambda **more: spark.read.format("vcf").options(partition_bytes=size, **more).load(vcf_file)
    key = lambda df: sorted(map(tuple, df.select("chrom", "pos", "ref", "sample_id", "base").collect()))
    want = key(vcf.read_calls(spark, vcf_file))
    assert key(read()) == want
    some = read().where(F.col("pos").isin(19, 39, 77) & (F.col("sample_id") == "s2"))
    assert key(some) == [r for r in want if r[1] in (19, 39) and r[3] == "s2"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("Filters", ""), plan
    assert key(read().where("pos > 9 AND pos <= 29")) == [r for r in want if 9 < r[1] <= 29]
    assert key(read().where("chrom = '2'")) == [] and key(read(samples="s1,s4")) == [r for r in want if r[3] in ("s1", "s4")]
    assert key(read().where("base = 'N' AND pos >= 9")) == [r for r in want if r[4] == "N"]


def test_pushed_positions_drop_lines():
    """Cells of lines at other positions are never split."""
    wanted = vcf_source.Wanted()
    rest = [f for f in (In(("pos",), (3, 5, None)), GreaterThan(("pos",), 3), EqualTo(("base",), "A"), EqualTo(("s", "pos"), 1)) if not wanted.take(f)]
    assert len(rest) == 2 and wanted.pushed == ["In(pos)", "GreaterThan(pos)"]
    assert [p for p in range(8) if wanted.line("1", p)] == [5]
