"""The commands on a small published example against its published outputs; the reference record is made up, since none is published."""

from __future__ import annotations

import csv
import random
from pathlib import Path

import pytest

from snpgrid.plans import reports, workflow

DATA = Path(__file__).parent / "data"
LENGTH, MARKER = 4_809_037, (2_402_705, "T")


def table(path: Path) -> list[dict[str, str]]:
    files = sorted(path.glob("part-*")) if path.is_dir() else [path]
    return [r for f in files for r in csv.DictReader(f.open(), delimiter="\t")]


def rows(path: Path, *columns: str) -> list[tuple]:
    return sorted(tuple(r[c] or "" for c in columns) for r in table(path))


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("create")
    genome = bytearray(random.Random(7).choices(b"ACGT", k=LENGTH))
    for line in (DATA / "snps.vcf").read_text().splitlines():
        if not line.startswith("#"):
            f = line.split("\t")
            genome[int(f[1]) - 1] = ord(f[3])
    genome[MARKER[0]] = ord(MARKER[1])
    record = out / "record.gbk"
    record.write_text(f"LOCUS       REC {LENGTH} bp\nVERSION     REC.1\nFEATURES             Location/Qualifiers\nORIGIN\n        1 {genome.decode().lower()}\n//\n")
    config = workflow.Create(in_var=str(DATA / "snps.vcf"), in_meta=str(DATA / "sample.meta.txt"), outdir=str(out), reference=str(record), in_nwk=str(DATA / "tree.nwk"), root_name="root.0")
    workflow.create(spark, config)
    return out


def test_genotypes(built):
    for name in ("genotypes.raw", "genotypes.supported", "genotypes.selected"):
        assert rows(built / f"scheme-{name}.txt", "sample_id", "genotype") == rows(DATA / f"{name}.txt", "sample_id", "genotype"), name


def test_distance_genotypes(built):
    golden = table(DATA / "genotypes.distance.txt")
    columns = tuple(golden[0])
    assert rows(built / "scheme-genotypes.distance.txt", *columns) == rows(DATA / "genotypes.distance.txt", *columns)


def test_distances(built):
    strip = lambda p: sorted(tuple(r.values()) for r in table(p))
    assert strip(built / "scheme-dist.mat.txt") == strip(DATA / "dist.mat.txt")
    assert list(table(built / "scheme-dist.mat.txt")[0])[1:] == list(table(DATA / "dist.mat.txt")[0])[1:]


def test_clade_report(built):
    """All rows and columns; which metadata field the published file shows is not derivable, so the last three columns are left out."""
    mine, golden = table(built / "scheme-clades.info.txt"), table(DATA / "clades.info.txt")
    assert list(mine[0]) == list(golden[0]) == list(reports.CLADE) and len(mine) == len(golden) == 107
    key = lambda r: (r["clade_id"], int(r["pos"]), r["base"])
    for a, b in zip(sorted(mine, key=key), sorted(golden, key=key), strict=True):
        for c in reports.CLADE[:-3]:
            try:
                assert float(a[c]) == pytest.approx(float(b[c]), abs=1e-9), (key(b), c)
            except ValueError:
                assert a[c] == b[c], (key(b), c, a[c])


def test_scheme(built):
    columns = ("variant_start", "target_variant", "state", "positive_genotypes")
    assert rows(built / "scheme-snp.scheme.txt", *columns) == rows(DATA / "snp.scheme.txt", *columns)


def test_filtered_variants(built):
    lines = [x for f in sorted((built / "scheme-filtered.vcf").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == (DATA / "snps.vcf").read_text().splitlines()


def test_calls_and_scores(spark, tmp_path):
    calls = tmp_path / "calls"
    workflow.genotype(spark, workflow.Genotype(in_var=str(DATA / "snps.vcf"), in_scheme=str(DATA / "snp.scheme.txt"), outfile=str(calls), sample_meta=str(DATA / "sample.meta.txt")))
    golden = DATA / "genotype.calls.snps.txt"
    fixed = tuple(c for c in reports.CALL if c != "analysis_date")
    assert list(table(calls)[0])[: len(reports.CALL)] == list(reports.CALL) and rows(calls, *fixed) == rows(golden, *fixed)
    config = workflow.Benchmark(in_var=str(DATA / "snps.vcf"), in_scheme=str(DATA / "snp.scheme.txt"), in_genotype=str(golden), outdir=str(tmp_path / "b"), submitted_genotype_col="genotype", predicted_genotype_col="predicted_genotype")
    workflow.benchmark(spark, config)
    for mine, name, columns in (("scheme-scheme.scores.txt", "scheme.scores.txt", reports.SCORE), ("scheme-sample.results.txt", "sample.results.txt", reports.RESULT)):
        fixed = tuple(c for c in columns if c != "analysis_date")
        assert list(table(tmp_path / "b" / mine)[0]) == list(columns) and rows(tmp_path / "b" / mine, *fixed) == rows(DATA / name, *fixed), name


def test_namer(spark, tmp_path):
    (tmp_path / "names.tsv").write_text("node\tname\n0.2\tsecond one\n0.3\tthird one\n")
    workflow.namer(spark, workflow.Namer(in_scheme=str(DATA / "snp.scheme.txt"), in_names=str(tmp_path / "names.tsv"), outfile=str(tmp_path / "named")))
    mine, golden = table(tmp_path / "named"), table(DATA / "snp.scheme.txt")
    assert list(mine[0]) == list(golden[0]) and len(mine) == len(golden)
    names = {"0.2": "second one", "0.3": "third one"}
    for a, b in zip(mine, golden, strict=True):
        assert a["positive_genotypes"] == ",".join(names.get(x, x) for x in b["positive_genotypes"].split(","))


def test_kmer_half(built):
    """The published run has k-mers of 18 too, over a genome that is not published: the same states must find one here."""
    probes = (built / "scheme-probes.fasta").glob("part-*")
    lines = [x for f in probes for x in f.read_text().splitlines()]
    assert {len(x) for x in lines[1::2]} == {19}
    named = ("kmername", "target_pos", "target_base")
    assert set(rows(DATA / "probes.meta.txt", *named)) <= set(rows(built / "scheme-probes.meta.txt", *named))
    mine = rows(built / "scheme-probes.meta.txt", "target_pos", "target_base")
    published = {(str(int(r["variant_start"]) - 1), r["target_variant"]) for r in table(DATA / "snp.scheme.txt")}
    assert set(mine) <= published | {(str(MARKER[0]), MARKER[1])} and len(lines) == 2 * len(mine)
    scheme = table(built / "scheme-kmer.scheme.txt")
    assert {(r["variant_start"], r["target_variant"]) for r in scheme} == {(r["variant_start"], r["target_variant"]) for r in table(DATA / "snp.scheme.txt")}
    assert all(r["kseq"][int(r["variant_start"]) - 1 - int(r["kmer_start"])] == r["target_variant"] and r["klen"] == "18" for r in scheme)
    assert {r["is_valid"] for r in table(built / "scheme-extracted.kmers.txt")} <= {"true", "false"}


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """Six samples in three clades; at one site that marks a clade, one of two samples of another has a third base."""
    out = tmp_path_factory.mktemp("mixed")
    genome = "".join(random.Random(3).choices("ACGT", k=400))
    other = {"A": "CG", "C": "AG", "G": "AC", "T": "AC"}
    head = "##fileformat=VCFv4.2\n" + "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *"abcdef"])
    lines = []
    for pos, gts in ((60, "110000"), (120, "112000"), (200, "001100"), (300, "000011"), (350, "111100")):
        ref = genome[pos - 1]
        lines.append("\t".join(["1", str(pos), ".", ref, ",".join(other[ref]), ".", "PASS", ".", "GT", *gts]))
    (out / "x.vcf").write_text(head + "\n" + "\n".join(lines) + "\n")
    (out / "t.nwk").write_text("((a:1,b:1):4,(c:1,d:1):2,(e:1,f:1):9);" + " " * 20)
    (out / "m.tsv").write_text("sample_id\thost\n" + "".join(f"{s}\thuman-or-not\n" for s in "abcdef"))
    (out / "r.gbk").write_text(f"LOCUS       R 400 bp\nVERSION     R.1\nFEATURES             Location/Qualifiers\nORIGIN\n        1 {genome.lower()}\n//\n")
    config = workflow.Create(in_var=str(out / "x.vcf"), in_meta=str(out / "m.tsv"), outdir=str(out), reference=str(out / "r.gbk"), in_nwk=str(out / "t.nwk"), no_compression=True)
    workflow.create(spark, config)
    return out, genome, other, config


def test_snp_rules_take_all_samples(mixed):
    """With the default share of k-mers, a base of half a genotype's samples is partial in the SNP scheme."""
    out, genome, other, _ = mixed
    scheme = table(out / "scheme-snp.scheme.txt")
    third = [r for r in scheme if r["variant_start"] == "120" and r["target_variant"] == other[genome[119]][1]]
    assert third and all(r["partial_genotypes"] and not r["positive_genotypes"] for r in third)


def test_create_roots_at_the_midpoint(spark, mixed):
    out, _, _, config = mixed
    paths = {r["sample_id"]: r["genotype"] for r in table(out / "scheme-genotypes.raw.txt")}
    # the branch of length 9 is in the middle of the longest way
    assert {s for s, p in paths.items() if p.split(".")[1] == paths["e"].split(".")[1]} == {"e", "f"}
    assert not (out / "scheme-tmp").exists()
    with pytest.raises(ValueError, match="force"):
        workflow.create(spark, config)
    with pytest.raises(ValueError, match="root_method"):
        workflow.create(spark, workflow.Create(**{**config.__dict__, "root_method": "outgroup"}))


def test_pseudo_sequences_of_create(mixed):
    out, genome, other, _ = mixed
    want = {s: list(genome) for s in "abcdef"}
    for line in (out / "x.vcf").read_text().splitlines()[2:]:
        f = line.split("\t")
        for s, gt in zip("abcdef", f[9:], strict=True):
            want[s][int(f[1]) - 1] = [f[3], *f[4].split(",")][int(gt)]
    text = "".join(f.read_text() for f in sorted((out / "scheme-pseudo.seqs.fasta").glob("part-*")))
    got = {x.split("\n", 1)[0]: x.split("\n", 1)[1].replace("\n", "") for x in text.split(">")[1:]}
    assert list(got) == list("abcdef") and got == {s: "".join(x) for s, x in want.items()}
