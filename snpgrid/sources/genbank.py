"""GenBank records: sequence and coding features with their segments (driver side; a reference is one record)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_COMPLEMENT = str.maketrans("ACGTRYSWKMBDHVNacgtryswkmbdhvn", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn")
KEPT = ("CDS", "5'UTR", "3'UTR")


def location(text: str) -> list[tuple[int, int, bool]]:
    """Segments (start, end, reverse) of a location, 0-based half-open, in reading order; < and > are ignored."""
    text = re.sub(r"[<>\s]", "", text)

    def parts(t: str) -> list[str]:
        out, depth, at = [], 0, 0
        for i, c in enumerate(t):
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                out.append(t[at:i])
                at = i + 1
        return [*out, t[at:]]

    def read(t: str, reverse: bool) -> list[tuple[int, int, bool]]:
        if m := re.fullmatch(r"complement\((.*)\)", t):
            return read(m[1], not reverse)
        if m := re.fullmatch(r"(?:join|order)\((.*)\)", t):
            return [s for p in parts(m[1]) for s in read(p, reverse)]
        if m := re.fullmatch(r"(?:[\w.]+:)?(\d+)(?:(?:\.\.|\^)(\d+))?", t):
            a, b = int(m[1]), int(m[2] or m[1])
            return [(a - 1, b, reverse)]
        raise ValueError(f"location {t}")

    return read(text, False)


def parse(text: str) -> dict:
    """Accession, version, sequence and features of the first record."""
    locus = re.search(r"^LOCUS\s+(\S+)", text, re.M)
    version = re.search(r"^VERSION\s+(\S+)", text, re.M)
    accession = locus[1] if locus else ""
    origin = re.search(r"^ORIGIN.*?\n(.*?)^//", text, re.M | re.S)
    seq = re.sub(r"[^A-Za-z]", "", origin[1]).upper() if origin else ""
    table = re.search(r"^FEATURES.*?\n(.*?)^(?:ORIGIN|CONTIG|//)", text, re.M | re.S)
    features = []
    for m in re.finditer(r"^ {5}(\S+)\s+(.*?)(?=^ {5}\S|\Z)", table[1] if table else "", re.M | re.S):
        kind, body = m[1], m[2]
        if kind not in KEPT:
            continue
        where, *qualifiers = re.split(r"\n\s+/", body)
        q = {}
        for item in qualifiers:
            k, _, v = item.partition("=")
            v = re.sub(r"\n\s+", "" if k == "translation" else " ", v.strip())
            q.setdefault(k.strip(), v.strip('"'))
        segments = location(where)
        dna = "".join(seq[a:b].translate(_COMPLEMENT)[::-1] if r else seq[a:b] for a, b, r in segments)
        features.append({"type": kind, "gene_name": q.get("locus_tag", q.get("gene", "")), "dna_seq": dna, "aa_seq": q.get("translation", ""), "gene_len": len(dna), "segments": segments})
    return {"accession": accession, "version": version[1] if version else accession, "seq": seq, "features": features}


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, str, str]:
    """(features, accession, sequence); features: ord, type, gene_name, gene_start, gene_end, gene_len, dna_seq, aa_seq, seg_start, seg_end (inclusive), a row a segment."""
    record = parse("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    rows = []
    for i, f in enumerate(record["features"]):
        start, end = min(s[0] for s in f["segments"]), max(s[1] for s in f["segments"])
        rows += [(i, f["type"], f["gene_name"], start, end, f["gene_len"], f["dna_seq"], f["aa_seq"], a, b - 1) for a, b, _ in f["segments"]]
    schema = "ord int, type string, gene_name string, gene_start int, gene_end int, gene_len int, dna_seq string, aa_seq string, seg_start int, seg_end int"
    return spark.createDataFrame(rows, schema), record["accession"], record["seq"]
