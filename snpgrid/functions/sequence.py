"""Sequence functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the IUPAC nucleotide codes and the bases they stand for
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
# fixed values: codes and their complements; the standard genetic code with codons in order of T, C, A, G
CODES, COMPLEMENTS = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"
CODON_BASES, AMINO_ACIDS = "TCAG", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def revcomp(seq: Column) -> Column:
    """Reverse complement, IUPAC codes and both cases."""
    return F.reverse(F.translate(seq, CODES + CODES.lower(), COMPLEMENTS + COMPLEMENTS.lower()))


def canonical_kmer(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, revcomp(kmer))


def iupac_code(bases: Column) -> Column:
    """Code of a sorted array of distinct bases; ``-`` for none."""
    by_bases = F.create_map(*(F.lit(x) for code, b in IUPAC.items() for x in (b, code)))
    return F.coalesce(F.try_element_at(by_bases, F.array_join(bases, "")), F.lit("-"))


def expand_degenerate(seq: Column) -> Column:
    """All plain sequences that a degenerate one stands for."""
    by_code = F.create_map(*(F.lit(x) for code, b in IUPAC.items() for x in (code, b)))
    letters = F.transform(F.split(seq, ""), lambda c: F.split(F.try_element_at(by_code, c), ""))
    start = F.array(F.lit(""))
    return F.aggregate(letters, start, lambda acc, xs: F.flatten(F.transform(acc, lambda a: F.transform(xs, lambda x: F.concat(a, x)))))


def longest_homopolymer(seq: Column, bases: str = "ACGT") -> Column:
    """Length of the longest run of one of ``bases``; 0 if there is none."""
    runs = F.regexp_extract_all(seq, F.lit("(" + "|".join(f"{b}+" for b in bases) + ")"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def translate_codon(codon: Column) -> Column:
    """Amino acid of a codon, X if a base is unknown."""
    at = [F.instr(F.lit(CODON_BASES), F.substring(codon, i, 1)) for i in (1, 2, 3)]
    number = (at[0] - 1) * 16 + (at[1] - 1) * 4 + at[2]
    known = reduce(lambda a, b: a & b, (x > 0 for x in at)) & (F.length(codon) == 3)
    return F.when(known, F.substring(F.lit(AMINO_ACIDS), number, F.lit(1))).otherwise("X")


def ungapped_positions(aligned: Column) -> Column:
    """For each ungapped index its index in the aligned sequence (0-based)."""
    return F.filter(F.sequence(F.lit(0), F.length(aligned) - 1), lambda i: F.substring(aligned, i + 1, F.lit(1)) != "-")


def mutation_name(ref: Column, pos: Column, alt: Column) -> Column:
    return F.concat(F.lit("snp_"), ref, F.lit("_"), (pos + 1).cast("string"), F.lit("_"), alt)
