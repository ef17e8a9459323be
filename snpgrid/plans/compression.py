"""Choice of hierarchy levels on the collected clade table (one row a node, so thousands at most)."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass


@dataclass(frozen=True)
class Clade:
    num_members: int
    n_snps: int
    ave_within: float
    closest_dist: float
    closest_clade: str | None


@dataclass
class Selection:
    valid: set[str]
    selected: set[str]
    supported: dict[str, str]
    genotypes: dict[str, str]


def named(paths: dict[str, list[str]], valid: set[str], delimiter: str = ".") -> dict[str, str]:
    return {s: delimiter.join(n for n in p if n in valid) for s, p in paths.items()}


def thresholds(values: list[float], parts: int = 10) -> list[float]:
    """Last values of about ten equally filled bins of the sorted values; equal values stay together."""
    values = sorted(values)
    out, held, most = [], 0, int(len(values) / parts)
    for i, v in enumerate(values):
        if held > most and v > values[i - 1]:
            out.append(values[i - 1])
            held = 0
        held += 1
    return [*out, values[-1]] if values else []


def close(clades: dict[str, Clade], least: float) -> set[str]:
    near = {n for n, c in clades.items() if c.closest_dist < least}
    return near | {clades[n].closest_clade for n in near if clades[n].closest_clade is not None}


def steps(paths: dict[str, list[str]], valid: set[str]) -> set[tuple[str, str]]:
    kept = ([n for n in p if n in valid] for p in paths.values())
    return {pair for p in kept for pair in zip(p, p[1:], strict=False)}


def select(paths: dict[str, list[str]], clades: dict[str, Clade], min_members: int = 1, min_snps: int = 1, min_distance: float = 0, resolution: float = 0, compress: bool = True) -> Selection:
    """Valid nodes, selected nodes, and genotypes before and after compression.

    A node needs members and SNPs.  Compression drops nodes too close to another, children that do not fork and share a distance bin with their
    parent, and all but the last node of a path; then the root and the last nodes of the supported genotypes of more than two levels return.
    """
    good = {n for n, c in clades.items() if c.num_members >= min_members and c.n_snps >= min_snps}
    supported = named(paths, good)
    if not compress:
        return Selection(good, set(good), supported, named(paths, good))
    children: dict[str, set[str]] = defaultdict(set)
    for a, b in steps(paths, good):
        children[a].add(b)
    forks = {a for a, bs in children.items() if len(bs) > 1}
    left = good - close(clades, min_distance)
    bins = [{n for n, c in clades.items() if c.ave_within <= t} for t in thresholds([c.ave_within for c in clades.values()])]
    merged = {b for a, b in steps(paths, left) if b not in forks and any(a in s and b in s for s in bins)}
    left -= merged
    ends = {g[-1] for g in ([n for n in p if n in left] for p in paths.values()) if g}
    selected = left & ends
    roots = {p[0] for p in paths.values() if p} & clades.keys()
    valid = selected | roots
    fine = {n for n, c in clades.items() if c.ave_within < resolution}
    back = set()
    for g in supported.values():
        levels = g.split(".")
        if len(levels) > 2 and (kept := [n for n in levels if n not in fine]):
            back.add(kept[-1])
    valid = (valid - fine) | back
    return Selection(valid, selected | roots, supported, named(paths, valid))
