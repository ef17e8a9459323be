"""Pattern search, trees and alignment columns against brute force."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snpgrid.functions import stats
from snpgrid.operators import columns, patterns, tree

IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "N": "ACGT", "W": "AT"}
COMPLEMENT = str.maketrans("ACGT", "TGCA")


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("ACG", min_size=1, max_size=6), max_size=10), st.text("ACGN", max_size=1200))
def test_automaton(words, text):
    words = sorted(words)
    found, ends = patterns.Automaton(words).scan(patterns._CODE[np.frombuffer(text.encode(), np.uint8)])
    want = [(i, j + len(w)) for i, w in enumerate(words) for j in range(len(text) - len(w) + 1) if text.startswith(w, j)]
    assert sorted(zip(found.tolist(), ends.tolist(), strict=True)) == sorted(want)


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_pattern_search(spark, broadcast):
    rng = random.Random(8)
    seqs = {str(i): "".join(rng.choices("ACGTNacgt-", [8, 8, 8, 8, 1, 1, 1, 1, 1, 1], k=rng.choice([0, 3, 40, 700]))) for i in range(12)}
    held = {"9": "ACGTACGTA", "palindrome": "ACGT", "code": "AR-YN", "lower": "acg", "other": "AXC", "empty": "", "long": "".join(rng.choices("ACGT", k=40)), "none": None}
    held |= {f"p{i}": "".join(rng.choices("ACGT", k=rng.choice([2, 3, 5, 7]))) for i in range(30)}
    seqs["x"] = "TT" + held["long"] + "NN" + held["long"].translate(COMPLEMENT)[::-1]
    want = Counter()
    for p, pattern in held.items():
        clean = (pattern or "").replace("-", "").upper()
        if not clean or any(c not in IUPAC for c in clean):
            continue
        words = {"".join(w) for w in itertools.product(*(IUPAC[c] for c in clean))}
        for strand, w in {("+", w) for w in words} | {("-", w.translate(COMPLEMENT)[::-1]) for w in words}:
            for s, seq in seqs.items():
                want.update((p, s, i, i + len(w), strand) for i in range(len(seq) - len(w) + 1) if seq.upper().startswith(w, i))
    got = patterns.search_patterns(spark.createDataFrame([*seqs.items(), ("null", None)], "seq_id string, seq string"), spark.createDataFrame(list(held.items()), "pattern_id string, pattern string"), tile=64, shard=60, portion=500, broadcast=broadcast)
    assert Counter(tuple(r) for r in got.collect()) == want
    nothing = patterns.search_patterns(spark.createDataFrame([], "seq_id string, seq string"), spark.createDataFrame([], "pattern_id string, pattern string"), broadcast=broadcast)
    assert nothing.count() == 0


def random_tree(rng: random.Random, n: int, chain: float) -> list[tuple[str, str | None, float]]:
    names = [f"v{i}" for i in range(n)]
    rng.shuffle(names)
    return [(names[i], names[i - 1] if rng.random() < chain else names[rng.randrange(i)], rng.randint(0, 9) / 2) for i in range(1, n)]


@pytest.mark.parametrize(("n", "chain"), [(2, 0), (60, 0.2), (160, 0.97)])
def test_trees(spark, n, chain):
    edges = random_tree(random.Random(n), n, chain)
    up = {c: (p, x) for c, p, x in edges}

    def path(v):
        return [v] if v not in up else [*path(up[v][0]), v]

    df = spark.createDataFrame(edges, "child string, parent string, length double")
    paths = tree.tree_paths(df)
    nodes = {c for c, _, _ in edges} | {p for _, p, _ in edges}
    got = {r["node"]: r for r in paths.collect()}
    assert set(got) == nodes
    length = lambda v: sum(up[x][1] for x in path(v)[1:])
    assert all(got[v]["path"] == path(v) and got[v]["depth"] == len(path(v)) - 1 and got[v]["length"] == pytest.approx(length(v)) for v in nodes)
    order = [r["node"] for r in tree.preorder(paths).orderBy("at").collect()]
    assert order == [v for _, v in sorted((path(v), v) for v in nodes)]
    pairs = [(a, b) for a in nodes for b in nodes] if n < 100 else random.Random(1).sample([(a, b) for a in nodes for b in nodes], 900)
    rows = tree.shared_ancestors(spark.createDataFrame(pairs, "a string, b string"), paths).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        common = [x for x, y in zip(path(r["a"]), path(r["b"]), strict=False) if x == y]
        assert r["ancestor"] == common[-1] and r["dist"] == pytest.approx(length(r["a"]) + length(r["b"]) - 2 * length(common[-1]))
    leaves = nodes - {p for _, p, _ in edges}
    if n < 100:
        assert {(r["a"], r["b"]) for r in tree.leaf_distances(df).collect()} == set(itertools.combinations(sorted(leaves), 2))


def test_forests_and_wrong_trees(spark):
    make = lambda rows: spark.createDataFrame(rows, "child string, parent string")
    forest = tree.tree_paths(make([("a", "r"), ("b", "q"), ("q", None), (None, "r")]))
    assert {r["node"]: r["path"] for r in forest.collect()} == {"r": ["r"], "a": ["r", "a"], "q": ["q"], "b": ["q", "b"]}
    met = tree.shared_ancestors(spark.createDataFrame([("a", "b"), ("a", "r"), ("a", "?")], "a string, b string"), forest)
    assert {(r["a"], r["b"]): (r["ancestor"], r["dist"]) for r in met.collect()} == {("a", "b"): (None, None), ("a", "r"): ("r", 0.0)}
    assert tree.tree_paths(make([])).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        tree.tree_paths(make([("a", "b"), ("b", "a")]))
    with pytest.raises(ValueError, match="more than one parent"):
        tree.tree_paths(make([("a", "b"), ("a", "c")]))


def test_column_counts(spark):
    rng = random.Random(2)
    n, length = 9, 150
    reference = "".join(rng.choices("ACGTN", [5, 5, 5, 5, 1], k=length))
    cells = [list(reference) for _ in range(n)]
    spans = []
    for s in range(n):
        at = 0
        while at < length:
            at += rng.choice([1, 3, 40])
            end = at + rng.choice([1, 1, 2, 30])
            base = rng.choice("ACGTN--ax")
            spans.append((f"s{s}", at, end, base))
            for i in range(at, min(end, length)):
                cells[s][i] = base.upper() if base.upper() in "ACGTN-" else "N"
            at = end
    df = spark.createDataFrame([*spans, ("s0", -5, 0, "A"), ("s0", 7, 7, "A")], "sample_id string, start int, end int, base string")
    tiles = spark.createDataFrame([(i, reference[i : i + 64]) for i in range(0, length, 64)], "first int, bases string")
    got = {r["pos"]: tuple(r[x] for x in columns.STATES.values()) for r in columns.column_counts(df, n, tiles, length).collect()}
    assert got == {i: tuple(sum(row[i] == b for row in cells) for b in columns.STATES) for i in range(length)}
    segments = columns.column_segments(df, n, length).orderBy("start").collect()
    assert segments[0]["start"] == 0 and segments[-1]["end"] == length and all(a["end"] == b["start"] for a, b in itertools.pairwise(segments))
    bare = columns.column_segments(df.limit(0), n, length).collect()
    assert [tuple(r) for r in bare] == [(0, length, 0, 0, 0, 0, 0, 0, n)]


def test_spans_of_an_alignment(spark):
    seqs = spark.createDataFrame([("a", "ACGTA"), ("b", "ac-TTGG"), ("c", ""), ("d", None)], "seq_id string, seq string")
    got = {tuple(r) for r in columns.spans_of_alignment(seqs, "ACGTAC").collect()}
    assert got == {("a", 5, 6, "-"), ("b", 2, 3, "-"), ("b", 4, 5, "T"), ("b", 5, 6, "G"), ("c", 0, 6, "-"), ("d", 0, 6, "-")}


def gappy(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("ACGTN") if rng.random() < rng.choice([0.2, 0.9]) else "-" for _ in range(n))


def test_rank_and_select(spark, monkeypatch):
    monkeypatch.setattr(columns, "TILE", 3)
    rng = random.Random(6)
    seqs = {str(n): gappy(rng, n) for n in (0, 1, 63, 64, 65, 500, 1000)} | {"gaps": "-" * 300, "full": "A" * 300}
    blocks = columns.gap_blocks(spark.createDataFrame(list(seqs.items()), "seq_id string, seq string")).persist()
    points = spark.createDataFrame([(s, i) for s in seqs for i in range(1010)], "seq_id string, at long")
    ranks = {(r["seq_id"], r["at"]): (r["n"], r["n_is_gap"]) for r in columns.rank(points, blocks, "at", "n").collect() if r["at"] < len(seqs[r["seq_id"]])}
    assert ranks == {(s, i): (sum(c != "-" for c in q[:i]), q[i] == "-") for s, q in seqs.items() for i in range(len(q))}
    found = {(r["seq_id"], r["at"]): r["col"] for r in columns.select(points, blocks, "at", "col").collect()}
    assert found == {(s, u): i for s, q in seqs.items() for u, i in enumerate(i for i, c in enumerate(q) if c != "-")}


def test_gapped_kmers(spark, monkeypatch):
    monkeypatch.setattr(columns, "TILE", 1)
    rng = random.Random(9)
    seqs = {str(i): gappy(rng, rng.choice([0, 5, 70, 200])) for i in range(12)} | {"gaps": "-" * 80, "plain": "ACGT" * 30}
    at, k = [0, 1, 4, 5, 63, 64, 66, 100, 150, 400], 6
    want = set()
    for s, q in seqs.items():
        for pos in at:
            for start in range(max(0, pos - k + 1), pos) if pos < len(q) and q[pos] in "ACGT" else ():
                letters = [i for i in range(start, len(q)) if q[i] != "-"][:k]
                kmer = "".join(q[i] for i in letters)
                if len(kmer) == k and letters[-1] >= pos and kmer.count("N") <= 1:
                    want.add((s, pos, start, letters[-1] + 1, kmer))
    got = columns.gapped_kmers(spark.createDataFrame(list(seqs.items()), "seq_id string, seq string"), spark.createDataFrame([(p,) for p in at], "pos int"), k, 1)
    assert {tuple(r) for r in got.collect()} == want and want
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()


def test_ln_factorial(spark):
    n = [0, 1, 2, 31, 32, 33, 100, 10**6, 10**9]
    got = spark.createDataFrame([(x,) for x in n], "n long").select(stats.ln_factorial(F.col("n"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.lgamma(x + 1) for x in n], rel=1e-14, abs=1e-14)


def test_expected_information(spark, monkeypatch):
    monkeypatch.setattr(stats, "_TERMS", 5)
    rng = random.Random(1)
    labels = [(rng.choice("aaabbc"), rng.choice("xxyz")) for _ in range(60)]
    n = len(labels)
    xs, ys = Counter(a for a, _ in labels).values(), Counter(b for _, b in labels).values()
    want = 0.0
    for x in xs:
        for y in ys:
            for k in range(max(1, x + y - n), min(x, y) + 1):
                want += k / n * math.log(n * k / (x * y)) * math.comb(x, k) * math.comb(n - x, y - k) / math.comb(n, y)
    rows = [spark.createDataFrame(list(Counter(v).items()), f"{c} long, times long") for v, c in ((xs, "x"), (ys, "y"))]
    assert stats.expected_information(*rows, n).first()[0] == pytest.approx(want)
    assert stats.adjusted_mutual_info(spark.createDataFrame([], "p string, q string"), "p", "q").first()[0] == 1.0


@pytest.mark.parametrize("side", [1, 3, 64])
def test_leaf_distances_by_blocks(spark, monkeypatch, side):
    """All pairs of leaves of a forest of uneven trees against shared ancestors pair by pair, in blocks of few leaves."""
    monkeypatch.setattr(tree, "SIDE", side)
    rng = random.Random(23)
    edges = [(f"n{i}", None if i % 13 == 0 else f"n{rng.randrange(i // 13 * 13, i)}", rng.random()) for i in range(32)]
    df = spark.createDataFrame(edges, "child string, parent string, length double")
    got = [tuple(r) for r in tree.leaf_distances(df).select("a", "b", "ancestor", "dist").collect()]
    leaves = sorted({c for c, _, _ in edges} - {p for _, p, _ in edges})
    pairs = spark.createDataFrame(list(itertools.combinations(leaves, 2)), "a string, b string")
    want = {(r["a"], r["b"]): (r["ancestor"], r["dist"]) for r in tree.shared_ancestors(pairs, tree.tree_paths(df)).collect()}
    assert len(got) == len(want) and {(a, b) for a, b, _, _ in got} == set(want)
    assert all(want[a, b][0] == up and want[a, b][1] == (d if d is None else pytest.approx(d)) for a, b, up, d in got)
