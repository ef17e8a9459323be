"""Operators on documents against brute force, on a table of edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from snpgrid.llm.common import components, Scratch
from snpgrid.llm.decontaminate import contamination
from snpgrid.llm.exact_dedup import exact_duplicates
from snpgrid.llm.mixing import mix, mix_plan, source_targets
from snpgrid.llm.near_dedup import near_duplicates
from snpgrid.llm.substring_dedup import drop_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, c string, h string, n long, count long, row string, part int"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def corpus() -> list[tuple]:
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)] + ["É", "ñandú", "日本語"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    long = text(9000)
    base = [text(rng.randint(30, 120)) for _ in range(12)]
    passage = text(60)
    rows: list[tuple[int | None, str | None]] = list(enumerate(base))
    for i in range(20, 30):  # near copies of one text
        w = base[0].split()
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(40, base[1]), (41, base[1].upper()), (42, base[1]), (43, None), (44, ""), (45, " \t\n "), (46, "one"), (47, "ONE"), (48, "a b c d"), (49, "a  b c\td"), (50, long), (51, long + " tail")]
    rows += [(None, base[2]), (None, "no id here"), (60, base[3]), (60, base[3]), (61, passage + " " + text(20)), (62, text(15) + "\n" + passage), (63, passage * 1 + " " + passage), (64, "z " * 80), (65, "É é É É é")]
    return [(i, t, "en", [None, "b", "a", "", "hot", "hot", "hot"][k % 7], 0, 1, "c", "h", 2, 3, "r", 4) for k, (i, t) in enumerate(rows)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t: str | None) -> frozenset:
    w = WORD.findall((t or "").translate(AZ))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(docs, nothing):
    sets = [shingles(r[1]) for r in ROWS]
    label = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    smallest = {}
    for k, r in enumerate(ROWS):
        if r[0] is not None:
            smallest[label[k]] = min(r[0], smallest.get(label[k], r[0]))
    want = Counter()
    for k, r in enumerate(ROWS):
        c = smallest.get(label[k]) if sets[k] else r[0]
        want[(r[0], len(sets[k]), c, c == r[0])] += 1
    assert Counter(r[:4] for r in map(tuple, near_duplicates(docs).collect())) == want
    assert near_duplicates(nothing).count() == 0


def test_components(spark):
    rng = random.Random(1)
    key = lambda i: f"{i:04d}".encode()
    links = [(key(rng.randrange(200)), key(rng.randrange(200))) for _ in range(120)] + [(key(i), key(i + 1)) for i in range(300, 340)]
    edges = spark.createDataFrame(links, "a binary, b binary")
    root = {x: x for e in links for x in e}
    for _ in root:
        for x, y in links:
            root[x] = root[y] = min(root[x], root[y])
    got = {bytes(r[0]): bytes(r[1]) for r in components(Scratch(spark, "t"), edges, "a", "b").collect()}
    assert got == root and got[key(340)] == key(300)
    assert components(Scratch(spark, "t"), edges.limit(0), "a", "b").count() == 0


def test_components_of_hubs(spark):
    """A star of 3,000 links, whose hub and label are hot, beside a chain that reaches it."""
    links = [(1, i) for i in range(2, 3000)] + [(i, i + 1) for i in range(5000, 5030)] + [(5030, 2500)]
    edges = spark.createDataFrame(links, "x long, y long").select(*(F.expr(f"unhex(lpad(hex({c}), 16, '0'))").alias(c) for c in "xy"))
    got = components(Scratch(spark, "t"), edges, "x", "y").select("label").distinct().collect()
    assert [bytes(r[0]).hex() for r in got] == ["0000000000000001"]


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_duplicates(docs, nothing, keep, digest_bytes):
    groups: dict[str, list] = {}
    for r in ROWS:
        groups.setdefault((r[1] or "").translate(AZ), []).append(r[0])
    best = {"min": min, "max": max}[keep]
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        top = best(known) if known else None
        for i in ids:
            want[(i, top, len(ids), i == top, sha(t))] += 1
    assert Counter(map(tuple, exact_duplicates(docs, keep, digest_bytes).collect())) == want
    assert exact_duplicates(nothing).count() == 0


def test_contamination(spark, docs, nothing):
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    read = lambda t: words.findall((t or "").translate(AZ))
    w0, w4 = read(ROWS[0][1]), read(ROWS[4][1])
    items = [(1, " ".join(w0[3:15]).upper(), 7), (2, "one", 7), (3, " ".join(w4[2:6]), 7), (10, " ".join(w4[:10]) + " qqq", 7), (None, "a-b c", 7), (4, None, 7), (5, "", 7), (1, " ".join(w4[5:15]), 7), (6, "never seen here at all in any of these documents x", 7)]
    bench = spark.createDataFrame(items, "item_id long, text string, win int")
    want = Counter()
    for r in ROWS:
        ws, hit, names = read(r[1]), set(), set()
        for item, t, _ in items:
            iw = read(t)
            n = min(10, len(iw))
            for s in range(max(1, len(iw) - 9) if iw else 0):
                for p in range(len(ws) - n + 1):
                    if ws[p : p + n] == iw[s : s + n]:
                        hit.update(range(p, p + n))
                        names.add("" if item is None else str(item))
        want[(r[0], len(ws), len(hit), len(names), sha(",".join(sorted(names))), bool(hit))] += 1
    assert Counter(r[:6] for r in map(tuple, contamination(docs, bench).collect())) == want
    assert contamination(nothing, bench).count() == 0
    assert contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_mixing(docs, nothing):
    size = Counter()
    for r in ROWS:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        open_ = [s for s in order if s not in capped]
        rest = total - sum(3 * size[s] for s in capped)
        target = {s: 3.0 * size[s] if s in capped else weight[s] * rest / sum(weight[x] for x in open_) for s in order}
        new = {s for s in open_ if target[s] > 3 * size[s]}
        if not new:
            break
        capped |= new
    got = mix_plan(docs).collect()
    assert len(got) == len(ROWS)
    taken = Counter()
    for r in got:
        s = r["row"]["source"]
        assert r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        rate = target[s] / size[s] if size[s] else 0
        assert int(rate) <= r["copies"] <= int(rate) + (rate > int(rate)) and r["copies"] <= 3
        taken[s] += r["copies"]
    out = mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert sorted(map(str, out.collect())) == sorted(map(str, mix(docs).collect()))
    assert mix(nothing).count() == 0


def test_deep_nodes_against_brute_force():
    """Leaves, and depths, of the deep nodes of each group against all pairs of suffixes."""
    from snpgrid.llm.substring_dedup import deep_nodes

    rng = random.Random(9)
    for window in (3, 5, 35):
        contexts, groups = [], []
        for _ in range(60):
            groups.append(rng.randrange(4))
            contexts.append([rng.randrange(2) for _ in range(window + rng.randrange(12))])
            if rng.random() < 0.5:
                contexts.append(contexts[-1][: window + rng.randrange(3)] + [7])
                groups.append(groups[-1])
        n = [rng.randint(1, len(c) - window + 1) for c in contexts]
        begin = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
        got = set(zip(*map(np.ndarray.tolist, deep_nodes(np.array(groups), np.concatenate([np.array(c) for c in contexts]), begin, np.array(n), window)), strict=True))
        suffixes = [(i, s, c[s:]) for i, c in enumerate(contexts) for s in range(n[i])]
        want = set()
        for i, s, x in suffixes:
            same = [y for j, t, y in suffixes if groups[i] == groups[j] and (i, s) != (j, t) and y[:window] == x[:window]]
            if same:
                want.add((i, s, min(next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))) for y in same)))
        assert {r[:2] for r in got} == {r[:2] for r in want} and want and all(d >= window for *_, d in got)
        shared = {r[:2]: r[2] for r in want}
        assert all(window <= d <= shared[i, s] for i, s, d in got)


def test_index_filters(spark):
    """A run's filter lets through all that it holds and few others; runs are merged by level, and lookups keep the smallest identifier."""
    from snpgrid.llm.exact_dedup import DigestIndex

    digest = lambda x: F.unhex(F.sha2(F.col(x).cast("string"), 256)).alias("digest")
    index = DigestIndex(spark, Scratch(spark, "t"), "min")
    for b in range(6):
        index.flush(spark.range(b * 3000, b * 3000 + 4000).select(digest("id"), (F.col("id") + b).alias("id")))
    assert [r.level for r in index.runs] == [1, 0, 0]
    run = index.runs[1]
    assert run.pieces > 1 and run.may_hold(run.rows.select("digest")).count() == 4000
    assert run.may_hold(spark.range(10**6, 10**6 + 20_000).select(digest("id"))).count() < 3000
    got = index.lookup(spark.range(0, 30_000).select(digest("id")))
    assert got.count() == 19_000 and got.where("n = 2").count() == 5 * 1000
    assert index.lookup(spark.range(3000, 3001).select(digest("id"))).collect()[0][1:] == (3000, 2)
    assert index.lookup(spark.range(10**7, 10**7 + 9).select(digest("id"))).count() == 0


@pytest.mark.parametrize("memory_rows", [50_000, 3])
def test_drop_repeats(docs, nothing, memory_rows):
    windows = Counter(tuple(w[i : i + 35]) for r in ROWS for w in [WORD.findall(r[1] or "")] for i in range(len(w) - 34))
    want = Counter()
    for r in ROWS:
        w, gone = WORD.findall(r[1] or ""), set()
        for i in range(len(w) - 34):
            if windows[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        want[(r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    assert Counter(map(tuple, drop_repeats(docs, memory_rows=memory_rows).collect())) == want
    assert drop_repeats(nothing).count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a b", "s", 1, 2), (2, None, None, 3, 4)], ["doc_id", "text", "source", "a.b", "c`d"])
    rows = rows.select("doc_id", "text", "source", "`a.b`")
    assert mix(rows).columns == rows.columns and {r["a.b"] for r in mix(rows).collect()} <= {1, 3}


def test_mixing_comes_near_its_targets(spark):
    """Sizes from 1 to 3,000 words, sources of 40 documents: a source misses its target by less than its largest document."""
    rng = random.Random(12)
    rows = [(i, "w " * int(10 ** rng.uniform(0, 3.5)), f"s{i % 15:02d}" if i % 3 else "hot") for i in range(900)]
    plan = mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", "size", "target", "copies", F.col("row.source").alias("source")).collect()
    for source in {r["source"] for r in plan}:
        own = [r for r in plan if r["source"] == source]
        taken, whole = sum(r["size"] * r["copies"] for r in own), sum(r["size"] for r in own)
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own), (source, taken, own[0]["target"])
        rate = own[0]["target"] / whole
        assert all(int(rate) <= r["copies"] <= int(rate) + 1 for r in own)


def test_mixing_draws_with_the_rates_chance(spark):
    """Over many seeds each document gets its extra copy as often as the fraction says."""
    rows = spark.createDataFrame([(i, "w " * (1 + i % 7), "a" if i < 20 else "b") for i in range(40)], "doc_id long, text string, source string").repartition(1).persist()
    seen, trials = Counter(), 5
    for k in range(trials):
        for r in mix_plan(rows, seed=f"s{k}").collect():
            rate = r["target"] / r["source_size"]
            seen[r["doc_id"]] += r["copies"] - int(rate)
            seen["mean"] += rate - int(rate)
    drawn = sum(v for k, v in seen.items() if k != "mean")
    assert abs(drawn - seen["mean"]) <= 2 * trials
    assert len({v for k, v in seen.items() if k != "mean"}) > 1


@pytest.mark.parametrize("case", range(4))
def test_shares_by_prefix_sums(spark, case):
    """Targets against rounds of sharing, as the contract words them."""
    rng = random.Random(case)
    sizes = [[], [5], [rng.randint(0, 4) for _ in range(30)], [int(10 ** rng.uniform(0, 5)) for _ in range(40)]][case]
    rows = [(f"s{i:03d}", n) for i, n in enumerate(sizes)]
    weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(rows)}
    target, open_ = {}, dict(rows)
    total = sum(sizes)
    while True:
        rest, weighs = total - sum(3 * n for s, n in rows if s not in open_), sum(weight[s] for s in open_)
        over = [s for s, n in open_.items() if weight[s] * rest > 3 * n * weighs]
        if not over:
            target |= {s: weight[s] * rest / weighs for s in open_}
            break
        for s in over:
            target[s] = 3 * open_.pop(s)
    got = source_targets(spark.createDataFrame(rows, "source string, size long")).collect()
    assert {r["source"]: r["target"] for r in got} == pytest.approx(target)


def test_near_pairs_compare_bitmaps_in_their_first_table_alone(spark, monkeypatch):
    """Bitmaps cost most of a pair: the join asks first whether a pair met in an earlier table."""
    plans = {}
    monkeypatch.setattr(Scratch, "cut", lambda self, df, name, f=Scratch.cut: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and f(self, df, name))
    text = lambda i, n: " ".join(f"w{j if j % n else (i, j)}" for j in range(80))
    rows = [(i, text(i, 12 + i % 9)) for i in range(40)]
    near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count()
    (join,) = [line for line in plans["pairs"].splitlines() if "Join Inner" in line and "bit_count" in line]
    assert join.rindex("hx#") < join.index("bit_count")
