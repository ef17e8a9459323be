"""Token-group join, target resampling and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from snpgrid.llm import ngram_join as nj
from snpgrid.llm import queries, runs
from snpgrid.llm.common import Scratch
from snpgrid.llm.ngram_join import ngram_join
from snpgrid.llm.runs import periodic_runs, word_runs
from snpgrid.llm.target_resample import gains, ranked, target_resample

SCHEMA = "doc_id long, text string, c string, k string, n long, h string, g string, score string, part int, run string, at string"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def rows_of(pairs):
    return [(i, t, "x", "y", 1, "z", "q", "s", 0, "r", "a") for i, t in pairs]


def edge_cases() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)] + ["É", "ñandú"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    base = [text(rng.randint(40, 120)) for _ in range(10)]
    out: list[tuple[int | None, str | None]] = list(enumerate(base))
    for i in range(100, 160):  # variants of one text: near it, most not near each other
        w = base[0].split() if i < 130 else base[1].split()
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        out.append((i, " ".join(w)))
    passage = text(100)
    out += [(i, passage + " " + text(rng.randint(0, 14))) for i in range(200, 230)]
    out += [(40, base[2]), (41, base[2].upper()), (43, None), (44, ""), (45, " \t\n "), (46, "one"), (47, "ONE"), (48, "a b"), (49, "a  b"), (50, "a b c"), (51, "z " * 90), (52, text(8000))]
    return [*out, (None, base[3]), (None, base[3]), (None, "no id"), (60, base[4]), (60, base[4]), (60, text(30))]


ROWS = edge_cases()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(ROWS), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t: str | None) -> frozenset:
    w = SPACED.findall((t or "").translate(AZ))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def brute_join(pairs, percent: int) -> Counter:
    sets = [shingles(t) for _, t in pairs]
    label = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    smallest: dict[int, int] = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            smallest[label[k]] = min(i, smallest.get(label[k], i))
    return Counter((i, len(sets[k]), smallest.get(label[k]) if sets[k] else i) for k, (i, _) in enumerate(pairs))


@pytest.mark.parametrize(("percent", "group"), [(90, 4), (75, 32)])
def test_ngram_join(docs, percent, group):
    got = Counter((r[0], r[1], r[2]) for r in ngram_join(docs, percent=percent, group=group).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_join(ROWS, percent)


def test_ngram_join_random(spark):
    rng = random.Random(11)
    pairs = []
    for i in range(150):
        if pairs and rng.random() < 0.7:
            w = (pairs[rng.randrange(len(pairs))][1] or "").split()
            for _ in range(rng.randint(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice("abcdefghij")
            pairs.append((i, " ".join(w[rng.randint(0, 1) :])))
        else:
            pairs.append((i, " ".join(rng.choices("abcdefghij", k=rng.randint(1, 80)))))
    got = Counter((r[0], r[1], r[2]) for r in ngram_join(spark.createDataFrame(pairs, "doc_id long, text string"), group=3).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_join(pairs, 90)


def test_ngram_join_of_nothing(nothing):
    assert ngram_join(nothing).count() == 0


def test_single_tokens_ignore_copies(spark):
    rows = spark.createDataFrame([(1, [10, 11]), (1, [10, 11]), (2, [11, 12, 13]), (3, [])], "k long, t array<bigint>")
    assert {(r[0], r[1]) for r in nj.single_tokens(rows, "t").collect()} == {(1, 1), (2, 2)}


def brute_resample(pairs, target, percent=25, least=20, buckets=10_000):
    def features(t):
        w = ALNUM.findall((t or "").translate(AZ))
        return w, w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in pairs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in pairs:
        w, f = features(text)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w) >= least])
    drawn = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(drawn[: len(drawn) * percent // 100], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("n_runs", [1, 7])
def test_target_resample(spark, docs, n_runs):
    # rows of one id but other texts tie by the text's hash, which brute force does not know: their scores differ here
    target = [None, "", ROWS[0][1], ROWS[3][1][:100], "x " * 30, "Ñandú é"]
    texts = spark.createDataFrame([(t,) for t in target], "text string")
    got = Counter(tuple(r) for r in target_resample(docs, texts, runs=n_runs).collect())
    assert got == brute_resample(ROWS, target)


def test_target_resample_of_nothing(spark, docs, nothing):
    assert target_resample(nothing, docs).count() == 0
    assert Counter(tuple(r) for r in target_resample(docs, nothing).collect()) == brute_resample(ROWS, [])
    assert gains(np.zeros(4, np.int64), np.zeros(4, np.int64)).tolist() == [0, 0, 0, 0]


@pytest.mark.parametrize(("n", "p"), [(0, 4), (3, 8), (5000, 6)])
def test_regular_sampling_ranks(spark, n, p):
    rng = random.Random(n)
    # a third of the rows agree in everything
    rows = [(7, 7, 0) if rng.random() < 1 / 3 else (rng.choice([None, *range(50)]), rng.randrange(-5, 5), rng.randrange(-20, 20)) for _ in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, th long, score long").repartition(5)
    got, total = ranked(Scratch(spark, "t"), df, p)
    want = sorted(rows, key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1]))
    assert total == n and [(r["doc_id"], r["th"], r["score"]) for r in got.orderBy("rank").collect()] == want
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, n + 1))


def brute_runs(w, least=6, exponent=4) -> list[tuple[int, int, int]]:
    best: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=12), st.integers(0, 9)), max_size=5), st.sampled_from([(6, 4), (2, 2), (3, 3)]), st.sampled_from([5, 1 << 16]))
def test_runs_of_repeated_parts(parts, limits, step):
    w = np.array([x for part, times in parts for x in part * times], np.int64)
    held, runs.STEP = runs.STEP, step  # words appended in many small steps, and in one
    try:
        assert word_runs([w, w[::-1].copy()], *limits) == [brute_runs(list(w), *limits), brute_runs(list(w[::-1]), *limits)]
    finally:
        runs.STEP = held


def test_runs_of_long_texts_are_near_linear():
    found = word_runs([np.zeros(400_000, np.int64), np.arange(400_000) % 70_000, np.arange(50)])
    assert found == [[(0, 400_000, 1)], [(0, 400_000, 70_000)], []]


def test_periodic_runs(spark, docs, nothing):
    pairs = [*ROWS, (70, "a b " * 20 + "tail " * 7), (71, "x\ty\nz x y z x y z x y z end"), (72, "w " * 100_000), (73, "a a a a a"), (74, "a a a a a a")]
    pairs += [(i, " ".join(map(str, range(60)))) for i in range(300, 400)]
    got = {}
    frame = spark.createDataFrame(rows_of(pairs), SCHEMA)
    for plant in (False, True):
        want = Counter()
        for i, t in pairs:
            w = SPACED.findall(t or "")
            h = zlib.crc32((str(i) if i is not None else "").encode())
            if plant and h % 10 == 0 and w:
                a = h // 10 % len(w)
                p = 1 + (len(w) - a) // (3 + h // 10 % 8)
                w = w[:a] + [w[a + (k - a) % p] for k in range(a, len(w))]
            found = brute_runs(w) if len(w) < 1000 else word_runs([np.unique(w, return_inverse=True)[1].astype(np.int64)])[0]
            gone = {k for s, n, q in found for k in range(s + q, s + n)}
            want[i, len(w), tuple(found), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
        got[plant] = Counter((r[0], r[1], tuple(map(tuple, r[2])), r[3], r[4]) for r in periodic_runs(frame, plant=plant).collect())
        assert got[plant] == want
    assert got[True] != got[False]
    assert periodic_runs(nothing).count() == 0


def test_registered_columns_of_runs(spark, tmp_path):
    rows = [(12, None), (13, "a b a b a b a b c c c c c c c c c c d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    plain = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    assert plain == [12, 13]
    assert tuple(out[12]) == (12, 0, None, None, None, None, empty, empty)
    text = hashlib.sha256(b"0,8,2\n8,10,1\n").hexdigest()
    assert tuple(out[13]) == (13, 2, 8, 10, 1, 10_000, text, hashlib.sha256(b"a b c d").hexdigest())
