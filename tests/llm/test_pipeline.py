"""Registered queries and the pipeline's stages."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import pyarrow as pa

import corpus_pipeline
from snpgrid.llm import common, hashing, near_dedup, queries
from snpgrid.llm.common import Scratch
from snpgrid.llm.mixing import mix_plan
from snpgrid.llm.toxicity import THRESHOLD, toxicity


def test_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES if k.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES


def test_stages_take_effect(spark, tmp_path):
    bench = " ".join(f"item{i}" for i in range(12))
    rows = [(i, f"text number {i} " + " ".join(f"w{i}x{j}" for j in range(40)), "en", f"s{i % 2}", 0) for i in range(30)]
    near = rows[0][1].replace("w0x39", "changed")
    rows += [(100, rows[3][1].upper(), "en", "s0", 0), (101, near, "en", "s1", 0), (102, "start " + bench + " end", "en", "s0", 0), (103, None, "en", "s1", 0), (104, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids[name] = sorted(r[0] for r in docs.select("doc_id").collect())
    everyone = sorted(r[0] for r in rows)
    assert ids["toxicity"] == everyone
    assert ids["exact_dedup"] == [i for i in everyone if i not in (3, 103)]  # of 103 and 104, both empty, the larger stays
    assert ids["near_dedup"] == [i for i in ids["exact_dedup"] if i != 101]
    assert ids["decontaminate"] == [i for i in ids["near_dedup"] if i != 102]
    mixed = Counter(r[0] for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").collect())
    assert mixed and set(mixed) <= set(ids["decontaminate"]) and max(mixed.values()) <= 3


def test_stages_against_brute_force(spark, tmp_path):
    """Every stage on rows with null and shared ids, repeated rows and columns that clash with ours, against plain Python."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    text = lambda n=40: " ".join(word() for _ in range(n))
    bench = text(14)
    base = [text() for _ in range(25)]
    near_copy = base[4].rsplit(" ", 1)[0] + " changed"
    texts = [(i, t) for i, t in enumerate(base)]
    texts += [(50, base[1]), (None, base[2]), (None, "only here " + text()), (None, None), (5, "only here too " + text()), (5, base[3]), (60, base[5]), (60, base[5]), (61, near_copy), (None, near_copy + " x"), (70, text(5) + " " + bench), (5, bench + " " + text(9)), (71, ""), (72, None)]
    rows = [(i, t, "en", ["a", "b", None][k % 3], 0, k, "m", 1.5) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id long, _maybe string, _cell double"
    names = [c.split()[0] for c in schema.split(", ")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def exact(rows):
        best = {}
        for r in rows:
            best[r[1] or ""] = max(best.get(r[1] or "", -1), -1 if r[0] is None else r[0])
        return [r for r in rows if best[r[1] or ""] in (-1, r[0])]

    def near(rows):
        sets = [shingles(r[1]) for r in rows]
        label = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                    label = [label[j] if x == label[i] else x for x in label]
        out = []
        for k, r in enumerate(rows):
            ids = [s[0] for s, x in zip(rows, label, strict=True) if x == label[k] and s[0] is not None]
            if not sets[k] or r[0] == (min(ids) if ids else None):
                out.append(r)
        return out

    def clean(rows):
        w = bench.split()
        windows = {" ".join(w[i : i + 10]) for i in range(len(w) - 9)}
        return [r for r in rows if not any(x in " ".join((r[1] or "").split()) for x in windows)]

    want = rows
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], (list, exact, near, clean), strict=True):
        want = plain(want)
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert Counter(map(str, map(tuple, docs.collect()))) == Counter(map(str, want)), name
    assert any(r[1] and r[1].startswith("only here too") for r in want) and any(r[0] is None and r[1] and r[1].startswith("only here ") for r in want)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert out.columns == names and set(map(str, map(tuple, out.collect()))) <= set(map(str, want))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity_stage_rejects(spark, tmp_path):
    """Documents that the operator scores at the threshold or above go, labelled or not, and all others stay as they are."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    insult = lambda: rng.choice(["vilelings", "rotheads"])
    text = lambda bad: " ".join(w for k in range(10) for w in (*rng.choices(words, k=4), *([insult(), insult()] if bad and k in (3, 7) else [])))
    rows = [(i, text(i % 4 == 0), "en", f"s{i % 3}", i) for i in range(400)] + [(900, None, "en", None, 0), (901, "", "en", "s0", 0), (None, text(False), "en", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    scored = toxicity(docs, labels.select("doc_id", "toxic")).collect()
    want = Counter(r["doc_id"] for r in scored if r["score"] < THRESHOLD)
    left = Counter(r["doc_id"] for r in kept.collect())
    assert left == want
    bad = {i for i in range(400) if i % 4 == 0}
    assert len(bad - set(left)) >= 0.8 * len(bad) and set(range(400)) - bad <= set(left) and {900, 901, None} <= set(left)


def test_mixing_stage_follows_its_plan(spark, tmp_path):
    rows = [(i, "w " * (1 + i % 50), "en", f"s{i % 7}" if i % 3 else "hot", 0) for i in range(300)] + [(None, "a b", "en", None, 1), (5, "x", "en", "s5", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = Counter((r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect())
    plan = Counter()
    for r in mix_plan(docs).collect():
        plan[r["row"]["doc_id"], r["row"]["text"], r["row"]["source"]] += r["copies"]
    assert mixed == +plan


def test_written_tables_bound_the_drivers_heap(spark, monkeypatch):
    """After a written table the JVM collects its garbage if it has taken the share of its limit, and not otherwise; the table is whole either way."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(common, "PAUSE", 0.0)
    counts = []
    for share in (0.0, 2.0):
        monkeypatch.setattr(common, "TAKEN", share)
        before = full()
        assert Scratch(spark, "heap").cut(spark.range(5), f"t{share}").count() == 5
        counts.append(full() - before)
    assert counts == [1, 0]


def test_toxicity_needs_no_pandas_on_the_driver(spark, monkeypatch):
    """The model's parts reach the driver as Arrow tables: pandas would be imported for them alone."""
    monkeypatch.setattr("pyspark.sql.DataFrame.toPandas", lambda self: 1 / 0)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toPandas", lambda self: 1 / 0)
    docs = spark.createDataFrame([(i, f"word{i % 3} other common text", "en") for i in range(30)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    assert toxicity(docs, labels).count() == 30
    none = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity(none, labels).count() == 0


def test_signatures_hold_small_pieces(monkeypatch):
    """A task's memory follows small pieces of its texts, and its results do not depend on them."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(300)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(range(1500)), pa.array(texts)], ["doc_id", "text_hash", "text"])
    run = near_dedup._signatures(5, 10, 2)
    hashing._powers.cache_clear()
    tracemalloc.start()
    rows = sum(x.num_rows for x in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1500 and peak < 40e6
    small = [x.to_pylist() for x in run(iter([batch]))]
    monkeypatch.setattr(near_dedup, "PIECE_BYTES", hashing.CHUNK_BYTES)
    assert sum(small, []) == sum((x.to_pylist() for x in run(iter([batch]))), [])
