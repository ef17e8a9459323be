"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

An example is a passage (``PASSAGE`` consecutive words) of a labelled document; documents are scored by their most suspect passage, so one insult is
not diluted by the text around it.  Terms are words and word beginnings: those in at least ``LEAST_DF`` of the example
documents and either in at most ``MOST_DF`` of all documents or ``TELLING`` times as frequent in the examples of label 1, weighted by their frequency over all documents.  The most similar examples of a
passage are found exactly: examples are clustered by their heaviest term before they are cut into blocks, blocks are taken in the order of their upper bounds
(query weights times the block's largest weights), and all those whose bound reaches the k-th best cosine so far are scored.
The neighbours' labels vote by similarity, weighted by how many labelled documents of the label an example stands for; the
largest vote of a document is calibrated by isotonic regression.  A passage never meets examples of a document with its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch
from .hashing import NOT_ALNUM, PIECE_BYTES, Words, mix, pieces, signed

#: Labelled documents of each label used at most (those of smallest hash), and passages of one of them (those of smallest hash).
SAMPLE, SAMPLE_PASSAGES = 600, 800
#: Words a passage, bytes of word beginnings, examples a block, neighbours, similarity that votes for the base rate, documents that draw a calibrated value to it.
PASSAGE, PREFIXES, BLOCK, K, CALM, DRAWN = 4, (5, 6), 512, 15, 0.5, 10
#: Least share of the examples and largest share of all documents that may hold a term; what the query predicts from.
LEAST_DF, MOST_DF, THRESHOLD = 0.01, 0.05, 0.7
#: A term of more documents than that is used if it is so many times as frequent in the examples of label 1.
TELLING = 2.0
#: Postings of the terms of the passages that a task searches for at a time.
POSTINGS = 150_000


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, passage number in the text, term hash) of every occurrence of a word or of a word's beginning."""
    w = Words(texts, NOT_ALNUM)
    owner = w.doc_of_word()
    place = (np.arange(len(owner)) - w.first[owner]) // PASSAGE
    owners, places, hashes = [owner], [place], [w.hash]
    for n in PREFIXES:
        longer, h = w.prefixes(n)
        owners.append(owner[longer])
        places.append(place[longer])
        hashes.append(mix(h + np.uint64(n)))
    return np.concatenate(owners), np.concatenate(places), np.concatenate(hashes)


def text_hashes(texts: list[bytes]) -> np.ndarray:
    """A hash of each text's words (lower-cased)."""
    w = Words(texts, NOT_ALNUM)
    at = np.arange(len(w.hash)) - w.first[w.doc_of_word()]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.hash + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))])
    return total[w.first[1:]] - total[w.first[:-1]]


def _runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def _spread(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of the ranges of some numbers, one after another, and the ranges' sizes."""
    start = first[of].astype(np.int64)
    n = first[of + 1] - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()), n


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = _runs(keys)
    return keys[first], np.add.reduceat(values[order], first) if len(first) else np.zeros(0)


def _rank(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group and falling value (0 to 2, to 2**-30; ties as they come), and each place's rank in its group."""
    order = np.argsort((group << 32) - (value * (1 << 30)).astype(np.int64), kind="stable")
    first = _runs(group[order])
    return order, np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))


class Vocabulary:
    """Terms in order of hash, with inverse document frequencies."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.idf = hashes[order], idf[order].astype(np.float32)

    def passages(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of the passages that have a term: (text number of each passage, its number in the text; passage, term, weight of each entry)."""
        none = np.zeros(0, np.int64)
        if not len(self.hashes):
            return none, none, none, none, none.astype(np.float32)
        owner, place, h = terms(texts)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        ok = self.hashes[at] == h
        owner, place, at = owner[ok], place[ok], at[ok]
        width = int(place.max()) + 1 if len(place) else 1
        pair, n = np.unique((owner * width + place) * len(self.hashes) + at, return_counts=True)
        where, at = pair // len(self.hashes), pair % len(self.hashes)
        w = (1 + np.log(n)) * self.idf[at]
        first = _runs(where)
        passage = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(where))))
        norm = np.sqrt(np.bincount(passage, weights=w * w, minlength=len(first)))
        return where[first] // width, where[first] % width, passage, at, (w / norm[passage]).astype(np.float32)


class BlockMaxIndex:
    """Examples in blocks; postings by term and block, with the largest weight of each such cell.  ``groups``: examples of a document with a given text."""

    def __init__(self, n_terms: int, n: int, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, groups: np.ndarray | None = None):
        self.n, self.blocks = n, -(-max(n, 1) // BLOCK)
        # clustered: examples with the same heaviest term lie side by side
        order = np.lexsort((term, -weight, owner))
        first = _runs(owner[order])
        heaviest = np.full(n, n_terms, np.int64)
        heaviest[owner[order][first]] = term[order][first]
        self.example = np.argsort(heaviest, kind="stable")  # by place
        place = np.empty(n, np.int64)
        place[self.example] = np.arange(n)
        self.groups = (np.arange(n) if groups is None else groups)[self.example]
        owner = place[owner]
        order = np.lexsort((owner, term))
        self.owner, self.weight, term = owner[order].astype(np.int32), weight[order].astype(np.float32), term[order]
        cell = term.astype(np.int64) * self.blocks + self.owner // BLOCK
        first = _runs(cell)
        self.first = np.append(first, len(cell))
        self.block = cell[first] % self.blocks
        self.peak = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)
        self.cells = np.searchsorted(cell[first], np.arange(n_terms + 1, dtype=np.int64) * self.blocks)

    def portions(self, passage: np.ndarray, term: np.ndarray, n: int) -> list[tuple[int, int]]:
        """Ranges of the ``n`` passages, in order, whose terms have about ``POSTINGS`` postings: what a search holds follows these, not the number of passages."""
        held = np.diff(self.first[self.cells])
        upto = np.cumsum(np.bincount(passage, weights=held[term], minlength=n) + 1)
        edges = np.append(_runs((upto - 1) // POSTINGS), n).tolist()
        return list(zip(edges[:-1], edges[1:], strict=True))

    def nearest(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, example, cosine) of the k most similar examples of each query with a common term and of all as similar as the k-th, most similar first.

        ``leave``: the group of examples that each query may not meet, or -1.  The two most promising blocks of a query give a k-th best; of the
        others only those whose bound reaches it are scored.
        """
        at, n = _spread(self.cells, term)
        entry = np.repeat(np.arange(len(term)), n)
        key = query[entry].astype(np.int64) * self.blocks + self.block[at]
        order = np.argsort(key, kind="stable")
        at, entry, key = at[order], entry[order], key[order]
        first = _runs(key)
        pair = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        bound = np.bincount(pair, weights=weight[entry] * self.peak[at], minlength=len(first))
        of = key[first] // self.blocks
        ranked, rank = _rank(of, np.minimum(bound, 1.99))
        early = np.zeros(len(of), bool)
        early[ranked[rank < 2]] = True
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        least = np.zeros(int(of.max()) + 1 if len(of) else 1)  # the k-th best cosine of each query
        for chosen in (early, ~early):
            if chosen is not early:
                chosen = chosen & (bound >= least[of] - 1e-5)
            take = chosen[pair]
            post, m = _spread(self.first, at[take])
            from_ = np.repeat(entry[take], m)
            hit, cosine = _summed(query[from_].astype(np.int64) * self.n + self.owner[post], weight[from_].astype(float) * self.weight[post])
            q, e = hit // max(self.n, 1), hit % max(self.n, 1)
            ok = cosine >= least[q] - 1e-6
            if leave is not None:
                ok &= self.groups[e] != leave[q]
            q, e, cosine = q[ok], e[ok], cosine[ok]
            q, e, cosine = np.concatenate([best[0], q]), np.concatenate([best[1], e]), np.concatenate([best[2], cosine])
            ranked, rank = _rank(q, cosine)
            q, e, cosine = q[ranked], e[ranked], cosine[ranked]
            last = rank == k - 1
            least[q[last]] = cosine[last]
            ok = cosine >= least[q] - 1e-6
            best = (q[ok], e[ok], cosine[ok])
        return best[0], self.example[best[1]], best[2]


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots, values and weights of the non-decreasing weighted fit."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # [sum of w*y, sum of w, sum of w*x]
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        pools.append([b * c, c, a * c])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools]), np.array([p[1] for p in pools])


class Model:
    """Vocabulary, index of the examples' passages, and calibration."""

    def __init__(self, vocabulary: Vocabulary, examples: pa.Table, class_weight: tuple[float, float], k: int = K):
        """``examples``: doc_id, toxic, hash (of the text), then the entries of its passages: place, term, weight."""
        self.vocabulary, self.k = vocabulary, k
        flat = lambda c, t: np.concatenate([np.zeros(0, t), *(x.flatten().to_numpy(zero_copy_only=False) for x in examples[c].chunks)]).astype(t)
        sizes = examples["place"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        doc, place = np.repeat(np.arange(len(sizes)), sizes), flat("place", np.int64)
        self.ids, self.labels = examples["doc_id"].to_numpy(), examples["toxic"].to_numpy().astype(np.int64)
        self.stands_for = np.where(self.labels == 1, class_weight[1], class_weight[0]).astype(float)
        self.prior = float((self.stands_for * self.labels).sum() + 0.5) / float(self.stands_for.sum() + 1) if len(sizes) else 0.0
        self.known, group = np.unique(examples["hash"].to_numpy().astype(np.int64), return_inverse=True)
        passage, owner = np.unique(doc * (1 << 31) + place, return_inverse=True)
        self.doc = passage >> 31  # of each passage
        self.index = BlockMaxIndex(len(vocabulary.hashes), len(passage), owner, flat("term", np.int64), flat("weight", np.float32), group[self.doc] if len(passage) else self.doc)
        self.x, self.y = np.zeros(1), np.full(1, self.prior if self.labels.any() else 0.0)

    def calibrate(self, ids: np.ndarray, votes: np.ndarray) -> None:
        """Isotonic fit of the examples' labels on their votes, each pool drawn to the base rate by ``DRAWN`` documents of it."""
        at = {i: n for n, i in enumerate(self.ids.tolist())}
        number = np.array([at[i] for i in ids.tolist()], np.int64)
        if len(number):
            self.x, share, weight = _isotonic(votes, self.labels[number].astype(float), self.stands_for[number])
            self.y = np.maximum.accumulate((share * weight + DRAWN * self.prior * self.labels.any()) / (weight + DRAWN))

    def votes(self, texts: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Largest vote of each text's passages (0 without any term) and its nearest examples.

        A vote is the share of the similarity that stands for the label; ``CALM`` of similarity votes for the base rate.
        """
        out, evidence = np.zeros(len(texts)), [""] * len(texts)
        text, _, passage, term, weight = self.vocabulary.passages(texts)
        if not len(text) or not self.index.n:
            return out, evidence
        h = signed(text_hashes(texts))
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        own = np.where(self.known[at] == h, at, -1)
        found = []
        for at, end in self.index.portions(passage, term, len(text)):
            a, b = np.searchsorted(passage, (at, end))
            found.append((at, self.index.nearest(passage[a:b] - at, term[a:b], weight[a:b], self.k, leave=own[text[at:end]])))
        q, e, cosine = (np.concatenate(x) for x in zip(*((r[0] + at, *r[1:]) for at, r in found), strict=True))
        example = self.doc[e]
        share = cosine * self.stands_for[example]
        vote = np.bincount(q, weights=share * self.labels[example], minlength=len(text)) + CALM * self.prior
        vote /= np.bincount(q, weights=share, minlength=len(text)) + CALM
        order = np.lexsort((vote, text))
        last = np.flatnonzero(np.append(text[order][1:] != text[order][:-1], True))
        best = order[last]
        out[text[best]] = vote[best]
        begin = np.searchsorted(q, best)
        for p, b in zip(best, begin, strict=True):
            near = [f"{self.ids[example[i]]}:{cosine[i]:.4f}" for i in range(b, min(b + 3, len(q))) if q[i] == p]
            evidence[text[p]] = ",".join(near)
        return out, evidence

    def score(self, votes: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(votes, self.x, self.y), 0.0, 1.0)


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct terms."""
    for batch in batches:
        for _, _, texts in pieces(batch, limit=PIECE_BYTES):
            owner, _, h = terms(texts)
            order = np.lexsort((owner, h))
            first = np.flatnonzero(np.append(True, (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1]))) if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[order][first]))], ["h"])


def _frequencies(hashes: np.ndarray):
    """Rows (term number, documents) of each task; term -1 counts all its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(len(hashes), np.int64)
        for batch in batches:
            for _, _, texts in pieces(batch, limit=PIECE_BYTES):
                n += len(texts)
                owner, _, h = terms(texts)
                at = np.searchsorted(hashes, h)
                at[at == len(hashes)] = 0
                ok = hashes[at] == h
                number, count = np.unique(np.unique(owner[ok] * len(hashes) + at[ok]) % len(hashes), return_counts=True)
                df[number] += count
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, seen)), pa.array(np.append(n, df[seen]))], ["t", "df"])

    return run


EXAMPLE = "doc_id long, toxic int, hash long, place array<int>, term array<int>, weight array<float>"


def _examples(vocabulary: Vocabulary, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in pieces(batch, limit=PIECE_BYTES):
                text, place, passage, term, weight = vocabulary.passages(texts)
                # of a long document the passages of smallest hash
                order = np.lexsort((mix(place.astype(np.uint64)), text))
                first = _runs(text[order])
                rank = np.empty(len(text), np.int64)
                rank[order] = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
                take = rank[passage] < most
                passage, term, weight = passage[take], term[take], weight[take]
                off = pa.array(np.searchsorted(text[passage], np.arange(len(texts) + 1)).astype(np.int32))
                lists = (pa.ListArray.from_arrays(off, pa.array(x)) for x in (place[passage].astype(np.int32), term.astype(np.int32), weight))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), pa.array(signed(text_hashes(texts))), *lists], [f.split()[0] for f in EXAMPLE.split(", ")])

    return run


def _votes(model: Model):
    """Adds the score before calibration and its evidence to the columns before the last (text), or to all where the last is a row that holds its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, kept = batch.column(batch.num_columns - 1), batch.num_columns - 1
            if pa.types.is_struct(text.type):
                text, kept = text.field([f.name.lower() for f in text.type].index("text")), kept + 1
            for at, end, texts in pieces(pa.RecordBatch.from_arrays([text], ["text"]), limit=PIECE_BYTES):
                vote, evidence = model.votes(texts)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, end - at) for i in range(kept)), pa.array(vote), pa.array(model.score(vote)), pa.array(evidence)], [*batch.schema.names[:kept], "vote", "score", "evidence"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least_df: float = LEAST_DF, most_df: float = MOST_DF) -> Model:
    """The model of ``labels`` (doc_id, toxic) over ``docs``, from at most ``sample`` labelled documents a label whose crc32(doc_id) mod 3 is not 1.

    What reaches the driver is bounded by the sample: its terms, their frequencies, the examples' vectors and a vote each.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    own = labels.select(F.col("doc_id").cast("long").alias("l"), F.col("toxic").cast("int").alias("toxic")).where("l IS NOT NULL AND toxic IN (0, 1)")
    own = own.where(F.crc32(F.col("l").cast("string")) % 3 != 1).groupBy("l").agg(F.max("toxic").alias("toxic"))
    count = {r[0]: r[1] for r in own.groupBy("toxic").count().collect()}
    some = [own.where(F.col("toxic") == y).orderBy(F.xxhash64("l"), "l").limit(sample) for y in (0, 1)]
    picked = scratch.cut(some[0].unionByName(some[1]), "picked")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most two samples of ids are broadcast, whatever the input
    texts = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("l")).select("doc_id", "toxic", "text")
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text"))
    texts = scratch.cut(texts.groupBy("doc_id", "toxic").agg(one.alias("text")), "texts")
    least = max(2, int(least_df * texts.count()))
    held = [texts.where(F.col("toxic") == y).select("text").mapInArrow(_document_terms, "h long").select("h", F.lit(y).alias("y")) for y in (0, 1)]
    of = lambda y: F.sum(F.when(F.col("y") == y, 1).otherwise(0)).alias(f"n{y}")
    found = held[0].unionByName(held[1]).groupBy("h").agg(of(0), of(1)).where(F.col("n0") + F.col("n1") >= least).toArrow()
    found = {c: found[c].to_numpy().astype(np.int64) for c in found.column_names}
    order = np.argsort(found["h"].view(np.uint64))
    hashes = found["h"][order].view(np.uint64)
    taught = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    rate = [(found[f"n{y}"][order] + 0.5) / (taught.get(y, 0) + 1) for y in (0, 1)]
    telling = rate[1] >= TELLING * rate[0]
    df, n = np.zeros(len(hashes), np.int64), 0
    if len(hashes):
        counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_frequencies(hashes), "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).toArrow()
        t, c = (counted[x].to_numpy().astype(np.int64) for x in ("t", "df"))
        df[t[t >= 0]], n = c[t >= 0], int(c[t < 0].sum())
    # frequent terms stay if they tell the labels apart
    common = (df <= max(most_df * n, 2)) | telling
    vocabulary = Vocabulary(hashes[common], np.log((n + 1) / (df[common] + 1)) + 1)
    examples = texts.mapInArrow(_examples(vocabulary, SAMPLE_PASSAGES), EXAMPLE).orderBy("doc_id").toArrow()
    model = Model(vocabulary, examples, tuple(max(1.0, count.get(y, 0) / max(sample, 1)) for y in (0, 1)))
    got = texts.select("doc_id", "text").mapInArrow(_votes(model), "doc_id long, vote double, score double, evidence string").select("doc_id", "vote").toArrow()
    model.calibrate(got["doc_id"].to_numpy(), got["vote"].to_numpy())
    scratch.drop("picked", "texts")
    del examples, got
    pa.default_memory_pool().release_unused()
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` before its last, ``text``, then vote, score and evidence of each row.  A last column that is a struct with a string ``text`` stays."""
    added = "vote double, score double, evidence string"
    kept = docs.schema.fields if isinstance(docs.schema.fields[-1].dataType, StructType) else docs.schema.fields[:-1]
    return docs.mapInArrow(_votes(model), StructType([*kept, *StructType.fromDDL(added).fields]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, least_df: float = LEAST_DF, most_df: float = MOST_DF) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted, evidence (nearest examples of its most suspect passage, id:cosine).

    Scores depend on the text alone, and an example never votes on its own text.  Null and empty texts, and those without a term of the vocabulary, get the lowest score.
    Held-out rows (crc32(doc_id as text) mod 3 = 1; null ids are not) and unlabelled ones never teach.  Of several labels of an id the largest counts, of several texts the one of smallest hash;
    labels of unknown ids do nothing, and without labels all scores are 0.  Texts of any length are scored whole, in passages; examples
    as similar as the last neighbour all vote.  Repeated rows score alike.  Other columns are ignored; an empty table gives an empty result.
    """
    model = fit(docs, labels, sample, least_df, most_df)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return scores(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
