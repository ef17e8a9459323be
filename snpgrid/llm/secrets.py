"""Secrets in whole texts: fixed patterns, and a probabilistic automaton inferred from labelled credentials.

The credentials that the patterns label are the positive sample, but for those that are plain numbers, whose format says nothing; each counts in both cases of its
letters.  A probabilistic automaton over their character classes is learned in rounds: each counts, over all of them, what follows the ways that lead out of the states
known so far, and a way joins the first state whose continuation frequencies agree within a Hoeffding bound, or becomes a state.  Every other credential-like token of the corpus is scored by its mean log-likelihood a character under the automaton, less that under the best of
three models of what is ordinary: a chain of characters counted over all other distinct tokens, words, and numbers with separators (dates, versions, addresses).  The cut is
the score that few ordinary tokens reach, or few labelled credentials miss if that is lower, among all those that no model was fitted on, and not below 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch

KINDS = ("assign", "access", "hex")
LEAST_LENGTH, ALPHA = 12, 0.05
#: Classes that follow a state, by which it is told from others; bins of a round that seeks a score by its rank.
LOOK, BINS = 4, 1024
#: One in ``FOLD`` credentials and tokens (by checksum) is held out for the cut; few are ``LOW`` of the held-out credentials and ``HIGH`` of the held-out tokens, which may hold credentials of other formats.
FOLD, LOW, HIGH = 5, 0.05, 0.05
#: Share of a model's probability that is spread over all characters alike: of what is ordinary, and of the automaton, whose formats other credentials share in part.
SPREAD, LOOSE = 0.01, 0.4

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_WORDS = ("password", "passwd", "secret", "token", "key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # shorter runs fail anyway
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_LENGTH)

CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
_CLASS = {c: i for i, chars in enumerate(CLASSES) for c in chars}
END = len(CLASSES)
#: A letter for each class and for the end.
_ENDED = "abcdefghijkl"
_LETTERS = str.maketrans({**{c: _ENDED[k] for c, k in _CLASS.items()}, "$": _ENDED[END]})
ALPHABET = "".join(CLASSES)
_AT = {c: i for i, c in enumerate(ALPHABET)}
#: Of a token's start (or, as a next character, its end) in the chain of characters.
_EDGE = len(ALPHABET)
_ANY, _OPEN = SPREAD / (len(ALPHABET) + 1), LOOSE / (len(ALPHABET) + 1)


def base_spans(t: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, credential), by start, then kind."""
    out = []
    low = t.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(t) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in t:
        out += [(m.start(), 1, m.end(), m.group()) for m in _ACCESS.finditer(t) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m.group()) for m in _HEX.finditer(t)]
    return sorted(out)


def tokens(t: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Tokens as long as the shortest credential that the patterns label (12), unless a base span holds them whole: one pass over both, which are in order."""
    out, i, reach = [], 0, -1
    for m in _TOKEN.finditer(t):
        while i < len(base) and base[i][0] <= m.start():
            reach = max(reach, base[i][2])
            i += 1
        if reach < m.end():
            out.append((*m.span(), m.group()))
    return out


def _following(known: list[dict[int, int]]):
    """Counts (state, class, what follows) of each word's first way out of the ``known`` ones; what follows are up to ``LOOK`` classes or the end, a letter each.  Without states: of the words' starts."""

    def run(words: Iterable[str]) -> Counter:
        out: Counter = Counter()
        for w in words:
            s, k, i = 0, -1, 0
            while known and i < len(w):
                k, i = _CLASS[w[i]], i + 1
                if k not in known[s]:
                    break
                s = known[s][k]
            else:
                if known:
                    continue
            out[s, k, (w[i : i + LOOK] + "$")[:LOOK].translate(_LETTERS)] += 1
        return out

    return run


def _passing(known: list[dict[int, int]]):
    """Counts (state, class or end) over the words' whole ways."""

    def run(words: Iterable[str]) -> Counter:
        out: Counter = Counter()
        for w in words:
            s = 0
            for c in w:
                k = _CLASS[c]
                out[s, k, ""] += 1
                s = known[s][k]
            out[s, END, ""] += 1
        return out

    return run


class Automaton:
    """Probabilistic automaton over character classes.  ``words``: a list, or what gives the sum of a counting function over all words."""

    def __init__(self, words: list[str] | Callable[[Callable[[Iterable[str]], Counter]], Counter], alpha: float = ALPHA):
        total = words if callable(words) else lambda of: of(words)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next: list[dict[int, int]] = []
        self._after: list[Counter] = []
        while ways := self._ways(total(_following(self.next))):
            self._settle(ways)
        self.next = self.next or [{}]
        self.states = list(range(len(self.next)))
        self.count: list[Counter] = [Counter() for _ in self.states]
        for (s, k, _), n in total(_passing(self.next)).items():
            self.count[s][k] += n
        self._finish()

    @staticmethod
    def _ways(counted: Counter) -> dict[tuple[int, int], Counter]:
        """By way, how many words go on with each beginning of what follows."""
        ways: dict[tuple[int, int], Counter] = {}
        for (s, k, rest), n in counted.items():
            after = ways.setdefault((s, k), Counter())
            for i in range(len(rest) + 1):
                after[rest[:i]] += n
        return ways

    def _compatible(self, a: Counter, b: Counter) -> bool:
        """Whether two states, and what follows both in common, agree within the Hoeffding bound."""
        todo = [""]
        while todo:
            x = todo.pop()
            n, m = a[x], b[x]
            gap = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if gap < 1 and any(abs(a[x + k] / n - b[x + k] / m) > gap for k in _ENDED):
                return False
            todo += [x + k for k in _ENDED[:END] if len(x) + 1 < LOOK and x + k in a and x + k in b]
        return True

    def _settle(self, ways: dict[tuple[int, int], Counter]) -> None:
        """Takes ways in order of their number of words; each joins the first state that it is compatible with, or becomes one."""
        for (s, k), after in sorted(ways.items(), key=lambda w: (-w[1][""], w[0])):
            target = next((t for t, known in enumerate(self._after) if self._compatible(known, after)), None)
            if target is None:
                target = len(self.next)
                self.next.append({})
                self._after.append(after)
            else:
                self._after[target].update(after)
            if k >= 0:
                self.next[s][k] = target

    def _finish(self) -> None:
        self.log = []
        for count in self.count:
            n = max(sum(count.values()), 1)
            self.log.append({k: math.log((1 - LOOSE) * count[k] / n / (len(CLASSES[k]) if k < END else 1) + _OPEN) for k in range(END + 1)})

    def score(self, w: str) -> float:
        """Mean log-likelihood a character."""
        s, total = 0, 0.0
        for c in w:
            k = _CLASS[c]
            total += self.log[s][k]
            s = self.next[s].get(k, 0)
        return (total + self.log[s][END]) / (len(w) + 1)


def chain_counts(words: list[str]) -> np.ndarray:
    """How often each character (or the end) follows each character (or the start)."""
    out = np.zeros((_EDGE + 1, _EDGE + 1), np.int64)
    for w in words:
        at = [_EDGE, *map(_AT.__getitem__, w), _EDGE]
        np.add.at(out, (at[:-1], at[1:]), 1)
    return out


def _number(c: str) -> float:
    """Probability of a character in numbers with separators: four fifths digits, the rest separators and the end."""
    k = _CLASS[c]
    return (0.08 if k == 0 else 0.03 if k >= 5 else 0.0) * (1 - SPREAD) + _ANY


_NUMBERS = {c: math.log(_number(c)) for c in ALPHABET}
_NUMBER_END = math.log(0.02 * (1 - SPREAD) + _ANY)
#: Kinds of characters in words: digits, lower case, upper case, separators (and the edge of a token).
_KIND = {c: 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in ALPHABET}
_SIZE = (10, 26, 26, 6)
#: How words go on: by the kind of the character before, the chance of a digit, a lower-case letter, a capital, a separator, the end.
_WORDS_GO_ON = ((0.7, 0.02, 0.02, 0.13, 0.13), (0.01, 0.9, 0.005, 0.04, 0.045), (0.02, 0.6, 0.3, 0.03, 0.05), (0.15, 0.55, 0.15, 0.05, 0.1), (0.1, 0.55, 0.3, 0.05, 0.0))


def word_score(w: str) -> float:
    """Log-likelihood of a token as words: letters of one case, now and then a capital, a separator or some digits."""
    total, before = 0.0, 4
    for c in w if any(x.islower() for x in w) else w.lower():  # words may be all in capitals
        k = _KIND[c]
        total += _WORD_LOGS[before][k]
        before = k
    return total + _WORD_LOGS[before][4]


_WORD_LOGS = [[math.log((1 - SPREAD) * p / (_SIZE[k] if k < 4 else 1) + _ANY) for k, p in enumerate(row)] for row in _WORDS_GO_ON]


def is_number(w: str) -> bool:
    """Whether a token is made of digits and separators alone."""
    return all(_CLASS[c] in (0, 5, 6, 7, 8, 9, 10) for c in w)


class Scorer:
    """``automaton``: of the labelled credentials, if there are any.  ``finish`` adds what is learned from all other tokens; from ``least`` on a token is a credential."""

    def __init__(self, automaton: Automaton | None):
        self.automaton = automaton
        self.chain: list[list[float]] | None = None
        self.least = math.inf

    def score(self, w: str) -> float:
        if not self.automaton:
            return -math.inf
        plain = max(sum(map(_NUMBERS.__getitem__, w)) + _NUMBER_END, word_score(w))
        if self.chain:
            at = [_EDGE, *map(_AT.__getitem__, w), _EDGE]
            plain = max(plain, sum(self.chain[a][b] for a, b in zip(at[:-1], at[1:], strict=True)))
        return self.automaton.score(w) - plain / (len(w) + 1)

    def counts(self, w: str) -> bool:
        """Whether a token is counted in the chain: it is not held out, and the automaton does not explain it better than words or numbers do."""
        return not held_out(w) and self.score(w) < 0

    def finish(self, chain: np.ndarray) -> None:
        """``chain``: counts of the characters of ordinary tokens."""
        # a pair that is counted once may be the scored token's own, so each counts one less
        self.chain = np.log((1 - SPREAD) * np.maximum(chain - 1, 0) / np.maximum(chain.sum(axis=1, keepdims=True), 1) + _ANY).tolist()


def held_out(w: str) -> bool:
    return zlib.crc32(w.encode()) % FOLD == 0


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
TOKEN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])
LABELLED = pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64()), ("text", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, rest = [], []
        for x in batch.column(1):
            t = x.as_py() or ""
            b = base_spans(t)
            base.append([dict(zip(("start", "kind", "end", "text"), r, strict=True)) for r in b])
            rest.append([dict(zip(("start", "end", "text"), r, strict=True)) for r in tokens(t, b)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(LABELLED)), pa.array(rest, pa.list_(TOKEN))], ["doc_id", "found", "tokens"])


def _score(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, rest in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = [(b["start"], b["kind"], {"kind": KINDS[b["kind"]], "start": b["start"], "end": b["end"], "base": True}) for b in base]
                spans += [(t["start"], len(KINDS), {"kind": "inferred", "start": t["start"], "end": t["end"], "base": False}) for t in rest if scorer.score(t["text"]) >= scorer.least]
                out.append([s[2] for s in sorted(spans, key=lambda s: s[:2])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(SPAN))], ["doc_id", "spans"])

    return run


def _chain(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial counts of the chain, one row a pair of characters that occurs."""
        total = np.zeros((_EDGE + 1, _EDGE + 1), np.int64)
        for batch in batches:
            total += chain_counts(list(filter(scorer.counts, batch.column(0).to_pylist())))
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total[a, b])], ["a", "b", "n"])

    return run


def ordinary_chain(words: DataFrame, scorer: Scorer) -> np.ndarray:
    """The chain of all ``words`` (x) that ``scorer`` counts; a row a pair of characters reaches the driver."""
    out = np.zeros((_EDGE + 1, _EDGE + 1), np.int64)
    for r in words.select("x").mapInArrow(_chain(scorer), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        out[r["a"], r["b"]] = r["n"]
    return out


def _total(words: DataFrame):
    """Gives the sum of a counting function over all ``words`` (x): a row a counted key reaches the driver."""

    def total(of: Callable[[Iterable[str]], Counter]) -> Counter:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: Counter = Counter()
            for batch in batches:
                out.update(of(batch.column(0).to_pylist()))
            columns = list(zip(*((*k, n) for k, n in out.items()), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["s", "k", "rest", "n"])

        rows = words.select("x").mapInArrow(run, "s long, k long, rest string, n long").groupBy("s", "k", "rest").agg(F.sum("n").alias("n"))
        return Counter({(r["s"], r["k"], r["rest"]): r["n"] for r in rows.collect()})

    return total


def _rated(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(scorer.score, batch.column(0).to_pylist()), pa.float64())], ["score"])

    return run


def ranked(scores: DataFrame, rank: int) -> float:
    """The score (column score, no nulls) of that rank from 0 on, smallest first: by counts of ever narrower bins, so no task and not the driver holds the scores."""
    lo, hi = scores.agg(F.min("score"), F.max("score")).first()
    while lo < hi:
        at = F.least(F.floor((F.col("score") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
        bins = scores.where(F.col("score").between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))
        for r in sorted(bins.collect(), key=lambda r: r["bin"]):
            if rank < r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            rank -= r["n"]
    return lo


def fit(labelled: DataFrame, words: DataFrame, scratch: Scratch) -> Scorer:
    """The scorer of all distinct credentials ``labelled`` (x) and all distinct other tokens ``words`` (x), both written tables; one in ``FOLD`` of both sets the cut."""
    held = F.crc32(F.col("x").cast("binary")) % FOLD == 0
    formats = labelled.where(~F.col("x").rlike("^[0-9+/_.=-]+$"))  # as is_number says
    n, n_held = formats.agg(F.count("*"), F.count_if(held)).first()
    if not n:
        return Scorer(None)
    good = formats.where(held) if n_held else formats
    fitted = formats.where(~held) if n_held < n else formats
    both = F.array_distinct(F.array("x", F.translate("x", LOWER + UPPER, UPPER + LOWER)))
    scorer = Scorer(Automaton(_total(scratch.cut(fitted.select(F.explode(both).alias("x")), "fitted"))))
    scorer.finish(ordinary_chain(words, scorer))
    good = scratch.cut(good.select("x").mapInArrow(_rated(scorer), "score double"), "good")
    plain = scratch.cut(words.where(held).select("x").mapInArrow(_rated(scorer), "score double"), "plain")
    low = ranked(good, int(LOW * (n_held or n)))
    n_plain = plain.count()
    high = ranked(plain, n_plain - 1 - int(HIGH * n_plain)) if n_plain else low
    # not below 0, where a token is as well explained as something ordinary
    scorer.least = max(0.0, min(low, high))
    return scorer


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, base) of each row of ``docs`` (doc_id, text), by start, then kind.

    Whole texts are searched; null counts as empty.  The automaton is fitted on all distinct labelled credentials that are not held out, the chain on all distinct
    ordinary tokens, the cut with all held-out ones of both, each whole; without labelled credentials other than numbers nothing is inferred.
    Tokens of any length are scored whole; ties of start are ordered by kind, an inferred span last.
    Repeated rows and null ids give a row each; other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    schema = "doc_id long, found array<struct<start:long,kind:long,end:long,text:string>>, tokens array<struct<start:long,end:long,text:string>>"
    rows = scratch.cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, schema), "rows")
    labelled = scratch.cut(rows.select(F.explode("found.text").alias("x")).distinct(), "labelled")
    words = scratch.cut(rows.select(F.explode("tokens.text").alias("x")).distinct(), "words")
    scorer = fit(labelled, words, scratch)
    return rows.mapInArrow(_score(scorer), "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")
