"""Personal data in whole texts, with offset-preserving deobfuscation.

Two finite transducers are chained: the first rewrites characters (homoglyphs and full-width forms to ASCII, invisible characters to nothing),
the second what they spell (runs of spelled digits to digits, bracketed or spelled at/dot disguises to ``@`` and ``.``).  Each keeps, for each output
character, the span that it came from, and the maps are composed.  The detectors run on the source (base spans) and again on the last text; hits there
that touch rewritten characters are mapped back to source offsets and added unless a base span of their kind already holds them.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start where a run of digits starts, since a match always ends with its run
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

# look-alikes of ASCII letters: Cyrillic, then Greek
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅοαρυνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTYXIJSoapuvikABEZHIKMNOPTYX", strict=True))
INVISIBLE = "​‌‍⁠﻿­"
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

# look-alikes of separators: hyphens and minus, spaces, dots, at
SEPARATORS = {**dict.fromkeys("‐‑‒–—―−", "-"), **dict.fromkeys("\u00a0\u2007\u2009\u202f", " "), **dict.fromkeys("․。｡", "."), "﹫": "@"}


def _compatible() -> dict[str, str]:
    """Styled and full-width forms of ASCII characters, and decimal digits of other scripts, by their Unicode properties."""
    styled = [*range(0x2070, 0x20A0), *range(0x2100, 0x2150), *range(0x2460, 0x2500), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]
    out = {chr(c): n for c in styled if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n.isascii()}
    return out | {chr(c): str(d) for c in range(0x600, 0x1FC00) if (d := unicodedata.decimal(chr(c), None)) is not None}


_SINGLE = {**_compatible(), **HOMOGLYPHS, **SEPARATORS, **dict.fromkeys(INVISIBLE, "")}
# apart, since a class with characters beyond the basic plane is searched slowly
_WIDE = re.compile("[" + "".join(re.escape(c) for c in _SINGLE if c < "\U00010000") + "]")
_WIDER = re.compile("[" + "".join(re.escape(c) for c in _SINGLE if c >= "\U00010000") + "]")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_AT = r"[\[({<]\x20{0,3}(?:[aA][tT]|@)\x20{0,3}[\])}>]"
_DOT = r"[\[({<]\x20{0,3}(?:[dD][oO][tT]|\.)\x20{0,3}[\])}>]"
_BRACKET = re.compile(rf"\x20{{0,3}}(?:(?P<at>{_AT})|(?P<dot>{_DOT}))\x20{{0,3}}")
_HAS_BRACKET = re.compile(rf"{_AT}|{_DOT}")
# name at host dot word, spelled out; without a spelled dot the name must look like an address; signs set apart by spaces
_NAME = r"[a-z0-9][\w.%+-]{0,63}"
_SPELLED_AT = re.compile(rf"(?i)(?<![\w.%+-])(?:{_NAME}\x20dot\x20){{0,3}}{_NAME}(?P<at>\x20at\x20)[a-z0-9-]{{1,63}}(?:\x20dot\x20[a-z0-9-]{{1,63}}){{1,4}}(?!\w)")
_PLAIN_AT = [re.compile(rf"\x20{at}\x20(?=[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}){{0,3}}\.[A-Za-z]{{2,10}}(?![\w-]))") for at in ("at", "AT")]
_ADDRESS = re.compile(r"[A-Za-z0-9]+[._%+-][\w.%+-]*[\w]$|[A-Za-z]+[0-9]+$")
_SPACED_AT = re.compile(r"(?<=[\w%+-])(?P<at>\x20{0,2}@\x20{0,2})[A-Za-z0-9-]{1,63}(?:(?:\x20{1,2}\.\x20{1,2}|\.)[A-Za-z0-9-]{1,63}){1,4}")
# a spelled dot after a true sign
_AT_DOT = re.compile(r"(?i)(?<=[\w%+-])@[a-z0-9-]{1,63}(?:(?:\x20dot\x20|\.)[a-z0-9-]{1,63}){1,4}(?!\w)")
_SPACED_DOT = re.compile(r"(?<=\w)\x20{1,2}\.\x20{1,2}(?=[a-z0-9])")
# letters that stand for digits in a number: at least six true digits and a letter
_LOOSE_NUMBER = re.compile(r"[0-9+][0-9OoIl\x20().-]{7,40}(?![A-Za-z])")
_LETTER_DIGITS = {"O": "0", "o": "0", "I": "1", "l": "1"}
_SPELLED_DOT = re.compile(r"(?i)\x20dot\x20")
_NUMBER = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
# number words and groups of digits with separators between; the detectors reject runs that are no identifier
_BETWEEN = r"(?:[\x20\t\r\n,()-]{1,4}|[\x20\t\r\n]{0,2}\.[\x20\t\r\n]{0,2}|[\x20\t\r\n]{1,2}dot[\x20\t\r\n]{1,2})"
_SPELLED = re.compile(rf"(?i)(?<![\w+])(?:plus[\x20\t\r\n-]{{1,2}}|\+\x20?)?(?:{_NUMBER}|[0-9]++)(?!\w)(?:{_BETWEEN}(?:{_NUMBER}|[0-9]++)(?!\w))++")
# the same from a number word on and over spaces and hyphens only, for a run that other numbers stand before or after
_SPELLED_NARROW = re.compile(rf"(?i)(?<!\w)(?:plus[\x20-])?(?:{_NUMBER})(?:[\x20-]{{1,2}}(?:{_NUMBER}|[0-9])(?!\w))++")
_ONE_NUMBER = re.compile(rf"(?i)(?P<word>(?:plus|{_NUMBER})(?!\w))|(?P<dot>[\x20\t\r\n]*(?:\.|dot)[\x20\t\r\n]*)|(?P<gap>[\x20\t\r\n,()-]+)")
_HAS_NUMBER = re.compile(rf"(?i)(?<!\w)(?:{_NUMBER})(?!\w)")
_HAS_DOT = re.compile(r"(?i)[0-9]\s{1,2}dot\s{1,2}[0-9]")
_NUMBER_WORDS = tuple(DIGIT_WORDS)


def _may_spell(t: str) -> bool:
    """Whether the text may hold a spelled run: a number word, or a spelled dot between digits."""
    low = t.lower()
    return (any(w in low for w in _NUMBER_WORDS) and _HAS_NUMBER.search(t) is not None) or ("dot" in low and _HAS_DOT.search(t) is not None)


def _spelled(t: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """Edits of a spelled run: words to digits, spelled dots to dots, gaps to nothing."""
    run = t[start:end]
    if not _HAS_NUMBER.search(run) and not _HAS_DOT.search(run):
        return
    for m in _ONE_NUMBER.finditer(t, start, end):
        if m["word"]:
            yield *m.span(), "+" if m["word"].lower() == "plus" else DIGIT_WORDS[m["word"].lower()]
        elif m["dot"]:
            yield *m.span(), "."
        else:
            yield *m.span(), ""


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    done, at = 0, t.find("@")
    while at >= 0:
        s = at
        while s > done and t[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(t, at + 1) if s < at else None
        if m:
            yield s, m.end()
            done = m.end()
        at = t.find("@", max(at + 1, done))


def detect(t: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), leftmost non-overlapping per kind."""
    out = [(0, s, e) for s, e in _emails(t)] if "@" in t else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(t) if all(len(p) < 4 and int(p) < 256 for p in (x.lstrip("0") or "0" for x in m.group().split(".")))]
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 13:
            d = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in t:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(t) if 9 <= len(_DIGITS.findall(m.group())) <= 15]
    return out


def characters(t: str) -> list[tuple[int, int, str]]:
    """Source spans that the first transducer replaces: single characters."""
    if t.isascii():
        return []
    found = [(m.start(), m.end(), _SINGLE[m.group()]) for m in _WIDE.finditer(t)]
    if _ASTRAL.search(t):
        found = sorted(found + [(m.start(), m.end(), _SINGLE[m.group()]) for m in _WIDER.finditer(t)])
    return found


def rewrites(t: str, spelled: re.Pattern | None = None) -> list[tuple[int, int, str]]:
    """Spans that the second transducer replaces, in order, not overlapping; ``spelled`` finds the spelled runs, if there may be any."""
    found = []
    if ("(" in t or "[" in t or "{" in t or "<" in t) and _HAS_BRACKET.search(t):
        found += [(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKET.finditer(t)]
    if " dot " in t or " DOT " in t or " Dot " in t:
        for m in _SPELLED_AT.finditer(t):
            found.append((*m.span("at"), "@"))
            found += [(*d.span(), ".") for d in _SPELLED_DOT.finditer(t, m.start(), m.end())]
        if "@" in t:
            for m in _AT_DOT.finditer(t):
                found += [(*d.span(), ".") for d in _SPELLED_DOT.finditer(t, m.start(), m.end())]
    for pattern in _PLAIN_AT:
        for m in pattern.finditer(t):
            if _ADDRESS.search(t[max(0, m.start() - 64) : m.start()].rpartition(" ")[2]):
                found.append((*m.span(), "@"))
    if " @" in t or "@ " in t or ("@" in t and " . " in t):
        for m in _SPACED_AT.finditer(t):
            if " " in m["at"]:
                found.append((*m.span("at"), "@"))
            found += [(*d.span(), ".") for d in _SPACED_DOT.finditer(t, m.end("at"), m.end())]
    for m in _LOOSE_NUMBER.finditer(t):
        if sum(c.isdigit() for c in m.group()) >= 6:
            found += [(m.start() + i, m.start() + i + 1, _LETTER_DIGITS[c]) for i, c in enumerate(m.group()) if c in _LETTER_DIGITS]
    if spelled:
        for m in spelled.finditer(t):
            found += _spelled(t, m.start(), m.end())
    found.sort()
    out, done = [], 0
    for s, e, new in found:
        if s >= done:
            out.append((s, e, new))
            done = e
    return out


def transduce(t: str, edits: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The rewritten text and its pieces (output offset, source start, source end) at each edit."""
    parts, pieces, at, size = [], [], 0, 0
    for s, e, new in edits:
        parts += [t[at:s], new]
        size += s - at
        pieces.append((size, s, e))
        size += len(new)
        at = e
    parts.append(t[at:])
    return "".join(parts), pieces


class Rewritten:
    """A text after some edits, and the way back to its offsets."""

    def __init__(self, t: str, edits: list[tuple[int, int, str]]):
        self.edits = edits
        self.text, self.pieces = transduce(t, edits) if edits else (t, [])
        self.where = [p[0] for p in self.pieces]
        self.ends = [o + len(edit[2]) for (o, _, _), edit in zip(self.pieces, edits, strict=True)]

    def touches(self, s: int, e: int) -> bool:
        return bisect_left(self.where, e) > bisect_left(self.where, s)

    def source(self, o: int, closing: bool) -> int:
        """Source offset of an output offset (as an end: of the character before it)."""
        i = (bisect_left if closing else bisect_right)(self.where, o) - 1
        if i < 0:
            return o
        if closing and o <= self.ends[i]:
            return self.pieces[i][2]
        if not closing and o < self.ends[i]:
            return self.pieces[i][1]
        return self.pieces[i][2] + o - self.ends[i]


def deobfuscated(t: str) -> list[tuple[int, int, int]]:
    """Hits in the rewritten texts that touch an edit of either transducer, as source spans."""
    first = Rewritten(t, characters(t))
    seconds = [rewrites(first.text)]
    if _may_spell(first.text):
        wide, narrow = rewrites(first.text, _SPELLED), rewrites(first.text, _SPELLED_NARROW)
        seconds = [wide] + ([narrow] if narrow != wide else [])
    out = []
    for edits in seconds:
        if not edits and not first.edits:
            continue
        second = Rewritten(first.text, edits)
        for kind, s, e in detect(second.text):
            s1, e1 = second.source(s, False), second.source(e, True)
            if second.touches(s, e) or first.touches(s1, e1):
                out.append((kind, first.source(s1, False), first.source(e1, True)))
    return list(dict.fromkeys(out))


def spans(t: str) -> list[tuple[int, int, int, bool]]:
    """(kind number, start, end, base), by kind, then start; offsets are code points."""
    base = detect(t)
    more = []
    if added := deobfuscated(t):
        # base spans of a kind lie one after the other, so the last one that starts in time is the only one that may hold an added span
        starts, ends = [[] for _ in KINDS], [[] for _ in KINDS]
        for k, s, e in base:
            starts[k].append(s)
            ends[k].append(e)
        for k, s, e in added:
            i = bisect_right(starts[k], s) - 1
            if i < 0 or ends[k][i] < e:
                more.append((k, s, e, False))
    return sorted([(*b, True) for b in base] + more)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    for batch in batches:
        found = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in spans(x.as_py() or "")] for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind))], ["doc_id", "spans"])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, base) of each row of ``docs`` (doc_id, text), ordered by kind as in KINDS, then start.

    Whole texts are searched; null counts as empty and has no spans.  Repeated rows and null ids give a row each.  An added span may
    reach beyond a base span of its kind that saw only a part; ties of start are ordered by end.  Other columns are ignored; an empty table gives
    an empty result.  Time is linear in a text's length, also for long runs of digits or of address characters.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_run, SCHEMA)
