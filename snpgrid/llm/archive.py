"""WARC archives: writing pages as records, and reading them back by boundary-chain verification.

Writing is a text sink whose line separator is the record terminator, so Spark's committers make the files and a lost
executor costs a retry.  Reading: Spark's text reader splits files of any size by byte ranges at the terminator before a record magic; each such
fragment, also one that starts inside a payload, is a candidate that names its successor's offset.  Offsets follow from the fragments' lengths, summed over
the splits of a file.  Within a split the chain is followed at once; across splits pointer jumping from offset 0 over the splits' exits doubles
the reach a round, so the rounds grow with the logarithm of the splits of a file.  Only reachable candidates are records; a record that
holds further fragments in its payload is put together again for its digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, hot_rows, join_unique

MAGIC, END = b"WARC/1.0\r\n", b"\r\n\r\n"
#: Records a file holds at most.
FILE_RECORDS = 20_000
#: Payload bytes for which one more task writes.
TASK_BYTES = 16 << 20
#: Parts of the bitmap of repeated digests and bits of one (those of Spark's bitmap functions); if most bits are set, more payloads are moved than need be, with the same results.
MARKS, PART_BITS = 1024, 32_768

_HEADER = re.compile(rb"((?:[A-Za-z0-9-]+:[^\r\n]*\r\n)+)\r\n")
_FIELD = re.compile(rb"([A-Za-z0-9-]+):\x20?([^\r\n]*)\r\n")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.to_json(F.struct(*parts)))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for x in (F.substring(h, a, n), F.lit("-"))), F.substring(h, 21, 12), F.lit(">"))


def base32(hexed: Column) -> Column:
    """RFC 4648 base32 of a 160-bit digest in hex, built-in functions only."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for g in range(8):  # five hex digits are four letters
        v = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(letters, F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _slot(sha: str) -> tuple[Column, Column]:
    """Part and bit of a digest in a bitmap of ``MARKS`` parts."""
    h = F.xxhash64(sha)
    return F.pmod(h, F.lit(MARKS)), F.pmod(F.shiftright(h, 32), F.lit(PART_BITS))


def _marks(groups: DataFrame) -> DataFrame:
    """Bitmap (part, bits) of the digests (sha) of ``groups``: at most ``MARKS`` rows of 4 KB, however many digests there are."""
    part, bit = _slot("sha")
    return groups.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(bit).alias("bits"))


def _marked(sha: str) -> Column:
    """Whether ``bits`` holds a digest; it may hold others' bits, but misses none of its own."""
    bit = _slot(sha)[1]
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1


def write_archive(pages: DataFrame, path: str, revisit_bytes: int = 0, file_records: int = FILE_RECORDS) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html) below ``path``.

    The payload is the html in UTF-8, null as empty.  Of records with equal payloads of at least ``revisit_bytes`` bytes the one with the largest page_id
    is a response and the others revisit it; smaller ones are all responses.  A null id is smaller than any other and is written
    without the id field; a group with null ids only, and repeated rows of the largest id, are all responses.  Payloads of any length are written whole; other columns are ignored, whatever their names.  An empty table gives an archive without records.
    """
    scratch = Scratch(pages.sparkSession, "warc-write")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    groups = rows.groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("bytes"))
    groups = scratch.cut(groups, "groups")
    total, held = (x or 0 for x in groups.agg(F.sum("n"), F.sum("bytes")).first())
    tasks = 1 + max(total // file_records, held // TASK_BYTES)
    # only payloads that may be repeated are moved
    many = groups.where("n > 1").drop("bytes")
    marks = scratch.cut(_marks(many), "marks")
    probed = rows.join(F.broadcast(marks), _slot("sha")[0] == marks["part"], "left")
    maybe = F.coalesce(_marked("sha"), F.lit(False))
    alone = probed.where(~maybe).select(*rows.columns, F.lit(None).cast("long").alias("top"), F.lit(None).cast("long").alias("n"))
    rows = join_unique(probed.where(maybe).select(*rows.columns), many, ["sha"], F.col("n") >= hot_rows(total)).unionByName(alone)
    size = F.octet_length("payload")
    revisit = F.col("n").isNotNull() & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")) & (size >= revisit_bytes)
    uri = F.regexp_replace("url", r"[\r\n]", " ")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id"), F.col("url"), F.hex("sha").alias("sha")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), uri,
        F.coalesce(F.concat(F.lit("\r\nX-Page-Id: "), F.col("page_id").cast("string")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.sha1("payload")),
        F.when(revisit, F.concat(F.lit("\r\nX-Refers-To-Page: "), F.col("top").cast("string"), F.lit("\r\nX-Payload-Length: "), size.cast("string"), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )
    with scratch.passing():
        rows.select(head.alias("value")).coalesce(tasks).write.mode("overwrite").option("lineSep", END.decode()).option("maxRecordsPerFile", file_records).text(path)
    scratch.drop("groups", "marks")


CANDIDATE = "file string, split long, at long, size long, next long, exit long, open boolean, type string, page_id long, uri string, digest string, payload_bytes long, sound boolean, refers_to long"
_NAMES = [f.split()[0] for f in CANDIDATE.split(", ")]
_SCHEMA = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[f.split()[1]]) for f in CANDIDATE.split(", ")])


def _payload(kind: str, block: bytes) -> bytes:
    return block.partition(END)[2] if kind == "response" else block


def _described(fields: dict[bytes, bytes], block: bytes | None) -> tuple:
    """type, page_id, uri, digest, payload_bytes, sound and refers_to of a record; without its block the digest is unknown yet."""
    kind = fields.get(b"warc-type", b"").decode(errors="replace")
    stated = fields.get(b"warc-payload-digest", b"").decode(errors="replace").removeprefix("sha1:")
    number = lambda k: int(fields[k]) if k in fields and fields[k].lstrip(b"-").isdigit() and len(fields[k]) < 19 else None
    real, size = stated, number(b"x-payload-length")
    if kind == "response" and block is not None:
        payload = _payload(kind, block)
        real, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
    return kind, number(b"x-page-id"), fields.get(b"warc-target-uri", b"").decode(errors="replace"), real, size, real == stated, number(b"x-refers-to-page")


def _parse(body: bytes) -> tuple[dict, int, int] | None:
    """(fields, length of the header, length of the block) of a candidate's text after its magic; None if it has no valid header."""
    m = _HEADER.match(body)
    if not m:
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(m[1])}
    length = fields.get(b"content-length", b"").strip()
    return (fields, m.end(), int(length)) if length.isdigit() and len(length) <= 15 else None


class _Split:
    """The fragments of a split, in order.  Offsets are those of the magic, counted from the split's first fragment; an ``exit`` beyond the split has the same zero."""

    def __init__(self, file: str, split: int):
        self.file, self.split, self.end, self.rows = file, split, 0, []

    def add(self, value: bytes) -> None:
        if self.split == 0 and not self.rows:
            value = value[len(MAGIC) :] if value.startswith(MAGIC) else b"\0" * max(0, len(value) - len(MAGIC))
        # the reader may join two fragments where a terminator lies across its buffers
        for body in value.split(END + MAGIC):
            size = len(MAGIC) + len(body) + len(END)
            row = [self.file, self.split, self.end, size, -1, -1, False, *[None] * 7]
            if parsed := _parse(body):
                fields, head, n = parsed
                left = len(body) - head - n  # 0: the next fragment follows; the last one holds its terminator itself
                if left == 0 or (left == len(END) and body.endswith(END)):
                    row[4:] = [self.end + len(MAGIC) + head + n + len(END), -1, False, *_described(fields, body[head : head + n])]
                elif left < 0:
                    row[4:] = [self.end + len(MAGIC) + head + n + len(END), -1, True, *_described(fields, None)]
            self.rows.append(row)
            self.end += size

    def batches(self) -> Iterator[pa.RecordBatch]:
        leave: dict[int, int] = {}
        for row in reversed(self.rows):
            if row[4] >= self.end:
                leave[row[2]] = row[4]
            elif row[4] > 0:
                leave[row[2]] = leave.get(row[4], -1)
            row[5] = leave.get(row[2], -1)
        for i in range(0, len(self.rows), 2000):
            columns = zip(*self.rows[i : i + 2000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a fragment (``size``: its bytes with magic and terminator); without a valid header ``next`` is -1."""
    held: _Split | None = None
    for batch in batches:
        for file, split, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if held is None or (file, split) != (held.file, held.split):
                if held:
                    yield from held.batches()
                held = _Split(file, split)
            held.add(value.as_py())
    if held:
        yield from held.batches()


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps, in order of file, split and offset, the candidates on the chain from a split's entry."""
    key, want = None, -1
    for batch in batches:
        keep = []
        for file, split, at, after, entry in zip(*(batch.column(n).to_pylist() for n in ("file", "split", "at", "next", "entry")), strict=True):
            if (file, split) != key:
                key, want = (file, split), entry
            keep.append(at == want and after > 0)
            if at == want:
                want = after
        yield batch.filter(pa.array(keep, pa.bool_()))


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, split, at, body) of the fragments."""
    key, at = None, 0
    for batch in batches:
        rows = []
        for file, split, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = value.as_py()
            if (file, split) != key:
                key, at = (file, split), 0
                data = data[len(MAGIC) :] if split == 0 else data
            for body in data.split(END + MAGIC):
                rows.append((file, split, at, body))
                at += len(MAGIC) + len(body) + len(END)
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["file", "split", "at", "body"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and size of records whose fragments come as an ordered list."""
    for batch in batches:
        out = []
        for parts in batch.column(2).to_pylist():
            whole = (END + MAGIC).join(parts)
            fields, head, n = _parse(whole)
            out.append(_described(fields, whole[head : head + n]))
        columns = list(zip(*out, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.bool_())], ["f", "a", "d", "b", "s"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path``: file, at, type, page_id, uri, digest, payload_bytes, sound (digest as stated), refers_to.

    A record is what the chain from its file's start reaches; the chain ends at the first offset without a valid record, or with one that its successor or the
    end of the file doesn't bound, so a torn file gives its records up to there.  Files may have any size; a task holds one record and the offsets of its split.
    Empty files and folders give no rows; a file that starts with no record has none.  Fields beyond those named are ignored; repeated records give a row each.
    """
    scratch = Scratch(spark, "warc")
    lines = spark.read.option("lineSep", (END + MAGIC).decode()).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))
    cand = scratch.cut(lines.mapInArrow(_candidates, CANDIDATE), "candidates")

    # where each split's first fragment starts: the fragments before it in the file, a row a split
    totals = scratch.cut(cand.groupBy("file", "split").agg(F.sum("size").alias("bytes")), "totals")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = scratch.cut(totals.select("file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"), "bytes"), "splits")

    # the few offsets at which a chain may enter a split, and where it leaves it from there
    leaving = cand.where("exit >= 0").select("file", "split", "exit").distinct().join(splits, ["file", "split"])
    target = leaving.select("file", (F.col("base") + F.col("exit")).alias("enter")).distinct()
    target = target.join(splits, "file").where((F.col("enter") >= F.col("base")) & (F.col("enter") < F.col("base") + F.col("bytes")))
    start = splits.where("base = 0 AND split = 0").select("file", "split", F.lit(0).cast("long").alias("at"), "base")
    doors = target.select("file", "split", (F.col("enter") - F.col("base")).alias("at"), "base").unionByName(start).distinct()
    doors = doors.join(cand.select("file", "split", "at", "exit"), ["file", "split", "at"])
    jump = scratch.cut(doors.select("file", "split", "at", (F.col("base") + F.col("at")).alias("from"), F.when(F.col("exit") >= 0, F.col("base") + F.col("exit")).alias("to")), "jump0")
    entry = scratch.cut(jump.where("`from` = 0").select("file", "from"), "entry0")
    doors, n, held = jump, 0, entry.count()
    while held:
        reached = entry.join(jump.select("file", "from", "to"), ["file", "from"]).select("file", F.col("to").alias("from"))
        more = reached.join(doors.select("file", "from"), ["file", "from"], "left_semi")
        entry = scratch.cut(entry.union(more).distinct(), f"entry{n + 1}")
        now = entry.count()
        if now == held:
            break
        held, n = now, n + 1
        far = jump.select("file", F.col("from").alias("to"), F.col("to").alias("further"))
        jump = scratch.cut(jump.join(far, ["file", "to"], "left").select("file", "from", F.coalesce("further", "to").alias("to")), f"jump{n}")
    entry = entry.join(doors, ["file", "from"]).groupBy("file", "split").agg(F.min("at").alias("entry"))

    marked = cand.join(entry, ["file", "split"]).repartition("file", "split").sortWithinPartitions("file", "split", "at")
    kept = marked.select(*_NAMES, "entry").mapInArrow(_chains, f"{CANDIDATE}, entry long").drop("entry").join(splits.drop("bytes"), ["file", "split"])
    kept = scratch.cut(kept.withColumns({"at": F.col("base") + F.col("at"), "next": F.col("base") + F.col("next")}).drop("base"), "kept")

    # a record must end where another begins or where its file ends; only the last one of a chain can fail that
    sizes = splits.groupBy("file").agg(F.max(F.col("base") + F.col("bytes")).alias("whole"))
    last = kept.groupBy("file").agg(F.max("next").alias("next")).join(sizes, "file").select(F.col("file").alias("f"), F.when(F.col("next") > F.col("whole"), F.col("next")).alias("torn"))
    kept = kept.join(last, F.col("file") == F.col("f")).where(F.coalesce(F.col("next") != F.col("torn"), F.lit(True)))

    # records that hold further fragments: their parts, by the splits that they reach into
    opened = scratch.cut(kept.where("open").select("file", "at", "next"), "open")
    if opened.limit(1).count():
        reach = opened.join(splits, "file").where((F.col("base") < F.col("next")) & (F.col("base") + F.col("bytes") > F.col("at")))
        reach = reach.select("file", "split", F.col("at").alias("first"), (F.col("at") - F.col("base")).alias("lo"), (F.col("next") - F.col("base")).alias("hi"), "base")
        parts = lines.mapInArrow(_bodies, "file string, split long, at long, body binary").join(reach, ["file", "split"]).where("at >= lo AND at < hi")
        parts = parts.groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct((F.col("base") + F.col("at")).alias("at"), "body"))).alias("parts"))
        again = scratch.cut(parts.select("file", "first", F.col("parts.body").alias("body")).mapInArrow(_joined, "f string, a long, d string, b long, s boolean"), "again")
        whole = kept.drop("f").join(again, (F.col("file") == F.col("f")) & (F.col("at") == F.col("a")), "left")
        kept = whole.withColumns({"digest": F.coalesce("d", "digest"), "payload_bytes": F.coalesce("b", "payload_bytes"), "sound": F.coalesce("s", "sound")})
    return kept.select("file", "at", "type", "page_id", "uri", "digest", "payload_bytes", "sound", "refers_to")
