"""VCF files as a Spark data source: ``spark.read.format("vcf")``, with byte-range partitions and filters on position, chromosome and sample pushed to the reader.

Options: ``path``; ``partition_bytes``, the size of a partition; ``samples``, names joined by commas, to read no other columns.  The filters that a plan
pushes (``spark.sql.python.filterPushdown.enabled``) are equality and IN on ``chrom``, ``pos`` and ``sample_id`` and bounds on ``pos``: lines at other positions are dropped
before their cells are split.  Positions are 0-based, bases are decoded as ``vcf.read_calls`` decodes them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .vcf import REQUIRED

SCHEMA = "chrom string, pos int, ref string, sample_id string, base string"
#: Bytes of a partition, and calls of a batch that a reader hands over.
PARTITION_BYTES, BATCH_CALLS = 1 << 26, 1 << 16
_ARROW = pa.schema([("chrom", pa.string()), ("pos", pa.int32()), ("ref", pa.string()), ("sample_id", pa.string()), ("base", pa.string())])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _base(gt: str, ref: str, alts: list[str]) -> str:
    gt = gt.partition(":")[0]
    if gt.isascii() and gt.isdigit() and len(gt) <= 4:
        alleles = [ref, *alts]
        gt = alleles[int(gt)] if int(gt) < len(alleles) else "N"
    return gt if gt in ("A", "C", "G", "T", "-") else "-" if gt == "*" else "N"


@dataclass
class Range(InputPartition):
    start: int
    end: int


@dataclass
class Wanted:
    """What the pushed filters leave; None: everything."""

    pos: frozenset[int] | None = None
    chrom: frozenset[str] | None = None
    sample_id: frozenset[str] | None = None
    least: int | None = None
    most: int | None = None
    pushed: list[str] = field(default_factory=list)

    def take(self, f: Filter) -> bool:
        """Whether the filter is one that the reader applies; if so it does from now on."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if isinstance(f, EqualTo | In) and name in ("pos", "chrom", "sample_id"):
            values = frozenset(v for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None)
            held = getattr(self, name)
            setattr(self, name, values if held is None else held & values)
        elif isinstance(f, GreaterThan | GreaterThanOrEqual) and name == "pos":
            bound = f.value + isinstance(f, GreaterThan)
            self.least = bound if self.least is None else max(self.least, bound)
        elif isinstance(f, LessThan | LessThanOrEqual) and name == "pos":
            bound = f.value - isinstance(f, LessThan)
            self.most = bound if self.most is None else min(self.most, bound)
        elif not (isinstance(f, IsNotNull) and name):  # no column is ever null
            return False
        self.pushed.append(f"{type(f).__name__}({name})")
        return True

    def line(self, chrom: str, pos: int) -> bool:
        return (self.pos is None or pos in self.pos) and (self.chrom is None or chrom in self.chrom) and (self.least is None or pos >= self.least) and (self.most is None or pos <= self.most)


class VcfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("the vcf source needs a path")
        self.path, self.size = options["path"], int(options.get("partition_bytes", PARTITION_BYTES))
        self.wanted = Wanted(sample_id=frozenset(options["samples"].split(",")) if options.get("samples") else None)
        self.names = self._header()

    def _header(self) -> list[str]:
        system, path = _open(self.path)
        with system.open_input_stream(path) as stream:
            held = b""
            while block := stream.read(1 << 20):
                *lines, held = (held + block).split(b"\n")
                for line in lines:
                    if line.startswith(b"#CHROM"):
                        names = line.decode().rstrip("\r").split("\t")
                        if missing := [c for c in ("#CHROM", "POS", "REF", "ALT") if c not in names]:
                            raise ValueError(f"{self.path} lacks {', '.join(missing)}")
                        return names
            if held.startswith(b"#CHROM"):
                return held.decode().rstrip("\r").split("\t")
        raise ValueError(f"{self.path} has no #CHROM line")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Range]:
        system, path = _open(self.path)
        size = system.get_file_info(path).size
        return [Range(i, min(i + self.size, size)) for i in range(0, max(size, 1), self.size)]

    def _lines(self, part: Range) -> Iterator[bytes]:
        """Lines that start in the range: the first partial one belongs to the range before, the last is read to its end."""
        system, path = _open(self.path)
        with system.open_input_file(path) as f:
            at = max(part.start - 1, 0)  # a line that starts here follows a line end just before
            f.seek(at)
            held, first = b"", part.start > 0
            start = at
            while start < part.end and (block := f.read(1 << 20)):
                *lines, held = (held + block).split(b"\n")
                for line in lines:
                    if not first and start < part.end:
                        yield line
                    first = False
                    start += len(line) + 1
                    if start >= part.end:
                        return
            if held and not first and start < part.end:
                yield held

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        at = {n: i for i, n in enumerate(self.names)}
        wanted = self.wanted
        samples = [(i, n) for n, i in at.items() if n not in REQUIRED and (wanted.sample_id is None or n in wanted.sample_id)]
        chrom_at, pos_at, ref_at, alt_at = (at[c] for c in ("#CHROM", "POS", "REF", "ALT"))
        front = max(chrom_at, pos_at) + 1
        rows: list[list] = [[], [], [], [], []]
        for raw in self._lines(part):
            if raw.startswith(b"#") or not raw.strip():
                continue
            line = raw.decode().rstrip()
            head = line.split("\t", front)
            chrom, pos = head[chrom_at], int(head[pos_at]) - 1
            if not wanted.line(chrom, pos):
                continue
            f = line.split("\t")
            ref, alts = f[ref_at], f[alt_at].split(",")
            for i, name in samples:
                for column, value in zip(rows, (chrom, pos, ref, name, _base(f[i] if i < len(f) else ".", ref, alts)), strict=True):
                    column.append(value)
            if len(rows[0]) >= BATCH_CALLS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, _ARROW, strict=True)], schema=_ARROW)
                rows = [[], [], [], [], []]
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, _ARROW, strict=True)], schema=_ARROW)


class VcfDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vcf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VcfReader:
        return VcfReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes ``format("vcf")`` known to the session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VcfDataSource)
