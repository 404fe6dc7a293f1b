"""CSV with line ends inside quotes, read in as many tasks as the files have splits.

A split of a file begins at a line, and a line may begin inside a quoted field. The first pass finds for every split what
follows from either beginning: a split that begins outside (inside) of a field ends outside or inside of one. These
two answers of each split, chained in file order from the file's beginning, say how every split really begins. In the second pass
each task cuts its lines into records; a record that goes on in later splits is put together from its parts, one group a
record, and every record is parsed by ``from_csv``. Files without line ends in quotes go to the plain reader.

The driver holds one small row a split. Quotes count as a CSV reader takes them: at the start of a field they open it, doubled they are
text, anywhere else in an unquoted field they are plain characters.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C

CORRUPT = "_corrupt_record"
SPARK_NAMES = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1"}
LINES = "value binary, file string, block bigint"


def ends_inside(line: bytes, inside: bool, sep: bytes, quote: bytes) -> bool:
    """Does ``line``, begun inside a quoted field or not, end inside one?"""
    at = 0
    if not inside:
        if line.startswith(quote):
            at = 1
        else:
            at = line.find(sep + quote)
            if at < 0:
                return False
            at += len(sep) + 1
    while True:
        at = line.find(quote, at)
        if at < 0:
            return True
        if line.startswith(quote, at + 1):
            at += 2
            continue
        # Closed: the field ends at the next separator.
        at = line.find(sep, at + 1)
        if at < 0:
            return False
        if not line.startswith(quote, at + len(sep)):
            at = line.find(sep + quote, at + len(sep))
            if at < 0:
                return False
        at += len(sep) + 1


def _lines(spark: SparkSession, paths) -> DataFrame:
    """(value, file, block): the lines as bytes, in file order within a split."""
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", "\n").text(paths)
    return raw.select(F.col("value").cast("binary").alias("value"), meta.file_path.alias("file"), meta.file_block_start.alias("block"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """Lines of one split, batch by batch; a task may have several splits."""
    for batch in batches:
        values, files, blocks = (batch.column(c).to_pylist() for c in ("value", "file", "block"))
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or files[i] != files[start] or blocks[i] != blocks[start]:
                yield (files[start], blocks[start]), values[start:i]
                start = i


@dataclass
class Layout:
    """What the files hold and how their splits begin."""

    files: list[str]
    #: (file, block) -> the block in which the record began that is open at the split's beginning; None: the split begins with a record.
    owner: dict[tuple[str, int], int | None]
    #: Files of which a record goes over a split's end, or is open at the file's.
    spanning: list[str]
    encoding: str
    #: Records may hold line ends; the plain reader would cut them.
    quoted_line_ends: bool
    #: No line feeds at all, but carriage returns.
    returns_only: bool
    header: list[str]
    empty: bool


STATE = "file string, block bigint, from_out boolean, from_in boolean, closes boolean, within boolean, returns boolean, utf8 boolean, lines bigint, first binary"
_STATE = pa.schema([("file", pa.string()), ("block", pa.int64()), *[(k, pa.bool_()) for k in ("from_out", "from_in", "closes", "within", "returns", "utf8")],
                    ("lines", pa.int64()), ("first", pa.binary())])


class _Split:
    """One split's answers, line by line."""

    def __init__(self, key: tuple[str, int], sep: bytes, quote: bytes):
        (self.file, self.block), self.sep, self.quote = key, sep, quote
        self.from_out, self.from_in, self.closes = False, True, False
        self.within = self.returns = False
        self.utf8, self.lines, self.first, self.has_first = True, 0, b"", self.block > 0

    def add(self, lines: list[bytes]) -> None:
        for line in lines:
            if self.quote in line:
                self.from_out = ends_inside(line, self.from_out, self.sep, self.quote)
                self.from_in = ends_inside(line, self.from_in, self.sep, self.quote)
                self.within |= self.from_out
                self.closes |= not self.from_in
            if not self.has_first and (self.first or line.strip()):
                self.first += line + b"\n"
                self.has_first = not self.from_out
        text = b"\n".join(lines)
        self.returns |= b"\r" in text.replace(b"\r\n", b"").removesuffix(b"\r")
        self.lines += len(lines)
        try:
            text.decode("utf-8")
        except UnicodeDecodeError:
            self.utf8 = False

    def row(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{k: getattr(self, k) for k in _STATE.names}], _STATE)


def examine(spark: SparkSession, path, sep: str = ",", quote: str = '"') -> Layout:
    """First pass: one row a split reaches the driver."""
    s, q = sep.encode(), quote.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for key, lines in _by_split(batches):
            if split is None or (split.file, split.block) != key:
                if split is not None:
                    yield split.row()
                split = _Split(key, s, q)
            split.add(lines)
        if split is not None:
            yield split.row()

    found = sorted(_lines(spark, path).mapInArrow(run, STATE).collect(), key=lambda r: (r.file, r.block))
    owner, first, spanning = {}, {}, set()
    open_in = None
    for r in found:
        if r.file not in first:
            open_in = None
            first[r.file] = bytes(r.first)
        owner[r.file, r.block] = open_in
        if r.from_in if open_in is not None else r.from_out:
            open_in = r.block if open_in is None or r.closes else open_in
            spanning.add(r.file)
        else:
            open_in = None
    utf8 = all(r.utf8 for r in found)
    encoding = C.CSV_ENCODINGS[0 if utf8 else 1]
    header = next((h for _, h in sorted(first.items()) if h.strip()), b"").decode(encoding).removeprefix("\ufeff")
    names = next(csv.reader(header.rstrip("\r\n").splitlines(keepends=True), delimiter=sep, quotechar=quote), [])
    return Layout(sorted(first), owner, sorted(spanning), encoding, bool(spanning) or any(r.within or r.returns for r in found),
                  bool(found) and all(r.lines == 1 for r in found) and any(r.returns for r in found), _safe(names), not header.strip())


def _safe(names: list[str]) -> list[str]:
    """Names as the plain reader makes them: unnamed columns by number, repeated ones with their number."""
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


class _Cutter:
    """The records of one split: ``whole`` ones, or the ``parts`` (file, record, block, slot, text) of those that are also in others.
    The file's first record is its header."""

    def __init__(self, key: tuple[str, int], layout: Layout, sep: bytes, quote: bytes):
        if key not in layout.owner:
            raise RuntimeError(f"the splits of {key[0]} changed after they were examined")
        self.key, self.owner, self.encoding = key, layout.owner[key], layout.encoding
        self.sep, self.quote = sep, quote
        self.open, self.held = self.owner is not None, []
        self.head, self.header = self.open, key[1] == 0
        self.whole: list[str] = []
        self.parts: list[tuple] = []

    def _text(self) -> str:
        return b"\n".join(self.held).decode(self.encoding)

    def add(self, lines: list[bytes]) -> None:
        for line in lines:
            if self.quote in line:
                self.open = ends_inside(line, self.open, self.sep, self.quote)
            if self.held or self.head or self.open or line.strip():
                self.held.append(line)
                if not self.open:
                    if self.head:
                        self.parts.append((self.key[0], self.owner, self.key[1], 0, self._text()))
                    elif not self.header:
                        self.whole.append(self._text().removesuffix("\r"))
                    self.header &= self.head
                    self.head, self.held = False, []

    def end(self) -> None:
        if self.held:
            self.parts.append((self.key[0], self.owner if self.head else self.key[1], self.key[1], 0 if self.head else 1, self._text()))
            self.held = []


def records(spark: SparkSession, layout: Layout, sep: str = ",", quote: str = '"') -> DataFrame:
    """(record): every record but the headers, as text."""
    s, q = sep.encode(), quote.encode()

    def cut(batches: Iterator[pa.RecordBatch], take) -> Iterator[pa.RecordBatch]:
        at = None
        for key, lines in _by_split(batches):
            if at is None or at.key != key:
                if at is not None:
                    at.end()
                    yield from take(at)
                at = _Cutter(key, layout, s, q)
            at.add(lines)
            yield from take(at)
        if at is not None:
            at.end()
            yield from take(at)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def take(at: _Cutter) -> Iterator[pa.RecordBatch]:
            if at.whole:
                yield pa.RecordBatch.from_arrays([pa.array(at.whole, pa.string())], ["record"])
            at.whole, at.parts = [], []

        return cut(batches, take)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def take(at: _Cutter) -> Iterator[pa.RecordBatch]:
            if at.parts:
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*at.parts), types)], ["file", "began", "block", "slot", "part"])
            at.whole, at.parts = [], []

        return cut(batches, take)

    out = _lines(spark, layout.files).mapInArrow(whole, "record string")
    if layout.spanning:
        parts = _lines(spark, layout.spanning).mapInArrow(over, "file string, began bigint, block bigint, slot bigint, part string")
        in_order = F.sort_array(F.collect_list(F.struct("block", "slot", "part")))
        joined = parts.groupBy("file", "began").agg(F.array_join(F.transform(in_order, lambda x: x.part), "\n").alias("record"))
        out = out.unionByName(joined.select(F.regexp_replace("record", r"\r\z", "").alias("record")))
    return out


def parsed(rows: DataFrame, names: list[str], sep: str = ",", quote: str = '"', corrupt: bool = False) -> DataFrame:
    """The fields of ``records`` as text columns; with ``corrupt`` also the records with more or fewer fields than ``names``."""
    fields = [*names, *([CORRUPT] if corrupt else [])]
    ddl = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in fields)
    options = {"sep": sep, "quote": quote, "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return rows.select(F.from_csv("record", ddl, options).alias("r")).select("r.*")
