"""Benchmark decontamination with training suffix arrays.

Documents are read in shards of a bounded number of words. A shard's words are
numbered by the benchmark's vocabulary; runs of known words that are long enough
to hold a window make up the shard's text, over which a suffix array is built by
prefix doubling. Every test suffix is then looked up in it by binary search: its
interval of the suffix array has all places where the window at its head occurs
verbatim, and extending them gives the longest match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableaudit.llm.common import ROW_KEY, row_key, slices, stash, utf8, whole_row

WINDOW = 10
#: Words of a shard; bytes of benchmark text that are searched for in one pass.
SHARD_WORDS, BLOCK_BYTES = 1 << 18, 8 << 20
#: Bytes that are part of words (ASCII digits and letters, all of other characters), A-Z in lower case; others are blanks.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


@dataclass
class Suffixes:
    """Test suffixes of a block of benchmark items, one for each distinct window, by its length."""

    vocabulary: dict[bytes, int]
    names: list[str]  # item ids, sorted
    windows: dict[int, np.ndarray]  # length -> distinct windows
    items: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> where each window's items end, and their numbers in names
    texts: np.ndarray  # all items' word numbers, 0 after each
    at: dict[int, np.ndarray]  # length -> a place of each window in texts

    def items_of(self, size: int, which: int) -> list[str]:
        ends, items = self.items[size]
        return [self.names[i] for i in items[ends[which - 1] if which else 0:ends[which]]]


def prepare(items: list[tuple[str, bytes]], window: int) -> Suffixes:
    vocabulary: dict[bytes, int] = {}
    names = sorted({item for item, _ in items})
    number = {item: i for i, item in enumerate(names)}
    texts, parts, at = [np.empty(0, np.int32)], {}, 0
    for item, text in items:
        codes = np.array([*(vocabulary.setdefault(w, len(vocabulary) + 1) for w in split_words(text)), 0], np.int32)
        size = min(window, len(codes) - 1)
        if size:
            parts.setdefault(size, []).append((number[item], at, np.lib.stride_tricks.sliding_window_view(codes[:-1], size)))
        texts.append(codes)
        at += len(codes)
    out = Suffixes(vocabulary, names, {}, {}, np.concatenate(texts) if items else np.zeros(1, np.int32), {})
    for size, found in sorted(parts.items()):
        place = np.concatenate([first + np.arange(len(w)) for _, first, w in found])
        out.windows[size], first, which = np.unique(np.concatenate([w for _, _, w in found]), axis=0, return_index=True, return_inverse=True)
        pair = np.unique(which.ravel() * len(names) + np.repeat([i for i, _, _ in found], [len(w) for _, _, w in found]))
        out.items[size] = np.searchsorted(pair, (np.arange(len(first)) + 1) * len(names)), (pair % len(names)).astype(np.int32)
        out.at[size] = place[first]
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` numbers at least, by prefix doubling."""
    _, rank = np.unique(text, return_inverse=True)
    rank, h = rank.astype(np.int64), 1
    while h < depth:
        after = np.zeros_like(rank)
        after[:-h] = rank[h:] + 1 if h < len(rank) else 0
        _, new = np.unique(rank * (len(text) + 1) + after, return_inverse=True)
        done = int(new.max()) == len(text) - 1
        rank, h = new.astype(np.int64), 2 * h
        if done:
            break
    return np.argsort(rank, kind="stable")


def _bound(text: np.ndarray, order: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """For each wanted window the number of suffixes before it (or, with ``after``, up to its last)."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
    column = np.arange(wanted.shape[1])
    while (open_ := low < high).any():
        mid = (low + high) // 2
        head = text[np.minimum(order[np.minimum(mid, len(order) - 1)][:, None] + column, len(text) - 1)]
        differs = head != wanted
        first = differs.argmax(axis=1)
        row = np.arange(len(wanted))
        below = np.where(differs.any(axis=1), head[row, first] < wanted[row, first], after)
        low, high = np.where(open_ & below, mid + 1, low), np.where(open_ & ~below, mid, high)
    return low


def search(codes: np.ndarray, tests: Suffixes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each window length its matches in ``codes``: window numbers, places, lengths of the whole match."""
    known = codes > 0
    edge = np.flatnonzero(np.diff(np.r_[0, known.astype(np.int8), 0]))
    start, end = edge[::2], edge[1::2]
    for size, wanted in tests.windows.items():
        fits = end - start >= size
        if not fits.any():
            continue
        # The runs one after another, a zero after each.
        s, n = start[fits], (end - start)[fits]
        first = np.cumsum(n + 1) - (n + 1)
        place = np.full(int((n + 1).sum()), -1, np.int64)
        index = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place[np.repeat(first, n) + index] = np.repeat(s, n) + index
        text = np.where(place >= 0, codes[place], 0)
        order = suffix_array(text, size)
        low, high = _bound(text, order, wanted, False), _bound(text, order, wanted, True)
        hits = high - low
        if not hits.any():
            continue
        which = np.repeat(np.arange(len(wanted)), hits)
        found = order[np.repeat(low, hits) + np.arange(int(hits.sum())) - np.repeat(np.cumsum(hits) - hits, hits)]
        length, test = np.full(len(found), size), tests.at[size][which]
        while True:
            a, b = found + length, test + length
            more = text[np.minimum(a, len(text) - 1)] == tests.texts[np.minimum(b, len(tests.texts) - 1)]
            more &= (a < len(text)) & (b < len(tests.texts)) & (tests.texts[np.minimum(b, len(tests.texts) - 1)] > 0)
            if not more.any():
                break
            length = length + more
        yield size, which, place[found], length


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Suffixes]:
    """The benchmark in blocks of about BLOCK_BYTES, one after another: what the driver holds and is broadcast at once has that bound."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 + size // BLOCK_BYTES
    for block in range(count):
        mine = items.filter(F.pmod(F.xxhash64("item"), F.lit(count)) == block)
        yield prepare([(r.item, (r.text or "").encode()) for r in mine.toLocalIterator()], window)


class Shard:
    """Documents that are searched together; long ones are cut, overlapping by a window less a word."""

    def __init__(self, window: int):
        self.window, self.words, self.of, self.offset, self.size = window, [], [], [], 0

    def add(self, doc: int, words: list[bytes]) -> Iterator["Shard"]:
        step = SHARD_WORDS
        for at in range(0, max(1, len(words)), step):
            piece = words[at:at + step + self.window - 1] if at + step < len(words) else words[at:]
            if self.size and self.size + len(piece) > step:
                yield self
                self.__init__(self.window)
            self.words.append(piece)
            self.of.append(doc)
            self.offset.append(at)
            self.size += len(piece)

    def matches(self, tests: Suffixes) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, first word, window length, window, whole length) of each match."""
        get = tests.vocabulary.get
        codes = np.concatenate([np.array([*(get(w, 0) for w in p), 0], np.int64) for p in self.words])
        first = np.cumsum([0, *(len(p) + 1 for p in self.words)])
        for size, which, place, length in search(codes, tests):
            piece = np.searchsorted(first, place, "right") - 1
            for p, w, at, far in zip(piece.tolist(), which.tolist(), (place - first[piece]).tolist(), length.tolist()):
                yield self.of[p], at + self.offset[p], size, w, far


def _matches(docs: list[bytes], blocks: list[Suffixes], window: int):
    """For each text its words; for those with matches their spans (first word, words), item ids and longest match."""
    counts = [0] * len(docs)
    spans: dict[int, set[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    longest = [0] * len(docs)

    def look(shard: Shard) -> None:
        for tests in blocks:
            for doc, at, size, w, far in shard.matches(tests):
                spans.setdefault(doc, set()).add((at, size))
                items.setdefault(doc, set()).update(tests.items_of(size, w))
                longest[doc] = max(longest[doc], far)

    shard = Shard(window)
    for i, text in enumerate(docs):
        words = split_words(text)
        counts[i] = len(words)
        for full in shard.add(i, words):
            look(full)
    if shard.size:
        look(shard)
    return counts, spans, items, longest


def _runs(spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (first word, words) as disjoint runs in order; spans that touch stay apart."""
    out: list[tuple[int, int]] = []
    for at, size in sorted(spans):
        if out and at < sum(out[-1]):
            out[-1] = out[-1][0], max(sum(out[-1]), at + size) - out[-1][0]
        else:
            out.append((at, size))
    return out


def _covered(spans: set[tuple[int, int]]) -> int:
    """Words that spans (first word, words) cover."""
    return sum(size for _, size in _runs(spans))


def _find(docs: list[bytes], blocks: list[Suffixes], window: int):
    """For each text its words, hit words, item ids and longest match."""
    counts, spans, items, longest = _matches(docs, blocks, window)
    return counts, [_covered(spans.get(i, set())) for i in range(len(docs))], items, longest


def _hits(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """(row, at, size, items, longest) of the documents with matches, once for each block of the benchmark that
    has some. Each block is broadcast alone, and what it finds is written to the shared folder."""
    spark = docs.sparkSession
    source = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    parts = []
    for tests in _blocks(benchmark, window):
        shared = spark.sparkContext.broadcast(tests)
        del tests

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 4 << 20):
                _, spans, items, longest = _matches(utf8(batch, "text"), [shared.value], window)
                found = sorted(spans)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(found)), pa.array([[a for a, _ in spans[i]] for i in found], pa.list_(pa.int64())), pa.array([[n for _, n in spans[i]] for i in found], pa.list_(pa.int64())),
                         pa.array([sorted(items[i]) for i in found], pa.list_(pa.string())), pa.array([longest[i] for i in found], pa.int64())],
                        names=["row", "at", "size", "items", "longest"])

        found = source.mapInArrow(run, f"row {ROW_KEY}, at array<bigint>, size array<bigint>, items array<string>, longest bigint")
        parts.append(stash(found, "hits"))
        shared.destroy()
    return reduce(DataFrame.union, parts)


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, places) of every row of ``docs``.

    ``places``: the runs of hit words (at: number of words before, words), in order.
    ``longest``: words of the longest verbatim match found with an item, followed from one place of each window
    and within a shard. Null, empty and
    word-less texts have no words and no hits; items without words or without
    id have no windows; an item of fewer words than ``window`` is one window.
    Repeated rows and items give equal rows; empty tables an empty result, or
    no hits. Other columns are not looked at.
    """
    hits = (_hits(docs, benchmark, window).groupBy("row").agg(F.collect_set(F.struct("at", "size", "items")).alias("f"), F.max("longest").alias("longest"))
            .select("row", F.flatten("f.at").alias("at"), F.flatten("f.size").alias("size"), F.flatten("f.items").alias("items"), "longest"))
    source = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    kind = dict(source.dtypes)["doc_id"]
    runs = pa.list_(pa.struct([("at", pa.int64()), ("words", pa.int64())]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(split_words(t)) for t in utf8(batch, "text")], pa.int64())], names=["doc_id", "row", "n_words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, size, items in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                ids = sorted(set(items or ()))
                places = _runs(set(zip(at or (), size or ())))
                hit = sum(words for _, words in places)
                rows.append((hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0, [{"at": a, "words": n} for a, n in places]))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.bool_()))), batch.column(5), pa.array(cols[4], runs)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "places"])

    words = source.mapInArrow(count, f"doc_id {kind}, row {ROW_KEY}, n_words bigint")
    joined = words.join(hits, "row", "left").select("doc_id", "n_words", "at", "size", "items", F.coalesce("longest", F.lit(0)).alias("longest"))
    return joined.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, longest bigint, places array<struct<at:bigint,words:bigint>>")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, all columns as they are."""
    hits = _hits(docs, benchmark, window).select("row").distinct()
    keyed = docs.select(whole_row(docs).alias("all"), row_key(F.col("doc_id"), F.col("text")).alias("row"))
    return keyed.join(hits, "row", "left_anti").select("all.*")
