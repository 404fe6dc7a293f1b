"""Token ids as ORC: run-length coded integers, row indexes, Bloom filters on doc_id.

A dataset is a folder of ORC files in ascending doc_id order (file by file, row
by row). Columns: ``doc_id``, ``ids`` (array of int: ORC run-length codes them),
``n`` (their number), ``part`` (the file's place) and ``first`` (ids of the
documents before it in its file). Readers split by stripe; a search by doc_id
is answered from stripe statistics, row indexes and Bloom filters first.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableaudit.llm.common import shared_path, slices

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Words whose ids a worker remembers, and as many parts of words.
REMEMBERED = 300_000

ORC = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
}


#: Words of printable ASCII and Latin-1 letters: their normal form is their lower case, and their parts are runs of letters, digits one by one, and runs of other signs.
_PLAIN = "^[!-&(-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+$"
_PARTS = "([a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+)"
#: How the byte-level model writes bytes: printable ones as themselves, the others from U+0100 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


#: The settings of a tokenizer file whose texts may be cut into words here.
_CUT_HERE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "truncation": None, "padding": None,
}


def cut_here(settings: dict) -> bool:
    """Does the file's tokenizer normalise and split as ``Encoder`` assumes of plain words?"""
    same = all(settings.get(k) == v for k, v in _CUT_HERE.items())
    model = settings["model"]
    plain = model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
    return same and plain and all(t["content"].startswith("<|") for t in settings.get("added_tokens", []))


class Known:
    """Distinct strings, by number, and the ids of each, one after another in ``flat``."""

    def __init__(self):
        self.names = pa.array([], pa.string())
        self.flat, self.first = np.empty(0, np.int32), np.zeros(1, np.int64)

    def numbers(self, names: pa.Array) -> np.ndarray:
        """The names' numbers, -1 for unknown ones."""
        return pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, names: pa.Array, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Give new names their ids, ``size`` each, and the next numbers."""
        number = len(self.names) + np.arange(len(names))
        self.names = pa.concat_arrays([self.names, names])
        self.flat = np.concatenate([self.flat, ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        return number

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence of numbers, and how many each has."""
        size = self.first[numbers + 1] - self.first[numbers]
        upto = np.cumsum(size) - size
        source = np.repeat((self.first[numbers] - upto).astype(np.int32), size)  # a batch has fewer than 2^31 ids, as its lists in Arrow do
        source += np.arange(len(source), dtype=np.int32)
        return self.flat[source], size


class Encoder:
    """Ids of texts. White space always ends a word in this tokenizer's model, so a text's ids
    are those of its words in turn, and each distinct word is looked up once for a batch of
    texts. Plain words are cut into the tokenizer's own pre-tokens here and given to its model
    part by part; other words go through the whole tokenizer. Ids are remembered over
    the tasks of a worker. A tokenizer that normalises or splits otherwise (``cut_here``) gets whole texts."""

    def __init__(self, tokenizer: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if "/" not in tokenizer:
            import public_tokenizers

            tokenizer = public_tokenizers.path(tokenizer)
        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.fast = cut_here(json.loads(self.tokenizer.to_str()))
        self.words, self.parts = Known(), Known()

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, each text's with the end id after them, and their numbers."""
        if not self.fast:
            lists = [[*e.ids, end_id] for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(size.sum())), size
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        ids, size = self._coded(split.flatten(), "words", self._whole)
        ends = np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)
        stop = np.r_[0, np.cumsum(size)][ends] + np.arange(len(ends))
        out = np.full(len(ids) + len(ends), end_id, np.int32)
        inside = np.ones(len(out), bool)
        inside[stop] = False
        out[inside] = ids
        return out, np.diff(np.r_[-1, stop])

    def _coded(self, strings: pa.Array, store: str, learn) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sequence of strings, and how many each has; ``learn`` gives those of new strings."""
        if len(getattr(self, store).names) > REMEMBERED:
            setattr(self, store, Known())
        known = getattr(self, store)
        coded = strings.dictionary_encode()
        number = known.numbers(coded.dictionary)
        new = np.flatnonzero(number < 0)
        if len(new):
            names = coded.dictionary.take(pa.array(new))
            number[new] = known.add(names, *learn(names))
        return known.ids(number[coded.indices.to_numpy()])

    def _whole(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, and how many each has."""
        plain = pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, "<|")))
        cut = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(pc.if_else(plain, words, "")), _PARTS, "\\1\n"), "\n")
        parts = cut.flatten()
        part_ids, part_size = self._coded(parts, "parts", self._model)
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(), dtype=np.int64)
        upto = np.r_[0, np.cumsum(part_size)][np.r_[0, ends]]
        odd = {i: self.tokenizer.encode(words[i].as_py(), add_special_tokens=False).ids for i in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist() if words[i].as_py()}
        if not odd:
            return part_ids, np.diff(upto)
        lists = [odd[i] if i in odd else part_ids[a:b] for i, (a, b) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist()))]
        return np.concatenate([np.asarray(x, np.int32) for x in lists]), np.fromiter(map(len, lists), np.int64, len(lists))

    def _model(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens (or empty strings), and how many each has."""
        tokenize = self.tokenizer.model.tokenize
        lists = [[t.id for t in tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES))] if p else [] for p in parts.to_pylist()]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(size.sum())), size


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """This worker's encoder."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    return _ENCODERS[tokenizer]


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> str:
    """Write the ids of every row of ``docs`` (doc_id, text) as an ORC dataset.

    Null and empty texts have the end id alone. Rows are ordered by doc_id (null
    first), then text; repeated rows are all written. An empty table gives a
    dataset without rows. Other columns are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    # The range shuffle moves the texts, not the ids: its sample then costs no tokenising. The text's hash splits a doc_id of many rows.
    ordered = (docs.select("doc_id", "text", F.xxhash64("text").alias("by")).repartitionByRange("doc_id", "by")
               .sortWithinPartitions("doc_id", "by").select("doc_id", F.spark_partition_id().alias("part"), F.coalesce("text", F.lit("")).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before = encoder(tokenizer), 0
        for batch in slices(batches, "text", 8 << 20):
            ids, n = coder.ids(batch.column(2), end_id)
            edge = np.r_[0, np.cumsum(n)]
            lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before + edge[:-1]), pa.array(n), lists], names=["doc_id", "part", "first", "n", "ids"])
            before += int(edge[-1])

    rows = ordered.mapInArrow(run, f"doc_id {kind}, part int, first bigint, n bigint, ids array<int>")
    rows.write.options(**ORC).orc(path)
    return path


def read(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """(doc_id, start, n, ids) of the dataset; with ``doc_ids`` of these alone, found
    through the files' statistics, row indexes and Bloom filters. A dataset without rows gives none; of a
    doc_id that stands in it several times all rows; null doc_ids can't be asked for."""
    rows = spark.read.orc(path)
    # One row for each file: the files are as many as the write had partitions.
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    base = totals.select(F.col("part"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(doc_ids))
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n", "ids")


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``read`` returns, from the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            edge = ids.offsets.to_numpy()
            crc = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(edge).astype(np.int64)), pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` below the shared folder and return the digests of what the files hold: a row for
    every row of ``docs`` (see ``write`` for nulls, repeated rows, empty tables and other columns)."""
    spark = docs.sparkSession
    return digests(read(spark, write(docs, shared_path(spark, "tokens"), tokenizer, end_id)))
