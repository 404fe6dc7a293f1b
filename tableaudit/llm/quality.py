"""Quality classifier: supervised subword embeddings.

A document is a bag of hashed word unigrams, word bigrams and character n-grams;
each bucket has a learned vector, a document is the mean of its buckets' vectors,
and a softmax over two classes gives the score. Numpy stochastic gradient
descent trains the vectors on a bounded sample of labelled rows. As the softmax
is linear in the mean, scoring needs one learned number for each bucket.

Case is kept. A word equal to the one before it is read as a ditto mark, so that
repetition has a vector of its own whatever the repeated word is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableaudit.llm.common import kept, row_hash, slices, utf8

FOLDS = 5


@dataclass(frozen=True)
class Params:
    """``sample_rows``: about so many labelled documents are trained on, chosen by hash; the only bound of the training
    data. Each sends the driver one bag: its whole text's distinct buckets (at most ``buckets``) with
    their counts, 8 bytes each. ``step``: by how much of the rate one document moves its own mean."""

    sample_rows: int = 2048
    buckets: int = 1 << 17
    grams: tuple[int, ...] = (3, 4, 5)
    dim: int = 8
    epochs: int = 6
    rate: float = 0.8
    step: float = 0.05
    batch: int = 32
    seed: int = 17
    threshold: float = 0.3


#: Bytes hashed at once. What lies across two such chunks is carried over: the chunk size changes no result.
CHUNK = 1 << 20
_P = 0x100000001B3
_INVERSE = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Bucket numbers of all n-grams of a UTF-8 text, in numpy."""

    def __init__(self, p: Params):
        self.p = p
        self.shift = np.uint64(64 - (p.buckets.bit_length() - 1))
        self.up, self.down = _powers(_P, CHUNK + 64), _powers(_INVERSE, CHUNK + 64)

    def bucket(self, h: np.ndarray, kind: int) -> np.ndarray:
        h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> self.shift).astype(np.int32)

    def parts(self, text: bytes) -> Iterator[np.ndarray]:
        """Arrays of buckets: character n-grams, words and pairs of words, chunk by chunk."""
        most = max(self.p.grams)
        # A word that goes on in the next chunk (its hash and length so far); the word before it, as it was and as it is read.
        held, length = 0, 0
        before = read = None
        for at in range(0, len(text), CHUNK):
            raw = np.frombuffer(text[at : at + CHUNK], np.uint8)
            yield from self._grams(np.frombuffer(text[at : at + CHUNK + most - 1], np.uint8), len(raw))
            blank = _SPACE[raw]
            edge = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
            start, end = edge[::2], edge[1::2]
            total = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], dtype=np.uint64)]
            sums, sizes = (total[end] - total[start]) * self.down[start], (end - start).astype(np.uint64)
            if length:
                if len(start) and start[0] == 0:  # the first word began before
                    sums[0] = np.uint64((held + int(sums[0]) * pow(_P, length, 1 << 64)) % (1 << 64))
                    sizes[0] += np.uint64(length)
                else:
                    sums, sizes = np.r_[np.uint64(held), sums], np.r_[np.uint64(length), sizes]
                held, length = 0, 0
            if not blank[-1] and at + CHUNK < len(text):
                held, length, sums, sizes = int(sums[-1]), int(sizes[-1]), sums[:-1], sizes[:-1]
            if len(sums):
                word = sums + sizes
                first = before is not None and word[0] == before
                before, last = word[-1], read
                word = np.where(np.r_[first, word[1:] == word[:-1]], np.uint64(1), word)
                yield self.bucket(word, 101)
                chain = word if last is None else np.r_[last, word]
                if len(chain) > 1:
                    yield self.bucket(chain[:-1] * np.uint64(_P) + chain[1:], 102)
                read = word[-1]

    def _grams(self, raw: np.ndarray, starts: int) -> Iterator[np.ndarray]:
        h = raw.astype(np.uint64)
        for n in range(2, max(self.p.grams) + 1):
            if len(raw) < n:
                break
            h = h[:-1] * np.uint64(_P) + raw[n - 1:]
            if n in self.p.grams:
                yield self.bucket(h[:starts], n)


def bag(text: bytes, hasher: Hasher) -> np.ndarray:
    """Two rows: the distinct buckets of the whole text, and how often each occurs."""
    counts = np.zeros(hasher.p.buckets, np.int32)
    for ids in hasher.parts(text):
        counts += np.bincount(ids, minlength=len(counts)).astype(np.int32)
    ids = np.flatnonzero(counts)
    return np.stack([ids.astype(np.int32), counts[ids]])


def train(bags: list[np.ndarray], labels: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """Numbers (w, b) so that the log odds of label 1 are mean(w[buckets]) + b, means weighted by the buckets' counts."""
    rng = np.random.default_rng(p.seed)
    vectors = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim)).astype(np.float32)
    out, bias = np.zeros((p.dim, 2), np.float32), np.zeros(2, np.float32)
    usable = np.array([i for i, b in enumerate(bags) if b.shape[1]], int)
    steps, done = max(1, p.epochs * -(-len(usable) // p.batch)), 0
    for _ in range(p.epochs):
        order = rng.permutation(usable)
        for at in range(0, len(order), p.batch):
            rate = np.float32(p.rate * (1 - done / steps))
            done += 1
            rows = order[at:at + p.batch]
            size = np.array([bags[i].shape[1] for i in rows])
            ids, counts = np.concatenate([bags[i] for i in rows], axis=1)
            first = np.r_[0, np.cumsum(size)[:-1]]
            part = counts / np.repeat(np.add.reduceat(counts.astype(np.float64), first), size)
            mean = np.add.reduceat(vectors[ids] * part[:, None].astype(np.float32), first, axis=0)
            logit = mean @ out + bias
            prob = np.exp(logit - logit.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(len(rows)), labels[rows]] -= 1
            back = prob @ out.T
            out -= rate * (mean.T @ prob) / np.float32(len(rows)) * 8
            bias -= rate * prob.mean(axis=0)
            # Along its gradient each document moves its own mean by the same step, however many buckets it has.
            scale = part / np.repeat(np.add.reduceat(part * part, first), size) * p.step
            for d in range(p.dim):
                move = scale * np.repeat(-rate * back[:, d], size)
                vectors[:, d] += np.bincount(ids, move, minlength=p.buckets).astype(np.float32)
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> tuple[np.ndarray, float]:
    """Train on about ``p.sample_rows`` labelled documents, none of the held-out fold.

    Rows without doc_id or quality are no samples; a doc_id with several labels
    has their majority (ties: 1), one with several rows the text of least hash. Without samples of both classes the model is
    constant (the share of label 1, smoothed).
    """
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0))
             .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label")))
    n = known.count()
    share = min(1.0, p.sample_rows / max(1, n))
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) < F.lit(int(share * (1 << 53))))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(p)
        for batch in slices(batches, "text"):
            bags = [bag(t, hasher).tobytes() for t in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(bags, pa.binary())], names=["doc", "label", "key", "bag"])

    # The picked ids are bounded by sample_rows, so they may be broadcast; the texts stay where they are. Rows of one
    # doc_id are reduced to one bag in every task, then over all.
    rows = (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
            .select(F.col("doc_id").cast("string").alias("doc"), "label", "text", row_hash(F.col("doc_id"), F.col("text")).alias("key"))
            .mapInArrow(draw, "doc string, label int, key bigint, bag binary")
            .groupBy("doc").agg(F.min("label").alias("label"), F.min("key").alias("key"), F.min_by("bag", "key").alias("bag")))
    got = sorted((r.key, r.label, bytes(r.bag)) for r in rows.toLocalIterator())
    y = np.array([label for _, label, _ in got], int)
    if len(set(y.tolist())) < 2:
        p1 = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(p.buckets, np.float32), float(np.log(p1 / (1 - p1)))
    return train([np.frombuffer(b, np.int32).reshape(2, -1) for _, _, b in got], y, p)


def score_text(text: bytes, hasher: Hasher, w: np.ndarray, b: float) -> float:
    total, n = 0.0, 0
    for ids in hasher.parts(text):
        total += float(w[ids].sum(dtype=np.float64))
        n += len(ids)
    return float(1 / (1 + np.exp(-(total / n if n else 0.0) - b)))


def _scorer(docs: DataFrame, model: tuple[np.ndarray, float], p: Params):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batch: pa.RecordBatch, hasher: Hasher) -> np.ndarray:
        w, b = shared.value
        return np.array([score_text(t, hasher, w, b) for t in utf8(batch, "text")], np.float64)

    return scores


def score(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts have no n-grams: their score is the learned bias alone.
    A null doc_id isn't held out. Repeated rows get equal scores; an empty table
    gives an empty result; further columns are never looked at.
    """
    scores = _scorer(docs, fit(docs, labels, p), p)
    source = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False)).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(p)
        for batch in slices(batches, "text"):
            s = scores(batch, hasher)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= p.threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def accept(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts (score >= threshold), all columns as they are, whatever their
    names. Null and empty texts are judged by the bias alone, repeated rows alike; an empty table stays empty."""
    scores = _scorer(docs, fit(docs, labels, p), p)

    def start():
        hasher = Hasher(p)
        return lambda batch: scores(batch, hasher) >= p.threshold

    return kept(docs, start)
