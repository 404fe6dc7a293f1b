"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every fingerprint emits all variants within half the maximum bit distance; two
fingerprints meet in a common variant exactly when their distance is within the
maximum. The variants of one fingerprint that share a prefix travel as one row
(prefix, fingerprint) and are written out in the task that owns the prefix: the
shuffle moves some dozens of rows for each fingerprint instead of its 2,081
variants. Prefixes that would hold too many variants are split by further bits,
so a dense ball of fingerprints is spread over tasks too.

Within a variant's group every fingerprint is linked to one centre (each is
within half the distance of the variant, so the link is within the distance):
the links are linear in the group, and no pairs of a group are written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableaudit.llm.common import give_back, row_hash, slices, stash, utf8, whole_row

BITS = 64
SEED = 42
#: Variants that one prefix may hold (their sorted array is the task's memory), and the mean aimed at.
MOST_VARIANTS, MEAN_VARIANTS = 1 << 22, 1 << 20
#: Shingles hashed at once.
BLOCK = 1 << 16


def simhash(text: bytes, shingle: int) -> int:
    """Unsigned SimHash of a text: bit set where over half of its shingles' XXH64
    have it. No words: zero. Fewer words than the shingle: the whole sequence."""
    words = text.lower().split()  # for bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[:n].tolist()
    stops = (ends - 1)[min(shingle, len(words)) - 1:].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:at + BLOCK], stops[at:at + BLOCK])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, row, fp) of every row; ``row`` tells apart rows that share a doc_id."""
    source = docs.select("doc_id", row_hash(F.col("doc_id"), F.col("text")).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fp = np.array([simhash(t, shingle) for t in utf8(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "row", "fp"])

    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, row bigint, fp bigint")


def ball(bits: int, radius: int) -> int:
    """Variants of a word of so many bits within the radius."""
    return sum(comb(bits, i) for i in range(min(bits, radius) + 1)) if radius >= 0 else 0


def masks(low: int, high: int, radius: int) -> list[int]:
    """All masks with at most ``radius`` of the bits low..high-1, as signed longs."""
    out = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(low, high), r)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def _routed(rows: DataFrame, had: int, bits: int, radius: int) -> DataFrame:
    """Rows (fp, used) that share ``had`` prefix bits, sent to each prefix of ``bits`` that holds variants of theirs."""
    flips = masks(BITS - bits, BITS - had, radius)
    out = rows.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("bigint") for m in flips])))
    used = F.col("used") + F.bit_count("mask").cast("int")
    word = F.col("word").bitwiseXOR(F.col("mask"))
    return (out.select("fp", word.alias("word"), used.alias("used")).filter(F.col("used") <= radius)
            .select("fp", "word", "used", F.shiftrightunsigned("word", BITS - bits).alias("prefix")))


def _leaf(bits: int, distance: int):
    """Star links among the fingerprints of one prefix."""
    radius, inner = ceil(distance / 2), distance // 2
    low = BITS - bits
    keep = np.uint64((1 << low) - 1)
    by_flips = {r: np.array(masks(0, low, r), np.int64).view(np.uint64) for r in range(radius + 1)}
    weight = {r: np.bitwise_count(by_flips[r]).astype(np.int8) for r in by_flips}

    def variants(fp: np.ndarray, word: np.ndarray, used: np.ndarray):
        for u in range(radius + 1):
            of = used == u
            if of.any():
                for part in np.array_split(np.flatnonzero(of), 1 + int(of.sum()) * len(by_flips[radius - u]) // (1 << 20)):
                    if len(part):
                        yield u, fp[part], (word[part] & keep)[:, None] ^ by_flips[radius - u]

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
        if len(pdf) < 2:
            return none
        fp, word = pdf["fp"].to_numpy(np.int64), pdf["word"].to_numpy(np.int64).view(np.uint64)
        used = pdf["used"].to_numpy()
        every = np.concatenate([v.ravel() for _, _, v in variants(fp, word, used)])
        every.sort()
        met = np.unique(every[1:][every[1:] == every[:-1]])
        del every
        if not len(met):
            return none
        found = []
        for u, own, v in variants(fp, word, used):
            at = np.searchsorted(met, v)
            at[at == len(met)] = 0
            i, j = np.nonzero(met[at] == v)
            found.append((at[i, j], own[i], u + weight[radius - u][j]))
        at, own, far = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((own, far > inner, at))
        at, own, far = at[order], own[order], far[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        size = np.diff(np.r_[first, len(at)])
        centre, near = np.repeat(own[first], size), np.repeat(far[first] <= inner, size)
        links = near & (own != centre) & (np.bitwise_count((own ^ centre).view(np.uint64)) <= distance)
        give_back()
        return forest(own[links], centre[links])

    return links


def forest(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """The same components with one link (node, root) for each node that isn't its root."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        was = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == was).all():
            break
    own = root != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[own], "b": nodes[root[own]]})


def links(fps: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect the same
    groups as all pairs within ``distance`` bits would."""
    radius = ceil(distance / 2)
    spark, n = fps.sparkSession, fps.count()
    bits = max(1, min(24, ceil(log2(max(1, n * ball(BITS, radius) / MEAN_VARIANTS)))))  # one at least: a shift by all 64 bits is none
    # Each fingerprint becomes dozens of rows: a table of few files is dealt out first.
    dealt = fps.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")
    rows = _routed(dealt.select("fp", F.col("fp").alias("word"), F.lit(0).alias("used")), 0, bits, radius)
    out = spark.createDataFrame([], "a bigint, b bigint")
    while True:
        held = sum((F.when(F.col("used") == u, F.lit(ball(BITS - bits, radius - u))).otherwise(0) for u in range(radius + 1)), F.lit(0))
        dense = rows.groupBy("prefix").agg(F.sum(held).alias("held")).filter(F.col("held") > MOST_VARIANTS).select("prefix")
        dense = stash(dense, "dense")
        full = BITS - bits <= radius or dense.isEmpty()
        light = rows if full else rows.join(dense, "prefix", "left_anti")
        out = out.union(light.groupBy("prefix").applyInPandas(_leaf(bits, distance), "a bigint, b bigint"))
        if full:
            return out.distinct()
        more = min(6, BITS - bits)
        rows = stash(_routed(rows.join(dense, "prefix", "left_semi"), bits, bits + more, radius), "split")
        bits += more


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): alternating large and
    small stars, each round written to the shared folder; root is the smallest node."""
    e = stash(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = mark(e)
    while seen[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = (joined.select("a", F.col("m").alias("b")).union(joined.select(F.col("b"), F.col("m")))
                 .filter(F.col("a") != F.col("b")).distinct())
        e = stash(small, "stars")
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, row, fp, root, component_id) of every row of ``docs``.

    Null and word-less texts have fingerprint zero and are linked like others.
    ``component_id`` is the smallest doc_id reachable over links (null where
    every doc_id of the group is null). Repeated rows share everything. An
    empty table gives an empty result; other columns are not looked at.
    """
    rows = stash(fingerprints(docs, shingle), "simhash")
    each = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tree = components(links(stash(each.select("fp"), "fps"), distance))
    rooted = each.join(tree, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stash(rooted, "rooted")
    group = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(group, "root"), "fp").select("doc_id", "row", "fp", "root", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the
    smallest doc_id (null last); of several rows with it one, always the same.
    All columns stay as they are."""
    groups = near_duplicates(docs, shingle, distance)
    chosen = (groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row")).alias("m"))
              .select(F.col("m.doc_id").alias("id_"), F.col("m.row").alias("row_")))
    chosen = stash(chosen, "chosen")
    keyed = docs.select(whole_row(docs).alias("all"), F.col("doc_id").alias("id"), row_hash(F.col("doc_id"), F.col("text")).alias("row"))
    kept = keyed.join(chosen, F.col("id").eqNullSafe(F.col("id_")) & (F.col("row") == F.col("row_")), "left_semi")
    # Rows that agree in doc_id and text but perhaps in nothing else are few: only they are grouped whole.
    again = stash(groups.groupBy("doc_id", "row").count().filter("count > 1").select(F.col("row").alias("row_")).distinct(), "again")
    single = kept.join(again, F.col("row") == F.col("row_"), "left_anti").select("all.*")
    if again.isEmpty():
        return single
    several = kept.join(again, F.col("row") == F.col("row_"), "left_semi")
    one = several.groupBy("row").agg(F.min_by("all", F.xxhash64("all")).alias("all")).select("all.*")
    return single.union(one)
