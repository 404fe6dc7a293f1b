"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns; its key is a 128-bit sum of its turns' digests, each mixed with its
depth, so the prefixes of a conversation are running sums. Rows are sorted in ranges over (conversation,
place): a conversation may lie in many partitions, whose sums are carried over (one row a partition reaches the driver).

Subtree totals come from the parent edges. The mass of a subtree, the number of conversation rows in it, is a plain
group-by at its top. A component's centroid is its deepest node with half of the component's mass or more below it:
the weights of the component's nodes in the centroid's subtree are summed, and the sum is added to every node on the path from the
centroid up to the component's top. The centroid then leaves; what hung below it and what lies above are components of at
most half the mass. Where a node stands is looked up in the table of (conversation, depth) rows: its ancestor
at a depth is that of any conversation through it.

Components of more than ``max(LIMIT, rows / 65,536)`` rows are split by Spark, all at once: there are at most 65,536 of them, so
their centroids, sums and masses are small tables that may be broadcast. Smaller ones are dealt out whole and split to the end by array
operations over all components of a task.

Defined results: null role or text counts as empty; a null turn comes first; equal turns are ordered by a digest of
role and text; identical rows are turns of their own. Rows with null conv_id belong to no conversation. Other columns are not read. An
empty table has no conversations and no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableaudit.llm.common import give_back, stash
from tableaudit.llm.mixing import words
from tableaudit.session import cut

#: Rows of a component that one task splits; and the most components that Spark splits at once.
LIMIT, COMPONENTS = 1 << 12, 1 << 16
#: Decimal ids joined to one piece of text.
IDS_A_PIECE = 1 << 16


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, said, words): narrow rows; ``said`` is a 128-bit digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), said.alias("said"), words(text).alias("words"))


# Places in conversations that lie in several partitions

def _sorted(rows: DataFrame, order: list[Column]) -> DataFrame:
    """In ranges over ``order``, kept as they are by a checkpoint."""
    return cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))


def _arrays(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _edges(ranged: DataFrame) -> tuple[dict, dict, int]:
    """For each partition the rows its first conversation has before it; the rows of all
    conversations that may lie in several; all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        n_first = n_last = n = 0
        for batch in batches:
            if batch.num_rows:
                conv = batch.column("conv_id").to_numpy()
                first = conv[0] if first is None else first
                n_first += int(np.searchsorted(conv, first, "right"))
                tail = batch.num_rows - int(np.searchsorted(conv, conv[-1]))
                n_last = n_last + tail if last == conv[-1] else tail
                last, n = conv[-1], n + batch.num_rows
        if n:
            row = {"part": TaskContext.get().partitionId(), "first": int(first), "n_first": n_first, "last": int(last), "n_last": n_last, "n": n}
            yield pa.RecordBatch.from_pylist([row], pa.schema([(k, pa.int64()) for k in row]))

    before, whole, n, open_conv, held = {}, {}, 0, None, 0
    edges = ranged.select("conv_id").mapInArrow(run, "part long, first long, n_first long, last long, n_last long, n long").collect()
    for e in sorted(edges, key=lambda e: e.part):
        before[e.part] = held if open_conv == e.first else 0
        held = e.n_last + (before[e.part] if e.first == e.last else 0)
        open_conv, n = e.last, n + e.n
        whole[e.first] = whole.get(e.first, 0) + e.n_first
        if e.last != e.first:
            whole[e.last] = whole.get(e.last, 0) + e.n_last
    return before, whole, n


def _runs(conv: np.ndarray, before: int, whole: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of its run, place from 0, rows of its conversation) of each row of a partition."""
    starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    counts = np.diff(np.r_[starts, len(conv)])
    start = np.repeat(starts, counts)
    place = np.arange(len(conv)) - start
    place[: counts[0]] += before
    for run in {0, len(starts) - 1}:
        counts_of = whole.get(int(conv[starts[run]]))
        if counts_of is not None:
            counts[run] = counts_of
    return start, place, np.repeat(counts, np.diff(np.r_[starts, len(conv)]))


def rebuild(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Turns (conv_id, place, said, words) of conversations that begin with turns of another: the first ``h`` of
    conversation ``c - c % every`` and then the own turns after the first ``h``; h = crc32(c) mod ``most``. ``place`` orders a
    conversation's turns; each conversation has one row without ``said`` before its turns."""
    ranged = _sorted(turns_of(conversations), [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("said")])
    before, whole, _ = _edges(ranged)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _arrays(batches)
        if table is not None:
            _, place, _ = _runs(_ints(table, "conv_id"), before[TaskContext.get().partitionId()], whole)
            yield from table.drop_columns("turn").append_column("place", pa.array(place + 1)).to_batches(max_chunksize=100_000)
        give_back()

    own = ranged.mapInArrow(run, "conv_id long, said binary, words long, place long")
    own = stash(own.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most), "own-turns")
    every_one = own.where("place = 1").select("conv_id", "h")
    # At most `every` conversations have one base, and it gives each at most most - 1 turns.
    base = own.where((F.col("conv_id") % every == 0) & (F.col("place") < most)).select(F.col("conv_id").alias("base"), "said", "words", F.col("place").alias("nth"))
    shared = every_one.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base").where("nth <= h")
    return (
        every_one.select("conv_id", F.lit(0).cast("bigint").alias("place"), F.lit(None).cast("binary").alias("said"), F.lit(0).cast("bigint").alias("words"))
        .unionByName(shared.select("conv_id", F.col("nth").alias("place"), "said", "words"))
        .unionByName(own.where("place > h").select("conv_id", F.col("place") + most, "said", "words").toDF("conv_id", "place", "said", "words"))
    )


def plain(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, place, said, words) of the conversations as they are, for ``prefix_trie``."""
    return rebuild(conversations, 1, 1)


# Rows and nodes

def _lanes(said: pa.ChunkedArray, depth: np.ndarray) -> np.ndarray:
    """Two 64-bit words a turn: its digest mixed with its depth; 0 for the row before the turns."""
    blank = b"\0" * 16
    flat = np.frombuffer(b"".join(blank if s is None else s for s in said.to_pylist()), np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        x = flat + np.stack([depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), depth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)], 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    x[said.is_null().to_numpy()] = 0
    return x


def _binary(lanes: np.ndarray) -> pa.Array:
    n = len(lanes)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(lanes))])


def _rows(turns: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, depth, rest, node, parent, words) for every conversation and depth, and their number; ``rest``: turns that follow."""
    ranged = _sorted(turns.select("conv_id", "place", "said", "words"), [F.col("conv_id"), F.col("place")])
    before, whole, n = _edges(ranged)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the last conversation of a partition adds there."""
        table, part = _arrays(batches), TaskContext.get().partitionId()
        if table is not None:
            conv = _ints(table, "conv_id")
            start, depth, _ = _runs(conv, before[part], whole)
            lanes = _lanes(table.column("said"), depth)[start[-1]:].sum(0, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"part": [part], "a": [int(lanes[0])], "b": [int(lanes[1])], "one": [int(start[-1] == 0)]}, pa.schema([(k, pa.int64()) for k in ("part", "a", "b", "one")]))

    carry, held = {}, np.zeros(2, np.uint64)
    for r in sorted(ranged.mapInArrow(sums, "part long, a long, b long, one long").collect(), key=lambda r: r.part):
        carry[r.part] = held if before[r.part] else np.zeros(2, np.uint64)
        held = np.array([r.a, r.b], np.int64).view(np.uint64) + (carry[r.part] if r.one else np.uint64(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = _arrays(batches), TaskContext.get().partitionId()
        if table is not None:
            conv = _ints(table, "conv_id")
            start, depth, of = _runs(conv, before[part], whole)
            lanes = _lanes(table.column("said"), depth)
            above = np.r_[np.zeros((1, 2), np.uint64), lanes.cumsum(0, dtype=np.uint64)]
            base = above[start] - np.where((start == 0)[:, None], carry[part], np.uint64(0))
            out = pa.table({"conv_id": conv, "depth": depth, "rest": of - 1 - depth, "node": _binary(above[1:] - base), "parent": _binary(above[:-1] - base), "words": table.column("words")})
            yield from out.to_batches(max_chunksize=100_000)
        give_back()

    made = ranged.mapInArrow(run, "conv_id long, depth long, rest long, node binary, parent binary, words long")
    return stash(made.withColumn("parent", F.when(F.col("depth") > 0, F.col("parent"))), "trie-rows"), n


def _nodes(rows: DataFrame) -> DataFrame:
    """One row a node: its smallest member ``conv_id``, n_convs, ``ends`` (members that end there) and ``mass``."""
    made = rows.groupBy("node", "parent", "depth", "words").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("rest") == 0).alias("ends"), F.sum(F.col("rest") + 1).alias("mass"))
    return stash(made, "trie-nodes")


# Centroid decomposition

def split_all(top: np.ndarray, parent: np.ndarray, depth: np.ndarray, mass: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Subtree sums of ``weights`` (a row a node) in a forest by centroid decomposition of all trees at once.

    ``parent`` is an index or -1 at a top, ``top`` the index of a node's top, ``depth`` counts from any origin in
    a tree, ``mass`` is any measure of a subtree that grows from a child to its parent."""
    n = len(top)
    rel = depth - depth[top]
    # Order of a walk through each tree, from subtree sizes: level by level.
    by_level = np.argsort(rel, kind="stable")
    bounds = np.searchsorted(rel[by_level], np.arange(rel.max(initial=0) + 2))
    size = np.ones(n, np.int64)
    for level in range(len(bounds) - 2, 0, -1):
        at = by_level[bounds[level] : bounds[level + 1]]
        np.add.at(size, parent[at], size[at])
    kids = np.lexsort((np.arange(n), parent))
    up_to = size[kids].cumsum() - size[kids]
    first = np.r_[True, parent[kids][1:] != parent[kids][:-1]] if n else np.zeros(0, bool)
    beside = np.empty(n, np.int64)
    beside[kids] = up_to - np.maximum.accumulate(np.where(first, up_to, 0))
    pre = np.where(parent < 0, beside, 0)
    for level in range(1, len(bounds) - 1):
        at = by_level[bounds[level] : bounds[level + 1]]
        pre[at] = pre[parent[at]] + 1 + beside[at]
    end = pre + size
    # Components: `lab` is the index of a node's top; `left` what isn't taken out yet, in walk order.
    total, mass, lab = np.zeros_like(weights), mass.copy(), top.copy()
    left = np.argsort(pre, kind="stable")
    centroid = np.empty(n, np.int64)
    while len(left):
        heavy = left[2 * mass[left] >= mass[lab[left]]]
        heavy = heavy[np.argsort(depth[heavy], kind="stable")]
        centroid[lab[heavy]] = heavy  # the deepest is written last
        c = centroid[lab[left]]
        below = (pre[left] > pre[c]) & (pre[left] < end[c])
        path = (pre[left] <= pre[c]) & (pre[c] < end[left])
        inside = left[below | (left == c)]
        part = np.zeros_like(weights)
        np.add.at(part, lab[inside], weights[inside])
        on = left[path]
        total[on] += part[lab[on]]
        mass[on] -= np.where(on == c[path], 0, mass[c[path]])
        # What is below the centroid belongs to the child it hangs from: the last one before it in walk order.
        order = np.lexsort((pre[left], lab[left]))
        x, cx, under = left[order], c[order], below[order]
        begins = np.where((parent[x] == cx) & under, np.arange(len(x)), 0)
        child = x[np.maximum.accumulate(begins)]
        lab[x[under]] = child[under]
        left = left[left != c]
    return total


def _small(nodes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved) of components that are dealt out whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _arrays(batches)
        if table is not None:
            keys = {c: np.array(table.column(c).to_pylist(), dtype="S16") for c in ("node", "up", "comp")}
            order = np.argsort(keys["node"], kind="stable")
            find = lambda k: order[np.minimum(np.searchsorted(keys["node"], k, sorter=order), len(order) - 1)]
            top = find(keys["comp"])
            parent = np.where(keys["node"] == keys["comp"], -1, find(keys["up"]))
            weights = np.stack([_ints(table, "leaf"), _ints(table, "saved")], 1)
            total = split_all(top, parent, _ints(table, "depth"), _ints(table, "mass"), weights) + np.stack([_ints(table, "leaves_in"), _ints(table, "saved_in")], 1)
            out = pa.table({"node": table.column("node"), "n_leaves": total[:, 0], "saved_tokens": total[:, 1]})
            yield from out.to_batches(max_chunksize=100_000)
        give_back()

    return nodes.repartition("comp").mapInArrow(run, "node binary, n_leaves long, saved_tokens long")


def rollup(nodes: DataFrame, rows: DataFrame, n: int, limit: int = LIMIT) -> DataFrame:
    """(node, n_leaves, saved_tokens): subtree sums of childless nodes and of (n_convs - 1) * words, over ``n`` rows."""
    spark = nodes.sparkSession
    limit = max(limit, n // COMPONENTS)
    root = bytes(16)
    work = nodes.select("node", F.coalesce("parent", F.lit(root)).alias("up"), "depth", "conv_id", "mass", F.lit(root).alias("comp"),
                        (F.col("ends") == F.col("n_convs")).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
                        F.lit(0).cast("bigint").alias("leaves_in"), F.lit(0).cast("bigint").alias("saved_in"))
    columns, small, done = work.columns, [], []
    known = rows.select(F.col("conv_id").alias("at_conv"), F.col("depth").alias("at_depth"), F.col("node").alias("at_node"), F.col("parent").alias("at_parent"))
    #: Components to split: top -> mass. Disjoint, and of more than n / COMPONENTS rows each.
    comps = {root: n} if n > limit else {}
    if not comps:
        small.append(work)
    while comps:
        size = F.broadcast(spark.createDataFrame(list(comps.items()), "comp binary, total long"))
        found = work.join(size, "comp").where("2 * mass >= total").groupBy("comp").agg(F.max(F.struct("depth", "node", "conv_id", "mass")).alias("c"))
        cents = {bytes(r.comp): r.c for r in found.collect()}
        about = F.broadcast(spark.createDataFrame([(k, bytes(c.node), c.depth, c.conv_id, c.mass) for k, c in cents.items()], "comp binary, c_node binary, c_depth long, c_conv long, c_mass long"))
        deeper = F.col("depth") > F.col("c_depth")
        looked = work.join(about, "comp").withColumns({"at_conv": F.when(deeper, F.col("conv_id")).otherwise(F.col("c_conv")), "at_depth": F.when(deeper, F.col("c_depth") + 1).otherwise(F.col("depth"))})
        stood = looked.join(known, ["at_conv", "at_depth"]).select(
            *columns, "c_node", "c_depth", "c_mass", "at_node", (deeper & (F.col("at_parent") == F.col("c_node"))).alias("below"), (~deeper & (F.col("at_node") == F.col("node"))).alias("path"))
        stood = stash(stood, "components")
        inside = stood.where(F.col("below") | (F.col("node") == F.col("c_node"))).groupBy("comp").agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s"))
        parts = F.broadcast(spark.createDataFrame([(bytes(r.comp), r.l, r.s) for r in inside.collect()], "comp binary, add_leaves long, add_saved long"))
        tops = stood.where(F.col("below") & (F.col("depth") == F.col("c_depth") + 1) & (F.col("mass") > limit)).select("node", "mass").collect()
        rest = {k: comps[k] - c.mass for k, c in cents.items()}
        comps = {**{k: m for k, m in rest.items() if m > limit}, **{bytes(r.node): r.mass for r in tops}}
        on, add = F.col("path"), stood.join(parts, "comp")
        then = add.select(
            "node", "up", "depth", "conv_id", F.when(on & (F.col("node") != F.col("c_node")), F.col("mass") - F.col("c_mass")).otherwise(F.col("mass")).alias("mass"),
            F.when(F.col("below"), F.col("at_node")).otherwise(F.col("comp")).alias("comp"), "leaf", "saved",
            (F.col("leaves_in") + F.when(on, F.col("add_leaves")).otherwise(0)).alias("leaves_in"), (F.col("saved_in") + F.when(on, F.col("add_saved")).otherwise(0)).alias("saved_in"),
            (F.col("node") == F.col("c_node")).alias("out"))
        done.append(then.where("out").select("node", F.col("leaves_in").alias("n_leaves"), F.col("saved_in").alias("saved_tokens")))
        still = then.where("NOT out").drop("out")
        large = F.broadcast(spark.createDataFrame([(k,) for k in comps], "comp binary"))
        small.append(still.join(large, "comp", "left_anti").select(columns))
        work = still.join(large, "comp", "left_semi").select(columns)
    parts = small[0]
    for p in small[1:]:
        parts = parts.unionByName(p)
    out = _small(parts)
    for p in done:
        out = out.unionByName(p)
    return out


def _ends(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256): hash of the ids of the conversations that end at a node, ascending, comma-joined. Ids are joined to
    long pieces where they lie in order; a node's pieces are then streamed through its hash."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = None, []

        def piece() -> tuple:
            return at, ids[0], ",".join(map(str, ids)).encode()

        def sent(part: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.binary(), pa.int64(), pa.binary()))], ["node", "first", "piece"])

        for batch in batches:
            part = []
            for node, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (node != at or len(ids) == IDS_A_PIECE):
                    part.append(piece())
                    ids = []
                at = node
                ids.append(conv)
            if part:
                yield sent(part)
        if ids:
            yield sent([piece()])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
        for batch in batches:
            part = []
            for node, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist()):
                if node != at:
                    if sha is not None:
                        part.append((at, sha.hexdigest()))
                    at, sha = node, hashlib.sha256(piece)
                else:
                    sha.update(b"," + piece)
            if part:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], schema=schema)
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([sha.hexdigest()])], schema=schema)

    ends = rows.where("rest = 0").select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = ends.mapInArrow(join, "node binary, first long, piece binary")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row a node of the trie of ``turns`` (``plain`` or ``rebuild``): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (what caching each shared turn once saves in the subtree), ends_sha256, and the keys node and parent."""
    rows, n = _rows(turns)
    nodes = _nodes(rows)
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # One parent may have a third of all nodes as children: the planner splits that side of the join.
    out = nodes.join(rollup(nodes, rows, n, limit), "node").join(kids, "node", "left").join(_ends(rows), "node", "left")
    out = stash(out, "trie-sums").join(above, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"), "node", "parent")
