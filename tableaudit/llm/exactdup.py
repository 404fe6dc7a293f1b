"""Exact duplicates: radix tries whose terminal nodes own the equal texts.

Two texts are equal when their UTF-8 bytes are identical after A-Z became a-z.

1. Every map task inserts its texts into a Patricia trie of bounded size. The terminal node of a text
   counts its rows and remembers which of them stays; a full trie is written out and a new one
   begun. What leaves the task is one row a distinct text (pre-aggregation: a group of copies that
   holds a third of the table is one row a task) and one narrow row a document.
2. Distinct texts are dealt out by length and content hash and inserted, whole, into the tries of
   the partitions. Equality is that of byte strings; the hash only says where they meet. When
   a trie holds more than its budget, its heaviest subtree is spilled: what it holds and what arrives
   for it later goes to a file, which gets a trie of its own at the end.
3. Owners go back to the documents over (task, number), a key with at most one task's rows.

Defined results: null texts count as empty; empty texts equal each other. Of equal texts the row
with the largest (or smallest) doc_id stays, a null doc_id only if the group has no other; of
rows with that same doc_id exactly one stays. An empty table gives no rows. Columns beside doc_id and
text are neither read nor able to clash.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tableaudit.llm.common import slices, stash, utf8, whole_row

#: Bytes that a trie may hold (labels and nodes) before it is written out or spills a subtree.
HELD_BYTES = 48 << 20
#: What a node costs beside its label.
NODE_BYTES = 400


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Node:
    __slots__ = ("label", "kids", "terminal", "spill")

    def __init__(self, label: bytes):
        self.label, self.kids, self.terminal, self.spill = label, None, None, None


class Trie:
    """Compressed radix trie of byte strings with a value at each terminal node.

    ``merge(old, new)`` gives the value of a string that is there already. With ``spills``,
    a trie over its budget moves its heaviest subtree to a file."""

    def __init__(self, merge, budget: int = HELD_BYTES, spills: bool = False):
        self.merge, self.budget, self.spills = merge, budget, spills
        self.root, self.held, self.ends = Node(b""), 0, 0
        self.spilled: list[tuple[bytes, Node]] = []

    def _down(self, key: bytes) -> tuple[Node, int]:
        """The node that ends ``key`` (made if need be), or the spilled one above it; and how much of ``key`` lies above."""
        node, at = self.root, 0
        while at < len(key) and node.spill is None:
            if node.kids is None:
                node.kids = {}
            child = node.kids.get(key[at])
            if child is None:
                child = node.kids[key[at]] = Node(key[at:])
                self.held += len(child.label) + NODE_BYTES
                return child, len(key)
            if not key.startswith(child.label, at):
                n = shared(child.label, key[at : at + len(child.label)])
                upper = Node(child.label[:n])
                child.label = child.label[n:]
                upper.kids = {child.label[0]: child}
                node.kids[key[at]] = child = upper
                self.held += NODE_BYTES
            node, at = child, at + len(child.label)
        return node, at

    def add(self, key: bytes, value) -> Node:
        node, at = self._down(key)
        if node.spill is not None:
            pickle.dump((key[at:], value), node.spill)
            return node
        if node.terminal is None:
            node.terminal = value
            self.ends += 1
        else:
            node.terminal = self.merge(node.terminal, value)
        while self.spills and self.held > self.budget and self.ends > 1:
            self._spill()
        return node

    def walk(self, top: Node | None = None, above: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        """(key, node) of every terminal in memory below ``top``."""
        stack = [(top or self.root, above)]
        while stack:
            node, key = stack.pop()
            key += node.label
            if node.terminal is not None:
                yield key, node
            stack += [(kid, key) for kid in (node.kids or {}).values()]

    def _spill(self) -> None:
        """Move the heaviest subtree to a file: of those that begin where the trie first branches,
        or beside an earlier spilled one (a spilled node is never below another)."""
        top, above = self.root, b""
        while top.terminal is None and top.kids and len(top.kids) == 1:
            above += top.label
            top = next(iter(top.kids.values()))
        nodes, parents = [top], [-1]
        for i, node in enumerate(nodes):
            for kid in (node.kids or {}).values():
                nodes.append(kid)
                parents.append(i)
        size, free = [0] * len(nodes), [node.spill is None for node in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            size[i] += len(nodes[i].label) + NODE_BYTES
            size[parents[i]] += size[i]
            free[parents[i]] &= free[i]
        whole = [i for i in range(1, len(nodes)) if free[i] and (parents[i] == 0 or not free[parents[i]])]
        if not whole:  # what is left are the labels above spilled nodes
            self.spills = False
            return
        best = at = max(whole, key=size.__getitem__)
        path = []
        while at >= 0:
            path.append(nodes[at].label)
            at = parents[at]
        kid, out = nodes[best], tempfile.TemporaryFile()  # has no name and goes with the task
        for key, end in self.walk(kid):
            pickle.dump((key[len(kid.label):], end.terminal), out)
            self.ends -= 1
        self.held -= size[best] - len(kid.label) - NODE_BYTES
        kid.kids, kid.terminal, kid.spill = None, None, out
        self.spilled.append((above + b"".join(reversed(path)), kid))

    def items(self) -> Iterator[tuple[bytes, object]]:
        """(string, value) of all: those in memory, then each spilled subtree's from a trie of its own."""
        for key, node in self.walk():
            yield key, node.terminal
        self.root = Node(b"")
        for above, node in self.spilled:
            node.spill.seek(0)
            below = Trie(self.merge, self.budget, spills=True)
            while True:
                try:
                    below.add(*pickle.load(node.spill))
                except EOFError:
                    break
            node.spill.close()
            for key, value in below.items():
                yield above + key, value


def _better(largest: bool):
    """Which of two (doc_id, row) stays: the larger doc_id, null last; of equal ones the earlier row."""
    sign = (lambda a, b: a > b) if largest else (lambda a, b: a < b)

    def pick(a: tuple, b: tuple) -> tuple:
        if a[0] is None or b[0] is None:
            if (a[0] is None) != (b[0] is None):
                return b if a[0] is None else a
        elif a[0] != b[0]:
            return a if sign(a[0], b[0]) else b
        return a if a[1] <= b[1] else b

    return pick


def _table(schema: T.StructType, columns: dict) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in arrow], schema=arrow)


def _first_pass(numbered: DataFrame, largest: bool, held: int) -> DataFrame:
    """A row a document (task, number, row, doc_id, text_sha256), and a row a distinct text of a
    trie (also ``size``, ``text``; row and doc_id are those of the row that stays)."""
    out = T.StructType([
        T.StructField("task", T.LongType()), T.StructField("number", T.LongType()), T.StructField("row", T.LongType()),
        T.StructField("doc_id", numbered.schema["doc_id"].dataType), T.StructField("text_sha256", T.StringType()),
        T.StructField("size", T.LongType()), T.StructField("text", T.BinaryType()),
    ])
    pick = _better(largest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        merge = lambda a, b: (a[0], a[1] + 1, pick(a[2], b[2]), a[3])
        trie = Trie(merge, held)

        def flush() -> Iterator[pa.RecordBatch]:
            part, size = [], 0
            for key, node in trie.walk():
                part.append((key, *node.terminal))
                size += len(key)
                if size > 4 << 20:
                    yield rows(part)
                    part, size = [], 0
            if part:
                yield rows(part)

        def rows(part: list) -> pa.RecordBatch:
            keys, numbers, sizes, stays, digests = zip(*part)
            return _table(out, {"task": [task] * len(part), "number": numbers, "row": [s[1] for s in stays], "doc_id": [s[0] for s in stays],
                                "text_sha256": digests, "size": sizes, "text": keys})

        for batch in slices(batches, "text"):
            numbers, digests = [], []
            ids, places = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for text, doc_id, row in zip(utf8(batch, "text"), ids, places):
                low = text.lower()  # of bytes: A-Z only
                digest = hashlib.sha256(low).hexdigest()
                got = trie.add(low, (count, 1, (doc_id, row), digest)).terminal
                count += got[0] == count
                numbers.append(got[0])
                digests.append(digest)
            yield _table(out, {"task": [task] * len(ids), "number": numbers, "row": places, "doc_id": ids, "text_sha256": digests})
            if trie.held > held:
                yield from flush()
                trie = Trie(merge, held)
        yield from flush()

    return numbered.mapInArrow(run, out)


def _owners(texts: DataFrame, largest: bool, held: int) -> DataFrame:
    """For every (task, number): the row that stays of all equal texts, and how many there are."""
    out = T.StructType([
        T.StructField("task", T.LongType()), T.StructField("number", T.LongType()), T.StructField("keep_row", T.LongType()),
        T.StructField("keep_id", texts.schema["doc_id"].dataType), T.StructField("group_size", T.LongType()),
    ])
    pick = _better(largest)

    def merge(a: tuple, b: tuple) -> tuple:
        a[2].extend(b[2])
        return pick(a[0], b[0]), a[1] + b[1], a[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(merge, held, spills=True)
        for batch in slices(batches, "text"):
            cols = [batch.column(c).to_pylist() for c in ("task", "number", "row", "doc_id", "size", "text")]
            for task, number, row, doc_id, size, text in zip(*cols):
                trie.add(text, ((doc_id, row), size, [(task, number)]))
        part: list = []
        for _, (stays, size, refs) in trie.items():
            part += [(t, n, stays[1], stays[0], size) for t, n in refs]
            if len(part) > 50_000:
                yield _table(out, dict(zip(out.names, zip(*part))))
                part = []
        if part:
            yield _table(out, dict(zip(out.names, zip(*part))))

    dealt = texts.repartition(F.length("text"), F.substring("text_sha256", 1, 16))
    return dealt.mapInArrow(run, out)


def _decisions(numbered: DataFrame, keep: str, held: int) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256) of (row, doc_id, text)."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep: largest or smallest")
    first = stash(_first_pass(numbered, keep == "largest", held), "exact-texts")
    owners = _owners(first.where("size IS NOT NULL"), keep == "largest", held)
    docs = first.where("size IS NULL").drop("size", "text")
    return docs.join(owners, ["task", "number"]).select("row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def exact_duplicates(docs: DataFrame, keep: str = "largest", held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256
    (of the lower-cased text). See the module for nulls, ties and repeated rows."""
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return _decisions(numbered, keep, held_bytes).drop("row")


def unique(docs: DataFrame, keep: str = "largest", held_bytes: int = HELD_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are, whatever their names."""
    whole = stash(docs.select(F.monotonically_increasing_id().alias("row"), whole_row(docs).alias("doc")), "exact-rows")
    stays = _decisions(whole.select("row", "doc.doc_id", "doc.text"), keep, held_bytes).where("kept").select("row")
    return whole.join(stays, "row", "left_semi").select("doc.*")
