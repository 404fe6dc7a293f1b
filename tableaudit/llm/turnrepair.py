"""Conversation structure repair: cheapest edits by grammar-compressed dynamic programming.

A repaired conversation has the roles ``(s?(ua)+)?``: nothing, or an optional system turn and then user
and assistant turns by turns. Keeping a row costs 0 (K), giving it the role user or assistant 3 (R),
deleting it 4 (D; the only choice for blank and repeated rows), inserting an empty turn 3 (I); a truncated row
that isn't deleted costs 3 more. Of equally cheap edits the least string of initials is taken.

1. A row becomes a symbol: must be deleted, or role class and truncated or not. Rows are sorted in ranges over
   (conversation, turn), so a conversation may lie in many partitions, and written as pieces of bounded length.
2. Re-Pair: in each round the most frequent pairs over all distinct pieces become rules. A symbol is the left
   part of a round's rules, or the right part, never both, so no two replacements overlap and a
   round is one count over the pieces; frequent sequences are halved in each.
3. Every rule has one matrix over the states (nothing yet, after s, after u, after a): the least cost, and the audit
   as a rope: the two parts' entries, named by the state between them. Matrices are evaluated bottom-up
   once and shared by all conversations. Equal costs are decided by the ropes' hashes and texts.
   Two audits of the same rows and cost are never one another's prefix (they'd differ by insertions alone), so
   the least of a concatenation is the concatenation of the leasts.
4. A conversation is the product of its pieces' few symbols; its rows are then streamed beside its audit.

Defined results: null role or text counts as one space; a null turn comes first and has no part in ``gaps``; equal
turns are ordered by a digest of role and text; rows with null conv_id make one conversation of that id. Identical rows are
repeats, whatever their turn. A conversation without rows has zeros and an empty audit; an empty table no
rows. Other columns are not read. ``repaired_sha256`` is one SHA-256 over a whole conversation:
its rows pass through one task in order, as a stream (nothing of it is held but the audit).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tableaudit.llm.common import stash

#: Symbols of a piece, rules of a round, and rounds: a piece of 4,096 equal symbols is one symbol after twelve.
PIECE, ROUND_RULES, ROUNDS = 4_096, 4_096, 14
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"

# Role classes, states, and the role inserted or given on the way into a state.
S, U, A, OTHER = 0, 1, 2, 3
START, AFTER_S, AFTER_U, AFTER_A = 0, 1, 2, 3
ROLE_INTO = {AFTER_U: "user", AFTER_A: "assistant"}
#: States before a user turn and before an assistant turn.
BEFORE = {AFTER_U: (START, AFTER_S, AFTER_A), AFTER_A: (AFTER_U,)}
LEGAL = {(S, U), (U, A), (A, U)}
MUST_DELETE, TERMINALS = 0, 9
NEVER = 1 << 60
MOD, BASE = (1 << 61) - 1, 1_000_003


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults by crc32('conv_id:turn') mod 20: 0 drops the row, 1 empties
    its text, 2 removes its sentence ends, 3 repeats it, 4 makes its role user. Nulls become one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    rows = conversations.select("conv_id", "turn", F.when(k == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), k.alias("k"))
    rows = rows.where("k > 0").withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select("conv_id", "turn", "role", "text")


# Rows to pieces

def _said(conversations: DataFrame) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"))
    return rows.withColumn("said", F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256), 1, 32))


def _symbols(rows: DataFrame) -> DataFrame:
    """One narrow row for identical rows of a turn: (conv_id, turn, said, who, state, k, first)."""
    initial = F.substring("role", 1, 1)
    who = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(OTHER)
    core = F.rtrim(F.col("text"), F.lit(BLANKS))
    state = F.when(core == "", 1).when(~F.substring(core, -1, 1).isin(".", "!", "?"), 2).otherwise(0)
    same = rows.select("conv_id", "turn", "said", who.alias("who"), state.alias("state")).groupBy("conv_id", "turn", "said", "who", "state").agg(F.count("*").alias("k"))
    same = stash(same, "turns")
    firsts = same.groupBy("conv_id", "said").agg(F.bool_or(F.col("turn").isNull()).alias("none"), F.min("turn").alias("least"))
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("said").alias("s"), F.when(~F.col("none"), F.col("least")).alias("t"))
    at = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")) & F.col("turn").eqNullSafe(F.col("t"))
    # The key is unique on both sides: a passage said a billion times is one row in firsts and one a turn in same.
    return same.join(firsts, at, "left").select(*same.columns, F.col("s").isNotNull().alias("first"))


PIECES = "part int, at long, symbols binary, blank long, duplicate long, truncated long, illegal long, head int, tail int, first_turn long, last_turn long, turns long"


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("said")]


def _schema(df: DataFrame, more: str) -> StructType:
    return StructType([df.schema["conv_id"], *_parse_datatype_string(more).fields])


def _batch(schema: StructType, rows: list) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


class _Piece:
    def __init__(self):
        self.symbols = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.head = self.tail = self.first_turn = self.last_turn = None

    def add(self, turn, who: int, state: int, first: bool, k: int) -> int:
        """Take up to ``k`` identical rows; how many fitted. ``first``: nobody said the first of them before."""
        n = min(k, PIECE - len(self.symbols))
        kept = int(first and state != 1)
        self.symbols += bytes([1 + 2 * who + (state == 2)]) * kept + bytes(n - kept)
        if state == 1:
            self.blank += n
        else:
            self.duplicate += n - kept
            self.truncated += kept if state == 2 else 0
        self.illegal += n - 1 + (self.tail is not None and (self.tail, who) not in LEGAL)
        self.head, self.tail = who if self.head is None else self.head, who
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
        return n

    def row(self) -> tuple:
        return bytes(self.symbols), self.blank, self.duplicate, self.truncated, self.illegal, self.head, self.tail, self.first_turn, self.last_turn, self.turns


def _pieces(symbols: DataFrame) -> DataFrame:
    out = _schema(symbols, PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, done = TaskContext.get().partitionId(), 0, []
        piece, of = _Piece(), None
        for batch in batches:
            for conv, turn, who, state, k, first in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "who", "state", "k", "first")]):
                if conv != of and piece.symbols:
                    done.append((of, part, at, *piece.row()))
                    at, piece = at + 1, _Piece()
                of = conv
                while k:
                    n = piece.add(turn, who, state, first, k)
                    k, first = k - n, False
                    if len(piece.symbols) == PIECE:
                        done.append((of, part, at, *piece.row()))
                        at, piece = at + 1, _Piece()
            if done:
                yield _batch(out, done)
                done = []
        if piece.symbols:
            yield _batch(out, [(of, part, at, *piece.row())])

    ranged = symbols.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    return ranged.select("conv_id", "turn", "who", "state", "k", "first").mapInArrow(run, out)


# Grammar

def reduce(symbols, rounds: list[dict]) -> list[int]:
    """``symbols`` after the rounds' replacements, each from left to right."""
    seq = list(symbols)
    for rules in rounds:
        out, i = [], 0
        while i < len(seq):
            new = rules.get((seq[i], seq[i + 1])) if i + 1 < len(seq) else None
            out.append(seq[i] if new is None else new)
            i += 1 if new is None else 2
        seq = out
    return seq


def choose(pairs: list[tuple[int, int]], first: int) -> dict:
    """Rules for one round from ``pairs``, most frequent first: no symbol is left in one rule and right in another."""
    left, right, rules = set(), set(), {}
    for a, b in pairs:
        free = a not in left | right if a == b else a not in right and b not in left
        if free and (a, b) not in rules:
            rules[a, b] = first + len(rules)
            left.add(a)
            right.add(b)
    return rules


def grammar(pieces: DataFrame) -> list[dict]:
    """Rules by round, over all distinct pieces weighted by how often each occurs."""
    seqs = stash(pieces.groupBy("symbols").agg(F.count("*").alias("n")), "sequences")
    rounds: list[dict] = []
    next_symbol = TERMINALS
    while len(rounds) < ROUNDS:
        def count(batches: Iterator[pa.RecordBatch], rounds=tuple(rounds)) -> Iterator[pa.RecordBatch]:
            pairs: Counter = Counter()
            for batch in batches:
                for symbols, n in zip(batch.column("symbols").to_pylist(), batch.column("n").to_pylist()):
                    seq = reduce(symbols, rounds)
                    for pair in zip(seq, seq[1:]):
                        pairs[pair] += n
            if pairs:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "n": list(pairs.values())},
                                                 pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))

        found = seqs.mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1")
        rules = choose([(r.a, r.b) for r in found.orderBy(F.desc("n"), "a", "b").limit(ROUND_RULES).collect()], next_symbol)
        if not rules:
            break
        rounds.append(rules)
        next_symbol += len(rules)
    return rounds


class Matrices:
    """cost, rope length and rope hash of every (symbol, state before, state after), and for rules the state between the parts."""

    def __init__(self, rounds: list[dict]):
        self.parts: list = [None] * TERMINALS
        self.cost: list = []
        self.mid: list = []
        self.size: list = []
        self.code: list = []
        self.text: dict[int, bytes] = {}
        for sym in range(TERMINALS):
            self._terminal(sym)
        for rules in rounds:
            for a, b in rules:
                self._rule(a, b)

    def _put(self, entries: list[tuple]) -> None:
        self.cost += [e[0] for e in entries]
        self.size += [e[1] for e in entries]
        self.code += [e[2] for e in entries]
        self.mid += [e[3] for e in entries]

    def _terminal(self, sym: int) -> None:
        """Insertions before the row, then what is done to the row."""
        who, cut = divmod(sym - 1, 2)
        best: dict[tuple[int, int], tuple[int, str]] = {}

        def offer(p: int, q: int, cost: int, text: str) -> None:
            best[p, q] = min(best.get((p, q), (NEVER, "")), (cost, text))

        for p in range(4):
            for r, (cost, text) in INSERTS[p].items():
                offer(p, r, cost + DELETE, text + "D")
                if sym == MUST_DELETE:
                    continue
                cost += TRUNCATED * cut
                if who == S and r == START:
                    offer(p, AFTER_S, cost, text + "K")
                for q, before in BEFORE.items():
                    if r in before:
                        offer(p, q, cost + REROLE, text + "R")
                        if who == {AFTER_U: U, AFTER_A: A}[q]:
                            offer(p, q, cost, text + "K")
        entries = []
        for p in range(4):
            for q in range(4):
                cost, text = best.get((p, q), (NEVER, ""))
                code = 0
                for c in text.encode():
                    code = (code * BASE + c) % MOD
                self.text[sym * 16 + p * 4 + q] = text.encode()
                entries.append((cost, len(text), code, 0))
        self._put(entries)

    def _rule(self, a: int, b: int) -> None:
        self.parts.append((a, b))
        entries = []
        for p in range(4):
            for q in range(4):
                best, least = None, NEVER
                for r in range(4):
                    x, y = a * 16 + p * 4 + r, b * 16 + r * 4 + q
                    cost = self.cost[x] + self.cost[y]
                    if cost < least or cost == least < NEVER and self.less([x, y], best):
                        best, least, mid = [x, y], cost, r
                if best is None:
                    entries.append((NEVER, 0, 0, 0))
                else:
                    x, y = best
                    entries.append((least, self.size[x] + self.size[y], (self.code[x] * pow(BASE, self.size[y], MOD) + self.code[y]) % MOD, mid))
        self._put(entries)

    def _open(self, entry: int) -> list:
        """A rope's parts."""
        sym, p, q = entry >> 4, entry >> 2 & 3, entry & 3
        if sym < TERMINALS:
            return [self.text[entry]]
        a, b = self.parts[sym]
        r = self.mid[entry]
        return [a * 16 + p * 4 + r, b * 16 + r * 4 + q]

    def less(self, xs: list, ys: list) -> bool:
        """Is the text of the ropes ``xs`` before that of ``ys``? Equal ropes are passed over by hash."""
        xs, ys = xs[::-1], ys[::-1]
        while xs and ys:
            x, y = xs.pop(), ys.pop()
            n, m = (self.size[z] if isinstance(z, int) else len(z) for z in (x, y))
            if isinstance(x, int) and isinstance(y, int) and n == m and self.code[x] == self.code[y]:
                continue
            if isinstance(x, int) and (n >= m or not isinstance(y, int)):
                xs += self._open(x)[::-1]
                ys.append(y)
            elif isinstance(y, int):
                ys += self._open(y)[::-1]
                xs.append(x)
            else:
                k = min(n, m)
                if x[:k] != y[:k]:
                    return x[:k] < y[:k]
                xs += [x[k:]] * (n > k)
                ys += [y[k:]] * (m > k)
        return bool(ys) and not xs

    def spell(self, ropes: list) -> str:
        out, stack = [], ropes[::-1]
        while stack:
            x = stack.pop()
            if isinstance(x, int):
                stack += self._open(x)[::-1]
            else:
                out.append(x)
        return b"".join(out).decode()


#: State before -> {state after: (cost, text)} of inserted turns alone.
INSERTS = {
    START: {START: (0, ""), AFTER_U: (INSERT, "I"), AFTER_A: (2 * INSERT, "II")},
    AFTER_S: {AFTER_S: (0, ""), AFTER_U: (INSERT, "I"), AFTER_A: (2 * INSERT, "II")},
    AFTER_U: {AFTER_U: (0, ""), AFTER_A: (INSERT, "I")},
    AFTER_A: {AFTER_A: (0, ""), AFTER_U: (INSERT, "I")},
}
#: From each state to the end of a legal conversation.
ENDS = {START: (0, b""), AFTER_S: (2 * INSERT, b"II"), AFTER_U: (INSERT, b"I"), AFTER_A: (0, b"")}


class _Walk:
    """Least cost and audit of a growing conversation for each state; audits are linked lists of ropes that share their beginnings."""

    def __init__(self, matrices: Matrices):
        self.m = matrices
        self.now: dict[int, tuple[int, tuple | None]] = {START: (0, None)}

    def _before(self, x: tuple, y: tuple) -> bool:
        """Both lists have as many links: only what follows their last common one matters."""
        xs, ys = [], []
        while x is not y:
            xs.append(x[1])
            ys.append(y[1])
            x, y = x[0], y[0]
        return self.m.less(xs[::-1], ys[::-1])

    def step(self, sym: int) -> None:
        then: dict[int, tuple[int, tuple]] = {}
        for p, (so_far, links) in self.now.items():
            for q in range(4):
                cost = so_far + self.m.cost[sym * 16 + p * 4 + q]
                if cost < NEVER:
                    new = (links, sym * 16 + p * 4 + q)
                    old = then.get(q)
                    if old is None or cost < old[0] or cost == old[0] and self._before(new, old[1]):
                        then[q] = (cost, new)
        self.now = then

    def end(self) -> tuple[int, str]:
        best = None
        for p, (cost, links) in self.now.items():
            more, text = ENDS[p]
            new = (cost + more, (links, text))
            if best is None or new[0] < best[0] or new[0] == best[0] and self._before(new[1], best[1]):
                best = new
        ropes, links = [], best[1]
        while links is not None:
            ropes.append(links[1])
            links = links[0]
        return best[0], self.m.spell(ropes[::-1])


FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _facts(pieces: DataFrame, rounds: list[dict]) -> DataFrame:
    """One row a conversation: counts of faults, cost and audit."""
    out = _schema(pieces, FACTS)
    matrices = pieces.sparkSession.sparkContext.broadcast((rounds, Matrices(rounds)))
    names = [f.name for f in _parse_datatype_string(PIECES).fields[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, m = matrices.value
        short: dict[bytes, list[int]] = {}
        walk, total, tail, low, high, turns = _Walk(m), [0] * 4, None, None, None, 0
        of, begun, done = None, False, []

        def finished() -> tuple:
            cost, audit = walk.end()
            return (of, high - low + 1 - turns if turns else 0, *total, cost, audit)

        for batch in batches:
            for conv, symbols, *counts, head, last, first_turn, last_turn, n in zip(*[batch.column(c).to_pylist() for c in ("conv_id", *names)]):
                if begun and conv != of:
                    done.append(finished())
                    walk, total, tail, low, high, turns = _Walk(m), [0] * 4, None, None, None, 0
                of, begun = conv, True
                if not symbols:
                    continue
                if symbols not in short:
                    if len(short) > 50_000:
                        short.clear()
                    short[symbols] = reduce(symbols, rounds)
                for sym in short[symbols]:
                    walk.step(sym)
                total = [a + b for a, b in zip(total, counts)]
                total[3] += tail is not None and (tail, head) not in LEGAL
                tail = last
                if n:
                    turns += n - (high == first_turn)
                    low, high = first_turn if low is None else low, last_turn
            if done:
                yield _batch(out, done)
                done = []
        if begun:
            yield _batch(out, [finished()])

    order = [F.col("conv_id").asc_nulls_first(), "part", "at"]
    return pieces.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, out)


def _streamed(rows: DataFrame, facts: DataFrame, texts: bool) -> DataFrame:
    """Each conversation's facts pass before its rows: the repaired turns, or the hash of all of them."""
    beside = facts.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), *[F.lit(None).cast("string").alias(c) for c in ("said", "role", "text")], *facts.columns[1:])
    rows = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "said", "role", "text", *[F.lit(None).cast(t).alias(c) for c, t in facts.dtypes[1:]])
    every = beside.unionByName(rows).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "said")
    out = _schema(facts, "place long, edit string, role string, text string" if texts else FACTS + ", repaired_sha256 string")
    columns = [c for c, _ in facts.dtypes[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts_of, place, at, state, digest, done = None, 0, 0, START, None, []

        def take(role, text) -> None:
            """Edits up to and with the one that concerns the next row (``role`` None: what is left)."""
            nonlocal place, at, state
            audit = facts_of[-1]
            while at < len(audit):
                edit = audit[at]
                if edit != "I" and role is None:
                    raise ValueError("an audit has more edits than its conversation rows")
                at += 1
                if edit != "D":
                    if edit == "K" and state == START and role[:1] == "s":
                        state, as_role = AFTER_S, role
                    else:
                        state = AFTER_A if state == AFTER_U else AFTER_U
                        as_role = role if edit == "K" else ROLE_INTO[state]
                    said = text if edit != "I" else ""
                    if texts:
                        done.append((facts_of[0], place, edit, as_role, said))
                    else:
                        digest.update(f"{chr(10) * (place > 0)}{as_role}:{said}".encode())
                    place += 1
                if edit != "I":
                    return

        def finish() -> None:
            if facts_of is not None:
                take(None, None)
                if not texts:
                    done.append((*facts_of, digest.hexdigest()))

        for batch in batches:
            size = 0
            for conv, kind, role, text, *own in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", *columns)]):
                if kind == 0:
                    finish()
                    facts_of, place, at, state, digest = (conv, *own), 0, 0, START, hashlib.sha256()
                else:
                    take(role, text)
                    size += len(text)
                if len(done) > 5_000 or size > 4 << 20 and done:
                    yield _batch(out, done)
                    done, size = [], 0
            if done:
                yield _batch(out, done)
                done = []
        finish()
        if done:
            yield _batch(out, done)

    return every.mapInArrow(run, out)


def _solved(conversations: DataFrame, everyone: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    rows = _said(conversations)
    pieces = stash(_pieces(_symbols(rows)), "pieces")
    rounds = grammar(pieces)
    everyone = (conversations if everyone is None else everyone).select("conv_id").distinct()
    none = [F.lit(b"") if f.name == "symbols" else F.lit(None).cast(f.dataType) for f in pieces.schema.fields[1:]]
    empty = everyone.select("conv_id", *[c.alias(n) for c, n in zip(none, pieces.columns[1:])])
    return rows, _facts(pieces.unionByName(empty), rounds)


def repair_report(conversations: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """One row a conversation of ``everyone`` (default: those with rows): conv_id, gaps (turn numbers missing between the first
    and the last), blank, duplicate, truncated (each row's first fault), illegal (neighbours whose initials aren't su, ua or
    au), cost, audit, repaired_sha256 of the repaired ``role:text`` lines."""
    return _streamed(*_solved(conversations, everyone), texts=False)


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), edit (K, R or I), role, text."""
    return _streamed(*_solved(conversations, None), texts=True)
