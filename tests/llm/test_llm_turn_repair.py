"""Conversation repair by grammar-compressed dynamic programming, against a plain search."""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableaudit.llm import queries as LQ
from tableaudit.llm import turnrepair as T

CONV = "conv_id long, turn long, role string, text string"
LETTERS = "sua?"


def plain_repair(rows):
    """Least (cost, audit, repaired) for rows (initial, must, truncated, role, text): every edit tried at every row."""
    @functools.lru_cache(None)
    def best(i, state):
        found = [row_next(i, state)]
        for many in ("u", "a", "ua", "au"):  # more insertions in a row can't pay
            if all(step in OK for step in zip((state, *many), many)):
                cost, audit, said = row_next(i, many[-1])
                found.append((cost + 3 * len(many), "I" * len(many) + audit, tuple((NAMES[t], "") for t in many) + said))
        return min(found)

    @functools.lru_cache(None)
    def row_next(i, state):
        if i == len(rows):
            return (0, "", ()) if state in ("", "a") else (1 << 40, "", ())
        initial, must, cut, role, text = rows[i]
        cost, audit, said = best(i + 1, state)
        found = [(cost + 4, "D" + audit, said)]
        for target in "" if must else "sua":
            if (state, target) in OK:
                cost, audit, said = best(i + 1, target)
                if target == initial:
                    found.append((cost + 3 * cut, "K" + audit, ((role, text),) + said))
                if target != "s":
                    found.append((cost + 3 + 3 * cut, "R" + audit, ((NAMES[target], text),) + said))
        return min(found)

    return best(0, "")


NAMES = {"u": "user", "a": "assistant"}
OK = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def plain_report(rows, everyone):
    """The contract, conversation by conversation."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv in everyone:
        key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()[:32])
        got, seen, marked, counts = sorted(by[conv], key=key), set(), [], [0, 0, 0, 0]
        for i, (turn, role, text) in enumerate(got):
            core = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not core else 1 if (role, text) in seen else 2 if core[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            counts[3] += i > 0 and got[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
            marked.append((role[:1] if role[:1] in "sua" else "", fault in (0, 1), fault == 2, role, text))
        turns = {t for t, _, _ in got if t is not None}
        cost, audit, said = plain_repair(tuple(marked))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()))
    return sorted(out, key=str)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SYMBOLS = st.lists(st.integers(0, T.TERMINALS - 1), max_size=9)


@settings(max_examples=150, deadline=None)
@given(SYMBOLS, st.lists(SYMBOLS, max_size=6), st.integers(0, 3))
def test_matrices_of_rules_find_the_least_audit(symbols, others, n_rounds):
    rounds, nxt = [], T.TERMINALS
    for _ in range(n_rounds):
        seqs = [T.reduce(s, rounds) for s in [symbols, *others]]
        rules = T.choose([p for s in seqs for p in zip(s, s[1:])], nxt)
        rounds.append(rules)
        nxt += len(rules)
    walk = T._Walk(T.Matrices(rounds))
    for sym in T.reduce(symbols, rounds):
        walk.step(sym)
    plain = tuple(("sua"[(s - 1) // 2] if 0 < s < 7 else "", s == 0, s > 0 and (s - 1) % 2 == 1, "", "") for s in symbols)
    assert walk.end() == plain_repair(plain)[:2]


def test_a_long_run_is_a_few_symbols():
    rounds, nxt = [], T.TERMINALS
    seq = [3, 5] * 2_048  # kept user and assistant turns
    while len(T.reduce(seq, rounds)) > 1:
        s = T.reduce(seq, rounds)
        rounds.append(T.choose(list(zip(s, s[1:])), nxt))
        nxt += len(rounds[-1])
    assert len(rounds) == 12
    walk = T._Walk(T.Matrices(rounds))
    for sym in T.reduce(seq + [3], rounds):
        walk.step(sym)
    assert walk.end() == (3, "K" * 4_097 + "I")


def odd_rows():
    rows = [
        (1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello!"), (1, 5, "user", "Bye"),
        (2, None, "assistant", "First?"), (2, 0, "user", "   \n"), (2, 0, "tool", "x."), (2, 0, "tool", "x."), (2, 3, "tool", "x."),
        (3, 0, None, None), (3, 1, "", "no role."), (4, None, None, "only."), (None, 1, "user", "No conversation."), (None, None, "assistant", "None!"),
        (5, 0, "user", "w" * 200_000 + "."), (5, 1, "user", "w" * 200_000), (6, 7, "ünser", "é"), (6, 7, "ünser", "é"),
    ]
    return rows + [rows[1], rows[1]] + [(7, i % 9, LETTERS[i % 4], f"t{i % 5}" + ".!"[i % 2]) for i in range(60)]


def test_odd_rows_against_the_plain_search(spark):
    rows = odd_rows()
    everyone = [1, 2, 3, 4, 5, 6, 7, 8, None]
    df = spark.createDataFrame(rows, CONV).repartition(5).withColumns({c: F.lit("x") for c in ("said", "who", "k", "kind", "part", "cost", "a.b `c`")})
    ids = spark.createDataFrame([(i,) for i in everyone], "conv_id long")
    assert rows_of(T.repair_report(df, ids)) == plain_report(rows, everyone)
    turns = T.repair(df).where("conv_id = 1").orderBy("place").collect()
    assert [(r.edit, r.role, r.text) for r in turns][:3] == [("K", "system", "Be brief."), ("K", "user", "Hi."), ("K", "assistant", "Hello!")]
    damaged = T.damage(df)
    assert sorted(map(str, rows_of(damaged))) == sorted(str(r) for r in plain_damage(rows))


def test_pieces_and_ranges_dont_matter(spark, monkeypatch):
    rows = [(i % 3, i // 3, ["user", "assistant", "system"][i * i % 3], f"word {i % 17}" + "." * (i % 4 > 0)) for i in range(300)]
    df = spark.createDataFrame(rows, CONV)
    want = rows_of(T.repair_report(df))
    monkeypatch.setattr(T, "PIECE", 7)
    monkeypatch.setattr(T, "ROUNDS", 2)
    assert rows_of(T.repair_report(df.repartition(11))) == want
    assert [r[0] for r in want] == [0, 1, 2]


def test_a_passage_repeated_in_one_turn(spark):
    """A third of the rows are copies of one row: merged before they are shuffled, all deleted but the first."""
    rows = [(0, 1, "user", "Same.")] * 5_000 + [(0, 2, "assistant", "Yes.")]
    got = rows_of(T.repair_report(spark.createDataFrame(rows, CONV)))
    assert got[0][2:8] == (0, 4_999, 0, 4_999, 4 * 4_999, "K" + "D" * 4_999 + "K")


def test_empty_table(spark):
    df = spark.createDataFrame([], CONV)
    assert T.repair_report(df).collect() == [] and T.repair(df).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_the_plain_search(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(LQ.op12_turn_repair(spark, f"/root/testdata/{sf}")) == plain_report(plain_damage(rows), sorted({r[0] for r in rows}))
