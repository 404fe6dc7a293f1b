"""Prefix trie and its rollup by centroid decomposition, against a dictionary of prefixes."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableaudit.llm import prefixtrie as P
from tableaudit.llm import queries as LQ

CONV = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows, shared=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(said[0])}:{said[0]}{said[1]}".encode()).hexdigest()), said))
    own = {c: [said for _, said in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if shared else 0
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(built):
        turns = tuple(built[c])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                kids[turns[: d - 1]].add(turns[:d])
        ends[turns].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    return sorted(((members[x][0], len(x), members[x[:-1]][0] if x else None, len(members[x]), len(kids[x]), leaves[x], saved[x],
                    hashlib.sha256(",".join(map(str, ends[x])).encode()).hexdigest()) for x in members), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=80), st.integers(1, 4))
def test_centroids_sum_every_subtree(draws, n_trees):
    """Random forests, chains and stars among them."""
    parent = np.array([-1 if i < n_trees else [i - 1, n_trees - 1, d % i][d % 3] for i, d in enumerate(draws)])
    n = len(parent)
    top, depth, mass = np.arange(n), np.full(n, 7), np.ones(n, np.int64)
    for i in range(n):
        if parent[i] >= 0:
            top[i], depth[i] = top[parent[i]], depth[parent[i]] + 1
    weights = np.array([[d % 5, d % 1_000] for d in draws])
    want = weights.copy()
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            mass[parent[i]] += mass[i]
            want[parent[i]] += want[i]
    assert (P.split_all(top, parent, depth, mass, weights) == want).all()


def odd_rows():
    rows = [(c, t, ["user", None, ""][c % 3 * (t % 2)], [None, "", "a b\tc", "d" * 50_000][(c * t) % 4]) for c in range(45) for t in range(c % 6)]
    rows += [(20, None, "user", "first"), (None, 0, "user", "nobody's"), (41, 0, "user", "x"), (41, 0, "user", "x"), (100, 0, "u", "lone"), (101, 0, "u", "lone"), (-3, 1, "u", "neg"), (10**15, 0, "u", "far")]
    return rows + [(60, t, "user", f"w{t % 3} w") for t in range(300)]


@pytest.mark.parametrize("limit", [1, 40, 4_096])
def test_odd_rows_with_components_of_any_size(spark, limit):
    df = spark.createDataFrame(odd_rows(), CONV).repartition(6).withColumns({c: F.lit("x") for c in ("place", "node", "comp", "words", "a.b `c`")})
    assert rows_of(P.prefix_trie(P.rebuild(df), limit)) == plain_trie(odd_rows())


def test_one_conversation_and_one_first_turn_of_a_third_of_all_rows(spark):
    rows = [(0, t, "user", f"t{t}") for t in range(400)] + [(1 + i, 0, "user", "hello") for i in range(400)] + [(1 + i, 1, "assistant", f"answer {i % 90}") for i in range(0, 400)]
    got = rows_of(P.prefix_trie(P.plain(spark.createDataFrame(rows, CONV).repartition(4)), limit=100))
    assert got == plain_trie(rows, shared=False)


def test_turnless_conversations_belong_to_the_root(spark):
    """Conversation 22's two turns are its first three, and there is no conversation 20 to begin with."""
    assert zlib.crc32(b"22") % 4 >= 2
    rows = [(22, 0, "user", "a"), (22, 1, "user", "b")]
    assert rows_of(P.prefix_trie(P.rebuild(spark.createDataFrame(rows, CONV)))) == plain_trie(rows) == [(22, 0, None, 1, 0, 1, 0, hashlib.sha256(b"22").hexdigest())]


def test_ids_of_a_node_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "IDS_A_PIECE", 7)
    rows = [(i, 0, "user", "same") for i in range(500)]
    got = rows_of(P.prefix_trie(P.plain(spark.createDataFrame(rows, CONV).repartition(5))))
    assert got == plain_trie(rows, shared=False)


def test_empty_table(spark):
    assert P.prefix_trie(P.rebuild(spark.createDataFrame([], CONV))).collect() == []


def test_query_on_the_smallest_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(LQ.op11_prefix_trie(spark, "/root/testdata/sf0.001")) == plain_trie(rows)
