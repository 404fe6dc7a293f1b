"""Exact duplicates by radix tries, against grouping in plain Python."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableaudit.llm import exactdup as X
from tableaudit.llm import queries as LQ

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(c % 3 for c in b)), max_size=60), st.sampled_from([300, 2_000, 10**9]))
def test_trie_counts_every_string_with_any_budget(strings, budget):
    trie = X.Trie(lambda a, b: a + b, budget, spills=True)
    for s in strings:
        trie.add(s, 1)
    got = list(trie.items())
    want = defaultdict(int)
    for s in strings:
        want[s] += 1
    assert sorted(got) == sorted(want.items())


def test_a_small_budget_spills_and_long_prefixes_split_once():
    trie = X.Trie(lambda a, b: a + b, 5_000, spills=True)
    long = b"x" * 200_000
    for tail in (b"", b"a", b"b", b"ab", b"a"):
        trie.add(long + tail, 1)
    for i in range(200):
        trie.add(b"%03d" % (i % 150), 1)
    assert trie.spilled
    got = dict(trie.items())
    assert got[long + b"a"] == 2 and got[long] == 1 and got[b"001"] == 2 and got[b"149"] == 1 and len(got) == 154


def by_force(rows, largest=True):
    groups = defaultdict(list)
    for i, (doc_id, text, *_) in enumerate(rows):
        groups[bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())].append((doc_id, i))
    out = []
    for low, members in groups.items():
        ids = [d for d, _ in members if d is not None]
        keep = (max(ids) if largest else min(ids)) if ids else None
        once = True
        for d, _ in members:
            out.append((d, keep, len(members), once and d == keep, hashlib.sha256(low).hexdigest()))
            once = once and d != keep
    return sorted(out, key=str)


TEXTS = [None, "", "  ", "Ab", "aB", "ab", "É", "é", "\u212a", "k", "z" * 100_000, "Z" * 100_000, "z" * 99_999 + "y"]


def odd_rows():
    rows = [(i, t, "en", None if i % 3 else "s", 1) for i, t in enumerate(TEXTS)]
    return rows + [rows[5], rows[5], (None, "ab", None, None, None), (None, "only", None, None, None), (None, "only", "x", None, None)]


@pytest.mark.parametrize("held", [X.HELD_BYTES, 1_000])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_nulls_ties_repeats_and_long_texts(spark, keep, held):
    docs = spark.createDataFrame(odd_rows(), DOCS).repartition(3)
    docs = docs.withColumns({c: F.lit("x") for c in ("row", "task", "number", "size", "keep_id", "a.b `c`")})
    got = sorted((tuple(r) for r in X.exact_duplicates(docs, keep, held).collect()), key=str)
    assert got == by_force(odd_rows(), keep == "largest")
    kept = X.unique(docs, keep, held)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r[3] for r in got) == 10


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert X.exact_duplicates(docs).collect() == [] and X.unique(docs).collect() == []


def test_one_group_of_a_third_of_all_rows(spark):
    rows = [(i, "Copy" if i % 3 == 0 else f"text {i // 2}", None, None, None) for i in range(3_000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    assert sorted((tuple(r) for r in X.exact_duplicates(docs).collect()), key=str) == by_force(rows)


def test_query_on_the_smallest_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in LQ.op13_exact_dedup(spark, "/root/testdata/sf0.001").collect()), key=str) == by_force(rows)
