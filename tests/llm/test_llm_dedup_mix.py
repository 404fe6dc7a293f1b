"""Quality classifier, SimHash groups, decontamination, mixing, token files and the pipeline."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableaudit.llm import decontaminate as D
from tableaudit.llm import mixing as M
from tableaudit.llm import orcstore as O
from tableaudit.llm import quality as Q
from tableaudit.llm import queries as LQ
from tableaudit.llm import simhash as S
from tableaudit.llm.common import ROW_KEY, row_key

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   \n\t", "one", "a b", "a b", "É x 　y", "x" * 50_000, "w " * 30_000, "Ab aB AB ab cd EF gh ij kl mn"]


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"fp": F.lit(7), "all": F.lit("x"), "row": F.lit("r"), "h": F.lit(None).cast("string"), "score": F.lit(0.5), "a.b `c`": F.lit(1)}) if extra else df


def odd_rows():
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 1) for i, t in enumerate(ODD)]
    return rows + [rows[4], (None, "no id", None, None, None), (None, None, None, "s1", None)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# SimHash

def plain_simhash(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    bits = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbZé \t\n\x0b\x1f .", max_size=80), st.integers(1, 5))
def test_simhash_of_a_text(text, k):
    assert S.simhash(text.encode(), k) == plain_simhash(text, k)


def groups_by_force(fps, distance):
    out = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= distance:
                    out[i] = out[j] = min(out[i], out[j])
    return out


@pytest.mark.parametrize("distance,most", [(4, 1 << 22), (4, 3000), (3, 2000), (0, 1 << 22), (1, 1 << 22)])
def test_links_connect_what_all_pairs_would(spark, monkeypatch, distance, most):
    monkeypatch.setattr(S, "MOST_VARIANTS", most)  # small: dense prefixes are split
    rng = np.random.default_rng(3)
    fps = []
    for centre in rng.integers(0, 1 << 63, 6).tolist():
        for _ in range(9):
            fps.append(centre := centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    fps = sorted(set(fps) | {0, 1, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    tree = {r.node: r.root for r in S.components(S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance)).collect()}
    roots = [tree.get(x, x) for x in signed]
    want = groups_by_force(fps, distance)
    assert len(set(zip(roots, want))) == len(set(roots)) == len(set(want))


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (7, 6)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}}


def test_simhash_groups_on_documents(spark, documents):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in LQ.op4_simhash_near_dedup(spark, SF).collect()}
    rows = documents.select("doc_id", "text").collect()
    fps = {r.doc_id: plain_simhash(r.text, 4) for r in rows}
    assert {d: f"{f:016x}" for d, f in fps.items()} == {d: f for d, (f, _) in got.items()}
    ids = sorted(fps)
    group = dict.fromkeys(ids)
    for d in ids:
        group[d] = d
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if group[a] > group[b] and (fps[a] ^ fps[b]).bit_count() <= 4:
                    group[a], changed = group[b], True
    assert group == {d: c for d, (_, c) in got.items()}


def test_simhash_odd_rows(spark):
    df = frame(spark, odd_rows(), extra=True)
    got = S.near_duplicates(df).collect()
    assert len(got) == len(odd_rows())
    zero = {r.component_id for r in got if r.fp == 0}
    assert zero == {0}  # null, empty and blank texts, one without doc_id
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert len(rows) == len({r.root for r in got})
    assert sorted(r.doc_id for r in rows if r.doc_id is not None)[:2] == [0, 3]
    empty = frame(spark, [], extra=True)
    assert S.near_duplicates(empty).count() == 0 and S.keep_one(empty).count() == 0


# Quality

def test_quality_on_held_out_rows(spark):
    got = LQ.op3_quality_classifier(spark, "/root/testdata/sf0.01")
    both = got.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (both.held_out == both.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    assert ((both.score >= 0.3).astype(int) == both.predicted).all()
    assert (both.predicted == both.quality).mean() > 0.95


def test_quality_odd_rows(spark):
    df = frame(spark, odd_rows(), extra=True)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(None, 1, 0), (3, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = Q.score(df, labels)
    rows = got.collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in rows]
    assert Q.accept(df, labels).columns == df.columns
    none = labels.filter("false")
    assert {r.predicted for r in Q.score(df, none).collect()} == {1}
    assert Q.score(frame(spark, []), none).count() == 0 and Q.accept(frame(spark, []), labels).count() == 0


def plain_buckets(text, p):
    """Bucket numbers of a text, byte by byte."""
    mod, prime = 1 << 64, 0x100000001B3

    def bucket(h, kind):
        h = (h + kind) * 0x9E3779B97F4A7C15 % mod
        h ^= h >> 29
        return h * 0xBF58476D1CE4E5B9 % mod >> 64 - (p.buckets.bit_length() - 1)

    out = Counter()
    for n in p.grams:
        for i in range(len(text) - n + 1):
            h = 0
            for byte in text[i:i + n]:
                h = (h * prime + byte) % mod
            out[bucket(h, n)] += 1
    words, before, read = re.findall(rb"[^\x20\x09-\x0D]+", text), None, []
    for w in words:
        h = (sum((c + 1) * pow(prime, i, mod) for i, c in enumerate(w)) + len(w)) % mod
        read.append(1 if h == before else h)
        before = h
    out.update(bucket(h, 101) for h in read)
    out.update(bucket((x * prime + y) % mod, 102) for x, y in zip(read, read[1:]))
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé \n", max_size=60), st.sampled_from([3, 7, 1 << 20]))
def test_quality_grams_are_the_same_in_chunks_of_any_size(text, chunk):
    before = Q.CHUNK
    try:
        Q.CHUNK = chunk
        p = Q.Params()
        ids, counts = Q.bag(text.encode(), Q.Hasher(p))
    finally:
        Q.CHUNK = before
    assert dict(zip(ids.tolist(), counts.tolist())) == dict(plain_buckets(text.encode(), p))


def test_quality_score_is_the_mean_of_the_learned_numbers():
    p = Q.Params()
    w = np.random.default_rng(3).normal(size=p.buckets).astype(np.float32)
    for text in (b"", b"a", b"one two two  three", "é ü\n".encode() * 50, b"x" * 2_000):
        got = plain_buckets(text, p)
        mean = sum(float(w[b]) * n for b, n in got.items()) / max(1, sum(got.values()))
        assert Q.score_text(text, Q.Hasher(p), w, 0.25) == pytest.approx(1 / (1 + np.exp(-mean - 0.25)), abs=1e-6)


def test_quality_training_follows_the_gradient():
    """One step on one document moves its own log odds towards its label, by the same step whatever its length."""
    p = Q.Params(epochs=1, batch=1, buckets=1 << 10)
    for text in (b"a b c d", b"a b c d " * 400):
        bag = Q.bag(text, Q.Hasher(p))
        odds = []
        for label in (0, 1):
            w, b = Q.train([bag] * 30, np.full(30, label), p)
            odds.append(float((w[bag[0]] * bag[1]).sum() / bag[1].sum()) + b)
        assert odds[0] < -0.5 and odds[1] > 0.5


def test_quality_sends_one_bag_a_document(spark):
    """Thousands of rows of one doc_id are one sample, and a small share of very many labels still picks rows."""
    rows = [(1, f"good words number {i}", "en", "s", 1) for i in range(3_000)] + [(i, f"bad {i} text", "en", "s", 1) for i in range(2, 60)]
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 60)], "doc_id long, quality int")
    seen = []
    real = Q.train
    try:
        Q.train = lambda bags, y, p: seen.append((len(bags), int(y.sum()))) or real(bags, y, p)
        Q.fit(frame(spark, rows), labels)
    finally:
        Q.train = real
    wanted = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5]
    assert seen == [(len(wanted), int(1 in wanted))]


# Decontamination

def overlaps_by_force(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    wins = {}
    for item, text in items:
        w = split(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = split(text)
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i:i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[k]
        out.append((doc, len(w), len(hit), ",".join(sorted(found))))
    return out


@settings(max_examples=25, deadline=None)
@given(st.data())
def test_suffix_array_search(data):
    word = st.sampled_from(["a", "b", "C", "é"])
    items = [(i, " ".join(data.draw(st.lists(word, max_size=14)))) for i in range(3)]
    docs = [(i, ", ".join(data.draw(st.lists(word, max_size=40)))) for i in range(4)]
    tests = D.prepare([(str(i), t.encode()) for i, t in items], 4)
    counts, hit, found, longest = D._find([t.encode() for _, t in docs], [tests], 4)
    want = overlaps_by_force(docs, items, 4)
    assert [(d, c, h, ",".join(sorted(found.get(i, ())))) for i, ((d, _), c, h) in enumerate(zip(docs, counts, hit))] == want
    assert all(x >= 1 for x, h in zip(longest, hit) if h)


def test_long_documents_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(D, "SHARD_WORDS", 16)
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(rng.choice(["a", "b", "c"], n))) for i, n in enumerate([100, 3, 0, 57, 16])]
    items = [(9, " ".join(rng.choice(["a", "b", "c"], 30))), (10, "a b"), (11, "")]
    tests = D.prepare([(str(i), t.encode()) for i, t in items], 5)
    counts, hit, found, _ = D._find([t.encode() for _, t in docs], [tests], 5)
    assert [(d, c, h, ",".join(sorted(found.get(i, ())))) for i, ((d, _), c, h) in enumerate(zip(docs, counts, hit))] == overlaps_by_force(docs, items, 5)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 3, 200)
    order = D.suffix_array(text, 1 << 30)
    assert [tuple(text[i:]) for i in order] == sorted(tuple(text[i:]) for i in range(len(text)))


def test_decontamination_odd_rows(spark):
    df = frame(spark, odd_rows(), extra=True)
    items = spark.createDataFrame([(1, "AB ab ab, AB cd"), (1, "AB ab ab, AB cd"), (2, None), (3, ""), (None, "one"), (4, "one")], "item_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in D.overlaps(df, items).collect()}
    assert (9, 10, 5, 1) in got and (3, 1, 1, 1) in got and (0, 0, 0, 0) in got and (8, 30000, 0, 0) in got
    assert {r.doc_id for r in D.clean(df, items).collect()}.isdisjoint({3, 9})
    assert D.clean(df, items).columns == df.columns
    assert D.clean(df, items.filter("false")).count() == df.count()
    assert D.overlaps(frame(spark, []), items).count() == 0


def test_row_keys_tell_nulls_and_columns_apart(spark):
    rows = [(None, ""), ("", None), (None, None), ("", ""), ("a", "b"), ("ab", ""), ("", "ab")]
    keys = spark.createDataFrame([*rows, *rows], "x string, y string").select(row_key(F.col("x"), F.col("y")).alias("k"))
    assert keys.distinct().count() == len(rows) and keys.schema["k"].dataType.simpleString() == ROW_KEY
    assert keys.filter("k.a = k.b").isEmpty()


def test_benchmark_blocks_are_broadcast_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(rng.choice(["a", "b", "c", "d"], n))
    docs = [(i, text(60)) for i in range(12)] + [(50, ""), (51, "e f g")]
    items = [(i, text(12)) for i in range(9)] + [(20, "e f")]
    sent, put = [], spark.sparkContext.broadcast
    monkeypatch.setattr(D, "BLOCK_BYTES", 60)
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or put(value))
    df, tests = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(d, c, h, hashlib.sha256(found.encode()).hexdigest()) for d, c, h, found in overlaps_by_force(docs, items, 5)}
    got = D.overlaps(df, tests, 5).collect()
    assert len(got) == len(docs) + 1 and {(r.doc_id, r.n_words, r.n_hit, r.items_sha256) for r in got} == want
    assert {r.doc_id for r in D.clean(df, tests, 5).collect()} == {d for d, _, h, _ in want if not h}
    for r, text in ((r, dict(docs)[r.doc_id].split()) for r in got):
        runs = [text[p.at:p.at + p.words] for p in r.places]
        assert sum(map(len, runs)) == r.n_hit and [p.at for p in r.places] == sorted(p.at for p in r.places)
        assert all(overlaps_by_force([(0, " ".join(run))], items, 5)[0][2] == len(run) for run in runs)
    assert len(sent) > 4 and all(isinstance(x, D.Suffixes) for x in sent)
    assert max(len(x.names) for x in sent) < len(items)


# Mixing

def check_mix(rows, cycle=(1, 2, 3)):
    """Sums near targets, and targets as the contract says."""
    size, target, taken = Counter(), {}, Counter()
    for r in rows:
        size[r.source] += r.size
        target[r.source] = r.target
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rate = (total - sum(3 * size[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        new = {s for s in free if 3 * size[s] < weight[s] * rate}
        if not new:
            break
        capped |= new
    for s in order:
        want = 3 * size[s] if s in capped else weight[s] * rate
        assert abs(target[s] - want) <= 1e-6 * max(1, want)
        most = max([r.size for r in rows if r.source == s])
        assert abs(taken[s] - want) <= most / 2 + 1e-6


def test_mix_of_documents(spark, documents):
    got = M.mix_report(documents).join(documents.select("doc_id", "source"), "doc_id").collect()
    assert len(got) == documents.count()
    check_mix(got)


def test_mix_odd_rows(spark):
    df = frame(spark, odd_rows() + [(50, "tie tie", "en", "t", 1)] * 40, extra=True)
    once = sorted(map(str, M.mix_report(df).collect()))
    assert once == sorted(map(str, M.mix_report(df).collect())) and len(once) == df.count()
    rows = M.mix(df)
    assert rows.columns == df.columns
    taken = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows.collect() if r.source == "t")
    report = [r for r in M.mix_report(df).collect() if r.doc_id == 50]
    assert taken == sum(r.taken for r in report) and abs(taken - report[0].target) <= 1
    assert M.mix_report(frame(spark, [])).count() == 0 and M.mix(frame(spark, [])).count() == 0
    blank = frame(spark, [(1, None, None, None, 0), (2, " ", None, "a", 1)])
    assert {(r.target, r.taken) for r in M.mix_report(blank).collect()} == {(0.0, 0)}


def test_thresholds_are_nested(spark, documents):
    rows = documents.select("source", M.words(F.col("text")).alias("size"), M.rank(F.col("doc_id"), F.col("text")).alias("h"))
    low = {r.source: (r.copies, r.edge or 0) for r in M.thresholds(rows, (1, 2)).collect()}
    assert low and all(c <= 3 and 0 <= e < 1 << 60 for c, e in low.values())


# Token files

@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(O.TOKENIZER))


ENCODER = O.Encoder(O.TOKENIZER)


@pytest.mark.parametrize("file,fast", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_any_tokenizer_file_gives_its_own_ids(spark, file, fast):
    import pyarrow as pa

    coder = O.Encoder(file)
    assert coder.fast == fast
    texts = ["", "Hello  World's 42 tests\n", "É <|endoftext|> x", "naïve 　wide \t", *(t or "" for t in ODD[:9])]
    ids, size = coder.ids(pa.array(texts), 7)
    want = [[*coder.tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and size.tolist() == [len(w) for w in want]
    rows = O.round_trip(frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]), tokenizer=file).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [len(coder.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts]


def test_a_lookup_skips_files_and_stripes(spark, tmp_path):
    """Of 20,000 documents in files of many row groups, a search for two ids reads a few groups' rows."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    path = O.write(docs.coalesce(1), str(tmp_path / "ids"))
    assert sorted(r.doc_id for r in O.read(spark, path, [5, 17_003]).collect()) == [5, 17_003]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan that runs can be asked for its scan
        run = spark.read.orc(path).filter(F.col("doc_id").isin([5, 17_003]))._jdf.queryExecution()
        assert "In(doc_id" in run.toString()
        plan = run.executedPlan()
        plan.executeCollect()
        leaves = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(plan.collectLeaves())
        scanned = sum(n.metrics().apply("numOutputRows").value() for n in leaves)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert 2 <= scanned <= 2 * 1_000
ODD_TEXT = st.text(max_size=60) | st.text(alphabet="aA's' \n\t\u0301é\u00a0\u3000\x1c\x85<|endoftext>İß1²×", max_size=40)


def encoded(encoder, texts):
    import pyarrow as pa

    ids, n = encoder.ids(pa.array(texts, pa.string()), 1)
    return [x.tolist() for x in np.split(ids, np.cumsum(n))[:-1]]


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD_TEXT, max_size=4))
def test_ids_by_word_are_those_of_the_text(model, texts):
    assert encoded(ENCODER, texts) == [model.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_words_may_be_forgotten(model, monkeypatch):
    monkeypatch.setattr(O, "REMEMBERED", 5)
    text = "Hello there, it's  1234 \n\nworld'll Ünï-cödé <|endoftext|> " * 20 + "x" * 30
    encoder = O.Encoder(O.TOKENIZER)
    for _ in range(3):
        assert encoded(encoder, [text, "", "there"]) == [model.encode(t, add_special_tokens=False).ids + [1] for t in (text, "", "there")]


def test_token_files_round_trip(spark, documents, model):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in O.round_trip(documents).collect()}
    start = 0
    for r in documents.orderBy("doc_id").collect():
        ids = np.array(model.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        assert got[r.doc_id] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_by_id_and_order(spark, documents, tmp_path):
    import glob

    import pyarrow.orc as po

    path = O.write(documents, f"file://{tmp_path}/orc")
    files = sorted(glob.glob(f"{tmp_path}/orc/*.orc"))
    ids = [x for f in files for x in po.ORCFile(f).read(columns=["doc_id"]).column(0).to_pylist()]
    assert ids == sorted(ids) and len(ids) == documents.count()
    some = O.read(spark, path, [ids[3], ids[100]]).collect()
    whole = {r.doc_id: (r.start, r.ids) for r in O.read(spark, path).collect()}
    assert {r.doc_id: (r.start, r.ids) for r in some} == {i: whole[i] for i in (ids[3], ids[100])}


def test_token_files_odd_rows(spark):
    got = O.round_trip(frame(spark, odd_rows(), extra=True)).collect()
    assert len(got) == len(odd_rows())
    assert min(r.n_tokens for r in got) == 1 and sorted(r.start for r in got)[0] == 0
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert O.round_trip(frame(spark, [])).count() == 0


# SQL and pipeline

@pytest.mark.parametrize("name", sorted(LQ.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(LQ.SQL[name]).fetchall()
    names = [d[0] for d in con.description]
    got = LQ.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*names).collect())


def test_pipeline_stages(spark, documents, model):
    import corpus_pipeline as P

    assert [len(P.STAGES), P.STAGES[0][0]] == [5, "quality classifier"]
    docs, seen = documents, []
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == documents.columns
        seen.append({r.doc_id for r in docs.collect()})
    scores = {r.doc_id: r.predicted for r in Q.score(documents, labels).collect()}
    assert seen[0] == {d for d, p in scores.items() if p}
    kept = documents.filter(F.col("doc_id").isin(list(seen[0])))
    assert seen[1] == {r.component_id for r in S.near_duplicates(kept).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [(r.doc_id, r.text) for r in documents.filter(F.col("doc_id").isin(list(seen[1]))).collect()]
    assert seen[2] == {d for d, _, h, _ in overlaps_by_force(texts, items) if not h}
    left = documents.filter(F.col("doc_id").isin(list(seen[2])))
    takes = {r.doc_id: r.taken // r.size for r in M.mix_report(left).filter("size > 0").collect()}
    assert Counter(r.doc_id for r in docs.collect() if takes.get(r.doc_id)) == Counter({d: n for d, n in takes.items() if n})
    assert seen[3] - set(takes) <= seen[2] and not any(n == 0 and d in seen[3] for d, n in takes.items())
    last = P.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in docs.collect())
    assert P.run(spark, SF).count() == len(last)


def test_pipeline_of_odd_and_of_no_documents(spark, tmp_path):
    """Nulls, repeated rows, clashing names and empty tables go through all stages; of what a run stashed only its result is left."""
    import os

    import corpus_pipeline as P

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for label, rows in (("odd", odd_rows() * 2), ("none", [])):
        path = str(tmp_path / label)
        frame(spark, rows, extra=True).write.parquet(f"{path}/documents.parquet")
        (labels if rows else labels.limit(0)).write.parquet(f"{path}/labels.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
        before = set(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")))
        got = P.run(spark, path)
        assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        kept = got.collect()
        assert len(kept) <= len(rows) and (not rows or kept)
        new = set(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:"))) - before
        assert [n for n in new if "-" in n and not n.startswith("rdd-")] == [n for n in new if n.startswith("token-ID") or n.startswith("token")]
