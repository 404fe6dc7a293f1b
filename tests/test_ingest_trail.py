"""Ingest, sinks, audit trail, conversations, stream rules, shared statistics."""

from __future__ import annotations

import datetime as dt
import os
import random

import numpy as np
import pytest

from tableaudit.functions import stats as S
from tableaudit.operators import clean as CL
from tableaudit.operators import conversations as CV
from tableaudit.operators import detect as D
from tableaudit.operators import trail as TR
from tableaudit.sources import ingest as IN
from tableaudit.sources import sinks as SK
from tableaudit.streaming import rules as SR
from pyspark.sql import functions as F


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(4)
    vals = [round(rnd.gauss(0, 10), 1) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(8)
    got = S.quantiles(df, {"v": F.col("v")}, (0.1, 0.25, 0.5, 0.75, 0.9))["v"]
    assert got == pytest.approx(list(np.quantile(vals, [0.1, 0.25, 0.5, 0.75, 0.9])), abs=1e-9)


def test_moments_adjusted_like_pandas(spark):
    import pandas as pd
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, 11.0, 50.0]
    n, num, _ = S.moments(spark.createDataFrame([(v,) for v in vals], "v double"), {"v": F.col("v")})
    s = pd.Series(vals)
    assert num["v"].skew == pytest.approx(s.skew()) and num["v"].kurt == pytest.approx(s.kurtosis())


def test_read_csv_latin1_fallback(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "t.csv")
    with open(p, "wb") as f:
        f.write("name,age\nJos\xe9,30\nAna,\n".encode("latin-1"))
    df, enc = IN.read_table(spark, p)
    assert enc == "latin-1" and df.first()["name"] == "José"
    typed = IN.infer_types(df)
    assert dict(typed.dtypes)["age"] == "bigint"


def test_infer_types_keeps_text_dates(spark):
    df = spark.createDataFrame([("1.5", "2024-01-01", "NA"), ("2", "2024-02-01", "3")], "a string, d string, c string")
    t = dict(IN.infer_types(df).dtypes)
    assert t == {"a": "double", "d": "string", "c": "bigint"}


def test_validate_input(spark, tmpdir_path):
    good = os.path.join(tmpdir_path, "g.csv")
    with open(good, "w") as f:
        f.write("id,name,age\n1,a,3\n2,b,4\n3,c,5\n")
    rows = {r["check"]: r["passed"] for r in IN.validate_input(spark, good).collect()}
    assert all(rows.values())
    header_only = os.path.join(tmpdir_path, "h.csv")
    with open(header_only, "w") as f:
        f.write("id,name\n")
    rows = {r["check"]: r["passed"] for r in IN.validate_input(spark, header_only).collect()}
    assert rows["has_rows"] is False


def test_normalise_headers_collisions(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`First Name` int, `first-name` int, `%%` int")
    out, mapping = IN.normalise_headers(df)
    assert out.columns == ["first_name", "first_name_2", "column"]
    out2, _ = IN.normalise_headers(df, {"%%": "pct"})
    assert out2.columns[-1] == "pct"


def test_row_limit_and_finite(spark):
    df = spark.range(10)
    assert IN.row_limit_warning(df, 5) and IN.row_limit_warning(df, 10) is None
    f = spark.createDataFrame([(float("nan"), [1.0, float("inf")])], "x double, a array<double>")
    r = IN.finite_or_null(f).first()
    assert r["x"] is None and r["a"] == [1.0, None]


def test_write_reports_and_table(spark, tmpdir_path):
    df = spark.createDataFrame([(1, float("nan"))], "a int, b double")
    SK.write_reports({"anomalies": df}, tmpdir_path, "run-1")
    back = spark.read.parquet(os.path.join(tmpdir_path, "anomalies"))
    assert back.first()["b"] is None and back.first()["run_id"] == "run-1"
    SK.write_table(df, os.path.join(tmpdir_path, "clean_csv"), "csv")
    assert spark.read.option("header", True).csv(os.path.join(tmpdir_path, "clean_csv")).count() == 1


def test_audit_trail(spark):
    long_action = "x" * 300
    assert TR.audit_log(spark, [{"action": long_action}]).first()["action"] == long_action
    assert TR.audit_log(spark, [{"action": long_action}], action_max=255).first()["action"] == "x" * 248 + " [+52]"
    log = TR.audit_log(spark, [
        {"agent_name": "engineer", "phase": "phase2", "action": long_action, "reason": "OHE"},
        {"agent_name": "engineer", "phase": "phase2", "action": "b", "reason": "OHE"},
        {"agent_name": "janitor", "phase": "phase2", "action": "c", "reason": "r"},
        {"agent_name": "orchestrator", "phase": "phase1", "action": "d", "reason": "r"}])
    assert len(log.first()["action"]) == 300
    assert TR.audit_feed(log, "engineer").count() == 2
    assert TR.audit_feed(log, "all", "phase1").count() == 1
    tc = {r["transform_type"]: (r["entries"], r["display_order"]) for r in TR.transform_counts(log).collect()}
    assert tc == {"OHE": (2, 0)}
    facets = {(r["facet"], r["value"]) for r in TR.audit_facets(log).collect()}
    assert ("agent", "janitor") in facets and ("phase", "phase1") in facets


def test_sort_stats_nulls_last(spark):
    stats = spark.createDataFrame([("a", None), ("b", 0.5), ("c", 0.1)], "name string, null_rate double")
    assert [r["name"] for r in TR.sort_stats(stats, "null_rate", True).collect()] == ["c", "b", "a"]
    assert [r["name"] for r in TR.sort_stats(stats, "null_rate", False).collect()] == ["b", "c", "a"]


def test_chart_requests_and_context(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(15)]
    rows += [(2, 0, "user", "Please SHOW a histogram"), (2, 1, "assistant", "ok")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [r["turn"] for r in CV.chart_requests(conv).collect()] == [0]
    ctx = {r["conv_id"]: r for r in CV.conversation_context(conv, 10, 6).collect()}
    assert ctx[1]["history_turns"] == 10 and ctx[1]["first_turn"] == 5
    lines = ctx[1]["context"].split("\n")
    assert len(lines) == 6 and lines[0] == "ASSISTANT: turn 9" and lines[-1] == "USER: turn 14"
    assert ctx[2]["context"] == "USER: Please SHOW a histogram\nASSISTANT: ok"


def test_last_turns_hot_conversation(spark):
    rows = [(7, i, "user", "t") for i in range(500)] + [(8, 0, "user", "t")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = CV.last_turns(conv, 10)
    assert sorted(r["turn"] for r in got.where("conv_id = 7").collect()) == list(range(490, 500))


def test_stream_rules(spark, tmpdir_path):
    rows = [(float(v),) for v in [1.0, 200.0, -5.0, 30.0]]
    df = spark.createDataFrame(rows, "age double")
    det = D.detect(df, {"age": {"min_bound": 0, "max_bound": 120}})
    res = CL.clean(df, det, [{"anomaly_id": "LOGICAL_VIOLATION|age", "action": "clamp_bounds"}])
    src = os.path.join(tmpdir_path, "in")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = SR.apply_rules(stream, res).writeStream.format("memory").queryName("clamped").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(r["age"] for r in spark.sql("SELECT age FROM clamped").collect())
    assert got == [0.0, 1.0, 30.0, 120.0]


def test_run_history_and_detail(spark):
    runs = spark.createDataFrame([("r1", dt.datetime(2024, 1, 1)), ("r2", dt.datetime(2024, 2, 1))],
                                 "run_id string, created_at timestamp")
    hist = TR.run_history(runs).collect()
    assert [r["run_id"] for r in hist] == ["r2", "r1"] and hist[0]["total_runs"] == 2
    an = spark.createDataFrame([("r1", 1, "b"), ("r1", 0, "a"), ("r2", 0, "z")],
                               "run_id string, display_order int, anomaly_id string")
    assert [r["anomaly_id"] for r in TR.run_detail(an, "r1").collect()] == ["a", "b"]


def test_csv_with_quotes_and_line_ends(spark, tmpdir_path):
    path = f"{tmpdir_path}/quoted.csv"
    with open(path, "w") as f:
        f.write('a,b\n1,"say ""hi"", ok"\n2,"two\nlines"\n3,\n4," "\n')
    df, enc = IN.read_table(spark, path)
    assert enc == "utf-8" and [tuple(r) for r in df.collect()] == [("1", 'say "hi", ok'), ("2", "two\nlines"), ("3", None), ("4", " ")]


def test_infer_types_of_booleans_blanks_and_long_integers(spark):
    rows = [("True", "12345678901234567890", " ", "1", "1" * 40), ("false", "5", "x", "2.5", "2"), (None, None, "", "inf", None)]
    df = spark.createDataFrame(rows, "t string, big string, blank string, num string, huge string")
    got = IN.infer_types(df)
    assert dict(got.dtypes) == {"t": "boolean", "big": "decimal(38,0)", "blank": "string", "num": "double", "huge": "string"}
    assert [r.blank for r in got.collect()] == [" ", "x", None] and [r.t for r in got.collect()] == [True, False, None]
    assert [r.blank for r in IN.infer_types(df, blank_is_null=True).collect()] == [None, "x", None]


def test_a_repeated_run_replaces_its_own_rows(spark, tmpdir_path):
    one, two = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(3,)], "a int")
    run = "day=1/2 %x"
    for df, r in ((one, run), (two, "other"), (one, run), (two, run)):
        SK.write_reports({"t": df}, tmpdir_path, r)
    read = lambda: sorted((r.a, r.run_id) for r in spark.read.parquet(f"{tmpdir_path}/t").collect())
    assert read() == [(3, run), (3, "other")]
    SK.write_reports({"t": two.limit(0)}, tmpdir_path, run)
    assert read() == [(3, "other")]
    bad = spark.createDataFrame([(1, 0)], "a int, z int").select(F.expr("a DIV z").alias("a"))
    with pytest.raises(Exception):
        SK.write_reports({"t": bad}, tmpdir_path, "other")
    assert read() == [(3, "other")]


def test_run_positions_over_many_ranges(spark):
    rows = [(f"r{i}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i * 37 % 500)) for i in range(300)]
    got = TR.run_history(spark.createDataFrame(rows, "id string, created_at timestamp").repartition(7), position=True).collect()
    assert [r.position for r in got] == list(range(300)) and got[0].total_runs == 300
    assert [r.created_at for r in got] == sorted((r.created_at for r in got), reverse=True)
    assert TR.run_history(spark.createDataFrame([], "id string, created_at timestamp"), position=True).collect() == []
