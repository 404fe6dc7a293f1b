"""Cleaning actions on literal frames (FIXTURES.md §3) and the decision compiler."""

from __future__ import annotations

import re

import pytest

from tableaudit.operators import clean as CL
from tableaudit.operators import detect as D


def vals(df, c):
    return [r[c] for r in df.collect()]


def test_remove_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c")], "x int, y string")
    assert CL.remove_duplicates(df).count() == 3


def test_drop_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (None,), (5.0,)], "x double")
    assert CL.drop_missing_rows(df, "x").count() == 3


def test_fill_mean_median_mode(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (None,), (40.0,), (None,)], "x double")
    out = vals(CL.fill(df, "x", "mean"), "x")
    assert out[2] == pytest.approx(23.3333, abs=1e-4)
    df2 = spark.createDataFrame([(10.0,), (None,), (30.0,), (None,), (50.0,)], "x double")
    assert sorted(vals(CL.fill(df2, "x", "median"), "x")) == [10.0, 30.0, 30.0, 30.0, 50.0]
    df3 = spark.createDataFrame([("London",), (None,), ("Paris",), ("London",), (None,)], "city string")
    assert vals(CL.fill(df3, "city", "mode"), "city").count("London") == 4


def test_mode_ties_pick_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("a",)], "c string")
    assert vals(CL.fill(df, "c", "mode"), "c")[2] == "a"


def test_cap_and_clamp(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 3.0, 999.0, 1000.0]], "x double")
    assert max(vals(CL.cap_iqr(df, "x", 0, 10), "x")) == 10
    df2 = spark.createDataFrame([(v,) for v in [-5.0, 25.0, 200.0, 30.0]], "age double")
    assert vals(CL.clamp_bounds(df2, "age", 0, 120), "age") == [0, 25, 120, 30]


def test_cap_nonneg_floor(spark):
    df = spark.createDataFrame([(v,) for v in [-50.0, 5.0, 10.0]], "price double")
    assert min(vals(CL.cap_iqr(df, "price", -20, 100), "price")) == 0.0


def test_redact_hash_drop(spark):
    df = spark.createDataFrame([(f"u{i}@x.com",) for i in range(5)], "email string")
    assert set(vals(CL.redact(df, "email"), "email")) == {"[REDACTED]"}
    hashed = vals(CL.hash_sha256(df, "email"), "email")
    assert all(re.fullmatch(r"[0-9a-f]{64}", h) for h in hashed)
    assert "email" not in CL.drop_column(df, "email").columns


def test_mixed_type_cap(spark):
    df = spark.createDataFrame([("1.0",), ("2.0",), ("3.0",), ("not_a_number",), ("999.0",)], "x string")
    out = vals(CL.cap_iqr(df, "x", 0, 10), "x")
    assert max(v for v in out if v is not None) == 10 and out.count(None) == 1


def test_mixed_type_drop_and_inlier_mean(spark):
    df = spark.createDataFrame([("10",), ("20",), ("30",), ("not_numeric",), ("999999",)], "x string")
    kept = vals(CL.drop_outside_rows(df, "x", 0, 50), "x")
    assert "999999" not in kept and len(kept) == 4
    filled = vals(CL.fill(df, "x", "mean", "STATISTICAL_OUTLIER", 0, 50), "x")
    assert filled[4] == pytest.approx(20.0)


def test_treat_as_missing_and_zero_fill(spark):
    df = spark.createDataFrame([(v,) for v in [-5.0, 25.0, 200.0, 0.0]], "age double")
    assert vals(CL.treat_as_missing(df, "age", 0, 120), "age") == [None, 25.0, None, 0.0]
    z = vals(CL.fill(df, "age", "mean", "ZERO_AS_MISSING"), "age")
    assert z[3] == pytest.approx((-5 + 25 + 200) / 3)


def test_compiler_counts_and_score(spark):
    rows = [(1.0, "a"), (1.0, "a"), (None, "b"), (0.0, None), (5.0, "c"), (500.0, "d")]
    df = spark.createDataFrame(rows, "reading double, s string")
    det = D.detect(df, {"reading": {"min_bound": 0.5, "max_bound": 100}})
    decisions = [{"anomaly_id": r["anomaly_id"], "action": a} for r, a in
                 [(r, {"DUPLICATE_ROWS": "remove_duplicates", "MISSING_DATA": "fill_mean",
                       "ZERO_AS_MISSING": "drop_rows", "LOGICAL_VIOLATION": "clamp_bounds"}
                   .get(r["anomaly_type"], "keep_as_is")) for r in det.records]]
    decisions.append({"anomaly_id": "unknown", "action": "drop_rows"})
    res = CL.clean(df, det, decisions)
    ch = {r["anomaly_id"]: r for r in res.change_rows}
    assert ch["DUPLICATE_ROWS"]["rows_changed"] == 1
    assert "unknown" not in ch
    assert res.rows_after == res.df.count()
    assert 0 <= res.score_after <= 100


def test_score_100_when_all_resolved(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string")
    det = D.detect(df)
    res = CL.clean(df, det, [{"anomaly_id": "DUPLICATE_ROWS", "action": "remove_duplicates"}])
    assert res.score_after == 100.0


def test_unknown_action_skipped(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    det = D.detect(df)
    res = CL.clean(df, det, [{"anomaly_id": "MISSING_DATA|x", "action": "frobnicate"}])
    assert res.change_rows[0]["description"].startswith("Skipped unrecognised action")
    assert res.df.count() == 2


@pytest.mark.parametrize("action,atype,extra", [
    ("drop_rows", "MISSING_DATA", {}), ("drop_rows", "ZERO_AS_MISSING", {}),
    ("drop_rows", "LOGICAL_VIOLATION", {"lower_bound": 0, "upper_bound": 10}),
    ("clamp_bounds", "LOGICAL_VIOLATION", {"lower_bound": 0, "upper_bound": 10}),
    ("treat_as_missing", "LOGICAL_VIOLATION", {"lower_bound": 0, "upper_bound": 10}),
])
def test_idempotent(spark, action, atype, extra):
    df = spark.createDataFrame([(v,) for v in [0.0, 5.0, None, 50.0, -3.0]], "x double")
    a = {"anomaly_type": atype, "column_name": "x", **extra}
    once = CL.apply_one(df, a, action).df
    twice = CL.apply_one(once, a, action).df
    assert sorted(vals(once, "x"), key=str) == sorted(vals(twice, "x"), key=str)


def test_invalid_decisions(spark):
    an = spark.createDataFrame([("MISSING_DATA|x", "MISSING_DATA")], "anomaly_id string, anomaly_type string")
    dec = spark.createDataFrame([("MISSING_DATA|x", "cap_iqr")], "anomaly_id string, action string")
    assert CL.invalid_decisions(an, dec).count() == 1


def test_revise_matches_ids_without_dashes(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    recs = [{"anomaly_id": "ab-cd", "anomaly_type": "MISSING_DATA", "column_name": "x", "affected_rows": 1}]
    res = CL.revise(df, recs, [{"anomaly_id": "abcd", "action": "drop_rows"}], parent_run_id="run1")
    assert res.df.count() == 1 and res.parent_run_id == "run1"
