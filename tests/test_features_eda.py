"""Feature engineering, EDA statistics and chart data (FIXTURES.md §3)."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from tableaudit.operators import charts as CH
from tableaudit.operators import eda as EDA
from pyspark.sql import functions as F

from tableaudit.config import AuditConfig
from tableaudit.functions import stats as S
from tableaudit.operators import features as FE


def test_one_hot_keeps_original(spark):
    df = spark.createDataFrame([(c,) for c in ["London", "Paris", "Berlin"] * 20], "city string")
    out, recs, skipped = FE.one_hot(df, 10)
    assert "city" in out.columns
    assert [c for c in out.columns if c.startswith("city_")] == ["city_Berlin", "city_London", "city_Paris"]
    assert out.where("city_Paris = 1").count() == 20 and not skipped


def test_one_hot_skipped_and_frequency(spark):
    df = spark.createDataFrame([(f"name{i}", "same") for i in range(50)], "name string, const string")
    eng = FE.engineer(df)
    types = {(r["transform_type"], r["source_columns"][0] if r["source_columns"] else None) for r in eng.records}
    assert ("OHE", "name") not in types and ("OHE", "const") not in types
    assert ("FREQUENCY_ENCODING", "name") in types  # 50 <= 50
    assert eng.df.select("name_freq").distinct().collect()[0][0] == 1


def test_frequency_null_stays_null(spark):
    rows = [(f"v{i % 12}",) for i in range(60)] + [(None,)]
    out, recs = FE.frequency_encode(spark.createDataFrame(rows, "c string"), 11, 50)
    got = {r["c"]: r["c_freq"] for r in out.collect()}
    assert got[None] is None and got["v0"] == 5


def test_log_transform_guards(spark):
    rnd = np.random.default_rng(0)
    expo = rnd.exponential(1000, 100).tolist()
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in
                                zip(expo, range(-10, 90), [0, 1] * 50)], "spend double, shifted double, flag int")
    out, recs = FE.log_transform(df)
    names = {r["output_columns"][0] for r in recs}
    assert names == {"spend_log"}
    v = out.select("spend", "spend_log").first()
    assert v["spend_log"] == pytest.approx(np.log1p(v["spend"]))


def test_datetime_parts_and_weekend(spark):
    rows = [(dt.datetime(2024, 1, d),) for d in range(1, 11)]
    df = spark.createDataFrame(rows, "signup_date timestamp")
    out, recs = FE.datetime_parts(df, FE.detect_datetime(df))
    wk = {r["signup_date"].day: r["signup_date_is_weekend"] for r in out.collect()}
    assert [d for d, w in wk.items() if w == 1] == [6, 7]
    assert out.where("signup_date_dow = 0").first()["signup_date"].day == 1  # Monday = 0


def test_text_dates_need_time_name_and_rate(spark):
    rows = [("2024-01-05", "2024-01-05"), ("2024-02-10", "x"), ("2024-03-01", "2024-03-01")]
    df = spark.createDataFrame(rows, "order_date string, label string")
    parsed = FE.detect_datetime(df)
    assert list(parsed) == ["order_date"]


def test_duration_floor_days(spark):
    rows = [(dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 3, 6)),
            (dt.datetime(2024, 1, 3, 12), dt.datetime(2024, 1, 1, 6))]
    df = spark.createDataFrame(rows, "start_date timestamp, end_date timestamp")
    out, recs = FE.duration_days(df, FE.detect_datetime(df))
    assert [r[-1] for r in out.collect()] == [1, -3]


def test_interaction_guards(spark):
    rnd = random.Random(3)
    a = [rnd.uniform(0, 100) for _ in range(200)]
    b = [0.9 * x + rnd.gauss(0, 2) for x in a]
    c = [rnd.uniform(0, 100) for _ in range(200)]
    f = [rnd.choice([0, 1]) for _ in range(200)]
    g = [rnd.choice([0, 1]) for _ in range(200)]
    df = spark.createDataFrame(list(zip(a, b, c, f, g)), "a double, b double, c double, f int, g int")
    out, recs = FE.interaction_term(df)
    assert [r["output_columns"][0] for r in recs] == ["a_x_b"]
    out2, recs2 = FE.interaction_term(df.select("a", "c", "f", "g"))
    assert recs2 == []


def test_report_no_transforms(spark):
    eng = FE.engineer(spark.createDataFrame([(1, "a"), (2, "a")], "id int, s string"))
    assert [r["transform_type"] for r in eng.report.collect()] == ["NO_TRANSFORMS"]


def _pandas_spearman(x, y):
    s = pd.DataFrame({"x": x, "y": y}).dropna()
    return s["x"].rank().corr(s["y"].rank())


def test_spearman_matches_rank_correlation(spark):
    rnd = random.Random(5)
    x = [float(rnd.randint(0, 20)) for _ in range(300)]
    y = [v * 2 + rnd.gauss(0, 5) if i % 7 else None for i, v in enumerate(x)]
    z = [float(rnd.randint(0, 5)) for _ in range(300)]
    df = spark.createDataFrame(list(zip(x, y, z)), "x double, y double, z double")
    got = EDA.spearman(df, [("x", "y"), ("x", "z"), ("y", "z")])
    assert got[("x", "y")] == pytest.approx(_pandas_spearman(x, y), abs=1e-9)
    assert got[("x", "z")] == pytest.approx(_pandas_spearman(x, z), abs=1e-9)
    assert got[("y", "z")] == pytest.approx(_pandas_spearman(y, z), abs=1e-9)


def test_top_spearman_at_most_three(spark):
    rnd = random.Random(2)
    cols = {f"c{i}": [rnd.random() * (i + 1) for _ in range(50)] for i in range(5)}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols))
    assert EDA.top_spearman(df, 3).count() <= 3



@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_spearman_of_many_masks_either_way(spark, monkeypatch, sent):
    monkeypatch.setattr(EDA, "SENT_VALUES", sent)
    rng = np.random.default_rng(5)
    n = 400
    base = rng.normal(size=n)
    data = {"a": base + rng.normal(size=n), "b": np.round(base), "c": np.where(rng.random(n) < 0.4, 0.0, base), "d": rng.normal(size=n), "e": np.full(n, 3.0), "f": np.full(n, np.nan)}
    for c, share in (("b", 0.2), ("c", 0.3), ("d", 0.1)):
        data[c] = np.where(rng.random(n) < share, np.nan, data[c])
    data["b"][np.isnan(data["d"])] = np.nan
    pdf = pd.DataFrame(data)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.to_numpy()]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)
    pairs = [(x, y) for i, x in enumerate(data) for y in list(data)[i + 1:]]
    got = EDA.spearman(df, pairs)
    for x, y in pairs:
        both = pdf[[x, y]].dropna()
        want = both[x].rank().corr(both[y].rank()) if len(both) >= 3 and "e" not in (x, y) else None
        assert got[x, y] == (None if want is None else pytest.approx(want, abs=1e-12)), (x, y)
    empty = EDA.spearman(df.filter("false"), [("a", "b")])
    assert empty == {("a", "b"): None}


def test_hotspots_readiness_recommend(spark):
    rows = [(None if i % 2 else float(i), None if i % 4 else "a", 5.0) for i in range(8)]
    df = spark.createDataFrame(rows, "x double, s string, k double")
    hs = EDA.missingness_hotspots(df).collect()
    assert [r["column"] for r in hs] == ["s", "x"]
    r = EDA.ml_readiness(df).first()[0]
    assert 0 <= r <= 100
    assert r == pytest.approx(round(100 * (1 - (0.5 + 0.75 + 0) / 3) * (1 - 1 / 2), 1))
    intents = spark.createDataFrame([("we want to predict churn",), ("segment users",), ("",)], "intent string")
    recs = [r["recommendation"] for r in EDA.recommend(intents).collect()]
    assert "predictive modelling" in recs[0] and "cluster" in recs[1] and "overview" in recs[2]


def test_histogram_and_box(spark):
    vals = [float(i) for i in range(100)] + [1000.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    h = CH.histogram(df, "v", 10)
    assert h.agg({"count": "sum"}).first()[0] == 101
    b = CH.box_stats(df, "v", 1.5).first()
    assert b["median"] == 50.0 and b["outliers"] == 1
    f = CH.distribution_facts(df, "v")
    assert f["shape"] == "right-skewed" and f["suggest_transform"]


def test_trend_halves_in_time_order(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(days=i), float(10 if i < 10 else 20)) for i in range(20)]
    df = spark.createDataFrame(list(reversed(rows)), "ts timestamp, y double")
    t = CH.trend(df, "ts", "y")
    assert t["pct"] == pytest.approx(100.0, rel=1e-6) and t["trend"] == "upward"


def test_chart_sample_exact_and_repeatable(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    a = [r["k"] for r in CH.chart_sample(df, 5000, ["k"]).collect()]
    b = [r["k"] for r in CH.chart_sample(df.repartition(3), 5000, ["k"]).collect()]
    assert len(a) == 5000 and sorted(a) == sorted(b)


def test_missingness_map_and_portfolio(spark):
    rows = [(1.0, None), (None, "a"), (None, None), (2.0, "b")]
    df = spark.createDataFrame(rows, "x double, s string")
    m = {r["pattern"]: r["rows"] for r in CH.missingness_map(df).collect()}
    assert m == {'["s"]': 1, '["x"]': 1, '["x","s"]': 1}
    p = CH.portfolio(df).collect()
    assert any(r["title"] == "Missingness heatmap" for r in p)


def test_heatmap_skip_note(spark):
    rnd = random.Random(9)
    rows = [(rnd.random(), rnd.random()) for _ in range(200)]
    f = CH.heatmap_facts(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])
    assert not f["emit"] and "omitted" in f["note"]


def test_eda_bundle_and_notes(spark):
    from tableaudit.operators import clean as CL
    from tableaudit.operators import detect as D
    rows = [(float(i), None if i % 3 else float(i % 5), f"c{i % 4}") for i in range(60)] + [(1.0, 1.0, "c1")] * 3
    df = spark.createDataFrame(rows, "a double, b double, c string")
    det = D.detect(df)
    res = CL.clean(df, det, [{"anomaly_id": "MISSING_DATA|b", "action": "fill_mean"},
                             {"anomaly_id": "DUPLICATE_ROWS", "action": "remove_duplicates"}])
    out = EDA.eda(res.df, "find outliers", res.changes, det.anomalies)
    assert out.row_count == res.df.count() and out.col_count == 3
    assert "anomalies" in out.recommendation
    assert out.notes[0] == "b had 40 gaps filled by the mean."
    assert any(n.startswith("b: ") and "were filled in" in n for n in out.notes)  # b had > 20 % nulls
    assert out.column_stats.count() == 3
    notes = EDA.narrative_notes(res.df, res.changes, det.anomalies).collect()
    assert [r["note"] for r in notes] == out.notes


def test_insight_text(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    f = CH.distribution_facts(df, "v")
    assert "approximately symmetric" in CH.insight_text("histogram", f)
    b = CH.box_stats(df, "v", 3.0).first().asDict()
    assert "No value lies beyond" in CH.insight_text("box", b)
    assert CH.insight_text("line", {"pct": 12.0, "trend": "upward"}).endswith("upward trend.")


def test_duration_and_unix_parts_do_not_depend_on_the_zone(spark):
    df = spark.sql("""SELECT timestamp_ntz'2024-03-01 00:00:00' AS start_date, timestamp_ntz'2024-03-15 00:00:00' AS end_date,
                      1709251200D AS made_ts, '2024-03-10T02:30:00+02:00' AS text_date""").union(
        spark.sql("SELECT timestamp_ntz'2024-03-20 00:00:00', timestamp_ntz'2024-03-18 12:00:00', 1709251199D, 'Jan 5 2024'"))
    seen = []
    zone = spark.conf.get("spark.sql.session.timeZone")
    for z in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", z)
        try:
            parsed = FE.detect_datetime(df)
            out, _ = FE.datetime_parts(df, parsed)
            out, _ = FE.duration_days(out, parsed)
            seen.append([tuple(r) for r in out.select("duration_days_start_date_to_end_date", "made_ts_year", "made_ts_month", "text_date_month", "text_date_dow").collect()])
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
    assert seen[0] == seen[1] == [(14, 2024, 3, 3, 6), (-2, 2024, 2, 1, 4)]


def test_one_hot_names_stay_apart(spark):
    df = spark.createDataFrame([("Yes", 1), ("yes", 2), ("x", 3)], "a string, a_x int")
    out, recs, _ = FE.one_hot(df, 10)
    assert recs[0]["output_columns"] == ["a_Yes", "a_x_2", "a_yes_2"]
    assert {tuple(r) for r in out.collect()} == {("Yes", 1, 1, 0, 0), ("yes", 2, 0, 0, 1), ("x", 3, 0, 1, 0)}


def test_infinite_values_and_far_dates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),)], "v double")
    assert S.exact_quantiles(df, {"v": F.col("v")}, (0.5,))["v"] == [2.0]
    assert sum(r["count"] for r in CH.histogram(df, "v", 4).collect()) == 2
    far = spark.sql("SELECT timestamp'9999-12-31 00:00:00' - make_interval(0, 0, 0, i) AS t, CAST(i AS DOUBLE) AS v FROM (SELECT explode(sequence(0, 9)) AS i)")
    assert CH.trend(far, "t", "v")["trend"] == "downward"


def test_portfolio_has_every_column_and_the_primary_chart(spark):
    df = spark.range(300).select(*[(F.col("id") * (i + 1) % 97).cast("double").alias(f"v{i}") for i in range(10)])
    rows = CH.portfolio(df, primary=("scatter", "v0", "v1")).collect()
    assert sum(r.chart_type == "histogram" for r in rows) == 10 and rows[0].display_order == 0 and rows[0].x_column == "v0"
    bound = CH.portfolio(df, AuditConfig(max_histogram_columns=8, scatter_max_columns=3)).collect()
    assert sum(r.chart_type == "histogram" and r.skip_note is None for r in bound) == 8
    assert sum("Left out" in (r.skip_note or "") for r in bound) == 2


def test_exact_quantiles_by_brackets(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 1, 30000), np.repeat(0.25, 9000), [1e9]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = S.exact_quantiles(df, {"v": F.col("v")}, probs)["v"]
    assert np.allclose(got, np.quantile(values, probs), rtol=0, atol=1e-12)


def test_name_patterns_are_parameters(spark):
    from tableaudit.config import NamePatterns
    from tableaudit.operators import profile as P
    df = spark.range(200).select((F.col("id") * 7).alias("kennung"))
    assert P.semantic_types(df).first().semantic_type == "CONTINUOUS"
    assert P.semantic_types(df, AuditConfig(names=NamePatterns(identifier=("kennung",)))).first().semantic_type == "ID"


def test_exact_quantiles_between_very_frequent_values(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(S, "BRACKET_VALUES", 3)
    for values in (np.r_[np.repeat(1.0, 40000), np.arange(2, 12), np.repeat(20.0, 40000)], np.r_[np.repeat(1.0, 500), np.repeat(2.0, 500)],
                   np.r_[np.arange(50000.0), np.repeat(-5.0, 20000)]):
        df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
        probs = (0.0, 0.25, 0.4999, 0.5, 0.50005, 0.75, 1.0)
        assert np.allclose(S.exact_quantiles(df, {"v": F.col("v")}, probs)["v"], np.quantile(values, probs), rtol=0, atol=1e-9)


def test_sketched_distinct_counts_decide_as_exact_ones(spark):
    """Columns at, below and above every mark; each comparison comes out as with the exact count."""
    from tableaudit.functions import stats as S
    n = 4_000
    sizes = [1, 2, 9, 10, 11, 50, 51, 1_000, 3_799, 3_800, 3_801, 4_000]
    df = spark.range(n).select(*[F.when(F.col("id") < n - 1, F.col("id") % k).alias(f"c{k}") for k in sizes]).repartition(5)
    exprs = {c: F.col(c) for c in df.columns}
    exact = S.distinct_counts(df, exprs)
    assert exact == {c: df.select(c).dropna().distinct().count() for c in df.columns}
    marks = [1, 2, 9, 10, 50, 51, 0.95 * n]
    got = S.distinct_for(df, exprs, {c: marks for c in exprs})
    for c in exprs:
        assert [got[c] >= m for m in marks] == [exact[c] >= m for m in marks] and [got[c] > m for m in marks] == [exact[c] > m for m in marks]
    estimates = S.distinct_estimates(df, exprs)
    assert all(abs(estimates[c] - exact[c]) <= S.SKETCH_BOUND * exact[c] + 1 for c in exprs)


def test_quantiles_take_two_scans_or_ranges(spark, monkeypatch):
    """Positions among many values are found by running sums over ranges; a broken bracket is narrowed step by step."""
    import numpy as np

    from tableaudit.functions import stats as S
    values = [float(i * 7919 % 10_007) for i in range(20_000)] + [5.0] * 3_000
    df = spark.createDataFrame([(v, None if i % 3 else v / 3) for i, v in enumerate(values)], "v double, w double").repartition(6)
    probs = (0.0, 0.25, 0.5, 0.75, 0.999, 1.0)
    want = [list(np.quantile(values, probs)), list(np.quantile([v / 3 for i, v in enumerate(values) if i % 3 == 0], probs))]
    exprs = {"v": F.col("v"), "w": F.col("w")}
    for most in (100_000, 2):
        monkeypatch.setattr(S, "DRIVER_VALUES", most)
        got = S.exact_quantiles(df, exprs, probs)
        assert np.allclose([got["v"], got["w"]], want, rtol=0, atol=1e-9)
    real = S._place
    monkeypatch.setattr(S, "_place", lambda *a: None)
    got = S.exact_quantiles(df, exprs, (0.5,))
    assert np.allclose([got["v"], got["w"]], [[w[2]] for w in want], rtol=0, atol=1e-9)
    assert real is not S._place


def test_brackets_are_counted_where_they_lie(spark):
    """What lies below a bracket is a sum, and tied positions need no row at all; positions hold with nulls and zeros of either sign."""
    import numpy as np

    from tableaudit.functions import stats as S
    values = [float(i % 7) for i in range(7_000)] + [-0.0] * 500
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 50, "v double").repartition(4)
    tied, wide, off = (S._Bracket("v", 0.5, lo, lo + 1, low, high, len(values)) for lo, low, high in ((3_800, 3.0, 3.0), (2_499, 1.0, 2.0), (7_400, 0.0, 3.0)))
    S._place(df, {"v": F.col("v")}, [tied, wide, off])
    assert [(b.below, b.upto) for b in (tied, wide, off)] == [(3_500, 4_500), (1_500, 3_500), (0, 4_500)]
    assert (tied.found, wide.found, off.found) == (3.0, 1.5, None)
    zero = S._Bracket("v", 0.0, 10, 11, -0.0, -0.0, len(values))
    S._place(df, {"v": F.col("v")}, [zero])
    assert np.copysign(1.0, zero.found) == 1.0


def _joined(spark):
    left = spark.range(400).select("id", (F.col("id") % 40).alias("k"), (F.col("id") * 0.5 + F.col("id") % 3).alias("amount"), F.lit("t").alias("note"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 1.5).alias("price"))
    return left.join(right, "k").select("id", F.col("amount"), (F.col("amount") * 2 + F.col("price")).alias("total"), "note")


def test_interaction_reads_a_joined_table_once(spark):
    df = _joined(spark)
    out, recs = FE.interaction_term(df, 0.5, 10)
    assert recs[0]["output_columns"] == ["amount_x_total"] and out.columns == [*df.columns, "amount_x_total"]
    want = sorted((r.id, r.amount * r.total) for r in df.collect())
    assert sorted((r.id, r.amount_x_total) for r in out.collect()) == want
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_scatter_matrix_reads_a_joined_table_once(spark):
    from tableaudit.operators import charts as CH
    df = _joined(spark)
    points, note = CH.scatter_matrix(df, key=["note"])
    assert note is None and points.columns == ["note", "amount", "total"]
    assert sorted(map(tuple, points.collect())) == sorted((r.note, r.amount, r.total) for r in df.collect())
    assert "Join" not in points._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("sent", [160, 500])
def test_spearman_joins_only_columns_of_many_values(spark, monkeypatch, sent):
    """One column of many values: its rows meet their ranks as they are, the others' ranks are looked up. Two: joined, put together by position."""
    monkeypatch.setattr(EDA, "SENT_VALUES", sent)
    rng = np.random.default_rng(9)
    n = 300
    data = {"a": rng.normal(size=n), "b": np.round(rng.normal(size=n) * 3), "c": np.round(rng.normal(size=n) * 2)}
    data["d"] = np.round(data["a"] * 100 + rng.normal(size=n) * 20)
    data["b"][rng.random(n) < 0.2] = np.nan
    data["a"][rng.random(n) < 0.1] = np.nan
    columns = list(data) if sent == 160 else ["a", "b", "c"]
    pdf = pd.DataFrame(data)[columns]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.to_numpy()], ", ".join(f"{c} double" for c in columns)).repartition(4)
    if sent == 500:
        def no_positions(*a):
            raise AssertionError("rows need no position for one column")
        monkeypatch.setattr(EDA, "with_position", no_positions)
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1:]]
    got = EDA.spearman(df, [*pairs, pairs[0]])
    for x, y in pairs:
        both = pdf[[x, y]].dropna()
        assert got[x, y] == pytest.approx(both[x].rank().corr(both[y].rank()), abs=1e-12), (x, y)


def test_dates_are_spelled_once_a_value(spark, monkeypatch):
    from tableaudit.functions import dates as DT
    taken, shape = [], DT.shape
    monkeypatch.setattr(DT, "shape", lambda t: taken.append(str(t)) or shape(t))
    df = spark.createDataFrame([("2024-01-05T10:00:00Z",), ("2024-01-05 10:00 +02:00",), ("1/5/2024, 10:00 GMT",), ("5 Jan 2024",), ("10:00:00.5utc",), (None,)], "t string")
    found = DT.forms(df, {"t": F.col("t")})
    assert [form for form, _ in found["t"]] == ["9 b Y", "9/9/Y 9:9", "Y-9-9 9:9", "Y-9-9T9:9:9"]
    assert taken and "regexp_replace" not in "".join(taken)


def test_written_dates_in_any_form(spark):
    """Forms that a table may hold, each read as its words say; numbers over twelve tell the day from the month."""
    from tableaudit.functions import dates as DT
    want = {
        "2024-01-05 10:00:00 PM": "2024-01-05 22:00:00", "Jan 5 2024 10:30": "2024-01-05 10:30:00", "5 January 2024 10:00": "2024-01-05 10:00:00",
        "Fri, 05 Jan 2024 10:00:00 GMT": "2024-01-05 10:00:00", "2024-01": "2024-01-01 00:00:00", "01-05-2024": "2024-01-05 00:00:00",
        "2024.01.05": "2024-01-05 00:00:00", "1/5/24": "2024-01-05 00:00:00", "20240105T101010": "2024-01-05 10:10:10", "20240105": "2024-01-05 00:00:00",
        "JANUARY 5th, 2024": "2024-01-05 00:00:00", "5-sept-2024": "2024-09-05 00:00:00", "Dec 2024": "2024-12-01 00:00:00", "2024-Jan-05": "2024-01-05 00:00:00",
        "2024-01-05T10:00:00.123Z": "2024-01-05 10:00:00.123", "2024-01-05 10:00:00.123456789+02:00": "2024-01-05 10:00:00.123456", "1/13/2024 9:05 am": "2024-01-13 09:05:00",
        "  2024/1/5   7:08 ": "2024-01-05 07:08:00", "not a date": None, "12345": None, "": None, "2024-13-45": None, "May": None, "3.2": None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(want)], "i int, t string")
    found = DT.forms(df, {"t": F.col("t")})["t"]
    got = {r.t: r.d for r in df.select("t", DT.parse(F.col("t"), found).alias("d")).collect()}
    assert {t: None if d is None else str(d).removesuffix("000") for t, d in got.items()} == {t: v.removesuffix("000") if v and v.endswith("123") else v for t, v in want.items()}
    assert DT.forms(df.where("i < 0"), {"t": F.col("t")}) == {"t": []}


def test_the_numbers_seen_tell_day_first_from_month_first(spark):
    from tableaudit.functions import dates as DT

    def read(*texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        found = DT.forms(df, {"t": F.col("t")})["t"]
        return [r.d and (r.d.month, r.d.day) for r in df.select(DT.parse(F.col("t"), found).alias("d")).collect()]

    assert read("03/04/2024", "05/06/2024") == [(3, 4), (5, 6)]
    assert read("03/04/2024", "25/06/2024 10:00") == [(4, 3), (6, 25)]
    assert read("03.04.2024") == [(4, 3)] and read("03.04.2024", "04.25.2024") == [(3, 4), (4, 25)]
    assert read("03/04/2024", "25/06/2024", "06/25/2024") == [(3, 4), (6, 25), (6, 25)]
