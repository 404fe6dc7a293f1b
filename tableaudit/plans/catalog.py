"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder reads the driver tables (whole) through ``views`` and returns
a DataFrame whose column names and types equal the oracle's. Doubles are
rounded to 4 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.expressions import column_kinds
from ..operators import detect as D
from . import oracle as O
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def cte(body: str, *views: str) -> str:
    """``WITH <views>, <body ctes> SELECT ...``"""
    return "WITH " + ",\n".join(v.strip() for v in views) + ",\n" + body.strip()


def plain(select: str, *views: str) -> str:
    if not views:
        return select.strip()
    return "WITH " + ",\n".join(v.strip() for v in views) + "\n" + select.strip()


def r4(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


def report(det: D.Detection) -> DataFrame:
    a = det.anomalies
    return a.select("anomaly_id", "anomaly_type", "column_name", "affected_rows", "total_flagged",
                    r4("null_rate").alias("null_rate"), "severity", r4("lower_bound").alias("lower_bound"),
                    r4("upper_bound").alias("upper_bound"), "threshold",
                    r4("mean_null_density").alias("mean_null_density"), "pii_types", "description",
                    "display_order")


ORDERS_COLS = ["o_orderkey", "cust", "status", "reading", "priority", "order_date"]
ORDERS_NUM = ["o_orderkey", "cust", "reading"]
ORDERS_TEXT = ["status", "priority"]
LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_NUM = LINE_COLS[:8]
LINE_TEXT = ["l_returnflag", "l_linestatus"]


# ---------------------------------------------------------------------------
# C: detection
# ---------------------------------------------------------------------------

@register("detect_orders", cte(O.detect_sql("dirty_orders", ORDERS_COLS, ORDERS_NUM, ORDERS_TEXT,
                                            V.DIRTY_ORDERS_BOUNDS), V.DIRTY_ORDERS_SQL))
def q_detect_orders(spark, sf):
    return report(D.detect(V.dirty_orders(spark, sf), V.DIRTY_ORDERS_BOUNDS))


@register("detect_lineitem", cte(O.detect_sql("dirty_lineitem", LINE_COLS, LINE_NUM, LINE_TEXT,
                                              V.DIRTY_LINEITEM_BOUNDS), V.DIRTY_LINEITEM_SQL))
def q_detect_lineitem(spark, sf):
    return report(D.detect(V.dirty_lineitem(spark, sf), V.DIRTY_LINEITEM_BOUNDS))


# ---------------------------------------------------------------------------
# D: cleaning
# ---------------------------------------------------------------------------

from ..functions.expressions import number_of  # noqa: E402
from ..operators import clean as CL  # noqa: E402


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded to 4 places (both sides of the oracle do the same)."""
    return df.select(*[F.round(F.col(c), 4).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def orders_fence(df: DataFrame, column: str = "reading") -> dict:
    f = D.fences_of(df, {column: number_of(df, column)}, None, DEFAULT.iqr_multiplier, DEFAULT)[column]
    return {"lower_bound": f[1], "upper_bound": f[2]}


def _one(anomaly: dict, action: str, params=None, fence: bool = False):
    def run(spark, sf):
        df = V.dirty_orders(spark, sf)
        a = dict(anomaly)
        if fence:
            a.update(orders_fence(df, a["column_name"]))
        return rounded(CL.apply_one(df, a, action, params).df)
    return run


OUT = "o_orderkey, cust, status, round(reading, 4) AS reading, priority, order_date"
FENCE = """
fz AS (SELECT quantile_cont(reading, 0.25) AS q1, quantile_cont(reading, 0.75) AS q3 FROM dirty_orders),
fr AS (SELECT q1 - 3.0 * (q3 - q1) AS lo, q3 + 3.0 * (q3 - q1) AS hi FROM fz)"""
ORD_SHARE = ("((o_orderkey IS NULL)::INT + (cust IS NULL)::INT + (status IS NULL)::INT + (reading IS NULL)::INT"
             " + (priority IS NULL)::INT + (order_date IS NULL)::INT) / 6.0")
BLANK = "regexp_matches({0}, '^\\s*$')"

_MISSING = {"anomaly_type": "MISSING_DATA"}
_CLEAN_ONE = {
    "clean_remove_duplicates": (
        {"anomaly_type": "DUPLICATE_ROWS", "column_name": None}, "remove_duplicates", None, False,
        f"SELECT DISTINCT {OUT} FROM dirty_orders"),
    "clean_drop_column": (
        {"anomaly_type": "PII_DETECTED", "column_name": "status"}, "drop_column", None, False,
        "SELECT o_orderkey, cust, round(reading, 4) AS reading, priority, order_date FROM dirty_orders"),
    "clean_drop_missing_rows": (
        {**_MISSING, "column_name": "priority"}, "drop_rows", None, False,
        f"SELECT {OUT} FROM dirty_orders WHERE NOT (priority IS NULL OR {BLANK.format('priority')})"),
    "clean_drop_outlier_rows": (
        {"anomaly_type": "STATISTICAL_OUTLIER", "column_name": "reading"}, "drop_rows", None, True,
        f"SELECT {OUT} FROM dirty_orders, fr WHERE NOT coalesce(reading < lo OR reading > hi, false)"),
    "clean_drop_logical_rows": (
        {"anomaly_type": "LOGICAL_VIOLATION", "column_name": "reading", "lower_bound": 1000.0,
         "upper_bound": 600000.0}, "drop_rows", None, False,
        f"SELECT {OUT} FROM dirty_orders WHERE NOT coalesce(reading < 1000 OR reading > 600000, false)"),
    "clean_drop_zero_rows": (
        {"anomaly_type": "ZERO_AS_MISSING", "column_name": "reading"}, "drop_rows", None, False,
        f"SELECT {OUT} FROM dirty_orders WHERE NOT coalesce(reading = 0, false)"),
    "clean_drop_sparse_rows": (
        {"anomaly_type": "HIGH_NULL_DENSITY_ROWS", "column_name": None, "threshold": 0.5}, "drop_rows", None, False,
        f"SELECT {OUT} FROM dirty_orders WHERE {ORD_SHARE} <= 0.5"),
    "clean_fill_mean": (
        {**_MISSING, "column_name": "reading"}, "fill_mean", None, False,
        "SELECT o_orderkey, cust, status, round(coalesce(reading, (SELECT avg(reading) FROM dirty_orders)), 4)"
        " AS reading, priority, order_date FROM dirty_orders"),
    "clean_fill_median": (
        {**_MISSING, "column_name": "reading"}, "fill_median", None, False,
        "SELECT o_orderkey, cust, status, round(coalesce(reading, (SELECT quantile_cont(reading, 0.5) FROM "
        "dirty_orders)), 4) AS reading, priority, order_date FROM dirty_orders"),
    "clean_fill_mode": (
        {**_MISSING, "column_name": "status"}, "fill_mode", None, False,
        "SELECT o_orderkey, cust, coalesce(status, (SELECT status FROM dirty_orders WHERE status IS NOT NULL "
        "GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)) AS status, round(reading, 4) AS reading, "
        "priority, order_date FROM dirty_orders"),
    "clean_fill_mode_numeric": (
        {**_MISSING, "column_name": "cust"}, "fill_mode", None, False,
        "SELECT o_orderkey, coalesce(cust, (SELECT quantile_cont(cust, 0.5) FROM dirty_orders))::DOUBLE AS cust,"
        " status, round(reading, 4) AS reading, priority, order_date FROM dirty_orders"),
    "clean_fill_outlier_mean": (
        {"anomaly_type": "STATISTICAL_OUTLIER", "column_name": "reading"}, "fill_mean", None, True,
        "SELECT o_orderkey, cust, status, round(CASE WHEN reading < lo OR reading > hi THEN (SELECT avg(reading) "
        "FROM dirty_orders, fr WHERE reading >= lo AND reading <= hi) ELSE reading END, 4) AS reading, priority, "
        "order_date FROM dirty_orders, fr"),
    "clean_fill_zero_mean": (
        {"anomaly_type": "ZERO_AS_MISSING", "column_name": "reading"}, "fill_mean", None, False,
        "SELECT o_orderkey, cust, status, round(CASE WHEN reading = 0 THEN (SELECT avg(reading) FROM dirty_orders "
        "WHERE reading <> 0) ELSE reading END, 4) AS reading, priority, order_date FROM dirty_orders"),
    "clean_cap_iqr": (
        {"anomaly_type": "STATISTICAL_OUTLIER", "column_name": "reading"}, "cap_iqr", None, True,
        "SELECT o_orderkey, cust, status, round(CASE WHEN reading IS NOT NULL THEN least(greatest(reading, lo), hi)"
        " END, 4) AS reading, priority, order_date FROM dirty_orders, fr"),
    "clean_clamp_bounds": (
        {"anomaly_type": "LOGICAL_VIOLATION", "column_name": "reading", "lower_bound": 1000.0,
         "upper_bound": 600000.0}, "clamp_bounds", {"max_bound": 500000.0}, False,
        "SELECT o_orderkey, cust, status, round(CASE WHEN reading IS NOT NULL THEN least(greatest(reading, 1000.0),"
        " 500000.0) END, 4) AS reading, priority, order_date FROM dirty_orders"),
    "clean_treat_as_missing": (
        {"anomaly_type": "LOGICAL_VIOLATION", "column_name": "reading", "lower_bound": 1000.0,
         "upper_bound": 600000.0}, "treat_as_missing", None, False,
        "SELECT o_orderkey, cust, status, round(CASE WHEN reading < 1000 OR reading > 600000 THEN NULL ELSE reading"
        " END, 4) AS reading, priority, order_date FROM dirty_orders"),
    "clean_redact": (
        {"anomaly_type": "PII_DETECTED", "column_name": "status"}, "redact", None, False,
        "SELECT o_orderkey, cust, '[REDACTED]' AS status, round(reading, 4) AS reading, priority, order_date "
        "FROM dirty_orders"),
    "clean_hash_sha256": (
        {"anomaly_type": "PII_DETECTED", "column_name": "priority"}, "hash_sha256", None, False,
        "SELECT o_orderkey, cust, status, round(reading, 4) AS reading, sha256(priority) AS priority, order_date "
        "FROM dirty_orders"),
    "clean_fill_sparse_rows": (
        {"anomaly_type": "HIGH_NULL_DENSITY_ROWS", "column_name": None, "threshold": 0.5}, "fill_mean", None, False,
        f"SELECT CASE WHEN {ORD_SHARE} > 0.5 THEN coalesce(o_orderkey, (SELECT avg(o_orderkey) FROM dirty_orders)) "
        f"ELSE o_orderkey END::DOUBLE AS o_orderkey, CASE WHEN {ORD_SHARE} > 0.5 THEN coalesce(cust, (SELECT avg(cust)"
        f" FROM dirty_orders)) ELSE cust END::DOUBLE AS cust, status, round(CASE WHEN {ORD_SHARE} > 0.5 THEN "
        f"coalesce(reading, (SELECT avg(reading) FROM dirty_orders)) ELSE reading END, 4) AS reading, priority, "
        f"order_date FROM dirty_orders"),
}
for _name, (_a, _act, _p, _fence, _sql) in _CLEAN_ONE.items():
    register(_name, cte(_sql, V.DIRTY_ORDERS_SQL, FENCE) if _fence else plain(_sql, V.DIRTY_ORDERS_SQL))(
        _one(_a, _act, _p, _fence))


# ---------------------------------------------------------------------------
# D21/D22 composite cleaning run; C11-C14, D20 report views
# ---------------------------------------------------------------------------

ORDERS_DECISIONS = [
    {"anomaly_id": "DUPLICATE_ROWS", "action": "remove_duplicates"},
    {"anomaly_id": "MISSING_DATA|priority", "action": "drop_rows"},
    {"anomaly_id": "MISSING_DATA|reading", "action": "fill_mean"},
    {"anomaly_id": "MISSING_DATA|status", "action": "fill_mode"},
    {"anomaly_id": "LOGICAL_VIOLATION|reading", "action": "clamp_bounds"},
    {"anomaly_id": "ZERO_AS_MISSING|cust", "action": "keep_as_is"},
    {"anomaly_id": "HIGH_NULL_DENSITY_ROWS", "action": "drop_rows"},
    {"anomaly_id": "MISSING_DATA|order_date", "action": "keep_as_is"},
    {"anomaly_id": "MISSING_DATA|cust", "action": "cap_iqr"},
    {"anomaly_id": "NO_SUCH_ANOMALY", "action": "drop_rows"},
]
DECISIONS_SQL = O.values("decisions", ["anomaly_id", "action"],
                         [(d["anomaly_id"], d["action"]) for d in ORDERS_DECISIONS])
ALLOWED_SQL = O.values("allowed", ["anomaly_type", "action"],
                       [(t, a) for t, acts in __import__("tableaudit.config", fromlist=["x"]).ALLOWED_ACTIONS.items()
                        for a in acts])
ORDERS_DETECT_CTES = O.detect_ctes("dirty_orders", ORDERS_COLS, ORDERS_NUM, ORDERS_TEXT, V.DIRTY_ORDERS_BOUNDS)

CLEAN_CHAIN = f"""
d1 AS (SELECT DISTINCT * FROM dirty_orders),
d2 AS (SELECT * FROM d1 WHERE NOT (priority IS NULL OR {BLANK.format('priority')})),
d3 AS (SELECT o_orderkey, cust, status, coalesce(reading, (SELECT avg(reading) FROM d2)) AS reading, priority,
       order_date FROM d2),
d4 AS (SELECT o_orderkey, cust, coalesce(status, (SELECT status FROM d3 WHERE status IS NOT NULL GROUP BY status
       ORDER BY count(*) DESC, status LIMIT 1)) AS status, reading, priority, order_date FROM d3),
d5 AS (SELECT o_orderkey, cust, status, CASE WHEN reading IS NOT NULL THEN least(greatest(reading, 1000.0), 600000.0)
       END AS reading, priority, order_date FROM d4),
d6 AS (SELECT * FROM d5 WHERE NOT ({ORD_SHARE.replace('/ 6.0', '/ 6.0 > 0.5')})),
counts AS (SELECT (SELECT count(*) FROM dirty_orders) AS n0, (SELECT count(*) FROM d1) AS n1,
       (SELECT count(*) FROM d2) AS n2, (SELECT count_if(reading IS NULL) FROM d2) AS f3,
       (SELECT count_if(status IS NULL) FROM d3) AS f4,
       (SELECT count_if(reading < 1000 OR reading > 600000) FROM d4) AS c5,
       (SELECT count(*) FROM d5) AS n5, (SELECT count(*) FROM d6) AS n6)"""


def _orders_clean(spark, sf):
    df = V.dirty_orders(spark, sf)
    det = D.detect(df, V.DIRTY_ORDERS_BOUNDS)
    return det, CL.clean(df, det, ORDERS_DECISIONS)


@register("clean_orders", plain(f"SELECT {OUT} FROM d6", V.DIRTY_ORDERS_SQL, CLEAN_CHAIN.strip().rstrip(',')))
def q_clean_orders(spark, sf):
    return rounded(_orders_clean(spark, sf)[1].df)


@register("clean_changes", plain("""
SELECT anomaly_id, action, rows_changed::INTEGER AS rows_changed FROM (VALUES
  ('DUPLICATE_ROWS', 'remove_duplicates', (SELECT n0 - n1 FROM counts)),
  ('MISSING_DATA|priority', 'drop_rows', (SELECT n1 - n2 FROM counts)),
  ('MISSING_DATA|reading', 'fill_mean', (SELECT f3 FROM counts)),
  ('MISSING_DATA|status', 'fill_mode', (SELECT f4 FROM counts)),
  ('LOGICAL_VIOLATION|reading', 'clamp_bounds', (SELECT c5 FROM counts)),
  ('ZERO_AS_MISSING|cust', 'keep_as_is', 0),
  ('HIGH_NULL_DENSITY_ROWS', 'drop_rows', (SELECT n5 - n6 FROM counts)),
  ('MISSING_DATA|order_date', 'keep_as_is', 0),
  ('MISSING_DATA|cust', 'cap_iqr', 0)) t(anomaly_id, action, rows_changed)""",
    V.DIRTY_ORDERS_SQL, CLEAN_CHAIN))
def q_clean_changes(spark, sf):
    ch = _orders_clean(spark, sf)[1].changes
    return ch.select("anomaly_id", "action", F.col("rows_changed").cast("int").alias("rows_changed"))


@register("clean_score_after", cte(f"""
{ORDERS_DETECT_CTES.strip()},
{CLEAN_CHAIN.strip()},
{O.weights_values()},
{DECISIONS_SQL},
remaining AS (SELECT * FROM anomalies WHERE anomaly_id NOT IN (SELECT anomaly_id FROM decisions
              WHERE action NOT IN ('keep_as_is', 'keep_all')))
SELECT s.quality_score, (SELECT n6 FROM counts) AS rows_after FROM ({O.score_select('remaining', '(SELECT n6 FROM counts)')}) s
""", V.DIRTY_ORDERS_SQL))
def q_clean_score_after(spark, sf):
    res = _orders_clean(spark, sf)[1]
    return spark.createDataFrame([(float(res.score_after), int(res.rows_after))],
                                 "quality_score double, rows_after bigint")


@register("quality_score", cte(f"""
{ORDERS_DETECT_CTES.strip()},
{O.weights_values()}
SELECT s.quality_score, {O.band('s.quality_score')} AS band
FROM ({O.score_select('anomalies', '(SELECT n FROM anomaly_n)')}) s""", V.DIRTY_ORDERS_SQL))
def q_quality_score(spark, sf):
    det = D.detect(V.dirty_orders(spark, sf), V.DIRTY_ORDERS_BOUNDS)
    return D.quality_score_frame(det.anomalies, det.n)


def _decisions_df(spark, rows=ORDERS_DECISIONS):
    return spark.createDataFrame([(d["anomaly_id"], d["action"]) for d in rows], "anomaly_id string, action string")


@register("severity_summary", cte(f"""
{ORDERS_DETECT_CTES.strip()},
{DECISIONS_SQL}
SELECT severity, count(*) AS anomalies, count(d.anomaly_id) AS decided
FROM anomalies a LEFT JOIN (SELECT DISTINCT anomaly_id FROM decisions) d USING (anomaly_id)
GROUP BY severity""", V.DIRTY_ORDERS_SQL))
def q_severity_summary(spark, sf):
    det = D.detect(V.dirty_orders(spark, sf), V.DIRTY_ORDERS_BOUNDS)
    return D.severity_summary(det.anomalies, _decisions_df(spark))


@register("decision_risk", cte(f"""
{ORDERS_DETECT_CTES.strip()},
{DECISIONS_SQL}
SELECT a.anomaly_id, a.anomaly_type, a.column_name, d.action, coalesce(a.total_flagged, a.affected_rows) AS rows_at_risk,
  round(coalesce(a.total_flagged, a.affected_rows) / (SELECT n FROM anomaly_n) * 100, 1) AS pct_at_risk,
  (a.anomaly_type = 'MISSING_DATA' AND d.action = 'drop_rows' AND coalesce(a.null_rate, 0.0) > 0.4) AS danger
FROM anomalies a JOIN decisions d USING (anomaly_id)""", V.DIRTY_ORDERS_SQL))
def q_decision_risk(spark, sf):
    det = D.detect(V.dirty_orders(spark, sf), V.DIRTY_ORDERS_BOUNDS)
    return D.decision_risk(det.anomalies, _decisions_df(spark), det.n)


@register("invalid_decisions", cte(f"""
{ORDERS_DETECT_CTES.strip()},
{DECISIONS_SQL},
{ALLOWED_SQL}
SELECT d.anomaly_id, a.anomaly_type, d.action FROM decisions d JOIN anomalies a USING (anomaly_id)
WHERE NOT EXISTS (SELECT 1 FROM allowed l WHERE l.anomaly_type = a.anomaly_type AND l.action = d.action)""",
    V.DIRTY_ORDERS_SQL))
def q_invalid_decisions(spark, sf):
    det = D.detect(V.dirty_orders(spark, sf), V.DIRTY_ORDERS_BOUNDS)
    return CL.invalid_decisions(det.anomalies, _decisions_df(spark))


# ---------------------------------------------------------------------------
# E: features
# ---------------------------------------------------------------------------

from ..operators import features as FE  # noqa: E402

PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@register("one_hot_part", plain(
    "SELECT p_partkey, p_name, p_brand, p_type, p_size, round(p_retailprice, 4) AS p_retailprice, "
    + ", ".join(f"CASE WHEN p_type = '{v}' THEN 1 ELSE 0 END::INTEGER AS \"p_type_{v}\"" for v in PART_TYPES)
    + " FROM part"))
def q_one_hot_part(spark, sf):
    return rounded(FE.one_hot(V.table(spark, sf, "part"), 10)[0])


@register("frequency_encode_part", plain(
    "SELECT p_partkey, p_name, p_brand, p_type, p_size, round(p_retailprice, 4) AS p_retailprice, "
    "CASE WHEN p_brand IS NOT NULL THEN count(*) OVER (PARTITION BY p_brand) END AS p_brand_freq FROM part"))
def q_frequency_encode_part(spark, sf):
    return rounded(FE.frequency_encode(V.table(spark, sf, "part"), 11, 50)[0])


@register("log_transform_events", plain("""
SELECT event_id, ts, user_id, event_type, round(value, 4) AS value, props,
  round(CASE WHEN (SELECT abs(skewness(value)) > 1.5 AND min(value) >= 0 AND count(DISTINCT value) >= 10
                   FROM events) THEN ln(1 + value) END, 4) AS value_log
FROM events"""))
def q_log_transform_events(spark, sf):
    return rounded(FE.log_transform(V.table(spark, sf, "events"), 1.5, 10)[0])


@register("datetime_parts_events", plain("""
SELECT event_id, year(ts)::BIGINT AS ts_year, month(ts)::BIGINT AS ts_month, (isodow(ts) - 1)::BIGINT AS ts_dow,
  coalesce((isodow(ts) - 1 >= 5)::BIGINT, 0) AS ts_is_weekend FROM events"""))
def q_datetime_parts_events(spark, sf):
    df = V.table(spark, sf, "events")
    out, _ = FE.datetime_parts(df, FE.detect_datetime(df))
    return out.select("event_id", "ts_year", "ts_month", "ts_dow", "ts_is_weekend")


@register("duration_order_lines", plain("""
SELECT l_orderkey, l_linenumber,
  floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000)::BIGINT AS duration_days_o_orderdate_to_l_shipdate,
  year(o_orderdate)::BIGINT AS o_orderdate_year, (isodow(l_shipdate) - 1)::BIGINT AS l_shipdate_dow
FROM order_lines""", V.ORDER_LINES_SQL))
def q_duration_order_lines(spark, sf):
    df = V.order_lines(spark, sf)
    parsed = FE.detect_datetime(df)
    out, _ = FE.datetime_parts(df, parsed)
    out, _ = FE.duration_days(out, parsed)
    return out.select("l_orderkey", "l_linenumber", "duration_days_o_orderdate_to_l_shipdate",
                      "o_orderdate_year", "l_shipdate_dow")


@register("interaction_order_lines", plain("""
SELECT l_orderkey, l_linenumber,
  round(CASE WHEN (SELECT abs(corr(l_quantity, amount)) >= 0.5 FROM order_lines) THEN l_quantity * amount END, 4)
  AS l_quantity_x_amount
FROM order_lines""", V.ORDER_LINES_SQL))
def q_interaction_order_lines(spark, sf):
    df = V.order_lines(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "amount")
    out, recs = FE.interaction_term(df, 0.5, 10)
    names = [c for r in recs for c in r["output_columns"]]
    return rounded(out.select("l_orderkey", "l_linenumber", *names))


@register("feature_report_part", plain("""
SELECT * FROM (
  SELECT 'OHE' AS transform_type, 'p_type' AS source_columns,
    'p_type_ECONOMY,p_type_LARGE,p_type_MEDIUM,p_type_PROMO,p_type_SMALL,p_type_STANDARD' AS output_columns
  WHERE (SELECT count(DISTINCT p_type) BETWEEN 2 AND 10 FROM part)
  UNION ALL SELECT 'FREQUENCY_ENCODING', 'p_brand', 'p_brand_freq'
  WHERE (SELECT count(DISTINCT p_brand) BETWEEN 11 AND 50 FROM part)
  UNION ALL SELECT 'SKIPPED_OHE', 'p_name', '' WHERE (SELECT count(DISTINCT p_name) > 50 FROM part)
  UNION ALL SELECT 'LOG_TRANSFORM', 'p_retailprice', 'p_retailprice_log'
  WHERE (SELECT abs(skewness(p_retailprice)) > 1.5 FROM part)
  UNION ALL SELECT 'INTERACTION_TERM', 'p_size,p_retailprice', 'p_size_x_p_retailprice'
  WHERE (SELECT abs(corr(p_size, p_retailprice)) >= 0.5 FROM part)
)"""))
def q_feature_report_part(spark, sf):
    eng = FE.engineer(V.table(spark, sf, "part"))
    return eng.report.select("transform_type", F.concat_ws(",", "source_columns").alias("source_columns"),
                             F.concat_ws(",", "output_columns").alias("output_columns"))


# ---------------------------------------------------------------------------
# B: profiling
# ---------------------------------------------------------------------------

from ..operators import profile as P  # noqa: E402

LINE_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax"]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


@register("numeric_profile", plain(_union([
    f"SELECT '{c}' AS \"column\", round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(avg({c}), 4) AS mean,"
    f" round(stddev_samp({c}), 4) AS std, round(quantile_cont({c}, 0.5), 4) AS median, "
    f"round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.75), 4) AS p75 FROM lineitem"
    for c in LINE_NUMERIC])))
def q_numeric_profile(spark, sf):
    return rounded(P.numeric_profile(V.table(spark, sf, "lineitem")))


def _stats_sql(view: str, cols: list[tuple[str, str, bool]]) -> str:
    parts = []
    for c, dtype, numeric in cols:
        if numeric:
            ind = f"(SELECT count_if({c} NOT IN (0, 1)) = 0 FROM {view})"
            parts.append(
                f"SELECT '{c}' AS name, '{dtype}' AS dtype, count_if({c} IS NULL)::BIGINT AS null_count, "
                f"round(count_if({c} IS NULL) / count(*), 4) AS null_rate, count(DISTINCT {c}) AS unique_count, "
                f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4)::DOUBLE AS min, "
                f"round(max({c}), 4)::DOUBLE AS max, CASE WHEN {ind} THEN NULL ELSE round(skewness({c}), 4) END AS skewness, "
                f"CASE WHEN {ind} THEN NULL ELSE round(kurtosis({c}), 4) END AS kurtosis FROM {view}")
        else:
            parts.append(
                f"SELECT '{c}', '{dtype}', count_if({c} IS NULL)::BIGINT, round(count_if({c} IS NULL) / count(*), 4), "
                f"count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL, NULL FROM {view}")
    return _union(parts)


@register("column_stats", plain(_stats_sql("dirty_orders", [
    ("o_orderkey", "bigint", True), ("cust", "bigint", True), ("status", "string", False),
    ("reading", "double", True), ("priority", "string", False), ("order_date", "timestamp_ntz", False)]),
    V.DIRTY_ORDERS_SQL))
def q_column_stats(spark, sf):
    return P.column_stats(V.dirty_orders(spark, sf))


def events_ext(spark, sf):
    """events with a Unix-second column and a 0/1 flag (derived from the table)."""
    e = V.table(spark, sf, "events")
    return e.select("event_id", "user_id", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts_epoch"),
                    (F.col("event_type") == "click").cast("int").alias("is_click"), "event_type")


EVENTS_EXT_SQL = """
events_ext AS (SELECT event_id, user_id, value, epoch(ts)::BIGINT AS ts_epoch,
  (event_type = 'click')::INTEGER AS is_click, event_type FROM events)"""


def _semantic_sql(view: str, cols: list[str]) -> str:
    from .. import config as K
    parts = []
    for c in cols:
        idn = "true" if O.name_has(c, K.ID_NAME_PATTERNS) else "false"
        tsn = "true" if O.name_has(c, K.TIMESTAMP_NAME_PATTERNS) else "false"
        parts.append(
            f"SELECT '{c}' AS \"column\", CASE WHEN count_if({c} NOT IN (0, 1)) = 0 THEN 'BOOLEAN' "
            f"WHEN {idn} AND count(*) > 0 AND count(DISTINCT {c}) / count(*) >= 0.95 THEN 'ID' "
            f"WHEN {tsn} AND count({c}) > 0 AND min({c}) >= 1000000000 AND max({c}) <= 9999999999 THEN 'TIMESTAMP' "
            f"ELSE 'CONTINUOUS' END AS semantic_type FROM {view}")
    return _union(parts)


EXT_NUM = ["event_id", "user_id", "value", "ts_epoch", "is_click"]


@register("semantic_types", plain(_semantic_sql("events_ext", EXT_NUM), EVENTS_EXT_SQL))
def q_semantic_types(spark, sf):
    return P.semantic_types(events_ext(spark, sf))


def _zero_sql(view: str, cols: list[str], bounds: dict) -> str:
    from .. import config as K
    parts = []
    for c in cols:
        lo = (bounds.get(c) or {}).get("min_bound")
        parts.append(
            f"SELECT '{c}' AS \"column\", CASE WHEN {str(O.name_has(c, K.ZERO_ALWAYS_VALID_PATTERNS)).lower()} "
            f"THEN 'ABSOLUTE_ZERO' WHEN count_if({c} NOT IN (0, 1)) = 0 THEN 'ABSOLUTE_ZERO' "
            f"WHEN {str(O.name_has(c, K.ZERO_MEANINGFUL_KEYWORDS)).lower()} THEN 'ABSOLUTE_ZERO' "
            f"WHEN {str(lo is not None and lo > 0).lower()} THEN 'MISSING_ZERO' "
            f"WHEN count_if({c} <> 0) > 0 AND count_if({c} < 0) = 0 THEN 'MISSING_ZERO' "
            f"ELSE 'BOUNDARY_ZERO' END AS zero_class FROM {view}")
    return _union(parts)


ZERO_VIEW_SQL = """
acct AS (SELECT c_custkey, c_nationkey, c_acctbal, c_acctbal - 1000 AS shifted, (c_custkey % 2) AS parity
         FROM customer)"""


def acct(spark, sf):
    c = V.table(spark, sf, "customer")
    return c.select("c_custkey", "c_nationkey", "c_acctbal", (F.col("c_acctbal") - 1000).alias("shifted"),
                    (F.col("c_custkey") % 2).alias("parity"))


@register("zero_classes", plain(_zero_sql("dirty_lineitem", LINE_NUMERIC, V.DIRTY_LINEITEM_BOUNDS),
                                V.DIRTY_LINEITEM_SQL))
def q_zero_classes(spark, sf):
    return P.classify_zeros(V.dirty_lineitem(spark, sf), V.DIRTY_LINEITEM_BOUNDS)


@register("zero_classes_customer", plain(_zero_sql("acct", ["c_custkey", "c_nationkey", "c_acctbal", "shifted",
                                                            "parity"], {}), ZERO_VIEW_SQL))
def q_zero_classes_customer(spark, sf):
    return P.classify_zeros(acct(spark, sf))


@register("bounds_coverage", plain(_union([
    f"SELECT '{c}' AS \"column\", {str(c in V.DIRTY_ORDERS_BOUNDS).lower()} AS has_bounds, "
    f"(SELECT (count_if(o_orderkey NOT IN (0,1)) > 0)::INT + (count_if(cust NOT IN (0,1)) > 0)::INT + "
    f"(count_if(reading NOT IN (0,1)) > 0)::INT FROM dirty_orders) AS continuous_columns "
    f"FROM dirty_orders HAVING count_if({c} NOT IN (0, 1)) > 0" for c in ORDERS_NUM]), V.DIRTY_ORDERS_SQL))
def q_bounds_coverage(spark, sf):
    return P.bounds_coverage(V.dirty_orders(spark, sf), V.DIRTY_ORDERS_BOUNDS)


def _chart_cols_sql(view: str, cols: list[str]) -> str:
    from .. import config as K
    parts = []
    for c in cols:
        idn = str(O.name_has(c, K.ID_NAME_PATTERNS)).lower()
        eng = str("_x_" in c or c.endswith("_log") or c.endswith("_freq")).lower()
        safe = (f"(count(DISTINCT {c}) > 1 AND NOT ({idn} AND count({c}) > 0 AND "
                f"count(DISTINCT {c}) / count({c}) >= 0.95))")
        parts.append(f"SELECT '{c}' AS \"column\", {safe} AS chart_safe, ({safe} AND count_if({c} NOT IN (0, 1)) > 0"
                     f" AND NOT {eng}) AS continuous FROM {view}")
    return _union(parts)


@register("chart_columns", plain(_chart_cols_sql("events_ext", EXT_NUM), EVENTS_EXT_SQL))
def q_chart_columns(spark, sf):
    return P.chart_columns(events_ext(spark, sf))


@register("dataset_summary", cte(f"""
{ORDERS_DETECT_CTES.strip()}
SELECT (SELECT n FROM anomaly_n)::BIGINT AS row_count, 6 AS col_count, (SELECT count(*) FROM anomalies)::INTEGER AS anomaly_count,
  (SELECT n FROM anomaly_n) || ' rows; 6 columns; numeric: o_orderkey, cust, reading; text: status, priority; '
  || (SELECT count(*) FROM anomalies) || ' anomalies: '
  || (SELECT string_agg(DISTINCT anomaly_type, ', ' ORDER BY anomaly_type) FROM anomalies) || '; intent: cleanup' AS summary""",
    V.DIRTY_ORDERS_SQL))
def q_dataset_summary(spark, sf):
    df = V.dirty_orders(spark, sf)
    det = D.detect(df, V.DIRTY_ORDERS_BOUNDS)
    return P.dataset_summary(df, det.anomalies, "cleanup")


# ---------------------------------------------------------------------------
# F: EDA statistics and chart data
# ---------------------------------------------------------------------------

from ..operators import charts as CH  # noqa: E402
from ..operators import eda as EDA  # noqa: E402

OL_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "amount"]


def _corr_sql(view: str, cols: list[str]) -> str:
    parts = []
    for a in cols:
        for b in cols:
            r = "max(1.0)" if a == b else f"corr({a}, {b})"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({r}, 3) AS r, "
                         f"CASE WHEN abs(round({r}, 3)) >= 0.2 THEN round({r}, 3) ELSE 0.0 END AS r_shown FROM {view}")
    return _union(parts)


@register("pearson_matrix", plain(_corr_sql("order_lines", OL_COLS), V.ORDER_LINES_SQL))
def q_pearson_matrix(spark, sf):
    return EDA.pearson_matrix(V.order_lines(spark, sf), OL_COLS)


@register("correlation_heatmap", plain(f"""
SELECT * FROM (
  SELECT a AS col_a, b AS col_b, round(r, 4) AS r, round(abs(r), 4) AS max_abs_r,
    CASE WHEN abs(r) > 0.8 THEN 'collinear' WHEN abs(r) >= 0.3 THEN 'moderate' ELSE 'weak' END AS label
  FROM ({_union([f"SELECT {i} AS o, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM order_lines"
                 for i, (a, b) in enumerate((a, b) for j, a in enumerate(OL_COLS) for b in OL_COLS[j + 1:])])})
  ORDER BY abs(r) DESC, o LIMIT 1) WHERE max_abs_r >= 0.2""", V.ORDER_LINES_SQL))
def q_correlation_heatmap(spark, sf):
    f = CH.heatmap_facts(V.order_lines(spark, sf), OL_COLS)
    rows = [(f["col_a"], f["col_b"], round(f["r"], 4), round(f["max_abs_r"], 4), f["label"])] if f["emit"] else []
    return spark.createDataFrame(rows, "col_a string, col_b string, r double, max_abs_r double, label string")


SPEAR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _spearman_sql(view: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b, (SELECT corr(ra, rb) FROM (
  SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
         rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
  FROM {view} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)) AS r""")
    return f"""SELECT col_a, col_b, round(abs(r), 3) AS spearman_r, round(r, 3) AS signed_r FROM ({_union(parts)})
WHERE r IS NOT NULL AND NOT isnan(r) ORDER BY abs(r) DESC, col_a DESC, col_b DESC LIMIT 3"""


@register("top_spearman", plain(_spearman_sql("dirty_lineitem", SPEAR_COLS), V.DIRTY_LINEITEM_SQL))
def q_top_spearman(spark, sf):
    return EDA.top_spearman(V.dirty_lineitem(spark, sf), 3, columns=SPEAR_COLS)


@register("scatter_facts", plain("""
SELECT 'l_quantity' AS x, 'amount' AS y, round(r, 4) AS spearman_r,
  CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, abs(r) > 0.5 AS candidate
FROM (SELECT corr(ra, rb) AS r FROM (
  SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS ra,
         rank() OVER (ORDER BY amount) + (count(*) OVER (PARTITION BY amount) - 1) / 2.0 AS rb
  FROM order_lines WHERE l_quantity IS NOT NULL AND amount IS NOT NULL))""", V.ORDER_LINES_SQL))
def q_scatter_facts(spark, sf):
    f = CH.scatter_facts(V.order_lines(spark, sf), "l_quantity", "amount")
    return spark.createDataFrame([(f["x"], f["y"], round(f["spearman_r"], 4), f["strength"], f["direction"],
                                   f["candidate"])],
                                 "x string, y string, spearman_r double, strength string, direction string, "
                                 "candidate boolean")


@register("missingness_hotspots", plain(f"""
SELECT "column", null_rate FROM ({_union([
    f"SELECT {i} AS o, '{c}' AS \"column\", round(count_if({c} IS NULL) / count(*), 3) AS null_rate, "
    f"count_if({c} IS NULL) / count(*) AS raw FROM dirty_orders" for i, c in enumerate(ORDERS_COLS)])})
WHERE raw > 0 ORDER BY raw DESC, o LIMIT 5""", V.DIRTY_ORDERS_SQL))
def q_missingness_hotspots(spark, sf):
    return EDA.missingness_hotspots(V.dirty_orders(spark, sf))


@register("ml_readiness", plain(f"""
SELECT round(greatest(0.0, 100.0 * (1 - ({' + '.join(f'count_if({c} IS NULL) / count(*)' for c in ORDERS_COLS)})
  / {len(ORDERS_COLS)}.0) * (1 - (({' + '.join(f'(stddev_samp({c}) = 0)::INT' for c in ORDERS_NUM)}) / 3.0))), 1)
  AS ml_readiness FROM dirty_orders""", V.DIRTY_ORDERS_SQL))
def q_ml_readiness(spark, sf):
    return EDA.ml_readiness(V.dirty_orders(spark, sf))


@register("cleaning_summary", plain("""
SELECT anomaly_id, action, sentence FROM (VALUES
  ('DUPLICATE_ROWS', 'remove_duplicates', 'Repeated rows taken out: ' || (SELECT n0 - n1 FROM counts) || '.'),
  ('MISSING_DATA|priority', 'drop_rows', 'priority led to ' || (SELECT n1 - n2 FROM counts) || ' dropped rows.'),
  ('MISSING_DATA|reading', 'fill_mean', 'reading had ' || (SELECT f3 FROM counts) || ' gaps filled by the mean.'),
  ('MISSING_DATA|status', 'fill_mode', 'status had ' || (SELECT f4 FROM counts) || ' gaps filled by the mode.'),
  ('LOGICAL_VIOLATION|reading', 'clamp_bounds', 'reading had ' || (SELECT c5 FROM counts) || ' values moved to its limits.'),
  ('HIGH_NULL_DENSITY_ROWS', 'drop_rows', NULL),
  ('MISSING_DATA|cust', 'cap_iqr', 'cust had 0 values moved to its limits.')
) t(anomaly_id, action, sentence) WHERE sentence IS NOT NULL""", V.DIRTY_ORDERS_SQL, CLEAN_CHAIN))
def q_cleaning_summary(spark, sf):
    det, res = _orders_clean(spark, sf)
    return EDA.cleaning_summary(res.changes, det.anomalies)


#: Every turn, with a sentence that holds a keyword (or none) in place of some: the driver's turns hold none.
SPOKEN = ("Please FORECAST sales", "split them into Segments", "is this fraud?", "an Outlier in a model", "nothing of the kind",
          "Show me a plot", "scatterbrained", "a HEATMAP, please", "tell me more")


def spoken(spark, sf):
    c = V.table(spark, sf, "conversations")
    text = F.col("text")
    for i, words in enumerate(SPOKEN):
        text = F.when((F.col("conv_id") * 7 + F.col("turn")) % 12 == i, F.lit(words)).otherwise(text)
    return c.withColumn("text", text)


SPOKEN_SQL = ("spoken AS (SELECT conv_id, turn, role, CASE (conv_id * 7 + turn) % 12 "
              + " ".join(f"WHEN {i} THEN {O.lit(w)}" for i, w in enumerate(SPOKEN)) + " ELSE text END AS text FROM conversations)")


@register("recommend", plain("""
SELECT conv_id, turn, CASE
  WHEN lower(text) LIKE '%predict%' OR lower(text) LIKE '%forecast%' OR lower(text) LIKE '%model%'
    THEN 'Build a predictive modelling baseline: pick features first, then fit a regression or a classifier.'
  WHEN lower(text) LIKE '%cluster%' OR lower(text) LIKE '%segment%' OR lower(text) LIKE '%group%'
    THEN 'Look for clusters: put the numeric columns on one scale, then try k-means or a density method.'
  WHEN lower(text) LIKE '%anomaly%' OR lower(text) LIKE '%outlier%' OR lower(text) LIKE '%fraud%'
    THEN 'Hunt for anomalies next, for instance with an isolation forest or local density scores.'
  ELSE 'The overview is done: look at the strongest correlations and the emptiest columns before any modelling.'
  END AS recommendation FROM spoken""", SPOKEN_SQL))
def q_recommend(spark, sf):
    return EDA.recommend(spoken(spark, sf), "text").select("conv_id", "turn", "recommendation")


@register("histogram", plain("""
WITH mm AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM dirty_lineitem),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 20 ELSE 1.0 END AS width FROM mm)
SELECT least(floor((l_extendedprice - lo) / width), 19)::INTEGER AS bin,
  round(lo + least(floor((l_extendedprice - lo) / width), 19) * width, 4) AS lower,
  round(lo + (least(floor((l_extendedprice - lo) / width), 19) + 1) * width, 4) AS upper, count(*) AS count
FROM dirty_lineitem, w WHERE l_extendedprice IS NOT NULL GROUP BY ALL""".replace("WITH mm", "mm", 1),
    V.DIRTY_LINEITEM_SQL).replace("\nmm AS", ",\nmm AS", 1))
def q_histogram(spark, sf):
    return rounded(CH.histogram(V.dirty_lineitem(spark, sf), "l_extendedprice", 20))


@register("box_stats", plain("""
SELECT 'l_extendedprice' AS "column", round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3,
  round(q3 - q1, 4) AS iqr, round(mx - mn, 4) AS range, round(q1 - 3 * (q3 - q1), 4) AS lower_fence,
  round(q3 + 3 * (q3 - q1), 4) AS upper_fence,
  (SELECT count_if(l_extendedprice < q1 - 3 * (q3 - q1) OR l_extendedprice > q3 + 3 * (q3 - q1)) FROM dirty_lineitem)::BIGINT
  AS outliers, CASE WHEN mx - mn > 0 AND (q3 - q1) / (mx - mn) > 0.4 THEN 'even' ELSE 'concentrated' END AS spread
FROM (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS med,
  quantile_cont(l_extendedprice, 0.75) AS q3, min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM dirty_lineitem)
""", V.DIRTY_LINEITEM_SQL))
def q_box_stats(spark, sf):
    return rounded(CH.box_stats(V.dirty_lineitem(spark, sf), "l_extendedprice", 3.0))


@register("trend", plain("""
SELECT n, round(m1, 4) AS first_mean, round(m2, 4) AS second_mean, round(pct, 4) AS pct,
  CASE WHEN pct > 5 THEN 'upward' WHEN pct < -5 THEN 'downward' ELSE 'flat' END AS trend
FROM (SELECT n, m1, m2, (m2 - m1) / (abs(m1) + 1e-9) * 100 AS pct FROM (
  SELECT count(*) AS n, avg(value) FILTER (WHERE pos <= n_all // 2) AS m1,
         avg(value) FILTER (WHERE pos > n_all // 2) AS m2
  FROM (SELECT value, row_number() OVER (ORDER BY ts NULLS LAST, value) AS pos, count(*) OVER () AS n_all
        FROM events WHERE value IS NOT NULL)))"""))
def q_trend(spark, sf):
    t = CH.trend(V.table(spark, sf, "events"), "ts", "value")
    return spark.createDataFrame([(t["n"], round(t["first_mean"], 4), round(t["second_mean"], 4),
                                   round(t["pct"], 4), t["trend"])],
                                 "n bigint, first_mean double, second_mean double, pct double, trend string")


@register("missingness_map", plain(f"""
SELECT CAST(to_json(list_filter([{', '.join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in ORDERS_COLS)}], lambda x: x IS NOT NULL)) AS VARCHAR) AS pattern,
  ({' + '.join(f'({c} IS NULL)::INT' for c in ORDERS_COLS)}) AS null_columns, count(*) AS rows
FROM dirty_orders GROUP BY 1, 2 HAVING null_columns > 0""", V.DIRTY_ORDERS_SQL))
def q_missingness_map(spark, sf):
    return CH.missingness_map(V.dirty_orders(spark, sf))


@register("chart_sample", plain("""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber) LIMIT 5000"""))
def q_chart_sample(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return CH.chart_sample(li, 5000, ["l_orderkey", "l_linenumber"])


@register("chart_data_bar", plain("""
SELECT l_returnflag, l_linestatus, count(*) AS count, round(sum(l_quantity), 4) AS sum_l_quantity
FROM lineitem GROUP BY ALL"""))
def q_chart_data_bar(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return rounded(CH.chart_data(li, "bar", "l_returnflag", "l_quantity", "l_linestatus"))


OL_ALL = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "amount"]
_PORTFOLIO_SQL = f"""
cc AS ({_chart_cols_sql("order_lines", OL_ALL)}),
flags AS (SELECT {", ".join(f"bool_or(continuous AND \"column\" = '{c}') AS c_{c}" for c in OL_ALL)} FROM cc),
pairs AS ({_union([f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM order_lines"
                    for i, a in enumerate(OL_ALL) for b in OL_ALL[i + 1:]])}),
strong AS (SELECT coalesce(max(abs(r)) FILTER (WHERE ({" OR ".join(f"(a = '{c}' AND c_{c})" for c in OL_ALL)})
                  AND ({" OR ".join(f"(b = '{c}' AND c_{c})" for c in OL_ALL)})), 0) >= 0.2 AS hit FROM pairs, flags),
ncont AS (SELECT {" + ".join(f"c_{c}::INT" for c in OL_ALL)} AS k FROM flags)
SELECT * FROM (
  {_union([f"SELECT 1 AS display_order, 'histogram' AS chart_type, 'Distribution of {c}' AS title, '{c}' AS x_column, "
           f"NULL::VARCHAR AS y_column, 'histogram' AS operator, NULL::VARCHAR AS skip_note FROM flags WHERE c_{c} "
           f"UNION ALL SELECT 2, 'box', 'Box plot — {c}', '{c}', NULL, 'box_stats', NULL FROM flags WHERE c_{c}"
           for c in OL_ALL])}
  UNION ALL SELECT 3, 'heatmap', 'Correlation heatmap', NULL, NULL, 'pearson_matrix', NULL FROM strong, ncont
    WHERE hit AND k >= 2
  UNION ALL SELECT 4, 'splom', 'Scatter matrix', NULL, NULL, 'scatter_matrix', NULL FROM strong, ncont
    WHERE hit AND k >= 2
  UNION ALL SELECT 5, 'line', coalesce({", ".join(f"CASE WHEN c_{c} THEN '{c}' END" for c in OL_ALL)}) || ' over time',
    'o_orderdate', coalesce({", ".join(f"CASE WHEN c_{c} THEN '{c}' END" for c in OL_ALL)}), 'time_line', NULL
    FROM flags, ncont WHERE k > 0
  UNION ALL SELECT 6, 'heatmap', 'Missingness heatmap', NULL, NULL, 'missingness_map', NULL FROM order_lines
    HAVING count_if({" OR ".join(f"{c} IS NULL" for c in OL_ALL + ["p_type", "o_orderdate", "l_shipdate"])}) > 0
)"""


@register("portfolio", cte(_PORTFOLIO_SQL, V.ORDER_LINES_SQL))
def q_portfolio(spark, sf):
    return CH.portfolio(V.order_lines(spark, sf))


@register("scatter_matrix", plain("""
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, round(amount, 4) AS amount FROM order_lines
WHERE (SELECT max(abs(r)) >= 0.2 FROM (SELECT corr(l_quantity, amount) AS r FROM order_lines))""", V.ORDER_LINES_SQL))
def q_scatter_matrix(spark, sf):
    points, _ = CH.scatter_matrix(V.order_lines(spark, sf), key=["l_orderkey", "l_linenumber"])
    return rounded(points)


@register("time_line", plain("""
SELECT date_trunc('day', ts)::TIMESTAMP AS time, count(*) AS count, round(min(value), 4) AS lowest, round(avg(value), 4) AS mean, round(max(value), 4) AS highest
FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1"""))
def q_time_line(spark, sf):
    return rounded(CH.time_line(V.table(spark, sf, "events"), "ts", "value"))


# ---------------------------------------------------------------------------
# G: audit trail views, H: conversation jobs
# ---------------------------------------------------------------------------

from ..operators import conversations as CV  # noqa: E402
from ..operators import trail as TR  # noqa: E402


@register("transform_counts", plain("""
SELECT transform_type, count(*) AS entries, CASE transform_type WHEN 'OHE' THEN 0 WHEN 'FREQUENCY_ENCODING' THEN 1
  WHEN 'LOG_TRANSFORM' THEN 2 WHEN 'DATETIME_EXTRACTION' THEN 3 WHEN 'DURATION' THEN 4 WHEN 'INTERACTION_TERM' THEN 5
  WHEN 'SKIPPED_OHE' THEN 6 WHEN 'NO_TRANSFORMS' THEN 7 ELSE 8 END AS display_order
FROM (""" + SQL["feature_report_part"] + ") GROUP BY transform_type"))
def q_transform_counts(spark, sf):
    part = V.table(spark, sf, "part")
    eng = FE.engineer(part)
    log = TR.audit_log(spark, TR.entries_from_engineer(eng, 0))
    return TR.transform_counts(log)


@register("audit_feed", plain("""
SELECT 'janitor' AS agent_name, 'phase2' AS phase, 'decision ' || action || ' on ' || anomaly_type AS reason,
  column_name AS column_affected, rows_changed::BIGINT AS rows_affected
FROM (""" + SQL["clean_changes"].split("\nSELECT anomaly_id, action, rows_changed::INTEGER", 1)[0] + """
SELECT * FROM (VALUES
  ('DUPLICATE_ROWS', 'remove_duplicates', (SELECT n0 - n1 FROM counts), 'DUPLICATE_ROWS', NULL),
  ('MISSING_DATA|priority', 'drop_rows', (SELECT n1 - n2 FROM counts), 'MISSING_DATA', 'priority'),
  ('MISSING_DATA|reading', 'fill_mean', (SELECT f3 FROM counts), 'MISSING_DATA', 'reading'),
  ('MISSING_DATA|status', 'fill_mode', (SELECT f4 FROM counts), 'MISSING_DATA', 'status'),
  ('LOGICAL_VIOLATION|reading', 'clamp_bounds', (SELECT c5 FROM counts), 'LOGICAL_VIOLATION', 'reading'),
  ('ZERO_AS_MISSING|cust', 'keep_as_is', 0, 'ZERO_AS_MISSING', 'cust'),
  ('HIGH_NULL_DENSITY_ROWS', 'drop_rows', (SELECT n5 - n6 FROM counts), 'HIGH_NULL_DENSITY_ROWS', NULL),
  ('MISSING_DATA|order_date', 'keep_as_is', 0, 'MISSING_DATA', 'order_date'),
  ('MISSING_DATA|cust', 'cap_iqr', 0, 'MISSING_DATA', 'cust'))
  t(anomaly_id, action, rows_changed, anomaly_type, column_name))"""))
def q_audit_feed(spark, sf):
    det, res = _orders_clean(spark, sf)
    log = TR.audit_log(spark, TR.entries_from_detection(det) + TR.entries_from_clean(res, det.records))
    return TR.audit_feed(log, "janitor", "phase2").select("agent_name", "phase", "reason", "column_affected",
                                                          "rows_affected")


_ORDER_STATS_SQL = _stats_sql("dirty_orders", [
    ("o_orderkey", "bigint", True), ("cust", "bigint", True), ("status", "string", False),
    ("reading", "double", True), ("priority", "string", False), ("order_date", "timestamp_ntz", False)])


@register("stat_bands", plain(f"""
SELECT name, null_rate, CASE WHEN null_rate < 0.01 THEN 'clean' WHEN null_rate < 0.20 THEN 'low'
  WHEN null_rate < 0.40 THEN 'elevated' WHEN null_rate < 0.60 THEN 'high' ELSE 'critical' END AS heat_band,
  CASE WHEN null_rate * 100 > 40 THEN 'critical' WHEN null_rate * 100 > 15 THEN 'high' ELSE 'good' END AS bar_band
FROM ({_ORDER_STATS_SQL}) WHERE null_rate > 0 """, V.DIRTY_ORDERS_SQL))
def q_stat_bands(spark, sf):
    return TR.stat_bands(P.column_stats(V.dirty_orders(spark, sf)))


@register("sort_stats", plain(f"""
SELECT name, skewness, (row_number() OVER (ORDER BY skewness ASC NULLS LAST, name) - 1)::INTEGER AS position FROM ({_ORDER_STATS_SQL})""", V.DIRTY_ORDERS_SQL))
def q_sort_stats(spark, sf):
    rows = TR.sort_stats(P.column_stats(V.dirty_orders(spark, sf)), "skewness", True).select("name", "skewness").collect()  # one row a column
    return spark.createDataFrame([(r.name, r.skewness, i) for i, r in enumerate(rows)], "name string, skewness double, position int")


@register("correlation_labels", plain(f"""
SELECT col_a, col_b, spearman_r, signed_r,
  CASE WHEN abs(signed_r) >= 0.7 THEN 'Strong' WHEN abs(signed_r) >= 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength,
  CASE WHEN signed_r >= 0 THEN 'positive' ELSE 'negative' END AS direction
FROM ({_spearman_sql('dirty_lineitem', SPEAR_COLS)})""", V.DIRTY_LINEITEM_SQL))
def q_correlation_labels(spark, sf):
    return TR.correlation_labels(EDA.top_spearman(V.dirty_lineitem(spark, sf), 3, columns=SPEAR_COLS))


_CHART_WORDS = __import__("tableaudit.config", fromlist=["x"]).CHART_KEYWORDS


@register("chart_requests", plain(
    "SELECT conv_id, turn, role FROM spoken WHERE " + " OR ".join(f"contains(lower(text), '{w}')" for w in _CHART_WORDS), SPOKEN_SQL))
def q_chart_requests(spark, sf):
    return CV.chart_requests(spoken(spark, sf)).select("conv_id", "turn", "role")


def part_known(spark, sf):
    """Conversations of which some turns lack the role or the text."""
    c = V.table(spark, sf, "conversations")
    return c.withColumns({"role": F.when(F.col("turn") % 5 != 3, F.col("role")), "text": F.when((F.col("conv_id") + F.col("turn")) % 7 != 2, F.col("text"))})


@register("conversation_context_part_known", plain("""
SELECT conv_id, count(*)::INTEGER AS history_turns, min(turn) AS first_turn,
  coalesce(string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) FILTER (WHERE r <= 6), '') AS context
FROM (SELECT conv_id, turn, CASE WHEN turn % 5 <> 3 THEN role ELSE '' END AS role, CASE WHEN (conv_id + turn) % 7 <> 2 THEN text ELSE '' END AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 10
GROUP BY conv_id"""))
def q_conversation_context_part_known(spark, sf):
    return CV.conversation_context(part_known(spark, sf), 10, 6)


@register("conversation_context", plain("""
SELECT conv_id, count(*)::INTEGER AS history_turns, min(turn) AS first_turn,
  coalesce(string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) FILTER (WHERE r <= 6), '') AS context
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 10
GROUP BY conv_id"""))
def q_conversation_context(spark, sf):
    return CV.conversation_context(V.table(spark, sf, "conversations"), 10, 6)


# ---------------------------------------------------------------------------
# A: ingest
# ---------------------------------------------------------------------------

from ..functions.expressions import NUMBER_TEXT, to_number  # noqa: E402
from ..sources import ingest as IN  # noqa: E402


def raw_values(spark, sf):
    e = V.table(spark, sf, "events")
    k = F.col("event_id")
    v = F.col("value").cast("string")
    raw = (F.when(k % 7 == 0, F.lit("n/a")).when(k % 11 == 0, F.concat(v, F.lit("d")))
           .when(k % 13 == 0, F.concat(F.lit("  "), v, F.lit(" "))).when(k % 17 == 0, F.lit("inf"))
           .when(k % 19 == 0, F.lit("NaN")).otherwise(v))
    return e.select("event_id", raw.alias("raw"))


RAW_VALUES_SQL = """
raw_values AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN value::VARCHAR || 'd'
  WHEN event_id % 13 = 0 THEN '  ' || value::VARCHAR || ' ' WHEN event_id % 17 = 0 THEN 'inf'
  WHEN event_id % 19 = 0 THEN 'NaN' ELSE value::VARCHAR END AS raw FROM events)"""


@register("to_number", plain(f"""
SELECT event_id, raw, round(CASE WHEN isnan(x) THEN NULL ELSE x END, 4) AS num FROM (
  SELECT event_id, raw, CASE WHEN regexp_matches(raw, '{NUMBER_TEXT.replace(chr(92), chr(92))}')
    THEN TRY_CAST(trim(raw) AS DOUBLE) END AS x FROM raw_values)""", RAW_VALUES_SQL))
def q_to_number(spark, sf):
    r = raw_values(spark, sf)
    return r.select("event_id", "raw", F.round(to_number(F.col("raw"), r.schema["raw"].dataType), 4).alias("num"))


@register("finite_or_null", plain("""
SELECT event_id, round(CASE WHEN isinf(x) OR isnan(x) THEN NULL ELSE x END, 4) AS x FROM (
  SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'inf'::DOUBLE WHEN event_id % 7 = 0 THEN '-inf'::DOUBLE
    WHEN event_id % 9 = 0 THEN 'nan'::DOUBLE ELSE value END AS x FROM events)"""))
def q_finite_or_null(spark, sf):
    e = V.table(spark, sf, "events")
    k = F.col("event_id")
    x = (F.when(k % 5 == 0, F.lit(float("inf"))).when(k % 7 == 0, F.lit(float("-inf")))
         .when(k % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return rounded(IN.finite_or_null(e.select("event_id", x.alias("x"))))


def customer_text(spark, sf):
    """customer with every column as text and messy header names."""
    c = V.table(spark, sf, "customer")
    names = {"c_custkey": "C CustKey", "c_name": "c-Name", "c_nationkey": "C__NationKey ",
             "c_acctbal": "  c acctbal", "c_mktsegment": "C.MktSegment"}
    return c.select(*[F.col(k).cast("string").alias(v) for k, v in names.items()])


@register("normalise_headers", plain("""
SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey,
  c_acctbal::VARCHAR AS c_acctbal, c_mktsegment FROM customer"""))
def q_normalise_headers(spark, sf):
    return IN.normalise_headers(customer_text(spark, sf))[0]


def _type_sql(c: str) -> str:
    v = f"{c}::VARCHAR"
    whole = f"regexp_matches({v}, '^[+-]?[0-9]+$')"
    return (f"SELECT '{c}' AS \"column\", CASE WHEN count({c}) = 0 THEN 'string' WHEN bool_and(lower({v}) IN ('true', 'false')) THEN 'boolean' "
            f"WHEN bool_and({whole} AND TRY_CAST({v} AS BIGINT) IS NOT NULL) THEN 'bigint' WHEN bool_and({whole}) THEN 'decimal(38,0)' "
            f"WHEN bool_and(TRY_CAST({v} AS DOUBLE) IS NOT NULL) THEN 'double' ELSE 'string' END AS inferred_type FROM typed")


@register("infer_types", plain(_union([_type_sql(c) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "rich", "serial")]),
    "typed AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, c_acctbal > 0 AS rich, '1234567890123456789' || (c_custkey % 10) AS serial FROM customer)"))
def q_infer_types(spark, sf):
    df, _ = IN.normalise_headers(customer_text(spark, sf))
    rich = F.when(F.col("c_acctbal").cast("double") > 0, "True").otherwise("False")
    serial = F.concat(F.lit("1234567890123456789"), (F.col("c_custkey").cast("bigint") % 10).cast("string"))
    return IN.inferred_schema(df.withColumns({"rich": rich, "serial": serial}))


# ---------------------------------------------------------------------------
# C: stand-alone checks and per-row flags
# ---------------------------------------------------------------------------

from .. import config as _K  # noqa: E402


@register("pii_scan_documents", plain(_union([
    f"SELECT '{c}' AS column_name, '{name}' AS pii_type, count_if(regexp_matches({c}, {O.lit(p)}))::BIGINT AS matches "
    f"FROM documents" for c in ("text", "lang", "source") for name, p in _K.PII_PATTERNS.items()])))
def q_pii_scan_documents(spark, sf):
    return D.detect_pii(V.table(spark, sf, "documents").select("text", "lang", "source"))


@register("detect_duplicates", plain("""
SELECT coalesce(sum(w - 1), 0)::BIGINT AS duplicate_rows, count_if(w > 1)::BIGINT AS duplicated_groups
FROM (SELECT count(*) AS w FROM dirty_orders GROUP BY ALL)""".replace("GROUP BY ALL",
    "GROUP BY o_orderkey, cust, status, reading, priority, order_date"), V.DIRTY_ORDERS_SQL))
def q_detect_duplicates(spark, sf):
    return D.detect_duplicates(V.dirty_orders(spark, sf))


@register("detect_missing", plain(_union([
    f"SELECT '{c}' AS column_name, count_if({c} IS NULL{' OR ' + BLANK.format(c) if c in ORDERS_TEXT else ''})"
    f"::BIGINT AS missing_count, count_if({c} IS NULL) / count(*) AS null_rate FROM dirty_orders"
    for c in ORDERS_COLS]), V.DIRTY_ORDERS_SQL))
def q_detect_missing(spark, sf):
    return D.detect_missing(V.dirty_orders(spark, sf))


@register("detect_sparse_rows", plain(f"""
SELECT count_if({ORD_SHARE} > 0.5)::BIGINT AS sparse_rows, round(avg(CASE WHEN {ORD_SHARE} > 0.5 THEN {ORD_SHARE} END), 4)
  AS mean_null_density FROM dirty_orders""", V.DIRTY_ORDERS_SQL))
def q_detect_sparse_rows(spark, sf):
    return rounded(D.detect_sparse_rows(V.dirty_orders(spark, sf), 0.5))


_FLAG_SQL = f"""
{ORDERS_DETECT_CTES.strip()},
numbered AS (SELECT d.*, row_number() OVER (PARTITION BY o_orderkey, cust, status, reading, priority, order_date)
             AS copy_no FROM dirty_orders d),
flags AS (SELECT o_orderkey, copy_no > 1 AS is_duplicate,
  (o_orderkey IS NULL OR cust IS NULL OR status IS NULL OR {BLANK.format('status')} OR reading IS NULL
   OR priority IS NULL OR {BLANK.format('priority')} OR order_date IS NULL) AS is_missing,
  (coalesce(mz_0 AND o_orderkey = 0, false) OR coalesce(mz_1 AND cust = 0, false)
   OR coalesce(mz_2 AND reading = 0, false)) AS is_zero_missing,
  coalesce(reading < 1000 OR reading > 600000, false) AS is_logical_violation,
  (coalesce(o_orderkey < lo_0 OR o_orderkey > hi_0, false) OR coalesce(cust < lo_1 OR cust > hi_1, false)
   OR coalesce(reading < lo_2 OR reading > hi_2, false)) AS is_outlier,
  {ORD_SHARE} > 0.5 AS is_sparse
  FROM numbered, fz)
SELECT *, CASE WHEN is_duplicate THEN 'DUPLICATE_ROWS' WHEN is_missing THEN 'MISSING_DATA'
  WHEN is_zero_missing THEN 'ZERO_AS_MISSING' WHEN is_logical_violation THEN 'LOGICAL_VIOLATION'
  WHEN is_outlier THEN 'STATISTICAL_OUTLIER' END AS first_tier FROM flags"""


@register("flag_rows", cte(_FLAG_SQL, V.DIRTY_ORDERS_SQL))
def q_flag_rows(spark, sf):
    df = V.dirty_orders(spark, sf)
    det = D.detect(df, V.DIRTY_ORDERS_BOUNDS)
    return D.flag_rows(df, det).select("o_orderkey", "is_duplicate", "is_missing", "is_zero_missing",
                                       "is_logical_violation", "is_outlier", "is_sparse", "first_tier")


_EXAMPLES = [("DUPLICATE_ROWS", "is_duplicate")] + [(f"MISSING_DATA|{c}", f"NOT is_duplicate AND ({c} IS NULL{blank})") for c, blank in (
    ("cust", ""), ("status", " OR trim(status) = ''"), ("reading", ""), ("priority", " OR trim(priority) = ''"), ("order_date", ""))] + [
    ("LOGICAL_VIOLATION|reading", "NOT is_duplicate AND NOT is_missing AND reading <> 0 AND (reading < 1000 OR reading > 600000)")]


def stored_dirty_orders(spark, sf):
    """The dirty orders as files, in the order of their keys."""
    path = _scratch(spark, "dirty_orders")
    V.dirty_orders(spark, sf).orderBy("o_orderkey").write.parquet(path)
    return spark.read.parquet(path)


@register("anomaly_examples", cte(f"""
stored AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, row_number() OVER (PARTITION BY o_orderkey) > 1 AS is_duplicate,
   (o_orderkey IS NULL OR cust IS NULL OR coalesce(trim(status) = '', true) OR reading IS NULL OR coalesce(trim(priority) = '', true) OR order_date IS NULL) AS is_missing FROM dirty_orders),
claims AS ({" UNION ALL ".join(f"SELECT '{a}' AS anomaly_id, place FROM stored WHERE {p}" for a, p in _EXAMPLES)}),
ranked AS (SELECT anomaly_id, CAST(row_number() OVER (PARTITION BY anomaly_id ORDER BY place) AS INTEGER) AS example, place AS row_number FROM claims)
SELECT * FROM ranked WHERE example <= 5""", V.DIRTY_ORDERS_SQL))
def q_anomaly_examples(spark, sf):
    df = stored_dirty_orders(spark, sf)
    kinds = [a for a, _ in _EXAMPLES]
    return D.example_rows(df, D.detect(df, V.DIRTY_ORDERS_BOUNDS)).where(F.col("anomaly_id").isin(kinds))


@register("remove_duplicates_stored", plain("SELECT DISTINCT * FROM dirty_orders", V.DIRTY_ORDERS_SQL))
def q_remove_duplicates_stored(spark, sf):
    return CL.remove_duplicates(stored_dirty_orders(spark, sf))


@register("distribution_facts", plain("""
SELECT 'l_extendedprice' AS "column", count(l_extendedprice) AS n, round(skewness(l_extendedprice), 4) AS skewness,
  round(kurtosis(l_extendedprice), 4) AS kurtosis, round(avg(l_extendedprice), 4) AS mean,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(stddev_samp(l_extendedprice), 4) AS std,
  round(stddev_samp(l_extendedprice) / abs(avg(l_extendedprice)), 4) AS cv,
  CASE WHEN skewness(l_extendedprice) > 0.5 THEN 'right-skewed' WHEN skewness(l_extendedprice) < -0.5
    THEN 'left-skewed' ELSE 'approximately symmetric' END AS shape,
  CASE WHEN stddev_samp(l_extendedprice) / abs(avg(l_extendedprice)) < 0.3 THEN 'low'
    WHEN stddev_samp(l_extendedprice) / abs(avg(l_extendedprice)) < 0.7 THEN 'moderate' ELSE 'high' END AS cv_label,
  abs(skewness(l_extendedprice)) > 1.0 AS suggest_transform
FROM dirty_lineitem""", V.DIRTY_LINEITEM_SQL))
def q_distribution_facts(spark, sf):
    f = CH.distribution_facts(V.dirty_lineitem(spark, sf), "l_extendedprice")
    r4_ = lambda v: round(v, 4)
    return spark.createDataFrame(
        [(f["column"], f["n"], r4_(f["skewness"]), r4_(f["kurtosis"]), r4_(f["mean"]), r4_(f["median"]),
          r4_(f["std"]), r4_(f["cv"]), f["shape"], f["cv_label"], f["suggest_transform"])],
        "column string, n bigint, skewness double, kurtosis double, mean double, median double, std double, "
        "cv double, shape string, cv_label string, suggest_transform boolean")


# ---------------------------------------------------------------------------
# Exact keys, dates in many forms, files read back, whole runs
# ---------------------------------------------------------------------------

BIG_SQL = "big AS (SELECT o_orderkey + 1152921504606846976 AS order_id, o_custkey + 1152921504606846976 AS cust_ref FROM orders)"


def big(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.select((F.col("o_orderkey") + F.lit(1 << 60)).alias("order_id"), (F.col("o_custkey") + F.lit(1 << 60)).alias("cust_ref"))


@register("column_stats_big_ids", plain(_union([
    f"SELECT '{c}' AS name, count_if({c} IS NULL)::BIGINT AS null_count, count(DISTINCT {c}) AS unique_count FROM big" for c in ("order_id", "cust_ref")]), BIG_SQL))
def q_column_stats_big_ids(spark, sf):
    return P.column_stats(big(spark, sf)).select("name", "null_count", "unique_count")


@register("semantic_types_big_ids", plain(_union([
    f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) / count(*) >= 0.95 AND {str(named).lower()} THEN 'ID' ELSE 'CONTINUOUS' END AS semantic_type FROM big"
    for c, named in (("order_id", True), ("cust_ref", False))]), BIG_SQL))
def q_semantic_types_big_ids(spark, sf):
    return P.semantic_types(big(spark, sf))


@register("clean_fill_mode_date", plain("""
SELECT o_orderkey, cust, status, round(reading, 4) AS reading, priority, coalesce(order_date, (SELECT order_date FROM dirty_orders
  WHERE order_date IS NOT NULL GROUP BY order_date ORDER BY count(*) DESC, order_date LIMIT 1)) AS order_date FROM dirty_orders""", V.DIRTY_ORDERS_SQL))
def q_clean_fill_mode_date(spark, sf):
    return rounded(CL.apply_one(V.dirty_orders(spark, sf), {"anomaly_type": "MISSING_DATA", "column_name": "order_date"}, "fill_mode").df)


#: Ways to write a day: Spark's pattern (None: a number of seconds).
DAY_FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd", "M/d/yyyy", "MM/dd/yyyy HH:mm", "MMM d yyyy", "d-MMM-yyyy", "dd.MM.yyyy", "yyyyMMdd", "yyyy/MM/dd",
             "yyyy-MM-dd hh:mm:ss a", "MMM d yyyy HH:mm", "d MMMM yyyy HH:mm", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "MM-dd-yyyy", "yyyy.MM.dd", "M/d/yy", "yyyyMMdd'T'HHmmss", "MMMM d, yyyy")


def written_dates(spark, sf):
    """Events whose time is text in nineteen forms, and Unix seconds."""
    e = V.table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp_ntz")
    text = F.lit(None).cast("string")
    for i, form in enumerate(DAY_FORMS):
        text = F.when(F.col("event_id") % len(DAY_FORMS) == i, F.date_format(ts, form)).otherwise(text)
    return e.select("event_id", text.alias("created_text"), F.floor(FE.wall_micros(ts) / 1_000_000).cast("double").alias("created_epoch"))


@register("datetime_parts_written", plain(f"""
SELECT event_id, {", ".join(f"year(ts)::BIGINT AS {c}_year, month(ts)::BIGINT AS {c}_month, (isodow(ts) - 1)::BIGINT AS {c}_dow, (isodow(ts) >= 6)::BIGINT AS {c}_is_weekend"
                           for c in ("created_text", "created_epoch"))} FROM events"""))
def q_datetime_parts_written(spark, sf):
    df = written_dates(spark, sf)
    out, _ = FE.datetime_parts(df, FE.detect_datetime(df))
    return out.select("event_id", *[f"{c}_{part}" for c in ("created_text", "created_epoch") for part in ("year", "month", "dow", "is_weekend")])


@register("engineered_part", plain("""
SELECT p_partkey, """ + ", ".join(f"CASE WHEN p_type = '{v}' THEN 1 ELSE 0 END::INTEGER AS \"p_type_{v}\"" for v in PART_TYPES) + """,
  CASE WHEN p_brand IS NOT NULL THEN count(*) OVER (PARTITION BY p_brand) END AS p_brand_freq FROM part"""))
def q_engineered_part(spark, sf):
    return FE.engineer(V.table(spark, sf, "part")).df.select("p_partkey", *[f"p_type_{v}" for v in PART_TYPES], "p_brand_freq")


def _scratch(spark, name: str) -> str:
    """A fresh path in the session's shared checkpoint folder."""
    import uuid

    from ..session import checkpoint_dir
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def quoted_turns(spark, sf):
    c = V.table(spark, sf, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"),
                    F.concat(F.lit('say "'), F.col("text"), F.lit('", ok\nand, more')).alias("text"))


@register("csv_round_trip", plain("""
SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, 'say "' || text || '", ok' || chr(10) || 'and, more' AS text FROM conversations"""))
def q_csv_round_trip(spark, sf):
    path = _scratch(spark, "turns")
    quoted_turns(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return IN.read_table(spark, path, "csv")[0]


@register("validate_csv", plain("""
SELECT * FROM (VALUES ('readable', true), ('has_columns', true), ('has_rows', (SELECT count(*) > 0 FROM conversations)), ('row_shape', true)) t("check", passed)"""))
def q_validate_csv(spark, sf):
    path = _scratch(spark, "turns")
    quoted_turns(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return IN.validate_input(spark, path).select("check", "passed")


from ..sources import sinks as SK  # noqa: E402


@register("validate_csv_ragged", plain("""
SELECT 'row_shape' AS "check", count(*) FILTER (turn % 5 = 3) = 0 AS passed, count(*) FILTER (turn % 5 = 3) || ' row(s) have a different number of fields than the header.' AS message FROM conversations"""))
def q_validate_csv_ragged(spark, sf):
    """Quoted texts with line ends; every turn 3, 8 ... has a field too few."""
    c = V.table(spark, sf, "conversations")
    text = F.concat(F.lit('"'), F.regexp_replace("text", '"', '""'), F.lit('\nand, more"'))
    line = F.when(F.col("turn") % 5 == 3, F.concat_ws(",", "conv_id", text)).otherwise(F.concat_ws(",", "conv_id", "turn", text))
    # The first row of every file begins with the header.
    begins = F.monotonically_increasing_id() % (1 << 33) == 0
    path = _scratch(spark, "ragged")
    c.select(F.when(begins, F.concat(F.lit("conv_id,turn,text\n"), line)).otherwise(line).alias("value")).write.text(path)
    return IN.validate_input(spark, path).where(F.col("check") == "row_shape")


@register("write_table_read_back", plain("SELECT * FROM nation"))
def q_write_table_read_back(spark, sf):
    path = _scratch(spark, "table")
    SK.write_table(V.table(spark, sf, "nation"), path, partition_by=["n_regionkey"])
    return spark.read.parquet(path).select(*V.table(spark, sf, "nation").columns)


@register("write_reports_read_back", plain(f"""
SELECT name, null_count, 'run1' AS run_id FROM ({_ORDER_STATS_SQL})""", V.DIRTY_ORDERS_SQL))
def q_write_reports_read_back(spark, sf):
    base = _scratch(spark, "reports")
    stats = P.column_stats(V.dirty_orders(spark, sf))
    for run in ("run0", "run1", "run1"):  # a run written twice is there once, and one of no rows takes its own away
        SK.write_reports({"stats": stats}, base, run)
    SK.write_reports({"stats": stats.limit(0)}, base, "run0")
    return spark.read.parquet(f"{base}/stats").select("name", "null_count", "run_id")


@register("audit_log_read_back", plain("""
SELECT reason, rows_affected, position FROM (""" + SQL["clean_changes"].split("\nSELECT anomaly_id, action, rows_changed::INTEGER", 1)[0] + """
SELECT 'decision ' || action || ' on ' || anomaly_type AS reason, rows_changed::BIGINT AS rows_affected, position FROM (VALUES
  ('remove_duplicates', 'DUPLICATE_ROWS', (SELECT n0 - n1 FROM counts), 0), ('drop_rows', 'MISSING_DATA', (SELECT n1 - n2 FROM counts), 1),
  ('fill_mean', 'MISSING_DATA', (SELECT f3 FROM counts), 2), ('fill_mode', 'MISSING_DATA', (SELECT f4 FROM counts), 3),
  ('clamp_bounds', 'LOGICAL_VIOLATION', (SELECT c5 FROM counts), 4), ('keep_as_is', 'ZERO_AS_MISSING', 0, 5),
  ('drop_rows', 'HIGH_NULL_DENSITY_ROWS', (SELECT n5 - n6 FROM counts), 6), ('keep_as_is', 'MISSING_DATA', 0, 7), ('cap_iqr', 'MISSING_DATA', 0, 8)
) t(action, anomaly_type, rows_changed, position))"""))
def q_audit_log_read_back(spark, sf):
    """The appended audit table, read back in the order of its times."""
    det, res = _orders_clean(spark, sf)
    path = _scratch(spark, "audit")
    for _ in range(2):  # a run written twice is there once
        TR.append_audit(TR.audit_log(spark, TR.entries_from_clean(res, det.records)), path, "run1")
    rows = TR.audit_feed(spark.read.parquet(path), "janitor").select("reason", "rows_affected").collect()  # one row a decision
    return spark.createDataFrame([(r.reason, r.rows_affected, i) for i, r in enumerate(rows)], "reason string, rows_affected bigint, position int")


@register("audit_facets", plain("SELECT * FROM (VALUES ('agent', 'janitor'), ('agent', 'orchestrator'), ('phase', 'phase1'), ('phase', 'phase2')) t(facet, value) "
                                "WHERE (SELECT count(*) FROM orders) > 0"))
def q_audit_facets(spark, sf):
    det, res = _orders_clean(spark, sf)
    return TR.audit_facets(TR.audit_log(spark, TR.entries_from_detection(det) + TR.entries_from_clean(res, det.records)))


@register("run_history", plain("""
SELECT o_orderkey AS run, o_orderdate AS created_at, count(*) OVER ()::INTEGER AS total_runs,
  (row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1)::BIGINT AS position FROM orders"""))
def q_run_history(spark, sf):
    runs = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("created_at"))
    return TR.run_history(runs, position=True).withColumn("total_runs", F.col("total_runs").cast("int"))


@register("revise_orders", plain(f"SELECT {OUT} FROM dirty_orders WHERE NOT (priority IS NULL OR {BLANK.format('priority')})", V.DIRTY_ORDERS_SQL))
def q_revise_orders(spark, sf):
    df = V.dirty_orders(spark, sf)
    det = D.detect(df, V.DIRTY_ORDERS_BOUNDS)
    return rounded(CL.revise(df, det, [{"anomaly_id": "MISSING_DATA|priority", "action": "drop_rows"}], "first").df)


@register("narrative_notes", plain(f"""
SELECT (row_number() OVER (ORDER BY o) - 1)::INTEGER AS position, note FROM (
  SELECT 0 AS o, 'On average ' || printf('%.1f', 100 * m) || '% of a column is empty: fill the gaps or drop columns.' AS note
  FROM (SELECT ({' + '.join(f'count_if({c} IS NULL)' for c in ORDERS_COLS)}) / (count(*) * {len(ORDERS_COLS)}.0) AS m FROM dirty_orders) WHERE m > 0.1
  UNION ALL SELECT 2, 'No two numeric columns move together; derived columns may help.' WHERE false)""", V.DIRTY_ORDERS_SQL))
def q_narrative_notes(spark, sf):
    return EDA.narrative_notes(V.dirty_orders(spark, sf))


@register("eda_bundle", plain("SELECT count(*) AS row_count, 6 AS col_count, 3 AS numeric, 2 AS categorical, 1 AS datetimes FROM dirty_orders", V.DIRTY_ORDERS_SQL))
def q_eda_bundle(spark, sf):
    e = EDA.eda(V.dirty_orders(spark, sf), "predict")
    return spark.createDataFrame([(e.row_count, e.col_count, len(e.numeric_cols), len(e.categorical_cols), len(e.datetime_cols))],
                                 "row_count bigint, col_count int, numeric int, categorical int, datetimes int")


def hollow_orders(spark, sf):
    """Orders with many gaps, a constant and a rank that goes with the price."""
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(F.when(k % 2 == 0, F.col("o_totalprice")).alias("price"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("status"), F.lit(7.0).alias("flat"))


@register("narrative_notes_hollow", plain("""
SELECT (row_number() OVER (ORDER BY o) - 1)::INTEGER AS position, note FROM (
  SELECT 0 AS o, 'On average ' || printf('%.1f', 100 * m) || '% of a column is empty: fill the gaps or drop columns.' AS note
  FROM (SELECT (count_if(o_orderkey % 2 <> 0) + count_if(o_orderkey % 3 <> 0)) / (count(*) * 3.0) AS m FROM orders) WHERE m > 0.1
  UNION ALL SELECT 1, 'Constant and of no use to a model or chart: 1 columns.'
  UNION ALL SELECT 2, 'No two numeric columns move together; derived columns may help.' WHERE (SELECT count(*) > 0 FROM orders))"""))
def q_narrative_notes_hollow(spark, sf):
    return EDA.narrative_notes(hollow_orders(spark, sf))


@register("eda_report", plain("""
SELECT 'stat' AS part, name AS item, null_rate AS value, unique_count::VARCHAR AS text FROM (""" + plain(_ORDER_STATS_SQL, V.DIRTY_ORDERS_SQL) + """)
UNION ALL SELECT 'hotspot', "column", null_rate, NULL FROM (""" + SQL["missingness_hotspots"] + """)
UNION ALL SELECT 'readiness', NULL, ml_readiness, NULL FROM (""" + SQL["ml_readiness"] + """)
UNION ALL SELECT 'note', NULL, position, note FROM (""" + SQL["narrative_notes"] + """)
UNION ALL SELECT 'recommendation', NULL, NULL, 'Build a predictive modelling baseline: pick features first, then fit a regression or a classifier.'
UNION ALL SELECT 'kind', name, NULL, CASE WHEN dtype IN ('bigint', 'double') THEN 'numeric' WHEN dtype = 'string' THEN 'categorical' ELSE 'datetime' END FROM (""" + plain(_ORDER_STATS_SQL, V.DIRTY_ORDERS_SQL) + ")"))
def q_eda_report(spark, sf):
    """The parts of the narrative of one table, one row for each of their statements."""
    e = EDA.eda(V.dirty_orders(spark, sf), "predict churn")
    kinds = [("kind", c, None, kind) for kind, cols in (("numeric", e.numeric_cols), ("categorical", e.categorical_cols), ("datetime", e.datetime_cols)) for c in cols]
    said = [("readiness", None, e.ml_readiness, None), ("recommendation", None, None, e.recommendation), *kinds, *[("note", None, float(i), n) for i, n in enumerate(e.notes)]]
    rows = spark.createDataFrame(said, "part string, item string, value double, text string")
    stats = e.column_stats.select(F.lit("stat").alias("part"), F.col("name").alias("item"), F.col("null_rate").alias("value"), F.col("unique_count").cast("string").alias("text"))
    hot = e.hotspots.select(F.lit("hotspot").alias("part"), F.col("column").alias("item"), F.col("null_rate").alias("value"), F.lit(None).cast("string").alias("text"))
    return rows.unionByName(stats).unionByName(hot)


@register("engineered_events", plain("SELECT event_id, value_log, ts_year, ts_month, ts_dow, ts_is_weekend FROM (" + SQL["log_transform_events"] + ") JOIN (" + SQL["datetime_parts_events"] + ") USING (event_id)"))
def q_engineered_events(spark, sf):
    """The log and date columns of one whole feature run."""
    out = FE.engineer(V.table(spark, sf, "events")).df
    return rounded(out.select("event_id", "value_log", "ts_year", "ts_month", "ts_dow", "ts_is_weekend"))


@register("row_limit_warning", plain("SELECT CASE WHEN count(*) > 50000 THEN 'Dataset has more than 50,000 rows — processing continues.' END AS warning FROM lineitem"))
def q_row_limit_warning(spark, sf):
    return spark.createDataFrame([(IN.row_limit_warning(V.table(spark, sf, "lineitem")),)], "warning string")


@register("column_kinds", plain("""
SELECT 'events' AS "table", column_name AS "column", CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' WHEN column_type = 'VARCHAR' THEN 'categorical' ELSE 'datetime' END AS kind
FROM (DESCRIBE SELECT * FROM events)
UNION ALL SELECT 'lineitem', column_name, CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' WHEN column_type = 'VARCHAR' THEN 'categorical' ELSE 'datetime' END
FROM (DESCRIBE SELECT * FROM lineitem)"""))
def q_column_kinds(spark, sf):
    from ..functions.expressions import column_kinds
    rows = [(t, c, kind) for t in ("events", "lineitem") for kind, cols in column_kinds(V.table(spark, sf, t)).items() for c in cols]
    return spark.createDataFrame(rows, "table string, column string, kind string")


@register("chart_data_scatter", plain("SELECT l_quantity, round(l_extendedprice, 4) AS l_extendedprice, l_returnflag FROM lineitem"))
def q_chart_data_scatter(spark, sf):
    return rounded(CH.chart_data(V.table(spark, sf, "lineitem"), "scatter", "l_quantity", "l_extendedprice", "l_returnflag"))


@register("chart_data_line", plain("""
SELECT l_shipdate, count(*) AS count, round(min(l_quantity), 4) AS lowest, round(avg(l_quantity), 4) AS mean, round(max(l_quantity), 4) AS highest
FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY l_shipdate"""))
def q_chart_data_line(spark, sf):
    return rounded(CH.chart_data(V.table(spark, sf, "lineitem"), "line", "l_shipdate", "l_quantity"))


register("chart_data_histogram", SQL["histogram"])(lambda spark, sf: rounded(CH.chart_data(V.dirty_lineitem(spark, sf), "histogram", "l_extendedprice")))
register("chart_data_box", SQL["box_stats"])(lambda spark, sf: rounded(CH.chart_data(V.dirty_lineitem(spark, sf), "box", "l_extendedprice")))


@register("box_outliers", plain("""
SELECT round(l_extendedprice, 4) AS l_extendedprice, round(greatest(1000 - l_extendedprice, l_extendedprice - 200000), 4) AS distance
FROM dirty_lineitem WHERE l_extendedprice < 1000 OR l_extendedprice > 200000""", V.DIRTY_LINEITEM_SQL))
def q_box_outliers(spark, sf):
    return rounded(CH.box_outliers(V.dirty_lineitem(spark, sf), "l_extendedprice", 1000.0, 200000.0))
