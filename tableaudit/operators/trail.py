"""G: audit trail and report views.

Audit entries are small report rows (one per action); they are built as a
DataFrame, appended to a table, and read back with filters and sorts.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import positions as PO
from ..sources.sinks import write_run

AUDIT_SCHEMA = ("agent_name string, phase string, action string, reason string, column_affected string, "
                "rows_affected bigint, before_value string, after_value string, is_llm_decision boolean, "
                "timestamp timestamp")


def audit_log(spark: SparkSession, entries: list[dict], start: _dt.datetime | None = None,
              action_max: int | None = None) -> DataFrame:
    """G1: one row per action; entries without a timestamp get increasing ones
    from ``start`` (keeps the order). With ``action_max`` longer action texts
    are cut and end with how many characters are left out."""
    t0 = start or _dt.datetime(2000, 1, 1)
    rows = []
    for i, e in enumerate(entries):
        rows.append((e.get("agent_name"), e.get("phase"), _shortened(e.get("action") or "", action_max), e.get("reason"),
                     e.get("column_affected"), e.get("rows_affected"), e.get("before_value"),
                     e.get("after_value"), bool(e.get("is_llm_decision", False)),
                     e.get("timestamp") or t0 + _dt.timedelta(milliseconds=i)))
    return spark.createDataFrame(rows, AUDIT_SCHEMA)


def _shortened(text: str, most: int | None) -> str:
    if most is None or len(text) <= most:
        return text
    mark = f" [+{len(text)}]"
    kept = max(0, most - len(mark))
    return text[:kept] + f" [+{len(text) - kept}]"


def append_audit(log: DataFrame, path: str, run_id: str) -> None:
    """Add a run's entries to the audit table (parquet, partitioned by run); the same run written again replaces its entries."""
    write_run(log, path, run_id)


def _entry(agent: str, phase: str, action: str, reason: str, rows: int, column: str | None = None) -> dict:
    return {"agent_name": agent, "phase": phase, "action": action, "reason": reason, "rows_affected": rows, "column_affected": column}


def entries_from_detection(det) -> list[dict]:
    found = sum(r["affected_rows"] for r in det.records)
    return [_entry("orchestrator", "phase1", f"detection found {len(det.records)} kinds of anomaly; the table scores {det.score:.1f}", "all tiers ran", found)]


def entries_from_clean(res, records: list[dict]) -> list[dict]:
    of = {str(r["anomaly_id"]): r for r in records}
    nothing: dict = {}
    return [_entry("janitor", "phase2", ch["description"], f"decision {ch['action']} on {of.get(str(ch['anomaly_id']), nothing).get('anomaly_type')}",
                   ch["rows_changed"], of.get(str(ch["anomaly_id"]), nothing).get("column_name")) for ch in res.change_rows]


def entries_from_engineer(eng, rows: int) -> list[dict]:
    # One row per transform.
    return [_entry("engineer", "phase2", r["description"], r["transform_type"], rows if r["output_columns"] else 0, next(iter(r["source_columns"] or []), "N/A"))
            for r in eng.report.collect()]


def audit_feed(log: DataFrame, agent: str = "all", phase: str = "all") -> DataFrame:
    """Entries for one agent and/or phase ("all" = no filter), oldest first."""
    out = log
    if agent != "all":
        out = out.where(F.col("agent_name") == agent)
    if phase != "all":
        out = out.where(F.col("phase") == phase)
    return out.orderBy("timestamp")


def audit_facets(log: DataFrame) -> DataFrame:
    """The distinct agents and phases a feed can be filtered on."""
    return (log.select(F.lit("agent").alias("facet"), F.col("agent_name").alias("value"))
            .union(log.select(F.lit("phase"), F.col("phase"))).distinct())


def transform_counts(log: DataFrame) -> DataFrame:
    """Engineer entries per transform type, in the fixed display order."""
    order = F.create_map(*[x for i, t in enumerate(C.TRANSFORM_TYPES) for x in (F.lit(t), F.lit(i))])
    return (log.where(F.col("agent_name") == "engineer").groupBy(F.col("reason").alias("transform_type"))
            .agg(F.count(F.lit(1)).alias("entries"))
            .withColumn("display_order", F.coalesce(F.element_at(order, F.col("transform_type")),
                                                    F.lit(len(C.TRANSFORM_TYPES)))))


def run_history(runs: DataFrame, created_col: str = "created_at", position: bool = False) -> DataFrame:
    """Runs newest first, each with the total run count. With ``position`` each has
    its place in that order, numbered over the sorted ranges instead of in one window."""
    total = runs.count()
    ordered = runs.withColumn("total_runs", F.lit(total)).orderBy(F.desc(created_col), *[c for c in runs.columns if c != created_col])
    if not position:
        return ordered
    return PO.numbered(runs.withColumn("total_runs", F.lit(total)), [F.desc(created_col), *[F.col(c) for c in runs.columns if c != created_col]], "position")


def run_detail(anomalies: DataFrame, run_id: str, run_col: str = "run_id") -> DataFrame:
    """One run's records in display order."""
    return anomalies.where(F.col(run_col) == run_id).orderBy("display_order")


def sort_stats(stats: DataFrame, key: str = "null_rate", ascending: bool = False) -> DataFrame:
    """Column stats sorted on any column, nulls last in both directions, ties by name."""
    c = F.col(key)
    return stats.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), "name")


def null_band(rate):
    r = F.least(F.lit(1.0), F.greatest(F.lit(0.0), rate))
    return (F.when(r < 0.01, "clean").when(r < 0.20, "low").when(r < 0.40, "elevated")
            .when(r < 0.60, "high").otherwise("critical"))


def stat_bands(stats: DataFrame) -> DataFrame:
    """Heat-map band per column with nulls (worst first) and the table bar band."""
    pct = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("null_rate") * 100))
    return (stats.where(F.col("null_rate") > 0)
            .select("name", "null_rate", null_band(F.col("null_rate")).alias("heat_band"),
                    F.when(pct > 40, "critical").when(pct > 15, "high").otherwise("good").alias("bar_band"))
            .orderBy(F.desc("null_rate"), "name"))


def correlation_labels(corrs: DataFrame, column: str = "signed_r") -> DataFrame:
    """Strength and direction labels; rows without a finite r are dropped."""
    r = F.col(column)
    valid = r.isNotNull() & ~F.isnan(r) & (F.abs(r) != float("inf"))
    return (corrs.where(valid)
            .withColumn("strength", F.when(F.abs(r) >= 0.7, "Strong").when(F.abs(r) >= 0.4, "Moderate")
                        .otherwise("Weak"))
            .withColumn("direction", F.when(r >= 0, "positive").otherwise("negative")))
