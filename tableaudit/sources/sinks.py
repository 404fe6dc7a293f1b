"""Sinks for cleaned/engineered tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import finite_frame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a cleaned or engineered table (CSV with a header, or parquet)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_reports(reports: dict[str, DataFrame], base: str, run_id: str) -> None:
    """Each report (anomalies, changes, features, charts ...) under ``base/<name>`` partitioned by
    ``run_id``; NaN/Inf written as null. A run's rows are committed as a whole: a repeated run replaces its own, one that
    fails leaves what was there, other runs are not touched."""
    for name, df in reports.items():
        write_run(finite_frame(df), f"{base.rstrip('/')}/{name}", run_id)


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """Write the rows of one run, in place of those that it wrote before."""
    rows = df.withColumn("run_id", F.lit(run_id))
    if rows.isEmpty():  # has no partition to replace: its folder is replaced by one without rows
        rows.drop("run_id").write.mode("overwrite").parquet(f"{path}/run_id={_escaped(run_id)}")
    else:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def _escaped(value: str) -> str:
    """A partition value as Spark writes it in a path."""
    return "".join(c if c.isalnum() or c in "-_. " else f"%{ord(c):02X}" for c in value)
