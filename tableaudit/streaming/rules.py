"""Cleaning rules on a stream.

A batch ``clean`` run compiles every decision into literals (fences,
bounds, fill values) and one row predicate, so the result is a stateless
projection + filter. The same expressions apply to each micro-batch of a
Structured Streaming source with the same schema. Duplicate removal needs
state across batches and is not offered here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.expressions import nan_to_null
from ..operators.clean import CleanResult


def stream_rules(result: CleanResult):
    rules = result.extra.get("rules")
    if rules is None:
        raise ValueError("decisions include remove_duplicates, which needs state across batches")
    return rules


def apply_rules(stream: DataFrame, result: CleanResult) -> DataFrame:
    """Apply a compiled cleaning run to a streaming (or batch) DataFrame."""
    alive, exprs = stream_rules(result)
    return nan_to_null(stream).where(alive).select(*[e.alias(c) for c, e in exprs.items()])


def flag_stream(stream: DataFrame, det) -> DataFrame:
    """Per-row tier flags (T2-T5 with the batch fences) on a stream; duplicates
    are not flagged since they need state."""
    from pyspark.sql import functions as F

    from ..functions.expressions import any_of
    cols = {}
    for tier, name in (("MISSING_DATA", "is_missing"), ("ZERO_AS_MISSING", "is_zero_missing"),
                       ("LOGICAL_VIOLATION", "is_logical_violation"), ("STATISTICAL_OUTLIER", "is_outlier")):
        cols[name] = any_of([ck.pred for ck in det.checks if ck.anomaly_type == tier])
    base = nan_to_null(stream)
    return base.select("*", *[e.alias(k) for k, e in cols.items()]).withColumn("flagged", F.lit(True) & any_of(
        [F.col(k) for k in cols]))
