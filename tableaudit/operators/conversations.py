"""H: jobs over the ``conversations`` table (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C


def chart_requests(conv: DataFrame, text_col: str = "text") -> DataFrame:
    """H1: turns whose lower-cased text contains any chart word."""
    low = F.lower(F.col(text_col))
    cond = F.lit(False)
    for w in C.CHART_KEYWORDS:
        cond = cond | low.contains(w)
    return conv.where(cond)


def last_turns(conv: DataFrame, n: int = 10, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Last ``n`` turns per conversation. Spark limits each conversation to its ``n`` last turns in
    every map task before the one shuffle (WindowGroupLimit), so a conversation that
    holds a third of all rows sends at most ``n`` rows a task."""
    latest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return conv.withColumn("__r", F.row_number().over(latest)).where(F.col("__r") <= n).drop("__r")


def conversation_context(conv: DataFrame, history: int = 10, context: int = 6) -> DataFrame:
    """H2: per conversation, the last ``history`` turns in time order and a
    context string of the last ``context`` of them as ``ROLE: text`` lines; a null role or text is empty."""
    last = last_turns(conv, history)
    g = last.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))  # <= history rows
    tail = F.slice(F.col("turns"), F.greatest(F.size("turns") - context + 1, F.lit(1)), context)
    lines = F.transform(tail, lambda t: F.concat(F.upper(F.coalesce(t["role"], F.lit(""))), F.lit(": "), F.coalesce(t["text"], F.lit(""))))
    return g.select("conv_id", F.size("turns").alias("history_turns"),
                    F.element_at(F.col("turns"), 1)["turn"].alias("first_turn"),
                    F.concat_ws("\n", lines).alias("context"))
