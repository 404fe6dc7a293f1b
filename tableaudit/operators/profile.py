"""B: projection, typing and profiling.

All per-column facts come from at most two jobs (``moments`` and the
unpivoted ``value_profile``); the rules that turn them into types and
classes run on the driver over one small record per column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..config import DEFAULT, AuditConfig
from ..functions import stats as S
from ..session import reused
from ..functions.expressions import col, column_kinds, exact_keys, name_has, number_of

__all__ = [
    "Facts", "facts", "numeric_profile", "column_stats", "semantic_types", "semantic_type_of",
    "classify_zeros", "domain_bounds", "bounds_coverage", "chart_columns", "dataset_summary",
    "column_kinds",
]


@dataclass
class Facts:
    """Small per-column facts of one table (driver side)."""
    n: int
    kinds: dict[str, list[str]]
    num: dict[str, S.NumStats]
    nulls: dict[str, int]
    distinct: dict[str, int] = field(default_factory=dict)
    quant: dict[str, list] = field(default_factory=dict)

    def numeric(self) -> list[str]:
        return self.kinds["numeric"]


def facts(df: DataFrame, cfg: AuditConfig = DEFAULT, distinct: bool = True, exact: bool = False) -> Facts:
    """Moments of numeric columns, null counts of all, and distinct counts: ``exact`` ones, or such as
    decide every rule as the exact ones do (from sketches, where these decide)."""
    with reused(df) as df:
        return _facts(df, distinct, exact)


def _facts(df: DataFrame, distinct: bool, exact: bool) -> Facts:
    kinds = column_kinds(df)
    exprs = {c: number_of(df, c) for c in kinds["numeric"]}
    n, num, nulls = S.moments(df, exprs, {c: col(c) for c in df.columns})
    fx = Facts(n=n, kinds=kinds, num=num, nulls=nulls)
    if distinct:
        keys = distinct_keys(df, exprs)
        if exact:
            keys |= {c: col(c) for c in df.columns if c not in exprs and _groupable(df, c)}
        fx.distinct = S.distinct_counts(df, keys) if exact else S.distinct_for(df, keys, distinct_marks(n, num))
    return fx


def distinct_keys(df: DataFrame, exprs: dict[str, Column]) -> dict[str, Column]:
    """What tells numbers apart: the value, and its exact text where a double can't."""
    exact = exact_keys(df, exprs)
    return {c: F.when(e.isNotNull(), F.struct(e.cast("double").alias("v"), exact[c].alias("t"))) if c in exact else e.cast("double") for c, e in exprs.items()}


def distinct_marks(n: int, num: dict[str, S.NumStats], least: int = DEFAULT.min_unique_for_transform) -> dict[str, list[float]]:
    """The distinct counts at which a rule on a numeric column changes its answer."""
    few = [1, 2, least - 1, least]
    return {c: [*few, n * C.ID_CARDINALITY_THRESHOLD, s.count * C.ID_CARDINALITY_THRESHOLD] for c, s in num.items()}


def _groupable(df: DataFrame, c: str) -> bool:
    dt = df.schema[c].dataType
    return not isinstance(dt, (T.MapType, T.ArrayType, T.StructType, T.BinaryType))


# ---------------------------------------------------------------------------
# B2 numeric profile
# ---------------------------------------------------------------------------

def numeric_profile(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Per numeric column: min, max, mean, sample std, median, p25, p75 (all-null skipped)."""
    fx = facts(df, cfg, distinct=False)
    exprs = {c: number_of(df, c) for c in fx.numeric() if fx.num[c].count}
    qs = S.quantiles(df, exprs, (0.25, 0.5, 0.75), cfg.quantiles, cfg.approx_accuracy)
    rows = []
    for c in exprs:
        s = fx.num[c]
        p25, med, p75 = qs[c]
        rows.append((c, s.min, s.max, s.mean, s.std, med, p25, p75))
    schema = ("column string, min double, max double, mean double, std double, "
              "median double, p25 double, p75 double")
    return df.sparkSession.createDataFrame(rows, schema)


# ---------------------------------------------------------------------------
# B3 column stats
# ---------------------------------------------------------------------------

COLUMN_STATS_SCHEMA = ("name string, dtype string, null_count bigint, null_rate double, "
                       "unique_count bigint, mean double, std double, min double, max double, "
                       "skewness double, kurtosis double")


def _r4(v):
    """To four places; what isn't a finite number is null."""
    return None if v is None or not math.isfinite(v) else round(float(v), 4)


def column_stats_rows(df: DataFrame, fx: Facts) -> list[tuple]:
    rows = []
    for f in df.schema.fields:
        c = f.name
        s = fx.num.get(c)
        has = s is not None and s.count > 0
        # 0/1 indicators have no meaningful shape
        indicator = has and s.nonbinary == 0
        rows.append((
            c, f.dataType.simpleString(), fx.nulls[c],
            round(fx.nulls[c] / fx.n, 4) if fx.n else None,
            fx.distinct.get(c),
            _r4(s.mean) if has else None, _r4(s.std) if has else None,
            _r4(s.min) if has else None, _r4(s.max) if has else None,
            None if (indicator or not has) else _r4(s.skew),
            None if (indicator or not has) else _r4(s.kurt),
        ))
    return rows


def column_stats(df: DataFrame, cfg: AuditConfig = DEFAULT, fx: Facts | None = None) -> DataFrame:
    """Per column: dtype, nulls, null rate (4 dp), distinct, mean, std, min, max, skew, kurtosis."""
    fx = fx or facts(df, cfg, distinct=True, exact=True)
    return df.sparkSession.createDataFrame(column_stats_rows(df, fx), COLUMN_STATS_SCHEMA)


# ---------------------------------------------------------------------------
# B4 semantic types, B5 zero classes
# ---------------------------------------------------------------------------

def semantic_type_of(name: str, s: S.NumStats, n_rows: int, n_distinct: int | None, names: C.NamePatterns = C.NAMES) -> str:
    if s.nonbinary == 0:
        return "BOOLEAN"
    if n_rows > 0 and n_distinct is not None and n_distinct / n_rows >= C.ID_CARDINALITY_THRESHOLD \
            and name_has(name, names.identifier):
        return "ID"
    if name_has(name, names.timestamp) and s.count > 0 \
            and C.UNIX_TS_MIN <= s.min and s.max <= C.UNIX_TS_MAX:
        return "TIMESTAMP"
    return "CONTINUOUS"


def semantic_types(df: DataFrame, cfg: AuditConfig = DEFAULT, fx: Facts | None = None) -> DataFrame:
    """BOOLEAN / ID / TIMESTAMP / CONTINUOUS per numeric column."""
    fx = fx or facts(df, cfg, distinct=True)
    rows = [(c, semantic_type_of(c, fx.num[c], fx.n, fx.distinct.get(c), cfg.names)) for c in fx.numeric()]
    return df.sparkSession.createDataFrame(rows, "column string, semantic_type string")


def zero_class_of(name: str, s: S.NumStats, bounds: dict, names: C.NamePatterns = C.NAMES) -> str:
    if name_has(name, names.zero_valid):
        return "ABSOLUTE_ZERO"
    if s.nonbinary == 0:
        return "ABSOLUTE_ZERO"
    if name_has(name, names.zero_meaningful):
        return "ABSOLUTE_ZERO"
    lo = (bounds.get(name) or {}).get("min_bound")
    if lo is not None and lo > 0:
        return "MISSING_ZERO"
    if s.count - s.zeros > 0 and s.negatives == 0:
        return "MISSING_ZERO"
    return "BOUNDARY_ZERO"


def classify_zeros(df: DataFrame, bounds=None, cfg: AuditConfig = DEFAULT,
                   fx: Facts | None = None) -> DataFrame:
    """ABSOLUTE_ZERO / MISSING_ZERO / BOUNDARY_ZERO per numeric column."""
    b = domain_bounds(bounds, df.columns)
    fx = fx or facts(df, cfg, distinct=False)
    rows = [(c, zero_class_of(c, fx.num[c], b, cfg.names)) for c in fx.numeric()]
    return df.sparkSession.createDataFrame(rows, "column string, zero_class string")


# ---------------------------------------------------------------------------
# B6 bounds, B7 coverage, B8 chart columns, B9 summary
# ---------------------------------------------------------------------------

def domain_bounds(bounds, columns: list[str] | None = None) -> dict[str, dict]:
    """Validity range per column from a dict or a small DataFrame
    ``(column, min_bound, max_bound[, description])``; unknown columns dropped."""
    if bounds is None:
        return {}
    if isinstance(bounds, DataFrame):
        rows = bounds.collect()  # one row per column of the audited table
        bounds = {r["column"]: {"min_bound": r["min_bound"], "max_bound": r["max_bound"],
                                "description": r.asDict().get("description") or ""} for r in rows}
    out = {}
    for c, b in bounds.items():
        if columns is not None and c not in columns:
            continue
        if isinstance(b, (tuple, list)):
            b = {"min_bound": b[0], "max_bound": b[1], "description": b[2] if len(b) > 2 else ""}
        out[c] = dict(b)
    return out


def bounds_coverage(df: DataFrame, bounds=None, cfg: AuditConfig = DEFAULT,
                    fx: Facts | None = None) -> DataFrame:
    """Continuous numeric columns (not all in {0,1}) and whether they have bounds."""
    b = domain_bounds(bounds, df.columns)
    fx = fx or facts(df, cfg, distinct=False)
    cont = [c for c in fx.numeric() if fx.num[c].nonbinary > 0]
    rows = [(c, c in b, len(cont)) for c in cont]
    return df.sparkSession.createDataFrame(rows, "column string, has_bounds boolean, continuous_columns int")


def coverage_warning(df: DataFrame, bounds, fx: Facts) -> str | None:
    b = domain_bounds(bounds, df.columns)
    cont = [c for c in fx.numeric() if fx.num[c].nonbinary > 0]
    missing = [c for c in cont if c not in b]
    if not missing:
        return None
    return f"No valid range is known for {', '.join(missing)} ({len(missing)} of {len(cont)} continuous columns): their values are not checked against one."


def is_engineered(name: str) -> bool:
    return C.ENGINEERED_INFIX in name or any(name.endswith(s) for s in C.ENGINEERED_SUFFIXES)


def chart_flags(name: str, s: S.NumStats, n_distinct: int | None, names: C.NamePatterns = C.NAMES) -> tuple[bool, bool]:
    """(chart_safe, continuous_chart_safe) for one numeric column."""
    d = n_distinct or 0
    safe = d > 1
    if safe and s.count > 0 and d / s.count >= C.ID_CARDINALITY_THRESHOLD \
            and name_has(name, names.identifier):
        safe = False
    cont = safe and s.nonbinary > 0 and not is_engineered(name)
    return safe, cont


def chart_columns(df: DataFrame, cfg: AuditConfig = DEFAULT, fx: Facts | None = None) -> DataFrame:
    """Numeric columns fit for charts (heat map) and for distribution charts."""
    fx = fx or facts(df, cfg, distinct=True)
    rows = []
    for c in fx.numeric():
        safe, cont = chart_flags(c, fx.num[c], fx.distinct.get(c), cfg.names)
        rows.append((c, safe, cont))
    return df.sparkSession.createDataFrame(rows, "column string, chart_safe boolean, continuous boolean")


def continuous_columns(fx: Facts, names: C.NamePatterns = C.NAMES) -> list[str]:
    return [c for c in fx.numeric() if chart_flags(c, fx.num[c], fx.distinct.get(c), names)[1]]


def dataset_summary_text(n: int, df: DataFrame, anomaly_types: list[str], intent: str = "", names: int | None = None) -> str:
    """One line on a table: rows, columns by kind, intent and anomaly types. With ``names``
    at most so many columns of a kind are named, and how many more there are."""
    def listed(columns: list[str]) -> str:
        shown = columns if names is None else columns[:names]
        return ", ".join(shown) + (f" and {len(columns) - len(shown)} more" if len(shown) < len(columns) else "")

    kinds = column_kinds(df)
    parts = [f"{n} rows", f"{len(df.columns)} columns", f"numeric: {listed(kinds['numeric'])}", f"text: {listed(kinds['categorical'])}",
             f"{len(anomaly_types)} anomalies: {', '.join(sorted(set(anomaly_types)))}", f"intent: {intent or 'not given'}"]
    return "; ".join(parts)


def dataset_summary(df: DataFrame, anomalies: DataFrame | None = None, intent: str = "") -> DataFrame:
    """One compact line describing the table and its anomaly report."""
    n = df.count()
    types = [r["anomaly_type"] for r in anomalies.select("anomaly_type").collect()] if anomalies is not None else []
    text = dataset_summary_text(n, df, types, intent)
    return df.sparkSession.createDataFrame([(n, len(df.columns), len(types), text)],
                                           "row_count bigint, col_count int, anomaly_count int, summary string")
