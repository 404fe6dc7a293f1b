"""D: cleaning, one operator per user decision, and the decision compiler.

``clean`` keeps one Column expression per output column and one running
row predicate, all written over a *base* DataFrame. Every decision rewrites
them; nothing runs until a decision needs a statistic of the current table
(mean, median, mode), which costs one job over ``base.where(alive)``.
The ``rows_changed`` counter of each decision is an expression over the same
base, so all counters are gathered in one aggregate at the end (or when the
base changes at ``remove_duplicates``). The cleaned table is a single
projection + filter over the base: Catalyst pushes the filters and prunes
columns down to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..config import DEFAULT, AuditConfig
from ..functions import positions as PO
from ..functions import stats as S
from ..functions.expressions import (col, is_numeric, is_text, missing, name_has, nan_to_null,
                                     to_number)
from ..session import reused
from .detect import quality_score, row_digest

KEEP = ("keep_as_is", "keep_all")
CHANGES_SCHEMA = "anomaly_id string, action string, description string, rows_changed bigint, coerced_to_null bigint"


@dataclass
class CleanResult:
    df: DataFrame
    changes: DataFrame
    change_rows: list[dict]
    score_after: float
    rows_after: int
    resolved: list[str]
    parent_run_id: str | None = None
    extra: dict = field(default_factory=dict)


def shown(v) -> str:
    """A number for a description: four significant digits."""
    return "none" if v is None else f"{float(v):.4g}"


def least_possible(name: str, names: C.NamePatterns = C.NAMES) -> Column | None:
    """Zero for columns whose name says that they cannot be negative."""
    return F.lit(0.0) if name_has(name, names.nonnegative) else None


def as_records(anomalies) -> list[dict]:
    """Anomaly report as dicts (the report is one row per anomaly: small)."""
    if anomalies is None:
        return []
    if isinstance(anomalies, DataFrame):
        return [r.asDict() for r in anomalies.collect()]
    if hasattr(anomalies, "records"):
        return list(anomalies.records)
    return list(anomalies)


def as_decisions(decisions) -> list[dict]:
    if decisions is None:
        return []
    if isinstance(decisions, DataFrame):
        rows = [r.asDict(recursive=True) for r in decisions.collect()]
    else:
        rows = [dict(d) for d in decisions]
    for d in rows:
        d["params"] = d.get("params") or {}
    return rows


class _State:
    """Column expressions and row predicate over a base DataFrame."""

    def __init__(self, base: DataFrame):
        self.set_base(base)

    def set_base(self, base: DataFrame):
        self.base = base
        self.exprs: dict[str, Column] = {c: col(c) for c in base.columns}
        self.types: dict[str, T.DataType] = {f.name: f.dataType for f in base.schema.fields}
        self.alive: Column = F.lit(True)
        self.counters: dict[str, Column] = {}

    def num(self, c: str) -> Column:
        return to_number(self.exprs[c], self.types[c])

    def missing(self, c: str) -> Column:
        return missing(self.exprs[c], self.types[c])

    def null_share(self) -> Column:
        n = max(len(self.exprs), 1)
        total = F.lit(0)
        for e in self.exprs.values():
            total = total + e.isNull().cast("int")
        return total / F.lit(float(n))

    def current(self) -> DataFrame:
        return self.base.where(self.alive).select(*[e.alias(c) for c, e in self.exprs.items()])

    def count_rows(self, key: str):
        """Deferred count of the rows alive now."""
        self.counters[key] = F.when(self.alive, 1).otherwise(0)

    def count_where(self, key: str, pred: Column):
        """Deferred count of alive rows where ``pred`` holds (null is false)."""
        self.counters[key] = F.when(self.alive & F.coalesce(pred, F.lit(False)), 1).otherwise(0)

    def flush(self) -> dict:
        longs = dict(self.counters)
        longs["__rows_now"] = F.when(self.alive, 1).otherwise(0)
        out = S.sums(self.base, longs)
        self.counters = {}
        return out


# ---------------------------------------------------------------------------
# Actions: each rewrites the state for one decision and describes what it does
# ---------------------------------------------------------------------------

class Step:
    """One decision on its way into the state."""

    def __init__(self, st: _State, anomaly: dict, params: dict, key: str, cfg: AuditConfig):
        self.st, self.anomaly, self.params, self.key, self.cfg = st, anomaly, params, key, cfg
        self.kind, name = anomaly["anomaly_type"], anomaly.get("column_name")
        self.column = name if name and name in st.exprs else None

    def rows(self) -> DataFrame:
        return self.st.base.where(self.st.alive)

    def number(self) -> Column:
        return self.st.num(self.column)

    def bound(self, name: str, asked: bool = False) -> float | None:
        """``lower_bound`` / ``upper_bound`` of the anomaly, or with ``asked`` the decision's own."""
        own = self.params.get({"lower_bound": "min_bound", "upper_bound": "max_bound"}[name]) if asked else None
        found = self.anomaly.get(name) if own is None else own
        return None if found is None else float(found)

    def limits(self, asked: bool = False) -> tuple[float, float] | None:
        low, high = self.bound("lower_bound", asked), self.bound("upper_bound", asked)
        return None if low is None or high is None else (low, high)

    def outside(self, low: float, high: float) -> Column:
        x = self.number()
        return F.coalesce(~x.between(low, high), F.lit(False))

    def share_limit(self) -> float:
        asked = self.params.get("threshold", self.anomaly.get("threshold"))
        return 0.5 if asked is None else float(asked)

    def changes(self, where: Column) -> None:
        """Count the rows that the decision changes."""
        self.st.count_where(self.key, where)

    def becomes(self, value: Column, dtype: T.DataType | None = None) -> None:
        """Put ``value`` in the column; as a number it counts the texts that are none and so get lost."""
        if dtype is None:
            dtype = T.DoubleType()
            if is_text(self.st.types[self.column]):
                self.st.count_where(self.key + "_lost", self.st.exprs[self.column].isNotNull() & value.isNull() & self.number().isNull())
        self.st.exprs[self.column], self.st.types[self.column] = value, dtype


def _drop_column(s: Step) -> str | None:
    if s.column is None:
        return None
    s.st.count_rows(s.key)
    del s.st.exprs[s.column], s.st.types[s.column]
    return f"removed column {s.column}"


def _rows_to_drop(s: Step) -> tuple[Column, str] | None:
    """The rows that a drop decision takes out, by type of anomaly."""
    if s.kind == "HIGH_NULL_DENSITY_ROWS":
        return s.st.null_share() > s.share_limit(), "that are mostly empty"
    if s.column is None:
        return None
    ranged = {"STATISTICAL_OUTLIER": "beyond the fences of", "LOGICAL_VIOLATION": "outside the valid range of"}
    if s.kind in ranged:
        return s.outside(*s.limits()), f"{ranged[s.kind]} {s.column}"
    simple = {"MISSING_DATA": (s.st.missing, "without"), "ZERO_AS_MISSING": (lambda c: s.st.num(c) == 0, "with a zero in")}
    if s.kind in simple:
        test, words = simple[s.kind]
        return F.coalesce(test(s.column), F.lit(False)), f"{words} {s.column}"
    return None


def _drop_rows(s: Step) -> str:
    found = _rows_to_drop(s)
    if found is None:
        return "left as it is: no rule says which rows to drop"
    gone, words = found
    s.changes(gone)
    s.st.alive = s.st.alive & ~gone
    return f"dropped {{rows}} rows {words}"


def _put_mean(s: Step, wrong: Column, words: str) -> str:
    """Replace the values that ``wrong`` marks by the mean of the others."""
    x = s.number()
    mean = s.rows().agg(F.avg(F.when(~wrong, x))).first()[0]
    s.changes(wrong)
    s.becomes(F.when(wrong, F.lit(mean)).otherwise(x))
    return f"put the mean of the other values ({shown(mean)}) for {{rows}} {words} of {s.column}"


def _fill_with(s: Step, value: float | None, name: str) -> str:
    if value is None:
        return f"left as it is: {s.column} has no numbers to take a {name} of"
    x = s.number()
    s.changes(x.isNull())
    s.becomes(F.coalesce(x, F.lit(float(value))))
    return f"filled {{rows}} gaps of {s.column} with the {name} ({shown(value)})"


def _fill_mean(s: Step) -> str | None:
    if s.column is None:
        return _fill_sparse_rows(s) if s.kind == "HIGH_NULL_DENSITY_ROWS" else None
    if s.kind == "STATISTICAL_OUTLIER":
        return _put_mean(s, s.outside(*s.limits()), "outliers")
    if s.kind == "ZERO_AS_MISSING":
        return _put_mean(s, F.coalesce(s.number() == 0, F.lit(False)), "zeros")
    return _fill_with(s, s.rows().agg(F.avg(s.number())).first()[0], "mean")


def _fill_median(s: Step) -> str | None:
    if s.column is None:
        return None
    return _fill_with(s, S.quantiles(s.rows(), {s.column: s.number()}, (0.5,), s.cfg.quantiles, s.cfg.approx_accuracy)[s.column][0], "median")


def _fill_mode(s: Step) -> str | None:
    if s.column is None:
        return None
    if is_numeric(s.st.types[s.column]):  # a column of numbers with gaps takes its median
        return f"{_fill_median(s)}, as it holds numbers"
    raw, dtype = s.st.exprs[s.column], s.st.types[s.column]
    # Counted in the column's own type; the smallest of equally frequent values.
    top = (s.rows().select(raw.alias("v")).where("v IS NOT NULL").groupBy("v").count()
           .orderBy(F.desc("count"), "v").limit(1).select(F.col("v").cast("string")).collect())
    if not top:
        return f"left as it is: {s.column} has no value to take"
    s.changes(raw.isNull())
    s.becomes(F.coalesce(raw, F.lit(top[0][0]).cast(dtype)), dtype)
    return f"filled {{rows}} gaps of {s.column} with its most frequent value ({top[0][0]})"


def _fill_sparse_rows(s: Step) -> str:
    """On rows over the null-share threshold, numeric nulls become column means."""
    st = s.st
    numbers = {c: st.num(c) for c in st.exprs if is_numeric(st.types[c])}
    if not numbers:
        return "left as it is: no column holds numbers"
    row = s.rows().agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(numbers.values())]).first()
    means = {c: m for c, m in zip(numbers, row) if m is not None}
    sparse = st.null_share() > s.share_limit()
    gaps = {c: sparse & numbers[c].isNull() for c in means}
    st.counters[s.key] = F.when(st.alive, sum((g.cast("int") for g in gaps.values()), F.lit(0))).otherwise(0)
    for c, m in means.items():
        st.exprs[c], st.types[c] = F.when(gaps[c], F.lit(float(m))).otherwise(numbers[c]), T.DoubleType()
    return "filled {rows} gaps in mostly empty rows with column means"


def _limit_to(s: Step, low, high, words: str) -> str:
    x, low = s.number(), low if isinstance(low, Column) else F.lit(low)
    s.changes(x.isNotNull() & ((x < low) | (x > high)))
    s.becomes(F.when(x.isNotNull(), F.least(F.greatest(x, low), F.lit(high))))
    return f"moved {{rows}} values of {s.column} to {words}"


def _cap_iqr(s: Step) -> str | None:
    found = s.column and s.limits()
    if not found:
        return None
    low, floor = F.lit(found[0]), least_possible(s.column, s.cfg.names)
    return _limit_to(s, low if floor is None else F.greatest(low, floor), found[1], f"the fences around {shown(found[0])} to {shown(found[1])}")


def _clamp_bounds(s: Step) -> str | None:
    found = s.column and s.limits(asked=True)
    return _limit_to(s, *found, f"the range {shown(found[0])} to {shown(found[1])}") if found else None


def _treat_as_missing(s: Step) -> str | None:
    found = s.column and s.limits()
    if not found:
        return None
    wrong = s.outside(*found)
    s.changes(wrong)
    s.becomes(F.when(~wrong, s.number()))
    return f"emptied {{rows}} values of {s.column} that lie outside its range"


def _overwrite(s: Step, value: Column, words: str) -> str:
    s.st.count_rows(s.key)
    s.becomes(value, T.StringType())
    return f"{words} every value of {s.column}"


def _redact(s: Step) -> str | None:
    return s.column and _overwrite(s, F.lit(C.REDACTED), "blacked out")


def _hash(s: Step) -> str | None:
    return s.column and _overwrite(s, F.sha2(s.st.exprs[s.column].cast("string"), 256), "put a SHA-256 digest for")


ACTIONS = {
    "drop_column": _drop_column, "drop_rows": _drop_rows, "fill_mean": _fill_mean, "fill_median": _fill_median, "fill_mode": _fill_mode,
    "cap_iqr": _cap_iqr, "clamp_bounds": _clamp_bounds, "treat_as_missing": _treat_as_missing, "redact": _redact, "hash_sha256": _hash,
}


def clean(df: DataFrame, anomalies, decisions, cfg: AuditConfig = DEFAULT,
          parent_run_id: str | None = None) -> CleanResult:
    """Apply decisions in order on the evolving table; count real changes.

    ``rows_changed`` counts the rows (or values) that a decision changes,
    ``coerced_to_null`` the texts that are no numbers and are lost as a column becomes numeric."""
    recs = as_records(anomalies)
    with reused(nan_to_null(df)) as base:
        return _clean(base, recs, decisions, cfg, parent_run_id)


def _clean(base: DataFrame, recs: list[dict], decisions, cfg: AuditConfig,
           parent_run_id: str | None) -> CleanResult:
    plain = lambda i: str(i).replace("-", "")
    by_id = {plain(r["anomaly_id"]): r for r in recs}
    st, counted, rebased = _State(base), {}, False
    log: list[dict] = []
    for d in as_decisions(decisions):
        anomaly = by_id.get(plain(d.get("anomaly_id", "")))
        if anomaly is None:
            continue
        action, key = str(d.get("action", "keep_as_is")), f"c{len(log)}"
        row = {"anomaly_id": str(anomaly["anomaly_id"]), "action": action, "description": "", "rows_changed": key}
        log.append(row)
        if action in KEEP:
            row["description"] = f"kept as it is: {anomaly['anomaly_type']}"
        elif action == "remove_duplicates":
            st.count_rows(key)
            counted.update(st.flush())
            # Only digests and row numbers are shuffled; later statistics and counters read the rows where they lie.
            now = st.current()
            st.set_base(PO.keep_first(now, row_digest(now)))
            rebased = True
            st.count_rows(key + "_left")
            row["description"] = "dropped {rows} rows that repeat another"
        else:
            made = ACTIONS[action](Step(st, anomaly, d["params"], key, cfg)) if action in ACTIONS else None
            row["description"] = made or f"Skipped unrecognised action '{action}'"
    counted.update(st.flush())
    for row in log:
        key = row["rows_changed"]
        row["rows_changed"] = int(counted.get(key, 0)) - int(counted.get(key + "_left", 0))
        row["coerced_to_null"] = int(counted.get(key + "_lost", 0))
        row["description"] = row["description"].replace("{rows}", str(row["rows_changed"]))
    resolved = [r["anomaly_id"] for r in log if r["action"] not in KEEP]
    remaining = [r for r in recs if str(r["anomaly_id"]) not in set(resolved)]
    changes = base.sparkSession.createDataFrame(
        [(r["anomaly_id"], r["action"], r["description"], r["rows_changed"], r["coerced_to_null"]) for r in log], CHANGES_SCHEMA)
    rules = None if rebased else (st.alive, dict(st.exprs))
    return CleanResult(df=st.current(), changes=changes, change_rows=log, score_after=quality_score(remaining, counted["__rows_now"]),
                       rows_after=counted["__rows_now"], resolved=resolved, parent_run_id=parent_run_id, extra={"rules": rules})


# ---------------------------------------------------------------------------
# Single-decision operators (D2-D18) and helpers
# ---------------------------------------------------------------------------

def apply_one(df: DataFrame, anomaly: dict, action: str, params: dict | None = None,
              cfg: AuditConfig = DEFAULT) -> CleanResult:
    """Run one decision; the building block the per-action functions share."""
    a = dict(anomaly)
    a.setdefault("anomaly_id", f"{a['anomaly_type']}|{a.get('column_name')}")
    return clean(df, [a], [{"anomaly_id": a["anomaly_id"], "action": action, "params": params or {}}], cfg)


def remove_duplicates(df: DataFrame) -> DataFrame:
    return apply_one(df, {"anomaly_type": "DUPLICATE_ROWS", "column_name": None}, "remove_duplicates").df


def drop_column(df: DataFrame, column: str) -> DataFrame:
    return apply_one(df, {"anomaly_type": "MISSING_DATA", "column_name": column}, "drop_column").df


def drop_missing_rows(df: DataFrame, column: str) -> DataFrame:
    return apply_one(df, {"anomaly_type": "MISSING_DATA", "column_name": column}, "drop_rows").df


def drop_outside_rows(df: DataFrame, column: str, lo: float, hi: float,
                      anomaly_type: str = "STATISTICAL_OUTLIER") -> DataFrame:
    a = {"anomaly_type": anomaly_type, "column_name": column, "lower_bound": lo, "upper_bound": hi}
    return apply_one(df, a, "drop_rows").df


def drop_zero_rows(df: DataFrame, column: str) -> DataFrame:
    return apply_one(df, {"anomaly_type": "ZERO_AS_MISSING", "column_name": column}, "drop_rows").df


def drop_sparse_rows(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return apply_one(df, {"anomaly_type": "HIGH_NULL_DENSITY_ROWS", "column_name": None},
                     "drop_rows", {"threshold": threshold}).df


def fill(df: DataFrame, column: str, how: str = "mean", anomaly_type: str = "MISSING_DATA",
         lo: float | None = None, hi: float | None = None) -> DataFrame:
    a = {"anomaly_type": anomaly_type, "column_name": column, "lower_bound": lo, "upper_bound": hi}
    return apply_one(df, a, f"fill_{how}").df


def cap_iqr(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    a = {"anomaly_type": "STATISTICAL_OUTLIER", "column_name": column, "lower_bound": lo, "upper_bound": hi}
    return apply_one(df, a, "cap_iqr").df


def clamp_bounds(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    a = {"anomaly_type": "LOGICAL_VIOLATION", "column_name": column, "lower_bound": lo, "upper_bound": hi}
    return apply_one(df, a, "clamp_bounds").df


def treat_as_missing(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    a = {"anomaly_type": "LOGICAL_VIOLATION", "column_name": column, "lower_bound": lo, "upper_bound": hi}
    return apply_one(df, a, "treat_as_missing").df


def redact(df: DataFrame, column: str) -> DataFrame:
    return apply_one(df, {"anomaly_type": "PII_DETECTED", "column_name": column}, "redact").df


def hash_sha256(df: DataFrame, column: str) -> DataFrame:
    return apply_one(df, {"anomaly_type": "PII_DETECTED", "column_name": column}, "hash_sha256").df


def allowed_actions(spark) -> DataFrame:
    """The (anomaly_type, action) pairs a user may choose."""
    rows = [(t, a) for t, acts in C.ALLOWED_ACTIONS.items() for a in acts]
    return spark.createDataFrame(rows, "anomaly_type string, action string")


def invalid_decisions(anomalies: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions whose action does not fit their anomaly's type."""
    allowed = allowed_actions(anomalies.sparkSession)
    d = decisions.select("anomaly_id", "action").join(
        anomalies.select("anomaly_id", "anomaly_type"), "anomaly_id", "inner")
    return d.join(F.broadcast(allowed), ["anomaly_type", "action"], "left_anti") \
            .select("anomaly_id", "anomaly_type", "action")


def score_after(anomalies, changes, rows_after: int) -> float:
    """Score on anomalies not resolved (anything but keep), new row count."""
    recs = as_records(anomalies)
    ch = as_records(changes)
    resolved = {str(c["anomaly_id"]) for c in ch if c["action"] not in KEEP}
    return quality_score([r for r in recs if str(r["anomaly_id"]) not in resolved], rows_after)


def revise(df_raw: DataFrame, anomalies, decisions, parent_run_id: str,
           cfg: AuditConfig = DEFAULT) -> CleanResult:
    """Re-run cleaning from the raw table with new decisions, same report."""
    return clean(df_raw, anomalies, decisions, cfg, parent_run_id=parent_run_id)
