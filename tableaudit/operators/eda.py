"""EDA statistics and the narrative bundle.

Correlations are one aggregate job. Spearman correlation is exact and
distributed: average ranks come from the range-partitioned running sums in
``functions.stats`` (one rank table per rank domain: a column and the
null mask of its partner, shared by all partners with that mask). Rank tables of
few values are sent to the tasks, which look ranks up and add up their products in
one scan. Columns of more values meet their ranks in one join for all of them, which carries the
others' values; the ranks of a row are put together by its position where several columns are joined. Either plan is as long for two columns as for fifty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT, AuditConfig
from ..functions import stats as S
from ..functions.expressions import col, number_of
from ..functions.positions import POSITION, with_position
from ..session import reused
from .features import correlations
from .profile import Facts, chart_flags, column_stats_rows, continuous_columns, facts


# ---------------------------------------------------------------------------
# F1, F2 Pearson
# ---------------------------------------------------------------------------

def pearson_matrix(df: DataFrame, columns: list[str] | None = None, cfg: AuditConfig = DEFAULT,
                   fx: Facts | None = None) -> DataFrame:
    """Long matrix ``(col_a, col_b, r, r_shown)``: r to 3 dp, |r| < min shown as 0."""
    with reused(df) as df:
        if columns is None:
            fx = fx or facts(df, cfg, distinct=True)
            columns = continuous_columns(fx, cfg.names)
        rs = correlations(df, columns, None if fx is None else {c: fx.num[c].mean for c in columns})
    rows = []
    for a in columns:
        for b in columns:
            if a == b:
                r = 1.0
            else:
                r = rs.get((a, b), rs.get((b, a)))
            r3 = None if r is None else round(r, 3)
            shown = None if r3 is None else (r3 if abs(r3) >= cfg.heatmap_min_corr else 0.0)
            rows.append((a, b, r3, shown))
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, r double, r_shown double")


def strongest_pair(df: DataFrame, columns: list[str], rs: dict | None = None):
    """(a, b, r) with the largest |r| in the upper triangle (first on ties), or None.
    ``rs``: the correlations, where the caller already has them."""
    rs = correlations(df, columns) if rs is None else rs
    found = [(a, b, r) for (a, b), r in rs.items() if r is not None]
    return max(found, key=lambda p: abs(p[2]), default=None)


def max_abs_correlation(df: DataFrame, columns: list[str], rs: dict | None = None) -> float | None:
    """Largest off-diagonal |r| (null when fewer than two columns or no valid r)."""
    best = strongest_pair(df, columns, rs)
    return None if best is None else abs(best[2])


# ---------------------------------------------------------------------------
# F3 Spearman
# ---------------------------------------------------------------------------

#: Distinct values of all rank domains together whose ranks (16 bytes each) are sent to every task; more are joined.
SENT_VALUES = 1 << 20


def _ranks(domains: int, tables, sent: dict[int, int], flat: list[int], listed: bool = False):
    """Ranks of a batch, by domain. Its first columns are the ranks in the ``flat`` domains, or if ``listed`` one column of each row's
    (domain, rank). ``tables`` has for each domain in ``sent`` its values in order and their ranks, to be looked up for the column that ``sent`` names."""
    def ranks(batch: pa.RecordBatch) -> np.ndarray:
        out = np.full((domains, batch.num_rows), np.nan)
        for d, c in zip(flat, batch.columns):
            out[d] = c.to_numpy(zero_copy_only=False)
        if listed:
            lists = batch.column(0)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            key, rank = (f.to_numpy(zero_copy_only=False) for f in lists.flatten().flatten())
            out[key, row] = rank
        columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[len(flat) + listed:]]
        for d, j in sent.items():
            values, rank = tables.value[d]
            if len(values):
                v = columns[j]
                out[d] = np.where(np.isnan(v), np.nan, np.append(rank, np.nan)[np.searchsorted(values, v)])
        return out
    return ranks


def _rank_products(pairs: dict[int, tuple[int, int]], ranks):
    """Per task and pair of domains (p) the sums (n, sa, sb, saa, sbb, sab) over the rows that have both ranks."""
    def run(batches):
        total = np.zeros((len(pairs), 6))
        for batch in batches:
            r = ranks(batch)
            known = ~np.isnan(r)
            for i, (a, b) in enumerate(pairs.values()):
                both = known[a] & known[b]
                u, v = r[a][both], r[b][both]
                total[i] += len(u), u.sum(), v.sum(), u @ u, v @ v, u @ v
        yield pa.RecordBatch.from_arrays([pa.array(list(pairs), pa.int32()), *(pa.array(c) for c in total.T)], names=["p", *_SUMS])
    return run


_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def spearman(df: DataFrame, pairs: list[tuple[str, str]], min_rows: int = 3) -> dict:
    """Exact Spearman r per pair on pairwise-complete rows (None if < min_rows or constant)."""
    if not pairs:
        return {}
    pairs = list(dict.fromkeys(pairs))
    cols = sorted({c for p in pairs for c in p})
    x = {c: number_of(df, c) for c in cols}
    nulls = S.sums(df, {c: F.when(x[c].isNull(), 1).otherwise(0) for c in cols})
    # A column is ranked within the rows that its partner has too. Partners whose nulls
    # stand in the same rows share a mask, and so the column's rank table.
    gaps = [c for c in cols if nulls[c]]
    apart = {}
    for i, a in enumerate(gaps):
        for b in gaps[i + 1:]:
            if nulls[a] == nulls[b]:
                apart[(a, b)] = F.when(x[a].isNull() != x[b].isNull(), 1).otherwise(0)
    differ = S.sums(df, {str(k): e for k, e in apart.items()})
    mask = {c: None if not nulls[c] else next((a for a in gaps[:gaps.index(c)] if differ.get(str((a, c))) == 0), c) for c in cols}
    specs: dict[str, tuple[str, str | None]] = {}

    def domain(c: str, partner: str) -> str:
        m = None if mask[partner] in (None, mask[c]) else mask[partner]
        name = f"s{cols.index(c)}" + (f"m{cols.index(m)}" if m else "")
        specs[name] = (c, m)
        return name

    pair_spec = {(a, b): (domain(a, b), domain(b, a)) for a, b in pairs}
    lookup, keys, sizes = S.average_ranks(df, x, specs)
    # Centred on the domain's mean rank: the sums of squares lose no digits.
    rank = F.col("_rank") - F.element_at(F.create_map(*[F.lit(v) for k, (n, _) in sizes.items() for v in (k, (n + 1) / 2.0)]), F.col(S.KEY)) if sizes else F.col("_rank")
    lookup = lookup.select(S.KEY, S.VAL, rank.alias("_rank"))
    # The columns with the fewest values are looked up in the tasks, as many as may be sent; the others' values are joined.
    of = {c: [keys[name] for name, (d, _) in specs.items() if d == c] for c in cols}
    held = {c: sum(sizes.get(k, (0, 0))[1] for k in of[c]) for c in cols}
    few, left = [], SENT_VALUES
    for c in sorted(cols, key=held.get):
        if held[c] > left:
            break
        few.append(c)
        left -= held[c]
    many = [c for c in cols if c not in few]
    wanted = {p: (keys[a], keys[b]) for p, (a, b) in pair_spec.items()}
    sent = {k: j for j, c in enumerate(few) for k in of[c]}
    got = lookup.where(F.col(S.KEY).isin(list(sent))).toArrow()
    key, val, rnk = (got.column(c).to_numpy() for c in (S.KEY, S.VAL, "_rank"))
    order = np.lexsort((val, key))
    key, val, rnk = key[order], val[order], rnk[order]
    tables = df.sparkSession.sparkContext.broadcast({k: (val[i:j], rnk[i:j]) for k in sent for i, j in [np.searchsorted(key, [k, k + 1])]})
    shape = "p int, " + ", ".join(f"{s} double" for s in _SUMS)
    light = [x[c].cast("double").alias(f"f{j}") for j, c in enumerate(few)]
    names = [f"f{j}" for j in range(len(few))]
    # A row's rank counts only in pairs whose columns it both has, so what its domain leaves out needs no test.
    parts = []
    sent_pairs = [p for p in pairs if p[0] in few and p[1] in few]
    if sent_pairs:
        parts.append((sent_pairs, df.select(*light), _ranks(len(keys), tables, sent, [])))
    if many:
        column = {k: i for i, c in enumerate(many) for k in of[c]}
        ranks = lookup.where(F.col(S.KEY).isin(list(column))).withColumn("_c", F.element_at(F.create_map(*[F.lit(v) for kc in column.items() for v in kc]), F.col(S.KEY)))
        flat = sorted(column) if len(many) == 1 else []
        if flat:
            of_value = ranks.groupBy(S.VAL).agg(*[F.max(F.when(F.col(S.KEY) == k, F.col("_rank"))).alias(f"r{k}") for k in flat])
            rows = df.select(x[many[0]].cast("double").alias(S.VAL), *light).where(F.col(S.VAL).isNotNull()).join(of_value, S.VAL)
            rows = rows.select(*[f"r{k}" for k in flat], *names)
        else:
            of_value = ranks.groupBy("_c", S.VAL).agg(F.collect_list(F.struct(S.KEY, "_rank")).alias("ranks"))  # a column's domains
            cells = F.array(*[F.struct(F.lit(i).alias("_c"), x[c].cast("double").alias(S.VAL)) for i, c in enumerate(many)])
            numbered = with_position(df.select(*[col(c) for c in cols]))
            long = numbered.select(POSITION, *light, F.explode(cells).alias("kv")).select(POSITION, *names, "kv.*").where(F.col(S.VAL).isNotNull())
            rows = long.join(of_value, ["_c", S.VAL]).groupBy(POSITION).agg(F.flatten(F.collect_list("ranks")).alias("ranks"), *[F.first(f).alias(f) for f in names]).drop(POSITION)
        parts.append(([p for p in pairs if p not in sent_pairs], rows, _ranks(len(keys), tables, sent, flat, not flat)))
    each = [rows.mapInArrow(_rank_products({pairs.index(p): wanted[p] for p in ps}, ranks), shape) for ps, rows, ranks in parts]
    sums = reduce(DataFrame.union, each)
    found = {r.p: r for r in sums.groupBy("p").agg(*[F.sum(s).alias(s) for s in _SUMS]).collect()}
    out = {}
    for i, p in enumerate(pairs):
        t, out[p] = found.get(i), None
        if t is not None and t.n >= max(min_rows, 1):
            va, vb = t.saa - t.sa * t.sa / t.n, t.sbb - t.sb * t.sb / t.n
            if va > 0 and vb > 0:
                out[p] = max(-1.0, min(1.0, (t.sab - t.sa * t.sb / t.n) / math.sqrt(va * vb)))
    return out


def top_spearman(df: DataFrame, k: int = 3, cfg: AuditConfig = DEFAULT, fx: Facts | None = None,
                 columns: list[str] | None = None) -> DataFrame:
    """Top-k pairs by |Spearman r| among continuous chart columns (3 dp)."""
    with reused(df if columns is None else df.select(*[col(c) for c in dict.fromkeys(columns)])) as df:
        if columns is None:
            fx = fx or facts(df, cfg, distinct=True)
            columns = continuous_columns(fx, cfg.names)
        pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
        rs = spearman(df, pairs)
    ranked = sorted(((abs(r), a, b, r) for (a, b), r in rs.items() if r is not None), reverse=True)[:k]
    rows = [(a, b, round(ar, 3), round(r, 3)) for ar, a, b, r in ranked]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, spearman_r double, signed_r double")


# ---------------------------------------------------------------------------
# F4, F5 missingness and readiness
# ---------------------------------------------------------------------------

def missingness_hotspots(df: DataFrame, k: int = 5, fx: Facts | None = None) -> DataFrame:
    """Columns with null rate > 0, highest first, top k (3 dp)."""
    fx = fx or facts(df, distinct=False)
    rates = [(c, fx.nulls[c] / fx.n) for c in df.columns if fx.n and fx.nulls[c] > 0]
    rates.sort(key=lambda t: (-t[1], df.columns.index(t[0])))
    rows = [(c, round(r, 3)) for c, r in rates[:k]]
    return df.sparkSession.createDataFrame(rows, "column string, null_rate double")


def ml_readiness_value(df: DataFrame, fx: Facts) -> float:
    mean_null = sum(fx.nulls[c] / fx.n for c in df.columns) / len(df.columns) if fx.n and df.columns else 0.0
    nums = fx.numeric()
    low_var = sum(1 for c in nums if fx.num[c].std is not None and fx.num[c].std == 0)
    return max(0.0, round(100.0 * (1 - mean_null) * (1 - low_var / max(len(nums), 1)), 1))


def ml_readiness(df: DataFrame, fx: Facts | None = None) -> DataFrame:
    """100 x (1 - mean null rate) x (1 - zero-variance share of numeric columns), 1 dp."""
    fx = fx or facts(df, distinct=False)
    return df.sparkSession.createDataFrame([(ml_readiness_value(df, fx),)], "ml_readiness double")


# ---------------------------------------------------------------------------
# F6-F8 text notes
# ---------------------------------------------------------------------------

def recommend(intents: DataFrame, column: str = "intent") -> DataFrame:
    """F8: next-step recommendation per intent text (keyword rules in order)."""
    low = F.lower(F.coalesce(col(column), F.lit("")))
    rec = None
    for words, text in C.RECOMMENDATIONS:
        cond = F.lit(False)
        for w in words:
            cond = cond | low.contains(w)
        rec = F.when(cond, F.lit(text)) if rec is None else rec.when(cond, F.lit(text))
    return intents.withColumn("recommendation", rec.otherwise(F.lit(C.DEFAULT_RECOMMENDATION)))


def recommendation_text(intent: str) -> str:
    low = (intent or "").lower()
    for words, text in C.RECOMMENDATIONS:
        if any(w in low for w in words):
            return text
    return C.DEFAULT_RECOMMENDATION


#: What a change did, by action; {n} its rows or values, {c} its column.
SENTENCES = {
    "remove_duplicates": "Repeated rows taken out: {n}.",
    "drop_column": "{c} is no longer part of the table.",
    "drop_rows": "{c} led to {n} dropped rows.",
    "treat_as_missing": "{c} lost {n} values outside its range.",
    "clamp_bounds": "{c} had {n} values moved to its limits.",
    "cap_iqr": "{c} had {n} values moved to its limits.",
    "redact": "{c} is blacked out.",
    "hash_sha256": "{c} now holds digests.",
}
FILLED = "{c} had {n} {what} filled by the {how}."


def cleaning_summary(changes: DataFrame, anomalies: DataFrame) -> DataFrame:
    """one sentence per change; count = rows_changed, else total_flagged, else affected.
    Only the removal of repeated rows has a sentence without a column."""
    a = anomalies.select("anomaly_id", "anomaly_type", "column_name", "total_flagged", "affected_rows")
    j = changes.join(a, "anomaly_id", "left")
    n = F.coalesce(F.col("rows_changed"), F.col("total_flagged"), F.col("affected_rows")).cast("string")
    c, action = F.col("column_name"), F.col("action")
    fills = action.startswith("fill_")
    what = F.when(F.col("anomaly_type") == "ZERO_AS_MISSING", "zeros").otherwise("gaps")
    pattern = F.when(fills, FILLED)
    for name, sentence in SENTENCES.items():
        pattern = pattern.when(action == name, sentence)
    text = F.when((action == "remove_duplicates") | c.isNotNull(), pattern)
    for mark, value in (("{c}", F.coalesce(c, F.lit(""))), ("{n}", n), ("{what}", what), ("{how}", F.expr("substring(action, 6)"))):
        text = F.replace(text, F.lit(mark), value)
    return j.select("anomaly_id", "action", text.alias("sentence")).where(F.col("sentence").isNotNull())


def imputed_columns(changes: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Columns filled by imputation with their null rate at detection time."""
    return (changes.where(F.col("action").isin("fill_mean", "fill_median", "fill_mode"))
            .join(anomalies.select("anomaly_id", "column_name", "null_rate"), "anomaly_id")
            .where(F.col("column_name").isNotNull() & F.col("null_rate").isNotNull())
            .select("column_name", "null_rate"))


def narrative_notes_list(df: DataFrame, fx: Facts, top_corr_count: int, imputed: list[tuple[str, float]],
                         cleaning: list[str], cfg: AuditConfig = DEFAULT) -> list[str]:
    """Cleaning sentences, then a note for each thing a reader should know of the table."""
    mean_null = sum(fx.nulls.values()) / (fx.n * len(df.columns)) if fx.n and df.columns else 0.0
    constant = [c for c in fx.numeric() if fx.num[c].std == 0]
    checks = [
        (mean_null > cfg.null_note_rate, f"On average {mean_null:.1%} of a column is empty: fill the gaps or drop columns."),
        (bool(constant), f"Constant and of no use to a model or chart: {len(constant)} columns."),
        (not top_corr_count, "No two numeric columns move together; derived columns may help."),
    ]
    checks += [(rate > cfg.imputation_warn_rate, f"{c}: {rate:.1%} of its values were filled in, so its statistics lean towards the filled value.")
               for c, rate in imputed]
    return [*cleaning, *(note for true, note in checks if true)]


def narrative_notes(df: DataFrame, changes: DataFrame | None = None, anomalies: DataFrame | None = None,
                    cfg: AuditConfig = DEFAULT) -> DataFrame:
    """narrative notes (cleaning lines first) as rows ``(position, note)``."""
    fx = facts(df, cfg, distinct=True)
    top = top_spearman(df, cfg.top_correlations, cfg, fx).count()
    imputed, cleaning = [], []
    if changes is not None and anomalies is not None:
        imputed = [(r["column_name"], r["null_rate"]) for r in imputed_columns(changes, anomalies).collect()]
        cleaning = [r["sentence"] for r in cleaning_summary(changes, anomalies).collect()]
    notes = narrative_notes_list(df, fx, top, imputed, cleaning, cfg)
    return df.sparkSession.createDataFrame(list(enumerate(notes)), "position int, note string")


# ---------------------------------------------------------------------------
# F20 bundle
# ---------------------------------------------------------------------------

@dataclass
class EDA:
    row_count: int
    col_count: int
    numeric_cols: list[str]
    categorical_cols: list[str]
    datetime_cols: list[str]
    column_stats: DataFrame
    top_correlations: DataFrame
    hotspots: DataFrame
    ml_readiness: float
    notes: list[str]
    recommendation: str
    cleaning_summary: list[str] = field(default_factory=list)


def eda(df: DataFrame, intent: str = "", changes: DataFrame | None = None,
        anomalies: DataFrame | None = None, cfg: AuditConfig = DEFAULT) -> EDA:
    """Row/column counts, kinds, column stats, top correlations, hotspots,
    readiness, notes and recommendation for one table."""
    fx = facts(df, cfg, distinct=True, exact=True)
    spark = df.sparkSession
    stats = spark.createDataFrame(column_stats_rows(df, fx),
                                  "name string, dtype string, null_count bigint, null_rate double, "
                                  "unique_count bigint, mean double, std double, min double, max double, "
                                  "skewness double, kurtosis double")
    top = top_spearman(df, cfg.top_correlations, cfg, fx)
    top_n = top.count()
    imputed, cleaning = [], []
    if changes is not None and anomalies is not None:
        imputed = [(r["column_name"], r["null_rate"]) for r in imputed_columns(changes, anomalies).collect()]
        cleaning = [r["sentence"] for r in cleaning_summary(changes, anomalies).collect()]
    notes = narrative_notes_list(df, fx, top_n, imputed, cleaning, cfg)
    return EDA(row_count=fx.n, col_count=len(df.columns), numeric_cols=fx.kinds["numeric"],
               categorical_cols=fx.kinds["categorical"], datetime_cols=fx.kinds["datetime"],
               column_stats=stats, top_correlations=top, hotspots=missingness_hotspots(df, cfg.hotspots, fx),
               ml_readiness=ml_readiness_value(df, fx), notes=notes,
               recommendation=recommendation_text(intent), cleaning_summary=cleaning)


__all__ = ["pearson_matrix", "max_abs_correlation", "strongest_pair", "spearman", "top_spearman",
           "missingness_hotspots", "ml_readiness", "recommend", "cleaning_summary", "narrative_notes",
           "eda", "chart_flags"]
