"""DuckDB SQL text for the correctness gate.

The oracle side re-derives every result in plain SQL from the same parquet
tables: no statistic computed by Spark is passed in. Where one text serves
several similar columns it is produced by small string templates here.
"""

from __future__ import annotations

from .. import config as C


def qi(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def name_has(name: str, pats) -> bool:
    low = name.lower()
    return any(p in low for p in pats)


def detect_sql(view: str, cols: list[str], numeric: list[str], text: list[str],
               bounds: dict, k: float = 3.0, t: float = 0.5) -> str:
    """Anomaly report (tiers, PII, sparse rows) as one SQL statement over ``view``."""
    return detect_ctes(view, cols, numeric, text, bounds, k, t) + "\nSELECT * FROM anomalies"


def detect_ctes(view: str, cols: list[str], numeric: list[str], text: list[str],
                bounds: dict, k: float = 3.0, t: float = 0.5) -> str:
    """CTE list ending in ``anomalies`` (the report) and ``anomaly_n`` (row count)."""
    allc = ", ".join(qi(c) for c in cols)
    st = ["count(*) AS n"]
    fz = ["*"]
    for i, x in enumerate(numeric):
        X = qi(x)
        st += [f"quantile_cont({X}, 0.25) AS q1_{i}", f"quantile_cont({X}, 0.5) AS q2_{i}",
               f"quantile_cont({X}, 0.75) AS q3_{i}",
               f"count_if({X} NOT IN (0, 1)) AS nb_{i}", f"count_if({X} <> 0) AS nz_{i}",
               f"count_if({X} < 0) AS ng_{i}"]
        if name_has(x, C.ZERO_ALWAYS_VALID_PATTERNS):
            mz = "false"
        else:
            bound_rule = "false"
            lo = (bounds.get(x) or {}).get("min_bound")
            if lo is not None and lo > 0:
                bound_rule = "true"
            named = "true" if name_has(x, C.ZERO_MEANINGFUL_KEYWORDS) else "false"
            mz = (f"(nb_{i} > 0 AND NOT {named} AND ({bound_rule} OR (nz_{i} > 0 AND ng_{i} = 0)))")
        fz += [f"CASE WHEN q3_{i} - q1_{i} <> 0 THEN q1_{i} - {k} * (q3_{i} - q1_{i}) END AS lo_{i}",
               f"CASE WHEN q3_{i} - q1_{i} <> 0 THEN q3_{i} + {k} * (q3_{i} - q1_{i}) END AS hi_{i}",
               f"{mz} AS mz_{i}"]
    p = ["g.w"]
    for j, c in enumerate(cols):
        C_ = qi(c)
        blank = f" OR regexp_matches({C_}, '^\\s*$')" if c in text else ""
        p.append(f"({C_} IS NULL{blank}) AS m_{j}")
        p.append(f"({C_} IS NULL) AS nl_{j}")
    for i, x in enumerate(numeric):
        p.append(f"coalesce(mz_{i} AND {qi(x)} = 0, false) AS z_{i}")
        p.append(f"coalesce({qi(x)} < lo_{i} OR {qi(x)} > hi_{i}, false) AS o_{i}")
    bl = [(b, v) for b, v in bounds.items() if v.get("min_bound") is not None and v.get("max_bound") is not None]
    for i, (b, v) in enumerate(bl):
        x = f"TRY_CAST({qi(b)} AS DOUBLE)"
        p.append(f"coalesce({x} < {float(v['min_bound'])} OR {x} > {float(v['max_bound'])}, false) AS l_{i}")
    share = " + ".join(f"({qi(c)} IS NULL)::INT" for c in cols)
    p.append(f"({share}) / {float(len(cols))} AS share")
    for j, c in enumerate(text):
        for name, pat in C.PII_PATTERNS.items():
            p.append(f"coalesce(regexp_matches({qi(c)}, {lit(pat)}), false) AS pii_{j}_{name}")

    t2 = " OR ".join(f"m_{j}" for j in range(len(cols))) or "false"
    t3 = " OR ".join(f"z_{i}" for i in range(len(numeric))) or "false"
    t4 = " OR ".join(f"l_{i}" for i in range(len(bl))) or "false"
    a = ["sum(w - 1) AS dup", "sum(w) AS n"]
    for j in range(len(cols)):
        a += [f"count_if(m_{j}) AS am_{j}", f"sum(CASE WHEN m_{j} THEN w ELSE 0 END) AS tm_{j}",
              f"sum(CASE WHEN nl_{j} THEN w ELSE 0 END) AS nn_{j}"]
    for i in range(len(numeric)):
        a += [f"count_if(z_{i} AND NOT ({t2})) AS az_{i}", f"sum(CASE WHEN z_{i} THEN w ELSE 0 END) AS tz_{i}",
              f"count_if(o_{i} AND NOT ({t2} OR {t3} OR {t4})) AS ao_{i}",
              f"sum(CASE WHEN o_{i} THEN w ELSE 0 END) AS to_{i}"]
    for i in range(len(bl)):
        a += [f"count_if(l_{i} AND NOT ({t2} OR {t3})) AS al_{i}", f"sum(CASE WHEN l_{i} THEN w ELSE 0 END) AS tl_{i}"]
    a += [f"sum(CASE WHEN share > {t} THEN w ELSE 0 END) AS sp",
          f"sum(CASE WHEN share > {t} THEN share * w END) AS spd"]
    for j, c in enumerate(text):
        for name in C.PII_PATTERNS:
            a.append(f"bool_or(pii_{j}_{name}) AS pii_{j}_{name}")

    def rec(order, atype, col, aff, tot, cond, null_rate="NULL", lo="NULL", hi="NULL", thr="NULL",
            mnd="NULL", pii="NULL", desc="NULL", sev=None):
        sev = sev or (f"CASE WHEN {aff} / a.n >= {C.SEVERITY_HIGH} THEN 'high' "
                      f"WHEN {aff} / a.n >= {C.SEVERITY_MEDIUM} THEN 'medium' ELSE 'low' END")
        return (f"SELECT {order} AS ord, '{atype}' AS anomaly_type, {lit(col)} AS column_name, "
                f"({aff})::BIGINT AS affected_rows, ({tot})::BIGINT AS total_flagged, "
                f"{null_rate}::DOUBLE AS null_rate, {sev} AS severity, {lo}::DOUBLE AS lower_bound, "
                f"{hi}::DOUBLE AS upper_bound, {thr}::DOUBLE AS threshold, {mnd}::DOUBLE AS mean_null_density, "
                f"{pii}::VARCHAR AS pii_types, {desc}::VARCHAR AS description FROM a, fz WHERE {cond}")

    recs = [rec(0, "DUPLICATE_ROWS", None, "dup", "dup", "dup > 0")]
    o = 1
    for j, c in enumerate(cols):
        recs.append(rec(o, "MISSING_DATA", c, f"am_{j}", f"tm_{j}", f"am_{j} > 0", null_rate=f"nn_{j} / a.n"))
        o += 1
    for i, x in enumerate(numeric):
        recs.append(rec(o, "ZERO_AS_MISSING", x, f"az_{i}", f"tz_{i}", f"az_{i} > 0"))
        o += 1
    for i, (b, v) in enumerate(bl):
        recs.append(rec(o, "LOGICAL_VIOLATION", b, f"al_{i}", f"tl_{i}", f"al_{i} > 0",
                        lo=str(float(v["min_bound"])), hi=str(float(v["max_bound"])),
                        desc=lit(v.get("description") or None)))
        o += 1
    for i, x in enumerate(numeric):
        recs.append(rec(o, "STATISTICAL_OUTLIER", x, f"ao_{i}", f"to_{i}", f"ao_{i} > 0",
                        lo=f"lo_{i}", hi=f"hi_{i}"))
        o += 1
    for j, c in enumerate(text):
        parts = ", ".join(f"CASE WHEN pii_{j}_{name} THEN '{name}' END" for name in C.PII_PATTERNS)
        cond = " OR ".join(f"pii_{j}_{name}" for name in C.PII_PATTERNS)
        recs.append(rec(o, "PII_DETECTED", c, "a.n", "a.n", cond, pii=f"concat_ws(',', {parts})", sev="'high'"))
        o += 1
    recs.append(rec(o, "HIGH_NULL_DENSITY_ROWS", None, "sp", "sp", "sp > 0", thr=str(t), mnd="spd / sp"))
    # the weighted row count doubles as "n" for the severity share
    body = f"""
g AS (SELECT {allc}, count(*) AS w FROM {view} GROUP BY ALL),
st AS (SELECT {', '.join(st)} FROM {view}),
fz AS (SELECT {', '.join(fz)} FROM st),
p AS (SELECT {', '.join(p)} FROM g, fz),
a AS (SELECT {', '.join(a)} FROM p),
recs AS ({' UNION ALL '.join(recs)}),
anomaly_n AS (SELECT n FROM a),
anomalies AS (
SELECT CASE WHEN column_name IS NULL THEN anomaly_type ELSE anomaly_type || '|' || column_name END AS anomaly_id,
  anomaly_type, column_name, affected_rows, total_flagged, round(null_rate, 4) AS null_rate, severity,
  round(lower_bound, 4) AS lower_bound, round(upper_bound, 4) AS upper_bound, threshold,
  round(mean_null_density, 4) AS mean_null_density, pii_types, description,
  (row_number() OVER (ORDER BY ord) - 1)::INTEGER AS display_order
FROM recs)"""
    return body


def weights_values() -> str:
    rows = ", ".join(f"('{k}', {C.PENALTY_WEIGHTS[k]}, {C.PENALTY_CAPS[k]})" for k in C.PENALTY_WEIGHTS)
    return f"weights(anomaly_type, weight, cap) AS (VALUES {rows})"


def score_select(anoms: str, n: str) -> str:
    """Quality score of the records in CTE ``anoms`` over row count expression ``n``."""
    return (f"SELECT CASE WHEN {n} = 0 THEN 100.0 ELSE greatest(0.0, round(100.0 - coalesce(sum(least("
            f"coalesce(w.weight, 0.0) * x.affected_rows / ({n}) * 100, coalesce(w.cap, {C.DEFAULT_PENALTY_CAP}))),"
            f" 0.0), 2)) END AS quality_score FROM {anoms} x LEFT JOIN weights w USING (anomaly_type)")


def band(expr: str) -> str:
    return f"CASE WHEN {expr} >= 80 THEN 'Good' WHEN {expr} >= 50 THEN 'Fair' ELSE 'Poor' END"


def values(name: str, cols: list[str], rows: list[tuple]) -> str:
    def v(x):
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return lit(x)
        return repr(x)
    body = ", ".join("(" + ", ".join(v(x) for x in r) + ")" for r in rows)
    return f"{name}({', '.join(cols)}) AS (VALUES {body})"
