"""Shared column statistics.

Everything here is one of three job shapes:

* ``moments`` / ``sums``: global aggregates of light functions over the input
  (partial aggregation on every executor, a single tiny final merge).
* ``value_counts`` + ``cumulative``: the table is unpivoted to
  ``(key, value)`` and grouped (map-side combine), then range partitioned on
  ``(key, value)``. Running sums are taken inside each partition and the
  per-partition totals (at most partitions + keys rows) give each partition
  its offset. Exact quantiles, distinct counts, average ranks and ordered
  splits all read from this; no task ever holds a whole column and no
  window runs over an unbounded group.
* small results (one row per column or per quantile) collected to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

KEY, VAL, TXT, WEIGHT = "_k", "_v", "_s", "_w"


def adjusted_skew(g1, n):
    """pandas/DuckDB sample skewness from the population value Spark returns."""
    if g1 is None or n is None or n < 3 or (isinstance(g1, float) and math.isnan(g1)):
        return None
    return g1 * math.sqrt(n * (n - 1)) / (n - 2)


def adjusted_kurt(g2, n):
    """pandas/DuckDB sample excess kurtosis from Spark's population value."""
    if g2 is None or n is None or n < 4 or (isinstance(g2, float) and math.isnan(g2)):
        return None
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)


@dataclass
class NumStats:
    count: int = 0
    min: float | None = None
    max: float | None = None
    mean: float | None = None
    std: float | None = None
    skew: float | None = None
    kurt: float | None = None
    nonbinary: int = 0          # non-null values outside {0, 1}
    zeros: int = 0
    negatives: int = 0
    nan: int = 0
    extra: dict = field(default_factory=dict)

    @property
    def binary(self) -> bool:
        """All non-null values in {0, 1} (also true for an all-null column)."""
        return self.nonbinary == 0


def moments(df: DataFrame, exprs: dict[str, Column], nulls_of: dict[str, Column] | None = None,
            shape: bool = True):
    """Row count, per-column moments and null counts in two light jobs.

    Pass 1 takes counts, min, max and sums; pass 2 takes power sums of the
    values centred on the pass-1 mean (numerically stable), plus the
    zero / negative / non-binary counts. Both are plain sums, so the
    aggregate stays cheap whatever the column count. Sample std and the bias-adjusted
    skewness and excess kurtosis follow pandas / DuckDB.
    """
    nulls_of = nulls_of or {}
    names = list(exprs)
    longs = {"__n": F.lit(1)}
    doubles, mins, maxs = {}, {}, {}
    for i, name in enumerate(names):
        x = exprs[name].cast("double")
        longs[f"c{i}"] = F.when(x.isNotNull(), 1).otherwise(0)
        doubles[f"s{i}"] = x
        mins[f"mn{i}"] = x
        maxs[f"mx{i}"] = x
    for j, (name, c) in enumerate(nulls_of.items()):
        longs[f"z{j}"] = F.when(c.isNull(), 1).otherwise(0)
    if not shape:
        for i, name in enumerate(names):
            x = exprs[name].cast("double")
            longs[f"nb{i}"] = F.when(~x.isin(0.0, 1.0), 1).otherwise(0)
            longs[f"z0{i}"] = F.when(x == 0, 1).otherwise(0)
            longs[f"ng{i}"] = F.when(x < 0, 1).otherwise(0)
    p1 = sums(df, longs, doubles, mins=mins, maxs=maxs)
    if not shape:
        n = p1["__n"]
        out = {}
        for i, name in enumerate(names):
            c = p1[f"c{i}"]
            out[name] = NumStats(count=c, min=p1[f"mn{i}"], max=p1[f"mx{i}"],
                                 mean=(p1[f"s{i}"] / c if c else None), nonbinary=p1[f"nb{i}"],
                                 zeros=p1[f"z0{i}"], negatives=p1[f"ng{i}"])
        return n, out, {name: p1[f"z{j}"] for j, name in enumerate(nulls_of)}
    n = p1["__n"]
    nulls = {name: p1[f"z{j}"] for j, name in enumerate(nulls_of)}
    centre = {}
    longs2, doubles2 = {}, {}
    for i, name in enumerate(names):
        c = p1[f"c{i}"]
        mu = p1[f"s{i}"] / c if c else 0.0
        centre[name] = mu
        x = exprs[name].cast("double")
        d = x - F.lit(mu)
        doubles2[f"d1_{i}"] = d
        doubles2[f"d2_{i}"] = d * d
        doubles2[f"d3_{i}"] = d * d * d
        doubles2[f"d4_{i}"] = d * d * d * d
        longs2[f"nb{i}"] = F.when(~x.isin(0.0, 1.0), 1).otherwise(0)
        longs2[f"z0{i}"] = F.when(x == 0, 1).otherwise(0)
        longs2[f"ng{i}"] = F.when(x < 0, 1).otherwise(0)
    p2 = sums(df, longs2, doubles2) if names else {}
    out: dict[str, NumStats] = {}
    for i, name in enumerate(names):
        c = p1[f"c{i}"]
        if not c:
            out[name] = NumStats(nonbinary=0)
            continue
        s1, s2, s3, s4 = (p2[f"d{k}_{i}"] or 0.0 for k in (1, 2, 3, 4))
        d = s1 / c
        m2 = max(s2 / c - d * d, 0.0)
        m3 = s3 / c - 3 * d * s2 / c + 2 * d ** 3
        m4 = s4 / c - 4 * d * s3 / c + 6 * d * d * s2 / c - 3 * d ** 4
        mean = centre[name]  # sum / count, as avg() computes it
        std = math.sqrt(m2 * c / (c - 1)) if c > 1 else None
        if m2 <= 0:
            skew, kurt = (0.0 if c >= 3 else None), (0.0 if c >= 4 else None)
        else:
            skew = adjusted_skew(m3 / m2 ** 1.5, c)
            kurt = adjusted_kurt(m4 / (m2 * m2) - 3.0, c)
        out[name] = NumStats(count=c, min=p1[f"mn{i}"], max=p1[f"mx{i}"], mean=mean, std=std, skew=skew,
                             kurt=kurt, nonbinary=p2[f"nb{i}"], zeros=p2[f"z0{i}"], negatives=p2[f"ng{i}"])
    return n, out, nulls


def sums(df: DataFrame, longs: dict[str, Column] | None = None,
         doubles: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None,
         mins: dict[str, Column] | None = None, maxs: dict[str, Column] | None = None) -> dict:
    """Many light aggregates over ``df`` in one job and one scan: sums of longs
    and doubles, boolean ors (``maxes``), double min/max.

    Light aggregates stay fast when wide (600 measured at about the cost of
    100); unpivoting them to ``(key, value)`` rows was measured 5-35x slower."""
    made = {
        "l": lambda e: F.coalesce(F.sum(e.cast("long")), F.lit(0)),
        "d": lambda e: F.sum(e.cast("double")),
        "b": lambda e: F.coalesce(F.max(e.cast("boolean")), F.lit(False)),
        "mn": lambda e: F.min(e.cast("double")),
        "mx": lambda e: F.max(e.cast("double")),
    }
    items = [(n, made[kind](e)) for kind, group in (("l", longs), ("d", doubles), ("b", maxes), ("mn", mins), ("mx", maxs))
             for n, e in (group or {}).items()]
    if not items:
        return {}
    row = df.agg(*[a.alias(f"m{i}") for i, (_, a) in enumerate(items)]).collect()[0]
    return {name: row[f"m{i}"] for i, (name, _) in enumerate(items)}


# ---------------------------------------------------------------------------
# Unpivoted value counts and distributed running sums
# ---------------------------------------------------------------------------

def digest(c: Column) -> Column:
    """A text's 128-bit key: distinct counts shuffle this instead of the text."""
    return F.concat(F.hex(F.xxhash64(c)), F.hex(F.xxhash64(c, F.lit(1))))


def value_counts(df: DataFrame, numeric: dict[str, Column] | None = None,
                 text: dict[str, Column] | None = None, weight: Column | None = None,
                 exact: dict[str, Column] | None = None):
    """Unpivot to ``(_k, _v, _s)`` and count equal values per column.

    Returns ``(vc, keys)``: ``vc`` has one row per distinct non-null value of
    each column (``_v`` for numbers, ``_s`` for text) with its count ``_w``;
    ``keys`` maps column name -> integer key. ``exact`` has the text key of
    numbers that a double cannot tell apart. Map-side combine shrinks
    repeated values before the shuffle, so a hot value costs one row per task.
    """
    numeric, text, exact = numeric or {}, text or {}, exact or {}
    keys: dict[str, int] = {name: i for i, name in enumerate([*numeric, *text])}
    none = F.lit(None)
    structs = [F.struct(F.lit(keys[name]).alias(KEY), e.cast("double").alias(VAL), exact.get(name, none).cast("string").alias(TXT))
               for name, e in numeric.items()]
    structs += [F.struct(F.lit(keys[name]).alias(KEY), none.cast("double").alias(VAL), e.cast("string").alias(TXT))
                for name, e in text.items()]
    w = (weight if weight is not None else F.lit(1)).cast("long")
    long = (df.select(F.explode(F.array(*structs)).alias("kv"), w.alias(WEIGHT))
            .select("kv.*", WEIGHT)
            .where(F.col(VAL).isNotNull() | F.col(TXT).isNotNull()))
    vc = long.groupBy(KEY, VAL, TXT).agg(F.sum(WEIGHT).alias(WEIGHT))
    return vc, keys


def _running_sums(key: str, weight: str):
    """Per-partition running sum of ``weight`` within runs of equal ``key``."""
    def run(batches):
        prev_key, carry = None, 0
        for pdf in batches:
            if len(pdf) == 0:
                yield pdf.assign(_local=np.zeros(0, dtype="int64"))
                continue
            k = pdf[key].to_numpy()
            w = pdf[weight].to_numpy(dtype="int64")
            cs = np.cumsum(w)
            change = np.ones(len(k), dtype=bool)
            change[1:] = k[1:] != k[:-1]
            run_id = np.cumsum(change) - 1
            before_run = (cs - w)[np.flatnonzero(change)]
            local = cs - before_run[run_id]
            if prev_key is not None and k[0] == prev_key:
                local[run_id == 0] += carry
            prev_key, carry = k[-1], int(local[-1])
            yield pdf.assign(_local=local)
    return run


def cumulative(vc: DataFrame, key: str, order: list[str], weight: str,
               partitions: int | None = None):
    """Global running sums of ``weight`` within each ``key`` in ``order``.

    Returns ``(ranked, totals)``. ``ranked`` is ``vc`` plus ``_before`` (sum of
    weights strictly before the row within its key), materialised in the
    checkpoint folder so the sampled range boundaries cannot move on
    recomputation. ``totals`` has ``key, _n`` (sum of weights) and ``_rows``.
    """
    spark = vc.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (vc.repartitionByRange(p, key, *order)
              .sortWithinPartitions(key, *order)
              .withColumn("_pid", F.spark_partition_id()))
    schema = T.StructType(ranged.schema.fields + [T.StructField("_local", T.LongType())])
    ranged = cut(ranged.mapInPandas(_running_sums(key, weight), schema))
    tot = ranged.groupBy("_pid", key).agg(F.sum(weight).alias("_t"), F.count(F.lit(1)).alias("_r"))
    w = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)
    # at most (partitions + keys) rows: safe to broadcast
    off = tot.select(key, "_pid", (F.sum("_t").over(w) - F.col("_t")).alias("_off"))
    ranked = (ranged.join(F.broadcast(off), [key, "_pid"])
              .withColumn("_before", F.col("_off") + F.col("_local") - F.col(weight))
              .drop("_off", "_local"))
    totals = tot.groupBy(key).agg(F.sum("_t").alias("_n"), F.sum("_r").alias("_rows"))
    return ranked, totals


def _lerp(a, b, t):
    return a if t == 0 or a == b else a + (b - a) * t


def quantile_targets(n: int, probs) -> list[tuple[float, int, int]]:
    out = []
    for p in probs:
        h = (n - 1) * p
        lo = int(math.floor(h))
        hi = min(lo + 1, n - 1)
        out.append((h - lo, lo, hi))
    return out


#: Accuracy of the brackets; values that the driver may order, of all brackets and of one.
BRACKET_ACCURACY, DRIVER_VALUES, BRACKET_VALUES = 10_000, 100_000, 2_000


@dataclass
class _Bracket:
    """A range of values that holds the positions ``lo`` and ``hi`` of a column."""
    name: str
    t: float
    lo: int
    hi: int
    low: float
    high: float
    n: int = 0
    below: int = 0
    upto: int = 0
    misses: int = 0
    found: float | None = None


def exact_quantiles(df: DataFrame, exprs: dict[str, Column], probs,
                    counts: dict[str, int] | None = None) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles (pandas ``quantile``), exact, from three scans.

    The first takes a quantile sketch a column, whose rank bound gives each quantile a bracket of values. The
    second counts what lies below and up to the end of each bracket, the third the values inside, so nothing but what
    lies within the bound is shuffled. The positions are then found among those counts: by the driver if they are few, else
    by running sums over ranges. ``counts``: non-null values per column, when the caller already has them."""
    probs = list(probs)
    if not exprs:
        return {}
    names = list(exprs)
    x = {c: e.cast("double") for c, e in exprs.items()}
    edge = 2.0 / BRACKET_ACCURACY
    wanted = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-edge, edge)})
    aggs = []
    for i, c in enumerate(names):
        aggs += [F.percentile_approx(x[c], wanted, BRACKET_ACCURACY).alias(f"q{i}"), F.min(x[c]).alias(f"a{i}"),
                 F.max(x[c]).alias(f"z{i}"), F.count(x[c]).alias(f"n{i}")]
    row = df.agg(*aggs).collect()[0]
    ends = {c: (row[f"a{i}"], row[f"z{i}"]) for i, c in enumerate(names)}
    n = {c: row[f"n{i}"] for i, c in enumerate(names)}
    brackets = []
    for i, c in enumerate(names):
        if n[c]:
            at = dict(zip(wanted, row[f"q{i}"]))
            for p, (t, lo, hi) in zip(probs, quantile_targets(n[c], probs)):
                low, high = at[max(0.0, p - edge)], at[min(1.0, p + edge)]
                brackets.append(_Bracket(c, t, lo, hi, low if p > edge else ends[c][0], high if p < 1 - edge else ends[c][1], n[c]))
    _place(df, x, brackets)
    missed = [b for b in brackets if b.found is None]
    if missed:  # the sketch broke its bound: whole columns are narrowed step by step
        for b in missed:
            b.low, b.high = ends[b.name]
        _narrow(df, x, missed, ends)
        _order(df, x, [b for b in missed if b.found is None])
    out, each = {}, iter(brackets)
    for c in names:
        out[c] = [next(each).found for _ in probs] if n[c] else [None] * len(probs)
    return out


def _place(df: DataFrame, x: dict[str, Column], brackets: list[_Bracket]) -> None:
    """Find all brackets' positions; ``found`` stays None where a bracket doesn't hold them. One scan counts what lies below and
    up to the end of each bracket, in light sums; the rows inside of one, a few in ten thousand unless values tie, are all that a second unpivots."""
    if not brackets:
        return
    light = {}
    for i, b in enumerate(brackets):
        light |= {f"b{i}": F.when(x[b.name] < b.low, 1).otherwise(0), f"u{i}": F.when(x[b.name] <= b.high, 1).otherwise(0)}
    row = sums(df, light)
    inner = []
    for i, b in enumerate(brackets):
        b.below, b.upto = row[f"b{i}"], row[f"u{i}"]
        if b.below <= b.lo and b.upto > b.hi:
            if b.low == b.high:
                b.found = b.low + 0.0
            else:
                inner.append(b)
    if not inner:
        return
    names = list(dict.fromkeys(b.name for b in inner))
    # A row's values are taken once, whatever expressions they are: the filter does not reach below the generator.
    taken = df.select(F.inline(F.array(F.struct(*[x[c].alias(f"x{j}") for j, c in enumerate(names)]))))
    at = [F.col(f"x{names.index(b.name)}") for b in inner]
    held = [(v >= b.low) & (v <= b.high) for v, b in zip(at, inner)]
    cells = F.array(*[F.when(h, F.struct(F.lit(i).alias(KEY), v.alias(VAL))) for i, (v, h) in enumerate(zip(at, held))])
    # Null structs become rows of nulls, which the filter drops in generated code.
    counts = (taken.where(reduce(Column.__or__, held)).select(F.inline(cells)).where(F.col(KEY).isNotNull())
              .groupBy(KEY, VAL).agg(F.count(F.lit(1)).alias(WEIGHT)))
    if sum(b.upto - b.below for b in inner) > DRIVER_VALUES:
        counts = cut(counts)
        if counts.count() > DRIVER_VALUES:
            _place_in_ranges(counts, inner)
            return
    values: dict[int, list[tuple[float, int]]] = {}
    for r in counts.collect():
        values.setdefault(r[KEY], []).append((r[VAL], r[WEIGHT]))
    for i, b in enumerate(inner):
        pos, got = b.below, {}
        for v, w in sorted(values.get(i, [])):
            for p in (b.lo, b.hi):
                if pos <= p < pos + w:
                    got[p] = v
            pos += w
        if b.lo in got and b.hi in got:
            b.found = _lerp(got[b.lo], got[b.hi], b.t)


def _place_in_ranges(counts: DataFrame, brackets: list[_Bracket]) -> None:
    """The same, where the brackets hold more values than the driver orders: two rows a bracket reach it."""
    ranked, _ = cumulative(counts, KEY, [VAL], WEIGHT)
    wanted = ranked.sparkSession.createDataFrame([(i, p - b.below) for i, b in enumerate(brackets) for p in {b.lo, b.hi}], f"{KEY} int, p bigint")
    hit = ranked.join(F.broadcast(wanted), KEY).where((F.col("_before") <= F.col("p")) & (F.col("p") < F.col("_before") + F.col(WEIGHT)))
    got = {(r[KEY], r.p): r[VAL] for r in hit.select(KEY, "p", VAL).collect()}
    for i, b in enumerate(brackets):
        low, high = got.get((i, b.lo - b.below)), got.get((i, b.hi - b.below))
        if low is not None and high is not None:
            b.found = _lerp(low, high, b.t)


def _narrow(df: DataFrame, x: dict[str, Column], brackets: list[_Bracket], ends: dict) -> None:
    """Count each bracket, and narrow those that hold more values than the driver orders."""
    open_ = list(brackets)
    while open_:
        aggs = []
        for i, b in enumerate(open_):
            aggs += [F.count_if(x[b.name] < b.low).alias(f"b{i}"), F.count_if(x[b.name] <= b.high).alias(f"u{i}")]
        row = df.agg(*aggs).collect()[0]
        again = []
        for i, b in enumerate(open_):
            b.below, b.upto = row[f"b{i}"], row[f"u{i}"]
            if b.below > b.lo or b.upto <= b.hi:  # the sketch missed: start again from the whole column, with wider brackets
                (b.low, b.high), b.misses = ends[b.name], b.misses + 1
                again.append(b)
            elif b.low == b.high:
                b.found = b.low
            elif b.upto - b.below > BRACKET_VALUES:
                again.append(b)
        full = [b for b in again if b.below <= b.lo and b.upto > b.hi]
        stuck = []
        if full:
            aggs = []
            for i, b in enumerate(full):
                size, edge = b.upto - b.below, 2.0 * 4 ** b.misses / BRACKET_ACCURACY
                inside = F.when(x[b.name].between(b.low, b.high), x[b.name])
                aggs.append(F.percentile_approx(inside, [max(0.0, (b.lo - b.below) / size - edge), min(1.0, (b.hi + 1 - b.below) / size + edge)],
                                                BRACKET_ACCURACY).alias(f"q{i}"))
            row = df.agg(*aggs).collect()[0]
            for i, b in enumerate(full):
                low, high = row[f"q{i}"]
                if (low, high) == (b.low, b.high):
                    stuck.append(b)
                b.low, b.high = low, high
        if stuck:
            _peel(df, x, stuck)
        open_ = [b for b in again if b.found is None]


def _peel(df: DataFrame, x: dict[str, Column], brackets: list[_Bracket]) -> None:
    """Brackets whose ends are very frequent values: find the positions there, or leave the ends out."""
    aggs = []
    for i, b in enumerate(brackets):
        v = x[b.name]
        aggs += [F.count_if(v == b.low).alias(f"l{i}"), F.count_if(v == b.high).alias(f"h{i}"),
                 F.min(F.when(v > b.low, v)).alias(f"n{i}"), F.max(F.when(v < b.high, v)).alias(f"p{i}")]
    row = df.agg(*aggs).collect()[0]
    for i, b in enumerate(brackets):
        after_low, before_high = b.below + row[f"l{i}"], b.upto - row[f"h{i}"]
        following, previous = row[f"n{i}"], row[f"p{i}"]
        if b.lo < after_low:
            b.found = _lerp(b.low, b.low if b.hi < after_low else following, b.t)
        elif b.hi >= before_high:
            b.found = _lerp(b.high if b.lo >= before_high else previous, b.high, b.t)
        else:
            b.low, b.high = following, previous


def _order(df: DataFrame, x: dict[str, Column], brackets: list[_Bracket]) -> None:
    """Find the positions of the remaining brackets among the counts of their values."""
    if not brackets:
        return
    inside = [F.struct(F.lit(i).alias(KEY), F.when(x[b.name].between(b.low, b.high), x[b.name]).alias(VAL)) for i, b in enumerate(brackets)]
    rows = (df.select(F.inline(F.array(*inside))).where(F.col(VAL).isNotNull())
            .groupBy(KEY, VAL).agg(F.count(F.lit(1)).alias(WEIGHT)))
    values: dict[int, list[tuple[float, int]]] = {}
    for r in rows.collect():
        values.setdefault(r[KEY], []).append((r[VAL], r[WEIGHT]))
    for i, b in enumerate(brackets):
        at, got = b.below, {}
        for v, w in sorted(values[i]):
            for pos in (b.lo, b.hi):
                if at <= pos < at + w:
                    got[pos] = v
            at += w
        b.found = _lerp(got[b.lo], got[b.hi], b.t)


def approx_quantiles(df: DataFrame, exprs: dict[str, Column], probs, accuracy: int = 10_000):
    """Bounded-memory quantiles (``percentile_approx``), one aggregate job."""
    if not exprs:
        return {}
    names = list(exprs)
    row = df.agg(*[F.percentile_approx(exprs[n], list(probs), accuracy).alias(f"q{i}")
                   for i, n in enumerate(names)]).collect()[0]
    return {n: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
            for i, n in enumerate(names)}


def quantiles(df: DataFrame, exprs: dict[str, Column], probs, method: str = "exact",
              accuracy: int = 10_000, counts: dict[str, int] | None = None):
    if method == "approx":
        return approx_quantiles(df, exprs, probs, accuracy)
    return exact_quantiles(df, exprs, probs, counts=counts)


def counts_and_quantiles(df: DataFrame, exprs: dict[str, Column], probs):
    """Row count, per-column counters (count, min, max, mean, zeros, negatives,
    values outside {0, 1}) and exact quantiles, from narrow aggregates alone."""
    n, stats, _ = moments(df, exprs, shape=False)
    return n, stats, exact_quantiles(df, exprs, probs)


def distinct_counts(df: DataFrame, exprs: dict[str, Column]) -> dict[str, int]:
    """Exact distinct non-null values per column in one job: each value is a column number and 128 digest bits,
    combined before the shuffle, so frequent values cost a row a task and rare ones spread by digest."""
    if not exprs:
        return {}
    cells = [F.when(e.isNotNull(), F.struct(F.lit(i).alias(KEY), F.xxhash64(e).alias("_a"), F.xxhash64(F.lit(1), e).alias("_b"))) for i, e in enumerate(exprs.values())]
    each = df.select(F.inline(F.array(*cells))).where(F.col(KEY).isNotNull()).groupBy(KEY, "_a", "_b").agg(F.lit(1).alias(WEIGHT))
    got = {r[KEY]: r["n"] for r in each.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {name: int(got.get(i, 0)) for i, name in enumerate(exprs)}


#: Distinct-value sketches: 64 KB each; five standard errors.
SKETCH_LOG_K, SKETCH_BOUND = 16, 5 * 1.04 / 2 ** 8


def distinct_estimates(df: DataFrame, exprs: dict[str, Column]) -> dict[str, int]:
    """Distinct non-null values per column to within ``SKETCH_BOUND``, from mergeable sketches in one scan without a shuffle of values."""
    if not exprs:
        return {}
    aggs = [F.hll_sketch_estimate(F.hll_sketch_agg(F.when(e.isNotNull(), F.xxhash64(e)), SKETCH_LOG_K)).alias(f"d{i}") for i, e in enumerate(exprs.values())]
    row = df.agg(*aggs).first()
    return {name: int(row[f"d{i}"] or 0) for i, name in enumerate(exprs)}


def distinct_for(df: DataFrame, exprs: dict[str, Column], marks: dict[str, list[float]]) -> dict[str, int]:
    """Distinct counts that compare with each of a column's ``marks`` as the exact ones do: the
    sketch's estimate where its bounds leave no mark open, else the exact count of that column."""
    found = distinct_estimates(df, exprs)

    def open_(name: str) -> bool:
        low, high = found[name] * (1 - SKETCH_BOUND) - 1, found[name] * (1 + SKETCH_BOUND) + 1
        return any(low <= m <= high for m in marks[name])

    return {**found, **distinct_counts(df, {c: e for c, e in exprs.items() if open_(c)})}


def mode_values(df: DataFrame, numeric: dict[str, Column] | None = None,
                text: dict[str, Column] | None = None) -> dict[str, object]:
    """Most frequent non-null value per column, smallest value on ties.

    Two aggregates over the value counts (max count, then min value among
    the values with that count); no group is ever collected into one task.
    """
    vc, keys = value_counts(df, numeric=numeric, text=text)
    top = vc.groupBy(KEY).agg(F.max(WEIGHT).alias("_top"))
    best = (vc.join(F.broadcast(top), [KEY]).where(F.col(WEIGHT) == F.col("_top"))
            .groupBy(KEY).agg(F.min(VAL).alias(VAL), F.min(TXT).alias(TXT)))
    got = {r[KEY]: (r[VAL] if r[VAL] is not None else r[TXT]) for r in best.collect()}
    return {name: got.get(k) for name, k in keys.items()}


def average_ranks(df: DataFrame, values: dict[str, Column], domains: dict[str, tuple[str, str | None]]):
    """Average ranks (ties share the mean position, 1-based) per rank domain.

    ``domains`` maps a domain's name to a column of ``values`` and to the one whose nulls leave
    rows out (None: no other). A column's values are counted once, with a weight for each domain. Returns
    ``(lookup, keys, sizes)``: ``lookup`` has ``_k, _v, _rank`` (one row per
    distinct value per domain, checkpointed), ``sizes`` the rows and distinct
    values of each domain by its key.
    """
    keys = {name: i for i, name in enumerate(domains)}
    columns = list(dict.fromkeys(c for c, _ in domains.values()))
    masks = list(dict.fromkeys(m for _, m in domains.values()))
    weights = [f"{WEIGHT}{j}" for j in range(len(masks))]
    has = [(F.lit(1) if m is None else F.when(values[m].isNotNull(), 1).otherwise(0)).cast("long").alias(w) for m, w in zip(masks, weights)]
    cells = F.array(*[F.struct(F.lit(i).alias("_c"), values[c].cast("double").alias(VAL)) for i, c in enumerate(columns)])
    counted = (df.select(F.explode(cells).alias("kv"), *has).select("kv.*", *weights).where(F.col(VAL).isNotNull())
               .groupBy("_c", VAL).agg(*[F.sum(w).alias(w) for w in weights]))
    of = F.array(*[F.when(F.col("_c") == columns.index(c), F.struct(F.lit(keys[name]).alias(KEY), F.col(weights[masks.index(m)]).alias(WEIGHT)))
                   for name, (c, m) in domains.items()])
    vc = counted.select(VAL, F.inline(of)).where(F.col(WEIGHT) > 0).select(KEY, VAL, WEIGHT)
    ranked, totals = cumulative(vc, KEY, [VAL], WEIGHT)
    sizes = {r[KEY]: (r["_n"], r["_rows"]) for r in totals.collect()}  # one row a domain
    return ranked.select(KEY, VAL, (F.col("_before") + (F.col(WEIGHT) + 1) / 2.0).alias("_rank")), keys, sizes
