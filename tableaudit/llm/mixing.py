"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash; a source's budget is met by the documents whose hash
lies below the source's threshold. The threshold is found without sorting: sizes
are summed by source and hash bucket, the bucket in which the budget ends is the
boundary bucket, and only its rows are summed again by finer buckets. As the
hashes don't depend on the budget, a smaller budget's documents are among those
of a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableaudit.llm.common import stash, whole_row

#: Bits of the hash, and of one histogram level.
HASH_BITS, LEVEL_BITS = 60, 10
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def rank(doc_id: Column, text: Column) -> Column:
    """60 hash bits of a row, the same on every run."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(sizes: DataFrame, cycle: tuple[int, ...], most: int) -> DataFrame:
    """(source, size, target): the total shared by weight; a target stops at ``most``
    times its source's size and the excess is shared again among the others."""
    # One narrow row for each source: the only table that is ordered as a whole.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (place % len(cycle) + 1).cast("int"))
    out = stash(sizes.withColumn("weight", weight), "weights")
    total, heavy = out.agg(F.sum("size"), F.sum("weight")).first()
    if not total:
        return out.withColumn("target", F.lit(0.0))
    rate, capped = total / heavy, -1
    while True:
        over = F.col("size") * most < F.col("weight") * F.lit(rate)
        n, held, free = out.agg(F.count_if(over), F.sum(F.when(over, F.col("size") * most).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if n == capped:
            break
        rate, capped = (total - held) / free, n
    return out.withColumn("target", F.when(over, (F.col("size") * most).cast("double")).otherwise(F.col("weight") * F.lit(rate)))


def thresholds(rows: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """For ``rows`` (source, size, h): per source its ``source_size`` and ``target``; the
    whole ``copies`` of every row; the hash ``edge`` below which a row is taken once more;
    and ``some`` of the ``tied`` rows at the edge itself that are taken once more too."""
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("size")), cycle, most)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    plan = plan.withColumn("copies", F.least(whole, F.lit(most)).cast("int"))
    plan = stash(plan.select("source", F.col("size").alias("source_size"), "target", "copies",
                             F.greatest(F.col("target") - F.col("copies") * F.col("size"), F.lit(0.0)).alias("budget")), "targets")
    state = plan.filter("budget > 0").select("source", "budget", F.lit(0).cast("bigint").alias("prefix"))
    edges, bits = None, 0
    by_source = Window.partitionBy("source").orderBy("bucket")
    while True:
        bits += LEVEL_BITS
        keyed = rows.select("source", "size", "h", F.shiftright("h", HASH_BITS - bits).alias("bucket"))
        if bits > LEVEL_BITS:  # only the boundary buckets
            keyed = (keyed.alias("r").join(state.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.shiftright("r.bucket", LEVEL_BITS) == F.col("s.prefix")))
                     .select("r.source", "size", "h", "bucket"))
        # At most 2^LEVEL_BITS rows of a source.
        tall = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("sum"), F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        tall = tall.withColumn("before", F.sum("sum").over(by_source) - F.col("sum")).alias("t")
        met = (tall.join(state.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")))
               .filter((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("sum") > F.col("budget")))
               .select("t.source", (F.col("budget") - F.col("before")).alias("budget"), F.col("bucket").alias("prefix"), "sum", "n", "low", "high"))
        met = stash(met, "boundary")
        one = (F.col("low") == F.col("high")) if bits < HASH_BITS else F.lit(True)
        done = met.filter(one).select("source", F.col("low").alias("edge"), F.col("n").alias("tied"),
                                      F.floor(F.col("budget") * F.col("n") / F.col("sum") + 0.5).alias("some"))
        edges = done if edges is None else edges.union(done)
        state = met.filter(~one).select("source", "budget", "prefix")
        if bits >= HASH_BITS or state.isEmpty():
            break
    return stash(plan.alias("p").join(edges.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left")
                 .select("p.source", "source_size", "target", "copies", "edge", "tied", "some"), "edges")


def _counted(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """``rows`` (source, h, all) with source_size, target and ``n``, how often each is taken."""
    plan = plan.withColumnRenamed("source", "of_source")
    both = rows.join(plan, F.col("source").eqNullSafe(F.col("of_source")))
    at = F.coalesce(F.col("h") == F.col("edge"), F.lit(False))
    more = F.when(F.coalesce(F.col("h") < F.col("edge"), F.lit(False)), 1)
    cut = F.col("some").between(1, F.col("tied") - 1)
    if plan.filter(cut).isEmpty():
        more = more.when(at & (F.col("some") > 0), 1)
    else:
        # Tied rows are repeats of one row, doc_id included: which of them are taken makes no difference.
        place = F.row_number().over(Window.partitionBy("source", "h").orderBy(F.lit(0)))
        tied = both.filter(at & cut).withColumn("place", place)
        both = both.filter(~(at & cut)).withColumn("place", F.lit(1)).union(tied)
        more = more.when(at & (F.col("place") <= F.col("some")), 1)
    return both.withColumn("n", F.least(F.col("copies") + more.otherwise(0), F.lit(most)))


def mix_report(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``.

    Size: words of the text (null and empty: 0; such rows take no words). Null
    source is a source of its own, ordered last. Null doc_id is hashed as empty.
    Repeated rows tie; as many of them are taken as come nearest to the target.
    Of a total of 0 all targets are 0; an empty table gives an empty result.
    Other columns are not looked at.
    """
    rows = stash(docs.select("doc_id", "source", words(F.col("text")).alias("size"), rank(F.col("doc_id"), F.col("text")).alias("h")), "sizes")
    plan = thresholds(rows.select("source", "size", "h"), cycle, most)
    out = _counted(rows, plan, most)
    return out.select("doc_id", "size", "source_size", "target", (F.col("n") * F.col("size")).cast("bigint").alias("taken"))


def mix(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows that the mix takes, repeated rows as often as taken, columns as in ``docs``."""
    keyed = docs.select("source", rank(F.col("doc_id"), F.col("text")).alias("h"), whole_row(docs).alias("all"))
    rows = stash(docs.select("source", words(F.col("text")).alias("size"), rank(F.col("doc_id"), F.col("text")).alias("h")), "sizes")
    out = _counted(keyed, thresholds(rows, cycle, most), most).filter("n > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("all.*")
