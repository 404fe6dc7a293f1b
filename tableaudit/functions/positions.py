"""Stored row order: a number for every row, and which rows repeat an earlier one.

Rows of a file scan are numbered by file and by their index in it, which the scan itself gives; those of any other frame by
their place in a checkpoint of it. Only digests and numbers of rows are shuffled.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, is_derived

POSITION = "__position"
#: Numbers (8 bytes each) that are sent to every task; more are joined by a shuffle.
SENT_ROWS = 1 << 20


def _scan_index(df: DataFrame) -> tuple[Column, Column] | None:
    """(file, index in it) where ``df`` is a scan, projection and filter of files that have row indexes."""
    if is_derived(df):
        return None
    try:
        meta = df.metadataColumn("_metadata")
        file, index = meta.getField("file_path"), meta.getField("row_index")
        df.select(file, index)
    except AnalysisException:
        return None
    return file, index


def with_position(df: DataFrame, name: str = POSITION) -> DataFrame:
    """``df`` with a row number from 0 in stored order: files by path, rows as they lie in them (without gaps, if no row is
    filtered out). A frame that isn't read from files is checkpointed and numbered in the order in which its rows came."""
    found = _scan_index(df)
    if found is None:
        return cut(df).withColumn(name, F.monotonically_increasing_id())
    file, index = found
    # A row a file: the scan's own list of files has as many.
    sizes = df.select(file.alias("f"), index.alias("i")).groupBy("f").agg(F.max("i").alias("last")).collect()
    at, offsets = 0, []
    for r in sorted(sizes, key=lambda r: r.f):
        offsets.append((r.f, at))
        at += r["last"] + 1
    if len(offsets) <= 1:
        return df.withColumn(name, index)
    file_name = name + "_file"
    starts = df.sparkSession.createDataFrame(offsets, f"`{file_name}` string, `{name}_at` bigint")
    numbered = df.withColumns({file_name: file, name: index}).join(F.broadcast(starts), file_name)
    return numbered.withColumn(name, F.col(name) + F.col(name + "_at")).select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], name)


def repeats(keyed: DataFrame, digest: list[str], name: str = POSITION) -> DataFrame:
    """Numbers of the rows of ``keyed`` (digest columns, number) that have an earlier row of the same digest. A digest that a third
    of all rows share is one row a task in the aggregate; the planner splits its rows in the join."""
    groups = keyed.groupBy(*digest).agg(F.count(F.lit(1)).alias("__n"), F.min(name).alias("__first")).where("__n > 1")
    return keyed.join(groups, digest).where(F.col(name) > F.col("__first")).select(name)


def marked(df: DataFrame, numbers: DataFrame, mark: str, name: str = POSITION) -> DataFrame:
    """``df`` with a Boolean ``mark``: is the row's number among ``numbers`` (checkpointed, distinct)? They are sent to every task
    if they are few, else joined by a shuffle on the number."""
    n = numbers.count()
    if not n:
        return df.withColumn(mark, F.lit(False))
    side = numbers.select(name, F.lit(True).alias(mark))
    out = df.join(F.broadcast(side) if n <= SENT_ROWS else side.hint("merge"), name, "left")
    return out.withColumn(mark, F.coalesce(F.col(mark), F.lit(False)))


def keep_first(df: DataFrame, digest: list[Column]) -> DataFrame:
    """``df`` without the rows that repeat an earlier one by ``digest`` (columns with names of their own)."""
    numbered = with_position(df)
    names = [f"__k{i}" for i in range(len(digest))]
    later = cut(repeats(numbered.select(*[d.alias(n) for d, n in zip(digest, names)], POSITION), names))
    kept = marked(numbered, later, "__later").where("NOT __later")
    return kept.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place from 0 in ``order``: sorted in ranges, counted a range (a row a partition reaches the
    driver), and numbered within it. Rows that tie on the whole order have any of their places."""
    at, part = name + "_at", name + "_part"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    ranged = cut(ranged)
    offsets, before = [], 0
    for r in sorted(ranged.groupBy(part).count().collect(), key=lambda r: r[part]):
        offsets.append((r[part], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(offsets, f"`{part}` int, `{name}` bigint")
    out = ranged.join(F.broadcast(starts), part).withColumn(name, F.col(name) + F.col(at))
    return out.drop(part, at).orderBy(name)
