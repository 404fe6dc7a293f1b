"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableaudit.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folder of the step that runs, if it is to be dropped afterwards.
_STEP: ContextVar[str | None] = ContextVar("step", default=None)


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder, or below the folder of the step that runs."""
    return f"{_STEP.get() or checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``shared_path`` named."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def step_folder(spark: SparkSession, label: str) -> Iterator[None]:
    """What is stashed inside goes into one folder, which is dropped at the end: write what is to stay elsewhere first."""
    path = shared_path(spark, f"{label}-steps")
    token = _STEP.set(path)
    try:
        yield
    finally:
        _STEP.reset(token)
        drop(spark, path)


def stash(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage
    ends there, and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_hash(*cols: Column) -> Column:
    """64-bit identity of a row (nulls told apart from empty values)."""
    return F.xxhash64(*[x for c in cols for x in (c, c.isNull())])


def row_key(*cols: Column) -> Column:
    """128-bit identity of a row, for joins in which two rows of one hash would give a wrong result: two 64-bit hashes of different beginnings."""
    return F.struct(*[F.xxhash64(F.lit(seed), *[x for c in cols for x in (c, c.isNull())]).alias(name) for seed, name in ((1, "a"), (2, "b"))])


#: Type of a row_key.
ROW_KEY = "struct<a:bigint,b:bigint>"


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and one that has done a
    large task would keep what it took while others run beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``most_bytes`` of ``column``
    (one row at least): what a task keeps in memory doesn't follow the batch size."""
    for batch in batches:
        start = size = 0
        values = batch.column(batch.schema.get_field_index(column))
        lengths = pc.binary_length(values).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and size + (n or 0) > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


def kept(docs: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], object]]) -> DataFrame:
    """The rows of ``docs`` that a mask keeps, all columns as they are, whatever their names.
    ``start`` runs once a task and gives the function that makes the mask of a batch."""
    names, numbered = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*numbered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = start()
        for batch in slices((b.rename_columns(names) for b in batches), "text"):
            yield batch.filter(pa.array(mask(batch), pa.bool_())).rename_columns(numbered)

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null is empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return pc.fill_null(values.cast(pa.binary()), b"").to_pylist()
