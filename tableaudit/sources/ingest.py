"""A: sources and ingest: read, type, validate and rename an uploaded table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from . import splitcsv as SC
from ..functions.expressions import BLANK_TEXT, NUMBER_TEXT, col, finite_frame, is_text, snake_case, to_number

# The text tokens a CSV reader turns into missing by default.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
INTEGRAL_TEXT = r"^\s*[+-]?\d+\s*$"
TRUE_TEXT, FALSE_TEXT = ("True", "TRUE", "true"), ("False", "FALSE", "false")


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> tuple[DataFrame, str | None]:
    """A1: load a table. CSV is read as text with a header; quoted fields may hold
    separators, doubled quotes and line ends. Files are read in as many tasks as they have splits, line ends in quotes or not
    (``splitcsv``). Bytes that are no UTF-8 make the encoding latin-1, which decodes any. With options
    beside ``sep`` and ``quote`` the plain reader is taken. Returns ``(df, encoding)``."""
    fmt = fmt or path.rsplit(".", 1)[-1].lower()
    if fmt not in ("csv", "txt", "tsv"):
        return spark.read.format(fmt).options(**options).load(path), None
    options = {("sep" if k == "delimiter" else k): v for k, v in options.items()}
    sep, quote = options.get("sep", "\t" if fmt == "tsv" else ","), options.get("quote", '"')
    layout = SC.examine(spark, path, sep, quote)
    plain = {"header": "true", "inferSchema": "false", "mode": "PERMISSIVE", "sep": sep, "quote": quote, "escape": '"',
             "encoding": SC.SPARK_NAMES[layout.encoding], **options}
    own = set(options) - {"sep", "quote"}
    if own or layout.returns_only or layout.empty:
        return spark.read.options(**{"multiLine": "true", **plain}).csv(path), layout.encoding
    if not layout.quoted_line_ends:
        return spark.read.options(**plain).csv(path), layout.encoding
    return SC.parsed(SC.records(spark, layout, sep, quote), layout.header, sep, quote), layout.encoding


def null_tokens(df: DataFrame, blank_is_null: bool = False) -> DataFrame:
    """Default missing-value tokens in text columns become null; blank text stays, unless asked."""
    def present(c: Column) -> Column:
        gone = c.isin(*NA_TOKENS)
        return F.when(~(gone | c.rlike(BLANK_TEXT)) if blank_is_null else ~gone, c)

    return df.select(*[(present(col(f.name)) if is_text(f.dataType) else col(f.name)).alias(f.name) for f in df.schema.fields])


#: Types that a text column may have, the first that fits all its values: a test, and the expression.
def _candidates(c: Column) -> list[tuple[str, Column, Column]]:
    whole = c.rlike(INTEGRAL_TEXT)
    return [
        ("boolean", c.isin(*TRUE_TEXT, *FALSE_TEXT), c.isin(*TRUE_TEXT)),
        ("bigint", whole & F.trim(c).try_cast("bigint").isNotNull(), F.trim(c).try_cast("bigint")),
        ("decimal", whole & F.trim(c).try_cast("decimal(38,0)").isNotNull(), F.trim(c).try_cast("decimal(38,0)")),
        ("double", c.rlike(NUMBER_TEXT) & ~whole | whole & F.trim(c).try_cast("bigint").isNotNull(), to_number(c, T.StringType())),
    ]


def infer_types(df: DataFrame, blank_is_null: bool = False) -> DataFrame:
    """A2: a text column becomes boolean, bigint, decimal (integers beyond 64 bits) or
    double if all its non-null values are such; else it stays text, as dates do.
    One aggregate job decides all columns."""
    df = null_tokens(df, blank_is_null)
    tests = {f.name: _candidates(col(f.name)) for f in df.schema.fields if is_text(f.dataType)}
    if not tests:
        return df
    aggs = []
    for i, (c, kinds) in enumerate(tests.items()):
        aggs += [F.count(col(c)).alias(f"n{i}"), *[F.count_if(fits).alias(f"{kind}{i}") for kind, fits, _ in kinds]]
    row = df.agg(*aggs).first()
    chosen = {}
    for i, (c, kinds) in enumerate(tests.items()):
        chosen[c] = next((e for kind, _, e in kinds if row[f"n{i}"] and row[f"{kind}{i}"] == row[f"n{i}"]), col(c))
    return df.select(*[chosen.get(c, col(c)).alias(c) for c in df.columns])


def inferred_schema(df: DataFrame) -> DataFrame:
    """The types ``infer_types`` picks, one row per column."""
    t = infer_types(df)
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in t.schema.fields],
                                           "column string, inferred_type string")


def validate_input(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A4: (check, passed, message) rows: readable, has columns, has rows, no ragged rows.
    Of CSV, the columns, rows and ragged rows are found in one pass over the splits after the one that finds how they begin."""
    checks: list[tuple[str, bool, str]] = []

    def report() -> DataFrame:
        return spark.createDataFrame(checks, "check string, passed boolean, message string")

    bad = None
    try:
        if fmt == "csv":
            layout = SC.examine(spark, path)
            if not layout.files:
                checks.append(("non_empty_file", False, "The file is empty."))
                return report()
            cols = [] if layout.empty else layout.header
            n = 0
            if cols:
                rows = SC.parsed(SC.records(spark, layout), cols, corrupt=True)
                n, bad = rows.agg(F.count(F.lit(1)), F.count(F.col(SC.CORRUPT))).first()
        else:
            df = spark.read.format(fmt).load(path)
            cols, n = df.columns, df.limit(1).count()
        checks.append(("readable", True, "The file could be read."))
    except Exception as exc:  # noqa: BLE001
        checks.append(("readable", False, f"Could not parse file: {type(exc).__name__}"))
        return report()
    checks.append(("has_columns", bool(cols), f"{len(cols)} columns." if cols else "No columns found."))
    checks.append(("has_rows", n > 0, "Has rows." if n else "The file has a header but no data rows."))
    if bad is not None:
        checks.append(("row_shape", bad == 0, f"{bad} row(s) have a different number of fields than the header."))
    return report()


def normalise_headers(df: DataFrame, renames: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """A5: snake_case names (user map first, rule for the rest); collisions get _2, _3."""
    renames = {k: v for k, v in (renames or {}).items() if k in df.columns}
    out, seen = [], {}
    for c in df.columns:
        new = renames.get(c) or snake_case(c)
        base, k = new, 1
        while new in seen:
            k += 1
            new = f"{base}_{k}"
        seen[new] = c
        out.append(new)
    mapping = dict(zip(df.columns, out))
    return df.toDF(*out), mapping


def row_limit_warning(df: DataFrame, limit: int = C.ROW_LIMIT_SOFT_WARNING) -> str | None:
    """A warning when the table has more than ``limit`` rows (reads at most limit+1)."""
    if df.limit(limit + 1).count() > limit:
        return f"Dataset has more than {limit:,} rows — processing continues."
    return None


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and +-Infinity become null in every float column, arrays and structs included."""
    return finite_frame(df)
