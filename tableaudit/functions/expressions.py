"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)

# A number as a text parser reading numbers would accept it (no type suffixes).
NUMBER_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"
# White space as Unicode has it; RE2 and Java read the class alike.
BLANK_TEXT = r"^[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*$"


def name_has(name: str, patterns) -> bool:
    """Substring test on the lower-cased column name."""
    low = name.lower()
    return any(p in low for p in patterns)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def column_kinds(df: DataFrame) -> dict[str, list[str]]:
    """B1: split columns into numeric / categorical / datetime / other (schema only)."""
    out = {"numeric": [], "categorical": [], "datetime": [], "other": []}
    for f in df.schema.fields:
        if is_numeric(f.dataType):
            out["numeric"].append(f.name)
        elif is_text(f.dataType):
            out["categorical"].append(f.name)
        elif is_datetime(f.dataType):
            out["datetime"].append(f.name)
        else:
            out["other"].append(f.name)
    return out


def q(name: str) -> str:
    """Back-quote a column name for SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def to_number(c: Column, dtype: T.DataType | None = None) -> Column:
    """A3: coerce to double; text that is not a plain number and NaN become null."""
    if dtype is not None and is_numeric(dtype):
        if not isinstance(dtype, (T.FloatType, T.DoubleType)):
            return c.cast("double")  # integers and decimals cannot hold NaN
        d = c.cast("double")
    elif dtype is not None and isinstance(dtype, T.BooleanType):
        d = c.cast("double")
    elif dtype is not None and not is_text(dtype):
        return F.lit(None).cast("double")
    else:
        s = c.cast("string")
        d = F.when(s.rlike(NUMBER_TEXT), F.trim(s).try_cast("double"))
    return F.when(~F.isnan(d), d)


def number_of(df: DataFrame, name: str) -> Column:
    """to_number for a column of ``df`` looked up by name."""
    return to_number(col(name), df.schema[name].dataType)


def exact_key(df: DataFrame, name: str) -> Column | None:
    """Text of the integers and decimals of a column that a double cannot tell
    apart (null for the others); None where the type has no such values."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.LongType):
        return F.when((col(name) > 1 << 53) | (col(name) < -(1 << 53)), col(name).cast("string"))
    if isinstance(dtype, T.DecimalType) and dtype.precision > 15:
        return col(name).cast("string")
    return None


def exact_keys(df: DataFrame, names) -> dict[str, Column]:
    return {c: k for c in names if (k := exact_key(df, c)) is not None}


def finite_or_null(c: Column) -> Column:
    """NaN and +-Infinity become null."""
    return F.when(~(F.isnan(c) | (F.abs(c) == F.lit(float("inf")))), c)


def finite_frame(df: DataFrame) -> DataFrame:
    """A7 over a whole frame: floats, arrays and structs of floats cleaned recursively."""
    def fix(c: Column, dt: T.DataType) -> Column:
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            return finite_or_null(c)
        if isinstance(dt, T.ArrayType):
            return F.transform(c, lambda x: fix(x, dt.elementType))
        if isinstance(dt, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[fix(c[f.name], f.dataType).alias(f.name)
                                                     for f in dt.fields]))
        return c
    return df.select(*[fix(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is one thing: NaN in float columns becomes null (ingest rule)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            cols.append(F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name))
        else:
            cols.append(col(f.name))
    return df.select(*cols)


def missing(c: Column, dtype: T.DataType) -> Column:
    """Null, or blank after trimming when the column holds text."""
    if is_text(dtype):
        return c.isNull() | c.rlike(BLANK_TEXT)
    return c.isNull()


def null_share(df: DataFrame) -> Column:
    """Share of a row's columns that are null."""
    n = len(df.columns)
    parts = [col(c).isNull().cast("int") for c in df.columns]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / F.lit(float(max(n, 1)))


#: (least affected share, label), highest first; below all of them: low.
SEVERITIES = ((C.SEVERITY_HIGH, "high"), (C.SEVERITY_MEDIUM, "medium"))


def severity(affected: Column, total: Column) -> Column:
    """Affected share >= .20 high, >= .05 medium, else low."""
    share = affected / F.greatest(total, F.lit(1))
    return F.coalesce(*[F.when(share >= least, label) for least, label in SEVERITIES], F.lit("low"))


def severity_of(affected: int, total: int) -> str:
    """``severity`` of driver-side counts."""
    return next((label for least, label in SEVERITIES if affected / max(total, 1) >= least), "low")


def score_band(score: Column) -> Column:
    """>= 80 Good, >= 50 Fair, else Poor."""
    return F.when(score >= 80, "Good").when(score >= 50, "Fair").otherwise("Poor")


def any_of(conds: list[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def snake_case(name: str) -> str:
    """A5 rule: the name's runs of ASCII letters and digits, in lower case, joined by '_'."""
    import re
    return "_".join(re.findall("[a-z0-9]+", str(name).lower())) or "column"
