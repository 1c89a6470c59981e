"""Parsing of text into numbers and dates, and missing-value rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The date shapes looked for anywhere in a text.
DATE_PATTERNS = (
    r"\d{4}-\d{2}-\d{2}",  # year-month-day
    r"\d{2}/\d{2}/\d{4}",  # month/day/year
    r"\d{2}-\d{2}-\d{4}",  # month-day-year
    r"\d{4}/\d{2}/\d{2}",  # year/month/day
)

# The parse formats for the shapes above, time of day optional.
DATE_FORMATS = (
    "yyyy-MM-dd[ HH:mm[:ss]]",
    "MM/dd/yyyy[ HH:mm[:ss]]",
    "MM-dd-yyyy[ HH:mm[:ss]]",
    "yyyy/MM/dd[ HH:mm[:ss]]",
)

# The texts a delimited file uses for "missing" (the pandas defaults).
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))\s*$"
INTEGER = r"^\s*[+-]?\d{1,18}\s*$"


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_date(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType)]


def date_typed_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_date(f.dataType)]


def try_number(df: DataFrame, name: str) -> Column:
    """The column as double; null where it is no number.

    The pattern is checked first because a plain string cast also takes ``1d`` and ``1f``.
    """
    dtype = df.schema[name].dataType
    c = F.col(name)
    if is_numeric(dtype):
        return nan_to_null(c.cast("double"))
    if is_text(dtype):
        return nan_to_null(F.when(c.rlike(NUMBER), c.try_cast("double")))
    return F.lit(None).cast("double")


def try_date(df: DataFrame, name: str) -> Column:
    """The column as a timestamp without zone; null where no format fits."""
    if not is_text(df.schema[name].dataType):
        return F.col(name).cast("timestamp_ntz")
    parsed = [F.try_to_timestamp(F.trim(F.col(name)), F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*parsed).cast("timestamp_ntz")


def has_date_shape(c: Column) -> Column:
    return c.rlike("|".join(DATE_PATTERNS))


def nan_to_null(c: Column) -> Column:
    """NaN means missing, but Spark would rank it above every number."""
    return F.when(~F.isnan(c), c)


def clean_nans(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(
        *[nan_to_null(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )
