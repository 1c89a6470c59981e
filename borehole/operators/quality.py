"""Data-quality reports.

A report is a DataFrame ``(check, column_name, metric, value, detail, severity)``. Each check reads
its table once: all metrics are aggregates of one row, unfolded into report rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borehole.functions import parsing as P

INFO, WARNING, ERROR = "info", "warning", "error"
REPORT = "check string, column_name string, metric string, value double, detail string, severity string"


def _entry(
    check: str,
    column: str | None,
    metric: str,
    value: Column | float | None = None,
    detail: Column | str | None = None,
    severity: str | Column = INFO,
    keep: Column | None = None,
) -> Column:
    """One report row; dropped where ``keep`` is not true."""
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(column).cast("string").alias("column_name"),
        F.lit(metric).alias("metric"),
        F.lit(value).cast("double").alias("value"),
        F.lit(detail).cast("string").alias("detail"),
        F.lit(severity).alias("severity"),
        (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).alias("keep"),
    )


def _unfold(one_row: DataFrame, entries: Sequence[Column]) -> DataFrame:
    fields = [f.split()[0] for f in REPORT.split(", ")]
    return one_row.select(F.inline(F.array(*entries))).where("keep").select(*fields)


def _static(df: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(rows), REPORT)


def is_valid(report: DataFrame) -> bool:
    return report.where(F.col("severity") == ERROR).isEmpty()


def validate_dataset(df: DataFrame, min_rows: int = 1, min_cols: int = 1) -> DataFrame:
    """Size, empty and sparse columns, duplicate rows, column types."""
    df = P.clean_nans(df)
    check = "dataset"
    rows = F.col("rows")
    nulls = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *nulls)
    n_cols = len(df.columns)
    entries = [
        _entry(check, None, "empty", severity=ERROR, keep=rows == 0),
        _entry(check, None, "too_few_rows", rows, severity=ERROR, keep=(rows > 0) & (rows < min_rows)),
        _entry(check, None, "rows", rows),
        _entry(check, None, "columns", float(n_cols)),
    ]
    if n_cols < min_cols:
        entries.append(_entry(check, None, "too_few_columns", float(n_cols), severity=ERROR))
    for i, c in enumerate(df.columns):
        share = F.try_divide(F.lit(100.0) * F.col(f"n{i}"), rows)
        entries += [
            _entry(check, c, "missing_count", F.col(f"n{i}")),
            _entry(check, c, "missing_percentage", share),
            _entry(check, c, "all_missing", severity=WARNING,
                   keep=(rows > 0) & (F.col(f"n{i}") == rows)),
            _entry(check, c, "over_half_missing", share, severity=WARNING, keep=share > 50),
        ]
    entries += [
        _entry(check, None, "dtype_columns", float(n), detail=t)
        for t, n in sorted(_dtype_counts(df).items())
    ]
    # apart from the counts above: rows must be shuffled to be compared, and would carry them
    copies = F.col("duplicate_rows")
    severity = F.when(copies > 0, F.lit(WARNING)).otherwise(F.lit(INFO))
    repeated = _entry(check, None, "duplicate_rows", copies, severity=severity)
    return _unfold(one, entries).unionAll(_unfold(duplicate_rows(df), [repeated]))


def missing_stats(df: DataFrame) -> DataFrame:
    """(column_name, count, percentage) of missing values: nulls and NaN."""
    df = P.clean_nans(df)
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"n{i}").alias("count"),
            F.try_divide(F.lit(100.0) * F.col(f"n{i}"), F.col("rows")).alias("percentage"),
        )
        for i, c in enumerate(df.columns)
    ]
    return one.select(F.inline(F.array(*entries)))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to another row before them, null equal to null."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def _dtype_counts(df: DataFrame) -> dict[str, int]:
    types = [t for _, t in df.dtypes]
    return {t: types.count(t) for t in types}


def dtype_histogram(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        sorted(_dtype_counts(df).items()), "dtype string, columns long"
    )


def validate_columns(
    df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()
) -> DataFrame:
    """Which expected columns are there, which are not, and which are extra."""
    check, have = "columns", set(df.columns)
    rows = [(check, c, "missing_required", None, None, ERROR) for c in required if c not in have]
    rows += [(check, c, "missing_optional", None, None, WARNING) for c in optional if c not in have]
    rows += [(check, c, "extra", None, None, INFO) for c in df.columns
             if c not in {*required, *optional}]
    rows += [(check, c, "found", None, None, INFO) for c in df.columns]
    rows += [(check, c, "required_found", None, None, INFO) for c in required if c in have]
    rows += [(check, c, "optional_found", None, None, INFO) for c in optional if c in have]
    return _static(df, rows)


def _absent(check: str, columns: Sequence[str], df: DataFrame) -> list[Column]:
    return [_entry(check, c, "not_found", severity=ERROR) for c in columns if c not in df.columns]


def _distinct(c: Column, approx: bool) -> Column:
    return F.approx_count_distinct(c) if approx else F.count_distinct(c)


def validate_numeric_columns(
    df: DataFrame, columns: Sequence[str], allow_missing: bool = True, approx: bool = False
) -> DataFrame:
    """Unparseable and missing values, and the spread of numeric columns."""
    df = P.clean_nans(df)
    check, entries, aggs = "numeric", _absent("numeric", columns, df), []
    dtypes = dict(df.dtypes)
    for i, c in enumerate(x for x in columns if x in df.columns):
        number, numeric = P.try_number(df, c), P.is_numeric(df.schema[c].dataType)
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"missing{i}"))
        entries += [
            _entry(check, c, "missing_count", F.col(f"missing{i}")),
            _entry(check, c, "data_type", detail=dtypes[c]),
        ]
        if not allow_missing:
            entries.append(
                _entry(check, c, "has_missing", severity=ERROR, keep=F.col(f"missing{i}") > 0)
            )
        if not numeric:
            aggs.append(F.count_if(number.isNull() & F.col(c).isNotNull()).alias(f"bad{i}"))
            entries.append(_entry(check, c, "non_numeric_values", F.col(f"bad{i}"),
                                  severity=WARNING, keep=F.col(f"bad{i}") > 0))
            continue
        stats = {
            "min": F.min(number),
            "max": F.max(number),
            "mean": F.avg(number),
            "std": F.stddev_samp(number),
            "unique_values": _distinct(number, approx),
        }
        for name, agg in stats.items():
            aggs.append(agg.alias(f"{name}{i}"))
            entries.append(_entry(check, c, name, F.col(f"{name}{i}"), keep=F.col(f"min{i}").isNotNull()))
    one = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    return _unfold(one, entries)


def validate_date_columns(
    df: DataFrame, columns: Sequence[str], approx: bool = False
) -> DataFrame:
    """Parse failures, range and repeats of date columns."""
    check, entries, aggs = "date", _absent("date", columns, df), []
    present = [c for c in columns if c in df.columns]
    parsed = df.select(
        *[F.col(c).alias(f"raw{i}") for i, c in enumerate(present)],
        *[P.try_date(df, c).alias(f"day{i}") for i, c in enumerate(present)],
    )
    for i, c in enumerate(present):
        raw, day = F.col(f"raw{i}"), F.col(f"day{i}")
        typed = P.is_date(df.schema[c].dataType)
        aggs += [
            F.count_if(day.isNull() & raw.isNotNull()).alias(f"bad{i}"),
            F.count(day).alias(f"n{i}"),
            F.min(day).alias(f"min{i}"),
            F.max(day).alias(f"max{i}"),
            _distinct(day, approx).alias(f"d{i}"),
        ]
        some, bad = F.col(f"n{i}") > 0, F.col(f"bad{i}")
        repeats = F.col(f"n{i}") - F.col(f"d{i}")
        # whole days between two moments, not calendar days
        span = F.floor(F.extract(F.lit("DAY"), F.col(f"max{i}") - F.col(f"min{i}")))
        entries += [
            _entry(check, c, "is_datetime", 1.0 if typed else 0.0),
            _entry(check, c, "min_date", detail=F.date_format(f"min{i}", "yyyy-MM-dd"), keep=some),
            _entry(check, c, "max_date", detail=F.date_format(f"max{i}", "yyyy-MM-dd"), keep=some),
            _entry(check, c, "total_days", span, keep=some),
            _entry(check, c, "unique_dates", F.col(f"d{i}"), keep=some),
            _entry(check, c, "duplicate_dates", repeats, severity=WARNING, keep=repeats > 0),
        ]
        if not typed:
            severity = F.when(bad > 0, F.lit(WARNING)).otherwise(F.lit(INFO))
            entries.append(_entry(check, c, "conversion_failures", bad, severity=severity))
    one = parsed.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    return _unfold(one, entries)


def validate_coordinates(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Non-numeric and out-of-range values, usable pairs, and suspicious ranges."""
    check = "coordinates"
    absent = [(check, c, "not_found", None, None, ERROR) for c in (lat, lon) if c not in df.columns]
    if absent:
        return _static(df, absent)
    pairs = df.select(
        F.col(lat).alias("raw_lat"),
        F.col(lon).alias("raw_lon"),
        P.try_number(df, lat).alias("lat"),
        P.try_number(df, lon).alias("lon"),
    )
    aggs, entries = [F.count(F.lit(1)).alias("rows")], []
    valid = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    aggs.append(F.count_if(valid).alias("valid"))
    for axis, name, limit in (("lat", lat, 90), ("lon", lon, 180)):
        c = F.col(axis)
        aggs += [
            F.count_if(~c.between(-limit, limit)).alias(f"out_{axis}"),
            F.count_if(c.isNull() & F.col(f"raw_{axis}").isNotNull()).alias(f"bad_{axis}"),
            F.min(c).alias(f"min_{axis}"),
            F.max(c).alias(f"max_{axis}"),
        ]
        entries += [
            _entry(check, name, "out_of_range", F.col(f"out_{axis}"), severity=WARNING,
                   keep=F.col(f"out_{axis}") > 0),
            _entry(check, name, "non_numeric_values", F.col(f"bad_{axis}"), severity=WARNING,
                   keep=F.col(f"bad_{axis}") > 0),
            _entry(check, name, "min", F.col(f"min_{axis}")),
            _entry(check, name, "max", F.col(f"max_{axis}")),
        ]
    some = F.col("valid") > 0
    spread = {a: F.col(f"max_{a}") - F.col(f"min_{a}") for a in ("lat", "lon")}
    entries += [
        _entry(check, None, "total_records", F.col("rows")),
        _entry(check, None, "valid_coordinates", F.col("valid")),
        _entry(check, None, "invalid_coordinates", F.col("rows") - F.col("valid")),
        # one distinct value means smallest equals largest, which needs no distinct count
        _entry(check, None, "all_identical", severity=WARNING,
               keep=some & (spread["lat"] == 0) & (spread["lon"] == 0)),
        _entry(check, None, "very_small_range", severity=WARNING,
               keep=some & (spread["lat"] < 0.001) & (spread["lon"] < 0.001)),
    ]
    return _unfold(pairs.agg(*aggs), entries)
