"""Cleaning, type detection, filling, encoding and scaling."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borehole.functions import parsing as P
from borehole.operators import grouping as G

DATE_SAMPLE = 10  # values looked at to decide whether a text column holds dates

# Words in column names that give their meaning away.
LATITUDE_WORDS = ("lat", "latitude")
LONGITUDE_WORDS = ("lon", "longitude", "long")
IDENTIFIER_WORDS = ("id", "station", "site", "well")
TARGET_WORDS = ("level", "depth", "height", "water", "gwl", "wl")


# --- columns and rows -------------------------------------------------------------------


def clean_column_names(df: DataFrame) -> DataFrame:
    """Trim, spaces to underscores, other symbols dropped."""
    names = [re.sub("[^A-Za-z0-9_]", "", c.strip().replace(" ", "_")) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes or "" in names:
        raise ValueError(f"column names clash or vanish once cleaned: {clashes or ['']}")
    return df.toDF(*names)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def null_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows and nulls per column, in one pass."""
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
    ).first()
    return row["_rows"], {c: row[f"n{i}"] for i, c in enumerate(df.columns)}


def drop_empty_columns(df: DataFrame) -> DataFrame:
    rows, nulls = null_counts(df)
    return df.select(*[F.col(c) for c in df.columns if nulls[c] < rows])


def drop_sparse_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Drop columns whose share of missing values (null or NaN) is above ``threshold``."""
    rows, nulls = null_counts(P.clean_nans(df))
    return df.select(*[F.col(c) for c in df.columns if nulls[c] <= threshold * rows])


BOOLEAN_TEXTS = ("True", "TRUE", "true", "False", "FALSE", "false")


def _cell_counts(df: DataFrame) -> dict[str, dict[str, int]]:
    """Per column: rows, non-null cells and, for texts, cells of each kind. One pass."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    texts = P.text_columns(df)
    for i, c in enumerate(df.columns):
        aggs.append(F.count(F.col(c)).alias(f"present{i}"))
        if c in texts:
            aggs += [
                F.count(P.try_number(df, c)).alias(f"number{i}"),
                F.count_if(F.col(c).rlike(P.INTEGER)).alias(f"integer{i}"),
                F.count_if(F.col(c).isin(*BOOLEAN_TEXTS)).alias(f"boolean{i}"),
            ]
    row = df.agg(*aggs).first().asDict()
    kinds = ("present", "number", "integer", "boolean")
    return {
        c: {"rows": row["rows"]} | {k: row.get(f"{k}{i}", 0) for k in kinds}
        for i, c in enumerate(df.columns)
    }


def _numeric_cast(df: DataFrame, c: str, n: dict[str, int], inferred: bool) -> Column:
    """The column as the type its cells speak for."""
    rows, present, numbers = n["rows"], n["present"], n["number"]
    if inferred and rows and n["integer"] == rows:
        return F.trim(c).cast("long").alias(c)
    if inferred and rows and n["boolean"] == rows:
        return (F.lower(c) == "true").alias(c)
    if numbers > 0.5 * rows or (inferred and present and numbers == present):
        return P.try_number(df, c).alias(c)
    return F.col(c)


def coerce_numeric(df: DataFrame, inferred: bool = False) -> DataFrame:
    """Text columns become double when more than half of all rows are numbers.

    With ``inferred`` (columns fresh from a delimited file) a column whose every non-null
    value is a number becomes numeric however sparse it is: whole numbers without gaps
    become long, ``true``/``false`` without gaps become boolean.
    """
    texts = P.text_columns(df)
    if not texts:
        return df
    counts = _cell_counts(df.select(*texts))
    return df.select(
        *[_numeric_cast(df, c, counts[c], inferred) if c in counts else F.col(c) for c in df.columns]
    )


def date_like_columns(df: DataFrame, order_by: Sequence[str] = ()) -> list[str]:
    """Text columns where more than half of the first ten non-null values look like dates.

    ``order_by`` says what "first" means; without it the rows are taken in the order of their hash. All columns are
    judged in one scan: each task keeps ten values per column.
    """
    texts = P.text_columns(df)
    if not texts:
        return []
    order = [F.col(c) for c in order_by] if order_by else [F.xxhash64(*df.columns)]
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(texts)])
    values = df.select(place.alias("place"), F.inline(cells)).where(F.col("v").isNotNull())
    first = G.top_per_group(values, ["i"], [F.col("place"), F.col("v")], DATE_SAMPLE)
    share = F.avg(P.has_date_shape(F.col("v")).cast("int"))
    rows = first.groupBy("i").agg(share.alias("s")).where("s > 0.5").collect()  # at most one row per column
    return [texts[i] for i in sorted(r["i"] for r in rows)]


def coerce_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Parse the given columns; what does not parse becomes null."""
    return df.select(
        *[P.try_date(df, c).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def tidy(df: DataFrame, order_by: Sequence[str] = (), inferred: bool = False) -> DataFrame:
    """The whole cleaning pass over a freshly read table.

    Empty columns and numeric columns are found in the same pass over the data.
    """
    df = drop_empty_rows(clean_column_names(P.clean_nans(df)))
    counts = _cell_counts(df)
    texts = P.text_columns(df)
    df = df.select(
        *[
            _numeric_cast(df, c, counts[c], inferred) if c in texts else F.col(c)
            for c in df.columns
            if counts[c]["present"]
        ]
    )
    return coerce_dates(df, date_like_columns(df, order_by))


# --- what kind of table is it -----------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    """Outcome of :func:`detect_dataset_type`."""

    kind: str
    rows: int
    missing_percentage: float
    date_columns: tuple[str, ...]
    coordinates: tuple[str, ...]
    identifiers: tuple[str, ...]
    numeric: tuple[str, ...]
    targets: tuple[str, ...]
    dtypes: tuple[tuple[str, str], ...]

    @property
    def features(self) -> dict[str, str]:
        found = {}
        if self.date_columns:
            found["temporal"] = f"Date columns found: {', '.join(self.date_columns)}"
        if self.coordinates:
            found["geospatial"] = f"Coordinates found: {', '.join(self.coordinates)}"
        if self.identifiers:
            found["identifiers"] = f"ID columns: {', '.join(self.identifiers)}"
        found["data_quality"] = f"{self.missing_percentage:.1f}% missing values"
        if self.targets:
            found["potential_targets"] = f"Possible targets: {', '.join(self.targets)}"
        elif self.numeric:
            found["potential_targets"] = f"Numeric columns: {', '.join(self.numeric[:3])}"
        return found


def _named(columns: Sequence[str], words: Sequence[str]) -> list[str]:
    return [c for c in columns if any(w in c.lower() for w in words)]


def detect_dataset_type(df: DataFrame, order_by: Sequence[str] = ()) -> Profile:
    """Tabular, time series or geospatial, with the columns that say so."""
    rows, nulls = null_counts(df)
    dates = set(P.date_typed_columns(df)) | set(date_like_columns(df, order_by))
    lats = _named(df.columns, LATITUDE_WORDS)
    lons = _named(df.columns, LONGITUDE_WORDS)
    coordinates = (lats[0], lons[0]) if lats and lons else ()
    kind = "geospatial" if coordinates else "tabular"
    if dates and rows > 10:
        kind = "timeseries"
    numeric = P.numeric_columns(df)
    cells = rows * len(df.columns)
    return Profile(
        kind=kind,
        rows=rows,
        missing_percentage=100.0 * sum(nulls.values()) / cells if cells else 0.0,
        date_columns=tuple(c for c in df.columns if c in dates),
        coordinates=coordinates,
        identifiers=tuple(_named(df.columns, IDENTIFIER_WORDS)),
        numeric=tuple(numeric),
        targets=tuple(_named(numeric, TARGET_WORDS)),
        dtypes=tuple(df.dtypes),
    )


# What is suggested for each detected type, and always.
RECOMMENDED = {
    "tabular": "Suitable for tabular prediction (regression/classification)",
    "timeseries": "Suitable for time-series forecasting",
    "geospatial": "Suitable for geospatial mapping and clustering",
}
ALWAYS_RECOMMENDED = "Can always run anomaly detection on any dataset"


def recommendations(kind: str) -> list[str]:
    """What to run on a dataset of this type."""
    return [*([RECOMMENDED[kind]] if kind in RECOMMENDED else []), ALWAYS_RECOMMENDED]


def missing_percentage(df: DataFrame) -> DataFrame:
    """Missing cells (null or NaN) as a percentage of all cells."""
    df = P.clean_nans(df)
    cells = F.count(F.lit(1)) * len(df.columns)
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    return df.agg(F.try_divide(F.lit(100.0) * nulls, cells).alias("missing_percentage"))


def column_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column_name string, dtype string")


# --- missing values ---------------------------------------------------------------------


def _fill_from(
    df: DataFrame, stats: DataFrame, cols: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Fill nulls of ``cols`` from the per-key columns ``fill_{col}`` of ``stats``."""
    joined = G.attach_stats(df, stats, keys)
    return joined.select(
        *[
            F.coalesce(F.col(c), F.col(f"fill_{c}").cast(df.schema[c].dataType)).alias(c)
            if c in cols
            else F.col(c)
            for c in df.columns
        ]
    )


def _widened(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Means and medians of whole numbers are no whole numbers."""
    return df.select(
        *[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def fill_mean(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    cols = [c for c in P.numeric_columns(df) if c not in keys]
    df = _widened(P.clean_nans(df), cols)
    return _fill_from(df, df.groupBy(*keys).agg(*[F.avg(c).alias(f"fill_{c}") for c in cols]), cols, keys)


def fill_median(
    df: DataFrame, cols: Sequence[str] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Missing values (null or NaN) become the exact median of their column."""
    df = P.clean_nans(df)
    cols = [c for c in (P.numeric_columns(df) if cols is None else cols) if c not in keys]
    if not cols:
        return df
    df = _widened(df, cols)
    # medians are looked for only in columns that have gaps; one pass says which
    _, nulls = null_counts(df.select(*cols))
    cols = [c for c in cols if nulls[c]]
    if not cols:
        return df
    medians = G.exact_quantiles(df, cols, [0.5], keys)
    medians = medians.select(*keys, *[F.col(f"{c}_q0").alias(f"fill_{c}") for c in cols])
    return _fill_from(df, medians, cols, keys)


def fill_mode(
    df: DataFrame, cols: Sequence[str] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Missing values (null or NaN) become the most frequent value, the smallest on ties."""
    df = P.clean_nans(df)
    cols = [c for c in (df.columns if cols is None else cols) if c not in keys]
    # values are counted only in columns that have gaps; one pass says which
    _, nulls = null_counts(df.select(*cols)) if cols else (0, {})
    cols = [c for c in cols if nulls[c]]
    if not cols:
        return df
    found = G.modes(df, cols, keys)
    found = found.select(*keys, *[F.col(c).alias(f"fill_{c}") for c in cols])
    return _fill_from(df, found, cols, keys)


def forward_fill(
    df: DataFrame, cols: Sequence[str], order_by: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Nulls become the last value before them in ``order_by``."""
    rows = G.ordered(df, keys, order_by)
    upto = rows.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.df
    for c in cols:
        filled = filled.withColumn(f"fill_{c}", F.last(c, ignorenulls=True).over(upto))
    if rows.partition != tuple(keys):  # split groups: carry the last value into the next piece
        earlier = (
            Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        )
        lasts = rows.df.groupBy(*keys, "_chunk").agg(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_pos"))).alias(f"c{i}")
              for i, c in enumerate(cols)]
        )
        carried = lasts.select(
            *keys,
            "_chunk",
            *[F.last(f"c{i}", ignorenulls=True).over(earlier).alias(f"carry{i}")
              for i in range(len(cols))],
        )
        filled = G.attach(filled, carried, [*keys, "_chunk"])
        for i, c in enumerate(cols):
            filled = filled.withColumn(f"fill_{c}", F.coalesce(f"fill_{c}", f"carry{i}"))
    return filled.select(
        *[F.col(f"fill_{c}").alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def fill_missing(
    df: DataFrame,
    strategy: str = "auto",
    threshold: float = 0.5,
    order_by: Sequence[str] = (),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Drop sparse columns, then fill by ``strategy``.

    ``auto``: text by mode, dates by the value before, numbers by the median.
    ``drop``: rows with a null go. ``fill_mean``, ``fill_median``: numbers only.
    ``fill_mode``: every column.
    """
    df = drop_sparse_columns(df, threshold)
    if strategy == "drop":
        return df.na.drop("any")
    if strategy == "fill_mean":
        return fill_mean(df, keys)
    if strategy == "fill_median":
        return fill_median(df, keys=keys)
    if strategy == "fill_mode":
        return fill_mode(df, keys=keys)
    if strategy != "auto":
        raise ValueError(f"unknown strategy: {strategy}")
    _, nulls = null_counts(df)
    gaps = [c for c in df.columns if nulls[c] and c not in keys]
    dates = [c for c in gaps if c in P.date_typed_columns(df)]
    if dates:
        if not order_by:
            raise ValueError(f"order_by must say in which order {dates} are filled forward")
        df = forward_fill(df, dates, order_by, keys)
    df = fill_mode(df, [c for c in gaps if c in P.text_columns(df)], keys)
    return fill_median(df, [c for c in gaps if c in P.numeric_columns(df)], keys)


# --- encoding and scaling ---------------------------------------------------------------


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    if not cols:
        return {}
    aggs = [F.count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs).first()
    return {c: row[f"d{i}"] for i, c in enumerate(cols)}


def encode_onehot(
    df: DataFrame, cols: Sequence[str] | None = None, max_categories: int = 20
) -> DataFrame:
    """Text columns of few categories become one flag per category but the first.

    A null has no flag set. Columns with more categories are left as they are.
    """
    cols = P.text_columns(df) if cols is None else list(cols)
    counts = distinct_counts(df, cols)
    few = [c for c in cols if counts[c] <= max_categories]
    columns: list[Column] = [F.col(c) for c in df.columns if c not in few]
    for c in few:  # at most max_categories values each
        values = [r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().collect()]
        for v in sorted(values)[1:]:
            columns.append(F.coalesce(F.col(c) == v, F.lit(False)).alias(f"{c}_{v}"))
    return df.select(*columns)


def label_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes count up from 0 in alphabetical order; null is the text ``nan``."""
    values = df.select(_as_label(column).alias("value")).distinct()
    return G.ordered(values, (), ["value"]).df.select("value", F.col("_pos").alias("code"))


def _as_label(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("nan"))


def encode_label(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Text columns become alphabetical integer codes, however many categories they have."""
    out = df
    for c in P.text_columns(df) if cols is None else cols:
        codes = label_dictionary(df, c).select(F.col("value").alias("_value"), "code")
        out = out.join(codes, _as_label(c) == F.col("_value"), "left").select(
            *[F.col("code").alias(c) if x == c else F.col(x) for x in out.columns]
        )
    return out


def encode_categorical(
    df: DataFrame, encoding: str = "onehot", max_categories: int = 20
) -> DataFrame:
    """One-hot up to ``max_categories``, label codes for the rest (or for all)."""
    if encoding not in ("onehot", "label"):
        raise ValueError(f"unknown encoding: {encoding}")
    if encoding == "onehot":
        df = encode_onehot(df, max_categories=max_categories)
    return encode_label(df)


def impute_median(
    df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    return fill_median(df, features, keys)


def standardize(
    df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """(x - mean) / population deviation; a constant feature becomes 0. NaN is missing."""
    df = P.clean_nans(df)
    stats = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in features],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in features],
    )
    scaled = {
        c: F.when(
            F.col(c).isNotNull(),
            F.coalesce(F.try_divide(F.col(c) - F.col(f"mean_{c}"), F.col(f"std_{c}")), F.lit(0.0)),
        ).alias(c)
        for c in features
    }
    return G.attach_stats(df, stats, keys).select(*[scaled.get(c, F.col(c)) for c in df.columns])


# --- looking at rows --------------------------------------------------------------------


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def tail(
    df: DataFrame, order_by: Sequence[str], n: int = 50, keys: Sequence[str] = ()
) -> DataFrame:
    """The last ``n`` rows of each group."""
    return G.top_per_group(df, keys, [F.col(c).desc() for c in order_by], n).drop("rank")
