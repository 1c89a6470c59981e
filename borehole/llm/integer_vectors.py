"""Vectors as whole numbers: each component ``floor(256 * c)``, so that sums and products are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Whole numbers below this are exact in double precision.
EXACT_DOUBLE = 1 << 53


def finite(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    entries = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(entries & (F.size(vector) > 0), F.lit(False))


def integer_rows(table: DataFrame, id_col: str, vector_col: str, *columns: Column) -> DataFrame:
    """``vec_id, x`` and further columns of the rows with a finite vector."""
    vector = F.col(vector_col).cast("array<double>")
    rows = table.where(finite(F.col(vector_col)))
    return rows.select(F.col(id_col).alias("vec_id"), F.transform(vector, lambda c: F.floor(c * SCALE)).alias("x"), *columns)


def one_length(rows: DataFrame) -> int:
    """The number of components, 0 without rows; vectors of several lengths have no common measure and raise."""
    found = rows.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if found["least"] != found["most"]:
        raise ValueError(f"vectors have from {found['least']} to {found['most']} components")
    return found["most"] or 0


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrow lists of one length as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
