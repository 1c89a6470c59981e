"""Many delimited files of different layouts as one table.

Files are grouped by their header and delimiter; each layout is read by one plan, whatever the number of its files.
A row keeps its cells in a map by column name, so that tables without a common column fit into one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borehole.functions import parsing as P
from borehole.operators import clean as C
from borehole.sources import files

DATASET_PATTERN = r"([^/]+)\.csv$"
ROWS = "dataset_id string, layout int, cells map<string,string>"


def headers(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, header``: the first line with text of each file. Files without one have no row."""
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    # a file's splits may be read in any order: the earliest line is the first of the first split that has text
    place = F.struct("_start", "_at")
    return lines.where(F.trim("value") != "").groupBy("file").agg(F.min_by("value", place).alias("header"))


class Datasets:
    """``rows`` (``dataset_id, layout, cells``), ``known`` (``dataset_id, layout``) and the column names of each layout."""

    def __init__(self, rows: DataFrame, known: DataFrame, layouts: list[tuple[str, ...]]):
        self.rows, self.known, self.layouts = rows, known, layouts

    def features(self, leave_out: Sequence[str] = ()) -> DataFrame:
        """``dataset_id, features``: the columns that are numbers in that dataset, by name; none is an empty list.

        As for a single table: more than half of the rows, or all cells that are not missing.
        """
        sizes = self.rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_rows"))
        cells = self.rows.select("dataset_id", F.explode("cells").alias("name", "value"))
        number = F.count(P.try_number(cells, "value"))
        counts = cells.groupBy("dataset_id", "name").agg(number.alias("_numbers"), F.count(F.lit(1)).alias("_present"))
        numeric = (F.col("_numbers") > 0.5 * F.col("_rows")) | (F.col("_numbers") == F.col("_present"))
        named = counts.join(sizes, "dataset_id").where(numeric & ~F.col("name").isin(*leave_out))
        listed = named.groupBy("dataset_id").agg(F.array_sort(F.collect_set("name")).alias("features"))
        none = F.array().cast("array<string>")
        return self.known.select("dataset_id").distinct().join(listed, "dataset_id", "left").select(
            "dataset_id", F.coalesce("features", none).alias("features")
        )

    def table(self, columns: Sequence[str]) -> DataFrame:
        """``dataset_id`` and the given columns as text, null where a dataset does not have one."""
        return self.rows.select("dataset_id", *[F.col("cells")[c].alias(c) for c in columns])


def read_datasets(
    spark: SparkSession, paths: str | Sequence[str], delimiter: str | None = None, dataset_pattern: str = DATASET_PATTERN
) -> Datasets:
    """All files, each a dataset named by its path.

    Names are cleaned and the usual texts for "missing" and empty rows dropped, as for a single file. A file with only a
    header is known but has no rows. Files of one name are one dataset. A quoted header may not span lines.
    """
    # one row per file: the driver lists them anyway
    found = headers(spark, paths).orderBy("file").collect()
    by: dict[tuple[str, str], list[str]] = {}
    for r in found:
        by.setdefault((r["header"], delimiter or files.detect_delimiter(r["header"])), []).append(r["file"])
    layouts, tables, known = [], [], []
    for number, ((_, sep), members) in enumerate(sorted(by.items())):
        df = files.read_text_table(spark, members, sep, path_column="_path")
        texts = [c for c in df.columns if c != "_path"]
        names = C.clean_column_names(df.drop("_path")).columns
        pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(f"`{c}`") for c in texts]))
        row = df.select(
            F.regexp_extract("_path", dataset_pattern, 1).alias("dataset_id"), F.lit(number).alias("layout"),
            F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("cells"),
        )
        tables.append(row.where(F.size("cells") > 0))
        layouts.append(tuple(names))
        known += [(m, number) for m in members]
    schema = T.StructType.fromDDL(ROWS)
    rows = reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], schema)
    one = spark.createDataFrame(known, "file string, layout int")
    one = one.select(F.regexp_extract("file", dataset_pattern, 1).alias("dataset_id"), "layout").distinct()
    return Datasets(rows, one, layouts)
