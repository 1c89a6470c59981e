"""Delimited files and stored datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borehole.functions.parsing import MISSING_TEXTS
from borehole.operators import clean as C

DELIMITERS = (",", ";", "\t", "|")  # ties go to the earlier one
SAMPLE_CHARS = 1024
READABLE = ("csv",)
SPREADSHEETS = ("xlsx", "xls")


def detect_delimiter(text: str) -> str:
    """The most frequent delimiter of a text, a comma if there is none."""
    counts = {d: text.count(d) for d in DELIMITERS}
    best = max(DELIMITERS, key=counts.__getitem__)
    return best if counts[best] else ","


def sample_text(spark: SparkSession, path: str, chars: int = SAMPLE_CHARS) -> str:
    """The first characters of a file; only its first lines are read."""
    lines = spark.read.text(path).select(F.substring("value", 1, chars).alias("v")).limit(chars)
    text = ""
    for row in lines.toLocalIterator():
        text += row["v"] + "\n"
        if len(text) >= chars:
            break
    return text[:chars]


def check_extension(path: str) -> None:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    extension = name.rsplit(".", 1)[-1] if "." in name else ""
    if extension in SPREADSHEETS:
        raise ValueError(f"spreadsheets are not read; export {name} as csv")
    if extension not in READABLE:
        raise ValueError(f"unsupported file format: {extension or name}")


def read_text_table(
    spark: SparkSession, paths: str | Sequence[str], delimiter: str, multi_line: bool = False,
    path_column: str | None = None,
) -> DataFrame:
    """All columns as text, the usual texts for "missing" as null; files share one header."""
    df = (
        spark.read.option("sep", delimiter)
        .option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(paths if isinstance(paths, str) else list(paths))
    )
    columns = [
        F.when(~F.col(f"`{c}`").isin(*MISSING_TEXTS), F.col(f"`{c}`")).alias(c) for c in df.columns
    ]
    if path_column:
        columns.append(F.col("_metadata.file_path").alias(path_column))
    return df.select(*columns)


def read_delimited(
    spark: SparkSession, path: str, delimiter: str | None = None, order_by: Sequence[str] = (),
    multi_line: bool = False,
) -> DataFrame:
    """A csv file as a clean, typed table: delimiter and column types come from the data."""
    check_extension(path)
    delimiter = delimiter or detect_delimiter(sample_text(spark, path))
    return C.tidy(read_text_table(spark, path, delimiter, multi_line), order_by, inferred=True)


def read_many(
    spark: SparkSession, paths: str | Sequence[str], delimiter: str | None = None,
    dataset_pattern: str = r"([^/]+)\.csv$", order_by: Sequence[str] = (),
) -> DataFrame:
    """Several files of one layout as one table with a ``dataset_id`` taken from the path."""
    listed = [paths] if isinstance(paths, str) else list(paths)
    delimiter = delimiter or detect_delimiter(sample_text(spark, listed[0]))
    df = read_text_table(spark, listed, delimiter, path_column="_path")
    ids = df.select(F.regexp_extract("_path", dataset_pattern, 1).alias("dataset_id"), "*")
    columns = [c for c in ids.columns if c not in ("dataset_id", "_path")]
    # the id is no cell of the file: it must not keep an empty row alive
    ids = ids.drop("_path").na.drop("all", subset=columns)
    return C.tidy(ids, order_by, inferred=True)


def list_datasets(
    spark: SparkSession, folder: str, extensions: Sequence[str] = (*READABLE, *SPREADSHEETS)
) -> DataFrame:
    """``dataset_id, filename, size_bytes, upload_time`` per file; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "length", "modificationTime")
    )
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(extension.isin(*extensions)).select(
        F.regexp_replace(name, r"\.[^.]+$", "").alias("dataset_id"),
        name.alias("filename"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("upload_time"),
    )


def register_dataset(df: DataFrame, dataset_id: str, folder: str) -> C.Profile:
    """Store a table as one partition of ``folder`` and say what it is.

    Registering an id again replaces that dataset only.
    """
    (
        df.withColumn("dataset_id", F.lit(dataset_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset_id")
        .parquet(folder)
    )
    stored = df.sparkSession.read.parquet(f"{folder.rstrip('/')}/dataset_id={dataset_id}")
    return C.detect_dataset_type(stored)


def load_datasets(
    spark: SparkSession, folder: str, dataset_ids: Sequence[str] | None = None
) -> DataFrame:
    """Stored datasets with their ``dataset_id``; only the wanted partitions are read."""
    df = spark.read.option("mergeSchema", True).parquet(folder)
    if dataset_ids is not None:
        df = df.where(F.col("dataset_id").isin(*dataset_ids))
    return df
