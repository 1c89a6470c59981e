"""JSON and GeoJSON output."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP_NULLS = {"ignoreNullFields": "false"}
COLLECTION_HEAD, COLLECTION_END = '{"type":"FeatureCollection","features":[', "]}"
MANIFEST = "part long, file string, features long, bytes long"


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON text in ``value``; nulls are written."""
    return df.select(F.to_json(F.struct(*df.columns), KEEP_NULLS).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("overwrite").text(path)


def result_envelope(df: DataFrame, task: str) -> DataFrame:
    """Each row as ``{"success": true, "task": ..., "data": {...}}``."""
    return df.select(
        F.to_json(
            F.struct(
                F.lit(True).alias("success"),
                F.lit(task).alias("task"),
                F.struct(*df.columns).alias("data"),
            ),
            KEEP_NULLS,
        ).alias("value")
    )


def write_geojson(features: DataFrame, path: str) -> None:
    """One GeoJSON feature per line, written in parallel; ``features`` has ``feature``."""
    features.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)


def collection_lines(features: DataFrame, order_by: Sequence[str] = ("id",)) -> DataFrame:
    """The lines of one FeatureCollection, ``_rank, order_by, value``: in this order they are a valid document.

    The first line opens the collection and holds the first feature, each further feature begins with its
    comma, and the last line closes the document. No line depends on another one, so they can be written in
    any number of parts. Null features are left out; equal features stay as often as they occur.
    """
    order = list(order_by)
    known = features.where("feature is not null").select(*order, "feature")
    key = F.struct(*order, "feature")
    first = known.agg(F.min(key).alias("k")).select("k.*")
    row = first.first()
    head = first.select(
        F.lit(0).alias("_rank"), *order, F.concat(F.lit(COLLECTION_HEAD), F.coalesce("feature", F.lit(""))).alias("value")
    )
    end = first.select(F.lit(2).alias("_rank"), *order, F.lit(COLLECTION_END).alias("value"))
    if row["feature"] is None:
        return head.union(end)
    fields = [f for f in known.schema if f.name in (*order, "feature")]
    spark = features.sparkSession
    opening = spark.createDataFrame([tuple(row[f.name] for f in fields)], T.StructType(fields))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"a.{f.name}").eqNullSafe(F.col(f"b.{f.name}"))
    # the opening feature is in the first line already; copies of it still follow
    twice = known.alias("a").join(F.broadcast(opening.alias("b")), same, "left_semi").count() - 1
    others = known.alias("a").join(F.broadcast(opening.alias("b")), same, "left_anti")
    copies = spark.range(twice).select(F.col("id").alias("_copy")).join(F.broadcast(opening)).select(*order, "feature")
    body = others.unionByName(copies)
    body = body.select(F.lit(1).alias("_rank"), *order, F.concat(F.lit(","), "feature").alias("value"))
    return head.union(body).union(end)


def write_feature_collection(features: DataFrame, path: str, order_by: Sequence[str] = ("id",)) -> DataFrame:
    """Write all features as one FeatureCollection in ordered parts, and return its manifest.

    The parts lie in a folder of their own below ``path``; joined in the order of the manifest they are one valid
    document, of any size, and no task holds more than its share. The manifest, ``part, file, features, bytes``, is written
    last and names the folder, so that a collection written again is replaced at once or not at all.
    """
    spark = features.sparkSession
    folder = f"{path.rstrip('/')}/parts-{uuid.uuid4().hex}"
    lines = collection_lines(features, order_by)
    ordered = lines.repartitionByRange("_rank", *order_by, "value").sortWithinPartitions("_rank", *order_by, "value")
    ordered.select("value").write.text(folder)
    # file names begin with the number of the task, which follows the order; one row per file
    written = spark.read.text(folder).groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    files = written.agg(
        F.count_if(F.col("value") != COLLECTION_END).alias("features"),
        F.count_if(F.col("value") == COLLECTION_HEAD).alias("_empty"),
    )
    number = F.regexp_extract("file", r"/part-(\d+)-", 1).cast("long")
    manifest = files.select(number.alias("part"), "file", (F.col("features") - F.col("_empty")).alias("features"), "bytes")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``part, file, features, bytes`` of a written collection, in order."""
    return spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/manifest").orderBy("part")


def read_feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """The features of a written collection, one ``feature`` a row; only committed parts are read."""
    files = [r["file"] for r in read_manifest(spark, path).collect()]  # a row per part
    line = F.col("value")
    value = F.when(line.startswith(COLLECTION_HEAD), F.substring(line, len(COLLECTION_HEAD) + 1, 2**31 - 1)).otherwise(
        F.substring(line, 2, 2**31 - 1)
    )
    lines = spark.read.text(files).where(line != COLLECTION_END)
    return lines.select(value.alias("feature")).where("feature <> ''")
