"""Row-wise operators on streams.

Alerts with given thresholds, station projection with given ids, GeoJSON features, date
parsing and model scoring keep no state, so they take a streaming DataFrame as it is. This
module only reads a folder as a stream and runs such a pipeline over what has arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_folder(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream; new files are new data."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def write_folder(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process all that has arrived, then stop; the checkpoint makes each row count once."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
