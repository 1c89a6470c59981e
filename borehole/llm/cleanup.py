"""Early release of the shuffle files of finished phases."""

from __future__ import annotations

import gc
import time

from pyspark.sql import SparkSession


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no live DataFrame can read again.

    Spark deletes them when the driver's JVM finds their plans unreachable, which may be long
    after a phase has been written to the scratch folder. Dropping the Python handles and asking
    the JVM to collect keeps the disk at the need of one phase. Results don't depend on it.
    """
    for _ in range(2):  # the first round drops the handles, the second what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
