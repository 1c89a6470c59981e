"""Sessions for tests and benchmarks, and the scratch folder on shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "borehole") -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    parallel = str(cores) if str(cores) != "*" else "8"
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", parallel)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@cache
def _package_archive() -> str:
    """This package as a zip file; the driver serves it, so a driver-local file is enough."""
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="borehole-package-"), "borehole.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    return target


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers of this application the package, once.

    Functions run by workers are found by import there. A job submitted with ``--py-files``
    does not need this.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        context.addPyFile(_package_archive())
        _SHIPPED.add(context.applicationId)


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="borehole-")


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting
    falls back to a temporary folder: on a cluster no other executor could read it.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_DIR} must name a folder all executors can reach")
        base = _local_scratch()
    return base.rstrip("/")


_SCOPE: ContextVar[str | None] = ContextVar("borehole_scratch_scope", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_SCOPE.get() or scratch_dir(spark) + '/borehole'}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside lie in one folder, which is deleted at the end, also after an error.

    Results are lazy and may read those tables: write or collect them before the scope ends. Scopes may be nested, and
    each thread has its own.
    """
    folder = scratch_path(spark, "scope")
    token = _SCOPE.set(folder)
    try:
        yield folder
    finally:
        _SCOPE.reset(token)
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    Used where a result feeds several passes. Unlike cached blocks the table outlives the
    executors that made it, and later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
