"""Scratch folder, package for the workers, and values passed through the driver."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from borehole import session
from borehole.operators import grouping as G


def test_scratch_folder_is_the_clusters(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert session.scratch_dir(spark) == named.rstrip("/")
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(Session())


def test_a_scope_deletes_its_tables(spark, tmp_path):
    import os

    from borehole.operators import anomaly

    outside = session.materialise(spark.range(3), "outside")
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("v"))
    with session.scratch_scope(spark) as folder:
        scored = anomaly.detect(df, "id", ["v"], method="local_outlier_factor")
        with session.scratch_scope(spark) as inner:
            assert session.materialise(df, "deep").count() == 200 and inner.startswith(folder)
        local = folder.removeprefix("file:").removeprefix("//")
        assert os.listdir(local) and not os.path.exists(f"{local}/{os.path.basename(inner)}")
        scored.write.parquet(str(tmp_path / "kept"))
    assert not os.path.exists(local)
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 200 and outside.count() == 3
    with pytest.raises(ValueError, match="stop"), session.scratch_scope(spark) as folder:
        session.materialise(df, "lost")
        raise ValueError("stop")
    assert not os.path.exists(folder.removeprefix("file:").removeprefix("//"))
    assert session._SCOPE.get() is None


def test_package_is_shipped_once(spark):
    session.ship_package(spark)
    before = len(session._SHIPPED)
    session.ship_package(spark)
    assert len(session._SHIPPED) == before


def test_dates_do_not_pass_through_a_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    moment = dt.datetime(2020, 3, 8, 2, 30, 0, 123456)  # a skipped hour in New York
    one = spark.createDataFrame([(moment, [1.5], None)], "t timestamp_ntz, a array<double>, s string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = G.attach(spark.range(1), one, ()).first()
        empty = G.attach(spark.range(1), one.where(F.lit(False)), ()).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert (row["t"], row["a"], row["s"]) == (moment, [1.5], None)
    assert tuple(empty)[1:] == (None, None, None)
