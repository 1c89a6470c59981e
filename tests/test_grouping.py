"""Ordering, quantiles and modes with one group holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from borehole.operators import clean as C
from borehole.operators import grouping as G
from borehole.session import materialise


@pytest.fixture
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 600
    keys = np.where(rng.random(n) < 0.6, "hot", np.char.add("k", (np.arange(n) % 7).astype(str)))
    pdf = pd.DataFrame({"k": keys, "t": rng.integers(0, 40, n), "id": np.arange(n),
                        "v": np.round(rng.normal(size=n), 2)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("limit", ["40", "1000000"])
def test_positions_are_those_of_a_sort(spark, skewed, limit):
    pdf, df = skewed
    spark.conf.set("spark.borehole.maxGroupRows", limit)
    rows = G.ordered(df, ["k"], ["t", "id"], before=3, after=2)
    got = rows.core(rows.df).toPandas().sort_values("id")
    spark.conf.unset("spark.borehole.maxGroupRows")
    want = pdf.sort_values(["t", "id"])
    want["_pos"] = want.groupby("k").cumcount()
    want = want.sort_values("id")
    assert (got["_pos"].to_numpy() == want["_pos"].to_numpy()).all()
    assert (got["_n"].to_numpy() == want.groupby("k")["id"].transform("size").to_numpy()).all()


def test_hot_timestamp_is_split(spark, small_groups):
    df = spark.range(500).select(F.lit("a").alias("k"), F.lit(1).alias("t"), "id")
    rows = G.ordered(df, ["k"], ["t", "id"], before=1)
    assert rows.partition == ("k", "_chunk")
    assert rows.df.groupBy("k", "_chunk").count().agg(F.max("count")).first()[0] <= 41
    got = rows.core(rows.df.withColumn("p", F.lag("id").over(rows.window))).orderBy("id").collect()
    assert [r["p"] for r in got] == [None, *range(499)]
    assert [r["_pos"] for r in got] == list(range(500))


def test_windows_wider_than_a_piece(spark, small_groups):
    df = spark.range(300).select("id", F.col("id").cast("double").alias("v"))
    rows = G.ordered(df, [], ["id"], before=100, after=0)
    frame = rows.window.rowsBetween(-100, 0)
    got = rows.core(rows.df.withColumn("s", F.sum("v").over(frame))).orderBy("id").collect()
    v = np.arange(300.0)
    assert [r["s"] for r in got] == [v[max(0, i - 100) : i + 1].sum() for i in range(300)]


@pytest.mark.parametrize("limit", ["40", "1000000"])
def test_quantiles_are_exact(spark, skewed, limit):
    pdf, df = skewed
    spark.conf.set("spark.borehole.maxGroupRows", limit)
    probs = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    got = G.exact_quantiles(df, ["v"], probs, ["k"]).toPandas().set_index("k").sort_index()
    overall = G.exact_quantiles(df, ["v"], probs).first()
    spark.conf.unset("spark.borehole.maxGroupRows")
    for i, p in enumerate(probs):
        want = pdf.groupby("k")["v"].quantile(p).sort_index()
        np.testing.assert_allclose(got[f"v_q{i}"], want)
        assert overall[f"v_q{i}"] == pytest.approx(pdf["v"].quantile(p))


def test_bracket_of_a_large_group_encloses_the_quantile(spark):
    """Enough rows for the sketch itself to draw the bracket, a third of them equal."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0.25)).otherwise(F.rand(5)).alias("v")
    )
    pdf = df.toPandas()
    for p in (0.1, 0.25, 0.5, 0.999):
        got = G.bracketed_quantiles(df, ["v"], [p], (), 60_000).first()["v_q0"]
        assert got == pytest.approx(np.quantile(pdf["v"], p), abs=1e-12)


@pytest.mark.parametrize(("ranked", "size", "error"), [(500, 200, 0.05), (500, 200, 1e-4), (50, 2000, 0.008)])
def test_narrowed_quantiles_are_exact(spark, monkeypatch, ranked, size, error):
    """Several rounds of sketches, margins that miss and must be widened, copies, gaps and groups of any size."""
    monkeypatch.setattr(G, "RANKED_ROWS", ranked)
    monkeypatch.setattr(G, "SKETCH_SIZE", size)
    monkeypatch.setattr(G, "SKETCH_ERROR", error)
    rows = spark.range(0, 30_000, 1, 8).select(
        F.when(F.col("id") < 29_000, "hot").when(F.col("id") < 29_003, F.lit(None)).otherwise("cold").alias("k"),
        F.when(F.col("id") % 3 == 0, 0.25).when(F.col("id") % 11 != 5, F.rand(5)).alias("v"),
        F.when(F.col("id") % 2 == 0, F.lit(1.0)).otherwise(F.lit(2.0)).alias("w"),
        F.lit(None).cast("double").alias("none"),
    )
    df = materialise(rows, "rows")
    pdf = df.toPandas()
    probs = [0.001, 0.5, 1.0]
    got = G.bracketed_quantiles(df, ["v", "w", "none"], probs, ["k"], 29_000).toPandas().set_index("k")
    overall = G.bracketed_quantiles(df, ["v", "w"], probs, (), 30_000).first()
    for c in ("v", "w"):
        for i, p in enumerate(probs):
            want = pdf.groupby("k", dropna=False)[c].quantile(p)
            for k in want.index:
                assert got[f"{c}_q{i}"][got.index.isna() if k != k or k is None else got.index == k].iloc[0] == pytest.approx(want[want.index.isna() if k != k or k is None else want.index == k].iloc[0], abs=1e-12)
            assert overall[f"{c}_q{i}"] == pytest.approx(pdf[c].quantile(p), abs=1e-12)
    assert got["none_q1"].isna().all()


def test_modes_take_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 2), ("b", 1), (None, None)], "s string, n int")
    assert tuple(G.modes(df, ["s", "n"]).first()) == ("a", 1)


@pytest.mark.parametrize("limit", ["40", "1000000"])
def test_forward_fill_across_pieces(spark, limit):
    spark.conf.set("spark.borehole.maxGroupRows", limit)
    df = spark.range(400).select(
        (F.col("id") % 2).alias("k"), "id",
        F.when(F.col("id").isin(20, 21, 250), F.col("id").cast("double")).alias("v"),
    )
    got = C.forward_fill(df, ["v"], ["id"], ["k"]).orderBy("id").toPandas()
    spark.conf.unset("spark.borehole.maxGroupRows")
    want = df.orderBy("id").toPandas()
    want["v"] = want.groupby("k")["v"].ffill()
    pd.testing.assert_series_equal(got["v"], want["v"])
