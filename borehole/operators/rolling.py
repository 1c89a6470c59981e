"""Anomalies against a centred rolling mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borehole.functions import parsing as P
from borehole.operators import grouping as G


def temporal_anomalies(
    df: DataFrame,
    ds: str,
    y: str,
    id_cols: Sequence[str] = (),
    keys: Sequence[str] = (),
    window: int = 30,
    threshold: float = 3.0,
) -> DataFrame:
    """Every reading with its rolling mean, deviation, ``z_score`` and ``is_anomaly``.

    The frame is centred: for an even window one more row before than after. Readings whose
    frame is not full, or is constant, have no z-score and are no anomaly. ``id_cols`` order
    readings of the same date, which are not averaged here.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    readings = df.select(
        *keys, *id_cols, P.try_date(df, ds).alias("ds"), P.try_number(df, y).alias("value")
    ).na.drop(subset=["ds", "value"])
    before, after = window // 2, (window - 1) // 2
    rows = G.ordered(readings, keys, ["ds", *id_cols], before, after)
    if rows.largest < window:
        raise ValueError(f"not enough data points for window size {window}")
    frame = rows.window.rowsBetween(-before, after)
    full = F.count("value").over(frame) == window
    scored = (
        rows.df.withColumn("_full", full)
        .withColumn("_mean", F.avg("value").over(frame))
        .withColumn("_std", F.stddev_samp("value").over(frame))
        .withColumn("rolling_mean", F.when(F.col("_full"), F.col("_mean")))
        .withColumn("rolling_std", F.when(F.col("_full"), F.col("_std")))
    )
    mean, std = F.col("rolling_mean"), F.col("rolling_std")
    z = F.abs(F.try_divide(F.col("value") - mean, std))
    return (
        rows.core(scored)
        .withColumn("z_score", z)
        .withColumn("is_anomaly", F.coalesce(F.col("z_score") > threshold, F.lit(False)))
        .withColumn("expected_low", mean - threshold * std)
        .withColumn("expected_high", mean + threshold * std)
        .select(
            *keys, *id_cols, "ds", "value", "rolling_mean", "rolling_std", "z_score",
            "expected_low", "expected_high", "is_anomaly",
        )
    )


def temporal_summary(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Points, anomalies and their rate."""
    found = F.count_if("is_anomaly")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_points"),
        found.alias("anomalies_detected"),
        (found / F.count(F.lit(1))).alias("anomaly_rate"),
    )
