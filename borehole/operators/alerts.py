"""Threshold alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borehole.functions import parsing as P
from borehole.operators import grouping as G

HIGH, LOW, NORMAL = "HIGH", "LOW", "NORMAL"


def alert_thresholds(
    df: DataFrame,
    value: str,
    upper_q: float = 0.9,
    lower_q: float = 0.1,
    keys: Sequence[str] = (),
    approx: bool = False,
) -> DataFrame:
    """``upper`` and ``lower``: exact linear-interpolated quantiles unless ``approx``."""
    df = P.clean_nans(df)
    if approx:
        return df.groupBy(*keys).agg(
            F.percentile_approx(value, F.lit(upper_q)).cast("double").alias("upper"),
            F.percentile_approx(value, F.lit(lower_q)).cast("double").alias("lower"),
        )
    found = G.exact_quantiles(df, [value], [upper_q, lower_q], keys)
    return found.select(
        *keys, F.col(f"{value}_q0").alias("upper"), F.col(f"{value}_q1").alias("lower")
    )


def alert_level(value: Column, upper: Column, lower: Column) -> Column:
    """HIGH above ``upper``, LOW below ``lower``, else (and for null and NaN) NORMAL."""
    missing = F.isnan(value.cast("double"))
    return (
        F.when(missing, F.lit(NORMAL)).when(value > upper, F.lit(HIGH)).when(value < lower, F.lit(LOW)).otherwise(F.lit(NORMAL))
    )


def risk_score(value: Column, upper: Column, lower: Column, signed: bool = False) -> Column:
    """How far beyond its threshold, relative to the threshold, at most 1; 0 when NORMAL.

    Relative to the threshold's size; with ``signed`` relative to the threshold itself, so
    negative thresholds give negative scores. Null at a threshold of 0; 0 for NaN.
    """

    def beyond(distance: Column, threshold: Column) -> Column:
        size = threshold if signed else F.abs(threshold)
        ratio = F.try_divide(distance, size)
        return F.when(ratio.isNotNull(), F.least(ratio, F.lit(1.0)))

    return (
        F.when(F.isnan(value.cast("double")), F.lit(0.0))
        .when(value > upper, beyond(value - upper, upper))
        .when(value < lower, beyond(lower - value, lower))
        .otherwise(F.lit(0.0))
    )


def with_alerts(
    df: DataFrame,
    value: str,
    upper: float | None = None,
    lower: float | None = None,
    keys: Sequence[str] = (),
    signed: bool = False,
) -> DataFrame:
    """Every row with ``alert`` and ``risk_score``.

    With both thresholds given this is row-wise and runs on a stream too; a missing one is
    taken from the data.
    """
    c = F.col(value).cast("double")
    if upper is not None and lower is not None:
        hi, lo = F.lit(float(upper)), F.lit(float(lower))
        return df.withColumn("alert", alert_level(c, hi, lo)).withColumn(
            "risk_score", risk_score(c, hi, lo, signed)
        )
    limits = alert_thresholds(df, value, keys=keys)
    if upper is not None:
        limits = limits.withColumn("upper", F.lit(float(upper)))
    if lower is not None:
        limits = limits.withColumn("lower", F.lit(float(lower)))
    limits = limits.select(*keys, F.col("upper").alias("_upper"), F.col("lower").alias("_lower"))
    hi, lo = F.col("_upper"), F.col("_lower")
    return (
        G.attach_stats(df, limits, keys)
        .withColumn("alert", alert_level(c, hi, lo))
        .withColumn("risk_score", risk_score(c, hi, lo, signed))
        .drop("_upper", "_lower")
    )


def alert_summary(alerts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return alerts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_records"),
        *[
            F.count_if(F.col("alert") == level).alias(name)
            for level, name in ((HIGH, "high_alerts"), (LOW, "low_alerts"), (NORMAL, "normal"))
        ],
        F.avg("risk_score").alias("avg_risk_score"),
    )


def alert_distribution(alerts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return alerts.groupBy(*keys, "alert").agg(F.count(F.lit(1)).alias("count"))


def top_risks(
    alerts: DataFrame, id_cols: Sequence[str], n: int = 10, keys: Sequence[str] = ()
) -> DataFrame:
    """HIGH and LOW rows by falling risk, ties by id."""
    order = [F.col("risk_score").desc_nulls_last(), *[F.col(c) for c in id_cols]]
    return G.top_per_group(alerts.where(F.col("alert") != NORMAL), keys, order, n)
