"""The whole forecast of each series: path, intervals, dates, errors and components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borehole.operators import grouping as G
from borehole.operators import sarima as A
from borehole.operators import series as S
from borehole.operators import smoothing as H
from borehole.session import materialise


@dataclass(frozen=True)
class Forecast:
    """``forecast``: keys, step, ds, yhat, lower, upper, method. The others: one row per series."""

    forecast: DataFrame
    metrics: DataFrame
    components: DataFrame | None
    last_observed: DataFrame


def forecast(
    df: DataFrame,
    ds: str,
    y: str,
    keys: Sequence[str] = (),
    period: int = 12,
    horizon: int = 6,
    method: str = "holt_winters",
    confidence: float = 0.95,
    refit: bool = True,
) -> Forecast:
    """Forecast ``horizon`` steps of every series.

    Parameters are chosen on the training part and judged on the tail behind it. With
    ``refit`` the forecast starts after the last date, otherwise after the training part.
    """
    H.check_confidence(confidence)
    paths_of = {"holt_winters": H.holt_winters_or_drift, "sarimax": A.sarima_or_simpler}
    if method not in paths_of:
        raise ValueError(f"unknown method: {method}")
    series = materialise(S.prepare_series(df, ds, y, keys), "series")
    if series.isEmpty():
        raise ValueError("no valid data points found")
    paths = materialise(paths_of[method](series, period, horizon, keys), "paths")
    tail = S.validation_tail(S.split_series(series, period, horizon, keys), keys)
    dates = S.forecast_dates(series, horizon, period, keys, refit)
    chosen = H.with_intervals(
        paths.where(F.col("origin") == ("all" if refit else "train")), confidence
    )
    dated = (
        chosen.alias("l")
        .join(dates.alias("r"), G.same_keys("l", "r", [*keys, "step"]))
        .select(
            *[F.col(f"l.{c}") for c in (*keys, "step")],
            "r.ds", "l.yhat", "l.lower", "l.upper", "l.method",
        )
    )
    components = None
    if G.largest_group(series, keys) >= 2 * period:
        parts = S.seasonal_decompose(series, period, keys)
        components = S.decomposition_summary(parts, period, keys)
    return Forecast(
        forecast=dated,
        metrics=S.forecast_errors(tail, paths.where(F.col("origin") == "train"), keys),
        components=components,
        last_observed=S.last_observed(series, keys),
    )
