"""Seasonal ARIMA (1,1,1)(1,1,1,s) per series by two least-squares steps (Hannan-Rissanen).

Regressors are lags, the normal equations are sums, so fitting is windows and aggregates over
all series at once; Python only solves one small system per series. The first step estimates
the innovations with a short autoregression, the second regresses on lagged values and lagged
innovations at 1, s and s+1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borehole.operators import grouping as G
from borehole.operators import series as S
from borehole.operators import smoothing as H
from borehole.session import materialise

METHOD = "sarimax"
SPARE_ROWS = 10  # training rows beyond the number of coefficients


def _long_lags(period: int) -> list[int]:
    """Lags of the autoregression that estimates the innovations."""
    return sorted({1, 2, 3, period, period + 1, period + 2} if period > 1 else {1, 2, 3})


def _model_lags(period: int) -> list[int]:
    return [1, period, period + 1] if period > 1 else [1]


def _differenced(w, period: int) -> Column:
    """First and seasonal difference of ``y``."""
    y = F.col("y")
    change = y - F.lag("y", 1).over(w)
    if period == 1:
        return change
    return change - (F.lag("y", period).over(w) - F.lag("y", period + 1).over(w))


def _normal_equations(df: DataFrame, x: Sequence[str], y: str, keys: Sequence[str]) -> DataFrame:
    """Sums of products over the training rows with all regressors: ``xx``, ``xy``, ``m``."""
    usable = df.where(F.col("is_train") & F.col(y).isNotNull()).na.drop(subset=list(x))
    pairs = [F.sum(F.col(a) * F.col(b)) for a in x for b in x]
    return usable.groupBy(*keys).agg(
        F.array(*pairs).alias("xx"),
        F.array(*[F.sum(F.col(a) * F.col(y)) for a in x]).alias("xy"),
        F.count(F.lit(1)).alias("m"),
    )


def _solve(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.drop(columns=["xx", "xy", "m"])
            out["coef"] = [
                np.linalg.pinv(np.reshape(xx, (size, size)), rcond=1e-12, hermitian=True) @ xy
                for xx, xy in zip(pdf["xx"], pdf["xy"])
            ]
            yield out

    return run


def _coefficients(df: DataFrame, x: Sequence[str], y: str, keys: Sequence[str]) -> DataFrame:
    sums = _normal_equations(df, x, y, keys).where(F.col("m") >= len(x) + SPARE_ROWS)
    schema = T.StructType([df.schema[k] for k in keys]).add("coef", T.ArrayType(T.DoubleType()))
    return sums.mapInPandas(_solve(len(x)), schema)


def _residual(y: str, x: Sequence[str]) -> Column:
    fitted = sum((F.col("coef")[i] * F.col(c) for i, c in enumerate(x)), F.lit(0.0))
    return F.col(y) - fitted


def _attach_coefficients(df: DataFrame, coef: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``coef``; series without coefficients drop out."""
    return G.attach(df, coef, keys).where(F.col("coef").isNotNull())


def _forecast(state: dict, period: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts and standard deviations from the last ``y, w, e`` and the coefficients."""
    lags = _model_lags(period)
    phi, theta = np.split(np.asarray(state["coef"], dtype=float), 2)

    def extend(y: list, w: list, e: list) -> list:
        for _ in range(horizon):
            nxt = sum(p * w[-lag] for p, lag in zip(phi, lags))
            nxt += sum(q * e[-lag] for q, lag in zip(theta, lags))
            w.append(nxt)
            e.append(0.0)
            level = nxt + y[-1]
            y.append(level if period == 1 else level + y[-period] - y[-period - 1])
        return y[-horizon:]

    path = extend(list(state["ys"]), list(state["ws"]), list(state["es"]))
    # the response to one unit innovation gives the weights of the forecast error
    zeros = [0.0] * (period + 2)
    impulse = [1.0, *extend([*zeros, 1.0], [*zeros, 1.0], [*zeros, 1.0])[: horizon - 1]]
    sd = np.sqrt(state["variance"] * np.cumsum(np.square(impulse)))
    return np.array(path), sd


def _stable(phi: np.ndarray, period: int) -> bool:
    """No root grows; a root of one is a steady change, as of a straight line."""
    poly = np.zeros(period + 2 if period > 1 else 2)
    poly[0] = 1.0
    for p, lag in zip(phi, _model_lags(period)):
        poly[lag] -= p
    return bool(np.all(np.abs(np.roots(poly)) <= 1.0 + 1e-6))


def _paths(keys: Sequence[str], period: int, horizon: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            frames = []
            for row in pdf.to_dict("records"):
                phi = np.split(np.asarray(row["coef"], dtype=float), 2)[0]
                if not _stable(phi, period):
                    continue
                path, sd = _forecast(row, period, horizon)
                if not (np.isfinite(path).all() and np.isfinite(sd).all()):
                    continue
                frame = pd.DataFrame({k: [row[k]] * horizon for k in keys}, index=range(horizon))
                frame["origin"] = row["origin"]
                frame["step"] = np.arange(1, horizon + 1, dtype="int32")
                frame["yhat"], frame["sd"] = path, sd
                frames.append(frame)
            if frames:
                yield pd.concat(frames, ignore_index=True)

    return run


def _end_state(df: DataFrame, origin: str, end: Column, reach: int, keys: Sequence[str]) -> DataFrame:
    """The last ``reach`` values before ``end``, as arrays in order: at most ``reach`` a series."""
    last = df.where((F.col("_pos") < end) & (F.col("_pos") >= end - reach))
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "y", "w", "e")))
    return last.groupBy(*keys).agg(ordered.alias("s")).select(
        *keys,
        F.lit(origin).alias("origin"),
        F.col("s.y").alias("ys"),
        F.col("s.w").alias("ws"),
        F.col("s.e").alias("es"),
    )


def sarima_paths(
    series: DataFrame, period: int = 12, horizon: int = 6, keys: Sequence[str] = ()
) -> DataFrame:
    """Forecast paths of the series long enough and stable; the others are left out."""
    reach = 3 * period + 4
    rows = S.split_series(series, period, horizon, keys, before=reach)
    w = rows.window
    long, short = _long_lags(period), _model_lags(period)
    df = rows.df.where(F.col("period") == period).withColumn("w", _differenced(w, period))
    df = df.withColumns({f"w{i}": F.lag("w", i).over(w) for i in sorted({*long, *short})})
    own = F.col("_core")

    first = [f"w{i}" for i in long]
    df = _attach_coefficients(df, _coefficients(df.where(own), first, "w", keys), keys)
    df = df.withColumn("e0", _residual("w", first)).drop("coef")
    df = df.withColumns({f"e{i}": F.lag("e0", i).over(w) for i in short})

    second = [f"w{i}" for i in short] + [f"e{i}" for i in short]
    coef = materialise(_coefficients(df.where(own), second, "w", keys), "coefficients")
    df = _attach_coefficients(df, coef, keys).withColumn("e", _residual("w", second))
    df = rows.core(df)

    fit = df.where(F.col("is_train") & F.col("e").isNotNull()).groupBy(*keys).agg(
        F.avg(F.col("e") * F.col("e")).alias("variance")
    )
    needed = period + 2
    states = _end_state(df, "train", F.col("n_train"), needed, keys).unionByName(
        _end_state(df, "all", F.col("_n"), needed, keys)
    )
    states = G.attach(_attach_coefficients(states, coef, keys), fit, keys)
    complete = F.size(F.array_compact("es")) == needed
    return states.where(complete).mapInPandas(
        _paths(keys, period, horizon), H.path_schema(series, keys)
    )


def sarima_or_simpler(
    series: DataFrame, period: int = 12, horizon: int = 6, keys: Sequence[str] = ()
) -> DataFrame:
    """SARIMA paths; series it cannot fit get Holt-Winters or mean and drift.

    A series without two seasons is fitted without the seasonal part.
    """
    paths = sarima_paths(series, period, horizon, keys)
    if period > 1:
        sizes = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        few = materialise(sizes.where((F.col("_rows") > 0) & (F.col("_rows") < 2 * period)).select(*keys, "_rows"), "short")
        if not few.isEmpty():
            short = G.attach(series, few, keys).where(F.col("_rows").isNotNull()).drop("_rows")
            paths = paths.unionByName(sarima_paths(short, 1, horizon, keys))
    fitted = materialise(paths, "paths")
    done = fitted.withColumn("method", F.lit(METHOD))
    if keys:
        have = fitted.select(*keys).distinct()
        rest = (
            series.alias("l")
            .join(have.alias("r"), G.same_keys("l", "r", keys), "left_anti")
        )
    else:
        rest = series if fitted.isEmpty() else series.limit(0)
    if rest.isEmpty():
        return done
    return done.unionByName(H.holt_winters_or_drift(rest, period, horizon, keys))
