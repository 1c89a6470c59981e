"""Holt-Winters exponential smoothing with additive trend and season, fitted per series.

For given parameters the recursion is linear in its state (level, trend, season, 1): a piece
of a series is summed up by a matrix taking the state across it and a quadratic form giving
its squared error. Pieces are summed up side by side and then combined in order, so a series
of any length is fitted exactly without one task seeing all of it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borehole.operators import grouping as G
from borehole.operators import series as S
from borehole.session import materialise

ALPHAS = (0.1, 0.3, 0.5, 0.7, 0.9)
BETAS = (0.01, 0.1, 0.3, 0.5, 0.9)
GAMMAS = (0.01, 0.1, 0.3, 0.5, 0.9)

PIECE_ROWS = 50_000
FAN_IN = 64  # pieces combined by one task
ERROR_BATCH = 256
METHOD = "holt_winters"


def parameter_grid(seasonal: bool) -> np.ndarray:
    return np.array(list(itertools.product(ALPHAS, BETAS, GAMMAS if seasonal else (0.0,))))


def check_confidence(confidence: float) -> float:
    """The two-sided normal quantile of a confidence level."""
    if not 0.8 <= confidence <= 0.99:
        raise ValueError("confidence must be from 0.8 to 0.99")
    return NormalDist().inv_cdf(0.5 + confidence / 2)


# --- the recursion ----------------------------------------------------------------------


def start_state(y: np.ndarray, period: int) -> np.ndarray:
    """(level, trend, season..., 1) from the first two periods, or the first two values."""
    if period == 1:
        return np.array([y[0], y[1] - y[0], 1.0])
    level = y[:period].mean()
    trend = (y[period : 2 * period].mean() - level) / period
    return np.concatenate([[level, trend], y[:period] - level, [1.0]])


def advance(
    y: np.ndarray, first: int, period: int, grid: np.ndarray, state: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Run the recursion over ``y`` (positions from ``first``) for every parameter set.

    ``state`` has shape (sets, size, columns): one column per starting state. Gives the state
    after ``y`` and the products of the errors of all pairs of columns, summed over ``y``.
    """
    alpha, beta, gamma = (grid[:, i, None] for i in range(3))
    state = state.copy()
    columns = state.shape[2]
    squares = np.zeros((len(grid), columns, columns))
    batch: list[np.ndarray] = []

    def flush() -> None:
        e = np.stack(batch)
        squares[:] += np.matmul(e.transpose(1, 2, 0), e.transpose(1, 0, 2))
        batch.clear()

    for t, value in enumerate(y, start=first):
        level = state[:, 0] + state[:, 1]
        error = value * state[:, -1] - level
        if period > 1:
            slot = 2 + t % period
            error = error - state[:, slot]
            state[:, slot] += gamma * error
        state[:, 0] = level + alpha * error
        state[:, 1] += alpha * beta * error
        batch.append(error)
        if len(batch) == ERROR_BATCH:
            flush()
    if batch:
        flush()
    return state, squares


def join_pieces(
    left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Sum up two neighbouring pieces as one."""
    across, squares = left
    return right[0] @ across, squares + across.T @ right[1] @ across


# --- pieces -----------------------------------------------------------------------------


def _piece_schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([df.schema[k] for k in keys])
    schema.add("piece", T.LongType()).add("period", T.IntegerType())
    schema.add("n_train", T.LongType()).add("n", T.LongType())
    for c in ("alpha", "beta", "gamma"):
        schema.add(c, T.DoubleType())
    return schema.add("across", numbers).add("squares", numbers)


def _summarise(keys: Sequence[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        one = pdf.iloc[0]
        period, piece = int(one["period"]), int(one["piece"])
        y = pdf["y"].to_numpy()
        grid = parameter_grid(period > 1)
        size = 3 if period == 1 else period + 3
        first = int(one["_pos"])
        if piece == 0:  # the state before the first piece is known
            state = np.tile(start_state(y, period)[:, None], (len(grid), 1, 1))
            if period == 1:
                y, first = y[1:], 1
        else:
            state = np.tile(np.eye(size), (len(grid), 1, 1))
        state, squares = advance(y, first, period, grid, state)
        out = pd.DataFrame({k: [one[k]] * len(grid) for k in keys}, index=range(len(grid)))
        out["piece"] = piece
        for c in ("period", "n_train"):
            out[c] = int(one[c])
        out["n"] = int(one["_n"])
        out["alpha"], out["beta"], out["gamma"] = grid.T
        out["across"] = [s.ravel() for s in state]
        out["squares"] = [q.ravel() for q in squares]
        return out

    return run


def _combine(columns: Sequence[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece")
        size = 3 if pdf["period"].iloc[0] == 1 else int(pdf["period"].iloc[0]) + 3
        total = None
        for across, squares in zip(pdf["across"], pdf["squares"]):
            width = len(across) // size
            one = (np.reshape(across, (size, width)), np.reshape(squares, (width, width)))
            total = one if total is None else join_pieces(total, one)
        out = pdf.iloc[[0]].copy()
        out["piece"] = out["piece"] // FAN_IN
        out["across"] = [total[0].ravel()]
        out["squares"] = [total[1].ravel()]
        return out[list(columns)]

    return run


# --- forecasts --------------------------------------------------------------------------


def _forecast_path(
    state: np.ndarray, rows: int, period: int, params: Sequence[float], variance: float, horizon: int
) -> tuple[np.ndarray, np.ndarray]:
    """Point forecasts and their standard deviations (additive-error variance)."""
    alpha, beta, gamma = params
    h = np.arange(1, horizon + 1)
    path = state[0] + h * state[1]
    impact = alpha + alpha * beta * h
    if period > 1:
        path = path + state[2 + (rows + h - 1) % period]
        impact = impact + gamma * (h % period == 0)
    spread = 1 + np.concatenate([[0.0], np.cumsum(impact[:-1] ** 2)])
    return path, np.sqrt(np.maximum(variance, 0.0) * spread)


def _paths(keys: Sequence[str], horizon: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            frames = []
            for row in pdf.to_dict("records"):
                period = int(row["period"])
                params = (row["alpha"], row["beta"], row["gamma"])
                state, sse = np.array(row["state"]), float(row["sse"])
                errors = row["n_train"] - (1 if period == 1 else 0)
                tail = np.array(row["tail"], dtype=float)
                grid = np.array([params])
                after, squares = advance(tail, row["n_train"], period, grid, state[None, :, None])
                for origin, rows, st, total, count in (
                    ("train", row["n_train"], state, sse, errors),
                    ("all", row["n"], after[0, :, 0], sse + squares[0, 0, 0], errors + len(tail)),
                ):
                    path, sd = _forecast_path(st, rows, period, params, total / max(count, 1), horizon)
                    frame = pd.DataFrame({k: [row[k]] * horizon for k in keys}, index=range(horizon))
                    frame["origin"] = origin
                    frame["step"] = np.arange(1, horizon + 1, dtype="int32")
                    frame["yhat"], frame["sd"] = path, sd
                    frames.append(frame)
            if frames:
                yield pd.concat(frames, ignore_index=True)

    return run


def path_schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    """``keys, origin, step, yhat, sd``: forecasts from the end of the training part and of all."""
    return T.StructType(
        [df.schema[k] for k in keys]
        + [
            T.StructField("origin", T.StringType()),
            T.StructField("step", T.IntegerType()),
            T.StructField("yhat", T.DoubleType()),
            T.StructField("sd", T.DoubleType()),
        ]
    )


def fit_holt_winters(
    series: DataFrame, period: int = 12, horizon: int = 6, keys: Sequence[str] = (),
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Parameters of least squared error on the training part, one row per series.

    Every (alpha, beta, gamma) of a fixed grid is tried; ties go to the smallest. ``state`` is
    the state after the training part, ``tail`` the values after it. Series with fewer than
    two training periods (or values) are left out.
    """
    rows = S.split_series(series, period, horizon, keys)
    df = rows.core(rows.df).where(
        F.col("n_train") >= F.when(F.col("period") == 1, 2).otherwise(2 * F.col("period"))
    )
    piece_rows = max(piece_rows, 2 * period)
    train = df.where("is_train").withColumn("piece", F.floor(F.col("_pos") / piece_rows))
    schema = _piece_schema(df, keys)
    needed = [*keys, "_pos", "y", "piece", "period", "n_train", "_n"]
    fits = (
        G.python_groups(train.select(*needed), [*keys, "piece"])
        .applyInPandas(_summarise(keys), schema)
    )
    pieces = -(-rows.largest // piece_rows)
    while pieces > 1:
        fits = fits.withColumn("_to", F.floor(F.col("piece") / FAN_IN))
        groups = G.python_groups(fits, [*keys, "alpha", "beta", "gamma", "_to"])
        fits = groups.applyInPandas(_combine(schema.names), schema)
        pieces = -(-pieces // FAN_IN)
    sse = F.col("squares")[0]
    params = [F.col(c) for c in ("alpha", "beta", "gamma")]
    best = (
        fits.groupBy(*keys, "period", "n_train", "n")
        .agg(F.min_by(F.struct(*params, F.col("across").alias("state"), sse.alias("sse")),
                      F.struct(sse, *params)).alias("b"))
        .select(*keys, "period", "n_train", "n", "b.*")
    )
    at = F.when(~F.col("is_train"), F.struct("_pos", "y"))  # at most `horizon` rows per series
    tails = df.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(at)), lambda s: s["y"]).alias("tail")
    )
    return G.attach(best, tails, keys)


def holt_winters_paths(
    series: DataFrame, period: int = 12, horizon: int = 6, keys: Sequence[str] = (),
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    fits = fit_holt_winters(series, period, horizon, keys, piece_rows)
    return fits.mapInPandas(_paths(keys, horizon), path_schema(series, keys))


def with_intervals(paths: DataFrame, confidence: float = 0.95) -> DataFrame:
    """``lower`` and ``upper`` around ``yhat`` from its standard deviation."""
    z = check_confidence(confidence)
    return paths.withColumn("lower", F.col("yhat") - z * F.col("sd")).withColumn(
        "upper", F.col("yhat") + z * F.col("sd")
    )


def drift_paths(
    series: DataFrame, period: int = 12, horizon: int = 6, keys: Sequence[str] = ()
) -> DataFrame:
    """The mean-and-drift forecast as paths, without deviations."""
    rows = S.split_series(series, period, horizon, keys)
    df = rows.core(rows.df)
    parts = {"train": df.where("is_train"), "all": df}
    frames = [
        S.mean_drift(part, horizon, keys).select(
            *keys,
            F.lit(origin).alias("origin"),
            F.col("step").cast("int").alias("step"),
            "yhat",
            F.lit(None).cast("double").alias("sd"),
        )
        for origin, part in parts.items()
    ]
    return frames[0].unionByName(frames[1])


def fall_back(
    first: DataFrame, method: str, second: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Paths of ``first`` where it has any, else of ``second`` (which carries its ``method``)."""
    on = G.same_keys("l", "r", [*keys, "origin", "step"])
    return (
        second.alias("l")
        .join(first.alias("r"), on, "left")
        .select(
            *[F.col(f"l.{c}") for c in (*keys, "origin", "step")],
            F.coalesce("r.yhat", "l.yhat").alias("yhat"),
            F.when(F.col("r.yhat").isNotNull(), F.col("r.sd")).otherwise(F.col("l.sd")).alias("sd"),
            F.when(F.col("r.yhat").isNotNull(), F.lit(method))
            .otherwise(F.col("l.method"))
            .alias("method"),
        )
    )


def holt_winters_or_drift(
    series: DataFrame, period: int = 12, horizon: int = 6, keys: Sequence[str] = ()
) -> DataFrame:
    """Holt-Winters paths; series too short for it get mean and drift."""
    drift = drift_paths(series, period, horizon, keys).withColumn("method", F.lit("mean_drift"))
    fitted = materialise(holt_winters_paths(series, period, horizon, keys), "paths")
    return fall_back(fitted, METHOD, drift, keys)
