"""Time series per station: preparation, splitting, decomposition, dates and errors.

Functions after :func:`prepare_series` expect columns ``keys..., ds, y``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borehole.functions import parsing as P
from borehole.operators import grouping as G


def prepare_series(df: DataFrame, ds: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, ds, y``: parsed, without nulls, values of equal dates averaged."""
    return (
        df.select(*keys, P.try_date(df, ds).alias("ds"), P.try_number(df, y).alias("y"))
        .na.drop(subset=["ds", "y"])
        .groupBy(*keys, "ds")
        .agg(F.avg("y").alias("y"))
    )


def _check_period(period: int, horizon: int = 1) -> None:
    if period < 1 or horizon < 1:
        raise ValueError("period and horizon must be at least 1")


def train_rows(n: Column, horizon: int) -> Column:
    """Rows before the validation tail: all but ``min(horizon, n // 4)``."""
    return n - F.least(F.lit(horizon), F.floor(n / 4))


def split_series(
    series: DataFrame,
    period: int = 12,
    horizon: int = 6,
    keys: Sequence[str] = (),
    before: int = 0,
    after: int = 0,
) -> G.Ordered:
    """Number each series and mark its training part.

    Adds ``n_train``, ``is_train`` and the usable ``period``: 1 when there are not two seasons.
    """
    _check_period(period, horizon)
    rows = G.ordered(series, keys, ["ds"], before, after)
    n = F.col("_n")
    df = (
        rows.df.withColumn("n_train", train_rows(n, horizon).cast("long"))
        .withColumn("is_train", F.col("_pos") < F.col("n_train"))
        .withColumn("period", F.when(n < 2 * period, F.lit(1)).otherwise(F.lit(period)))
    )
    return G.Ordered(df, rows.partition, rows.order, rows.largest)


def train_validation_split(
    series: DataFrame, period: int = 12, horizon: int = 6, keys: Sequence[str] = ()
) -> DataFrame:
    rows = split_series(series, period, horizon, keys)
    return rows.core(rows.df).withColumnRenamed("_pos", "pos").withColumnRenamed("_n", "n")


def mean_drift_forecast(
    series: DataFrame, horizon: int = 6, period: int = 12, keys: Sequence[str] = ()
) -> DataFrame:
    """``mean + i * (last - first) / n`` of the training part, for i = 1..horizon."""
    rows = split_series(series, period, horizon, keys)
    return mean_drift(rows.core(rows.df).where("is_train"), horizon, keys)


def mean_drift(train: DataFrame, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    fit = train.groupBy(*keys).agg(
        F.avg("y").alias("mean"),
        F.min_by("y", "ds").alias("first"),
        F.max_by("y", "ds").alias("last"),
        F.count(F.lit(1)).alias("n"),
    )
    drift = F.try_divide(F.col("last") - F.col("first"), F.col("n"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    return fit.select("*", steps.alias("step")).select(
        *keys, "step", (F.col("mean") + F.col("step") * drift).alias("yhat")
    )


# --- dates ------------------------------------------------------------------------------


def _month_number(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def series_steps(rows: G.Ordered, keys: Sequence[str] = ()) -> DataFrame:
    """The regular step of each series: ``step_months``, ``step_time`` or, unknown, one day.

    ``weekdays_only`` is set where every day from Monday to Friday has a row and weekends have none.

    ``rows`` must come from :func:`split_series` with ``before=1``.
    """
    before = F.lag("ds").over(rows.window)
    gaps = (
        rows.core(rows.df.withColumn("_before", before))
        .withColumn("_gap", F.col("ds") - F.col("_before"))
        .withColumn("_months", _month_number(F.col("ds")) - _month_number(F.col("_before")))
    )
    one_day, weekend = F.make_dt_interval(F.lit(1)), F.make_dt_interval(F.lit(3))
    after_weekend = (F.weekday("ds") == 0) & (F.col("_gap") == weekend)
    in_week = F.weekday("ds").between(1, 4) & (F.col("_gap") == one_day)
    last_day = F.last_day("ds") == F.to_date("ds")
    same_day = F.min(F.date_format("ds", "dd HH:mm:ss")) == F.max(
        F.date_format("ds", "dd HH:mm:ss")
    )
    per_key = gaps.groupBy(*keys).agg(
        F.max("ds").alias("last_ds"),
        F.max_by("ds", F.when(F.col("is_train"), F.col("ds"))).alias("last_train_ds"),
        F.count(F.lit(1)).alias("n"),
        F.min("_gap").alias("_min_gap"),
        F.max("_gap").alias("_max_gap"),
        F.min("_months").alias("_min_months"),
        F.max("_months").alias("_max_months"),
        F.every(last_day).alias("_month_ends"),
        same_day.alias("_same_day"),
        F.every(F.col("_gap").isNull() | after_weekend | in_week).alias("_weekdays"),
    )
    enough = F.col("n") >= 3
    monthly = (F.col("_min_months") == F.col("_max_months")) & (F.col("_min_months") > 0)
    even = F.col("_min_gap") == F.col("_max_gap")
    return per_key.select(
        *keys,
        "last_ds",
        "last_train_ds",
        F.when(enough & even, F.col("_min_gap")).alias("step_time"),
        F.when(
            enough & ~even & monthly & (F.col("_month_ends") | F.col("_same_day")),
            F.col("_min_months"),
        ).alias("step_months"),
        (F.col("_month_ends") & ~F.col("_same_day")).alias("at_month_end"),
        (enough & ~even & F.col("_weekdays")).alias("weekdays_only"),
    )


def date_after(start: Column, step: Column) -> Column:
    """The date ``step`` regular steps after ``start``, given :func:`series_steps` columns."""
    months = F.make_ym_interval(F.lit(0), F.col("step_months") * step)
    by_month = start + months
    by_month = F.when(
        F.col("at_month_end"),
        F.last_day(by_month).cast("timestamp_ntz") + (start - F.date_trunc("day", start)),
    ).otherwise(by_month)
    one_day = F.make_dt_interval(F.lit(1))
    by_time = start + F.coalesce(F.col("step_time"), one_day) * step
    ahead = F.weekday(start) + step
    days = F.floor(ahead / 5) * 7 + ahead % 5 - F.weekday(start)
    by_weekday = start + F.make_dt_interval(days.cast("int"))
    return (
        F.when(F.col("step_months").isNotNull(), by_month)
        .when(F.col("weekdays_only"), by_weekday)
        .otherwise(by_time)
    )


def forecast_dates(
    series: DataFrame,
    horizon: int = 6,
    period: int = 12,
    keys: Sequence[str] = (),
    refit: bool = True,
) -> DataFrame:
    """``step, ds`` of the forecast: after the last date, or the last training date."""
    rows = split_series(series, period, horizon, keys, before=1)
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    start = F.col("last_ds" if refit else "last_train_ds")
    return (
        series_steps(rows, keys)
        .select("*", steps.alias("step"))
        .select(*keys, "step", date_after(start, F.col("step")).alias("ds"))
    )


def last_observed(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return series.groupBy(*keys).agg(F.max_by("y", "ds").alias("last_observed_value"))


# --- errors -----------------------------------------------------------------------------


def forecast_errors(
    tail: DataFrame, forecast: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """``mae, rmse, mape`` of the validation tail; ``tail`` has ``step, y``.

    Zero actuals are left out of ``mape`` and counted in ``zero_actuals``.
    """
    pairs = (
        tail.alias("l")
        .join(forecast.alias("r"), G.same_keys("l", "r", [*keys, "step"]))
        .select(
            *[F.col(f"l.{k}") for k in keys], F.col("l.y"), (F.col("l.y") - F.col("r.yhat")).alias("e")
        )
    )
    return pairs.groupBy(*keys).agg(
        F.avg(F.abs("e")).alias("mae"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        (F.avg(F.abs(F.try_divide(F.col("e"), F.col("y")))) * 100).alias("mape"),
        F.count_if(F.col("y") == 0).alias("zero_actuals"),
    )


def validation_tail(rows: G.Ordered, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, step, y`` of the rows after the training part."""
    df = rows.core(rows.df).where(~F.col("is_train"))
    return df.select(*keys, (F.col("_pos") - F.col("n_train") + 1).cast("int").alias("step"), "y")


def mean_drift_errors(
    series: DataFrame, horizon: int = 6, period: int = 12, keys: Sequence[str] = ()
) -> DataFrame:
    rows = split_series(series, period, horizon, keys)
    train = rows.core(rows.df).where("is_train")
    return forecast_errors(validation_tail(rows, keys), mean_drift(train, horizon, keys), keys)


# --- decomposition ----------------------------------------------------------------------


def seasonal_decompose(
    series: DataFrame, period: int = 12, keys: Sequence[str] = ()
) -> DataFrame:
    """Additive decomposition: ``ds, observed, trend, seasonal, resid``.

    Trend is the centred moving average over one period (of 2 x period when it is even), null
    where the frame is not full. Seasonal is the mean of the detrended values by position in
    the period, centred on zero. Series shorter than two periods get null components.
    """
    _check_period(period)
    half = period // 2
    rows = G.ordered(series, keys, ["ds"], before=half, after=half)
    if rows.largest < 2 * period:
        raise ValueError(f"not enough data: need at least {2 * period} points")
    w = rows.window
    frame = w.rowsBetween(-half, half)
    total = F.sum("y").over(frame)
    if period % 2 == 0:
        total = total - (F.lag("y", half).over(w) + F.lead("y", half).over(w)) / 2
    full = (F.col("_pos") >= half) & (F.col("_pos") < F.col("_n") - half)
    enough = F.col("_n") >= 2 * period
    df = rows.core(
        rows.df.withColumn("_trend", total / period)
        .withColumn("trend", F.when(full & enough, F.col("_trend")))
        .withColumn("slot", F.col("_pos") % period)
    )
    # one row per position in the period, so the mean over them needs no gathering of rows
    by_slot = df.groupBy(*keys, "slot").agg(F.avg(F.col("y") - F.col("trend")).alias("_mean"))
    centred = by_slot.select(
        *keys,
        "slot",
        (F.col("_mean") - F.avg("_mean").over(Window.partitionBy(*keys))).alias("seasonal"),
    )
    return G.attach(df, centred, [*keys, "slot"]).select(
        *keys,
        "ds",
        F.col("y").alias("observed"),
        "trend",
        "seasonal",
        (F.col("y") - F.col("trend") - F.col("seasonal")).alias("resid"),
    )


def decomposition_summary(
    decomposed: DataFrame, period: int, keys: Sequence[str] = ()
) -> DataFrame:
    """Direction of the trend, the period, and the population deviation of the residual."""
    has_trend = F.col("trend").isNotNull()
    first = F.min_by("trend", F.when(has_trend, F.col("ds")))
    last = F.max_by("trend", F.when(has_trend, F.col("ds")))
    return (
        decomposed.groupBy(*keys)
        .agg(first.alias("_first"), last.alias("_last"), F.stddev_pop("resid").alias("residual_std"))
        .select(
            *keys,
            F.when(F.col("_last").isNull(), F.lit("Unable to decompose"))
            .when(F.col("_last") > F.col("_first"), F.lit("Upward trend detected"))
            .otherwise(F.lit("Downward trend detected"))
            .alias("trend"),
            F.when(F.col("_last").isNull(), F.lit("No clear pattern"))
            .otherwise(F.lit(f"Seasonal pattern with period {period}"))
            .alias("seasonality"),
            "residual_std",
        )
    )
