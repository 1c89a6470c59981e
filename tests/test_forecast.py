"""Fitted forecasts: exact on exact series, the same however a series is cut."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from borehole.operators import forecast as W
from borehole.operators import sarima as A
from borehole.operators import series as S
from borehole.operators import smoothing as H

DAY0 = dt.datetime(2020, 1, 1)


def make(spark, values, step=dt.timedelta(days=1)):
    rows = [(k, DAY0 + i * step, float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "station string, ds timestamp_ntz, y double")


def paths(df, origin="all"):
    pdf = df.where(f"origin = '{origin}'").orderBy("station", "step").toPandas()
    return {k: g["yhat"].to_numpy() for k, g in pdf.groupby("station")}


def test_line_is_continued_exactly(spark):
    df = make(spark, {"a": 3 + 0.5 * np.arange(40), "b": 100 - 2.0 * np.arange(60)})
    for made in (H.holt_winters_paths(df, 1, 5, ["station"]), A.sarima_paths(df, 1, 5, ["station"])):
        got = paths(made)
        np.testing.assert_allclose(got["a"], 3 + 0.5 * np.arange(40, 45), atol=1e-8)
        np.testing.assert_allclose(got["b"], 100 - 2.0 * np.arange(60, 65), atol=1e-8)


def test_season_is_continued_exactly(spark):
    wave = np.sin(2 * np.pi * np.arange(12) / 12)
    df = make(spark, {"a": np.tile(wave, 10)})
    for made in (H.holt_winters_paths(df, 12, 15, ["station"]), A.sarima_paths(df, 12, 15, ["station"])):
        np.testing.assert_allclose(paths(made)["a"], np.tile(wave, 2)[:15], atol=1e-8)


@pytest.mark.parametrize("period", [1, 4])
def test_cutting_a_series_changes_nothing(spark, period):
    rng = np.random.default_rng(3)
    values = {k: np.cumsum(rng.normal(size=n)) + np.tile([0, 3, 1, -2], n)[:n]
              for k, n in (("a", 300), ("b", 37), ("c", 160))}
    df = make(spark, values)
    columns = ["station", "alpha", "beta", "gamma", "sse", "state"]

    def fit(rows):
        made = H.fit_holt_winters(df, period, 6, ["station"], piece_rows=rows)
        return made.select(*columns).orderBy("station").toPandas()

    whole, cut = fit(10_000), fit(9)  # 9 rows a piece: over 32 pieces, more than one level is not
    for c in columns[:4]:
        assert list(whole[c]) == list(cut[c])
    np.testing.assert_allclose(whole["sse"], cut["sse"], rtol=1e-9)
    for x, y in zip(whole["state"], cut["state"]):
        np.testing.assert_allclose(x, y, rtol=1e-8, atol=1e-9)


def test_many_levels_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(H, "FAN_IN", 3)
    rng = np.random.default_rng(4)
    df = make(spark, {"a": rng.normal(size=200)})
    whole = H.fit_holt_winters(df, 1, 6, ["station"]).first()
    cut = H.fit_holt_winters(df, 1, 6, ["station"], piece_rows=7).first()
    assert whole["sse"] == pytest.approx(cut["sse"])
    assert (whole["alpha"], whole["beta"]) == (cut["alpha"], cut["beta"])


def test_fit_equals_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    y = 10 + np.tile([2.0, -1.0, 0.5], 20) + rng.normal(scale=0.3, size=60)
    row = H.fit_holt_winters(make(spark, {"a": y}), 3, 6, ["station"]).first()
    train = y[: row["n_train"]]
    best = None
    for a, b, g in H.parameter_grid(True):
        level, trend = train[:3].mean(), (train[3:6].mean() - train[:3].mean()) / 3
        season, sse = list(train[:3] - level), 0.0
        for t, v in enumerate(train):
            e = v - level - trend - season[t % 3]
            level, trend = level + trend + a * e, trend + a * b * e
            season[t % 3] += g * e
            sse += e * e
        if best is None or sse < best[0]:
            best = (sse, a, b, g)
    assert (row["alpha"], row["beta"], row["gamma"]) == best[1:]
    assert row["sse"] == pytest.approx(best[0])


@pytest.mark.parametrize("limit", ["60", "1000000"])
def test_sarima_recovers_an_autoregression(spark, limit):
    """ARIMA(1,1,0): the forecast of the next change is close to phi times the last one."""
    spark.conf.set("spark.borehole.maxGroupRows", limit)
    rng = np.random.default_rng(6)
    w = [0.0]
    for _ in range(1500):
        w.append(0.7 * w[-1] + rng.normal(scale=0.1))
    y = np.cumsum(w)
    got = paths(A.sarima_paths(make(spark, {"a": y}), 1, 3, ["station"]))["a"]
    spark.conf.unset("spark.borehole.maxGroupRows")
    assert got[0] - y[-1] == pytest.approx(0.7 * w[-1], abs=0.05)


def test_short_series_fall_back(spark):
    df = make(spark, {"short": [1.0], "long": 5 + np.tile([0.0, 1.0], 40)})
    for method, best in (("holt_winters", "holt_winters"), ("sarimax", "sarimax")):
        found = W.forecast(df, "ds", "y", ["station"], period=2, horizon=4, method=method)
        pdf = found.forecast.toPandas()
        assert dict(pdf.groupby("station")["method"].first()) == {"long": best, "short": "mean_drift"}
        assert len(pdf) == 8
        assert pdf[pdf["station"] == "short"]["lower"].isna().all()
        long = pdf[pdf["station"] == "long"].sort_values("step")
        assert long["ds"].iloc[0] == pd.Timestamp(DAY0 + dt.timedelta(days=80))
        assert (long["lower"] <= long["yhat"]).all() and (long["yhat"] <= long["upper"]).all()
        assert found.last_observed.where("station = 'long'").first()[1] == 6.0


def test_without_keys(spark):
    df = make(spark, {"a": 3 + 0.5 * np.arange(40)}).drop("station")
    for method in ("holt_winters", "sarimax"):
        found = W.forecast(df, "ds", "y", period=1, horizon=2, method=method, refit=False)
        pdf = found.forecast.orderBy("step").toPandas()
        np.testing.assert_allclose(pdf["yhat"], [3 + 0.5 * 38, 3 + 0.5 * 39], atol=1e-8)
        assert pdf["ds"].iloc[0] == pd.Timestamp(DAY0 + dt.timedelta(days=38))
        assert found.metrics.first()["mae"] == pytest.approx(0, abs=1e-8)
        assert found.components.first()["trend"] == "Upward trend detected"


def test_weekday_steps_cross_weekends(spark):
    days = pd.bdate_range("2024-01-01", periods=30)
    rows = [(d.to_pydatetime(), 1.0) for d in days]
    df = spark.createDataFrame(rows, "ds timestamp_ntz, y double")
    got = S.forecast_dates(df, 12, 1).orderBy("step").toPandas()["ds"]
    assert list(got) == list(pd.bdate_range(days[-1], periods=13)[1:])


def test_sarima_without_two_seasons(spark):
    rng = np.random.default_rng(3)
    values = {"few": np.cumsum(rng.normal(size=60)), "many": 5 + np.tile([0.0, 1.0], 100)}
    df = make(spark, values)
    found = W.forecast(df, "ds", "y", ["station"], period=40, horizon=4, method="sarimax")
    pdf = found.forecast.toPandas()
    assert len(pdf) == 8
    plain = paths(A.sarima_paths(make(spark, {"few": values["few"]}), 1, 4, ["station"]))["few"]
    few = pdf[pdf["station"] == "few"].sort_values("step")
    assert set(few["method"]) == {"sarimax"}
    got = few["yhat"]
    np.testing.assert_allclose(got, plain, atol=1e-9)


@pytest.mark.parametrize(
    "days, expected",
    [
        (["2020-01-31", "2020-02-29", "2020-03-31", "2020-04-30"], "2020-05-31"),
        (["2020-01-15", "2020-02-15", "2020-03-15"], "2020-04-15"),
        (["2020-01-01", "2020-01-08", "2020-01-15"], "2020-01-22"),
        (["2020-01-01", "2020-01-02", "2020-01-09"], "2020-01-10"),
        (["2024-02-01", "2024-02-02", "2024-02-05", "2024-02-09"], "2024-02-10"),
        (["2024-02-01", "2024-02-02", "2024-02-05", "2024-02-06"], "2024-02-07"),
        (["2024-02-05", "2024-02-06", "2024-02-07", "2024-02-08", "2024-02-09"], "2024-02-10"),
        (["2024-02-02", "2024-02-05", "2024-02-06", "2024-02-07", "2024-02-08", "2024-02-09"], "2024-02-12"),
        (["2024-02-03", "2024-02-04", "2024-02-07"], "2024-02-08"),
    ],
)
def test_next_date(spark, days, expected):
    rows = [(dt.datetime.fromisoformat(d), 1.0) for d in days]
    df = spark.createDataFrame(rows, "ds timestamp_ntz, y double")
    assert str(S.forecast_dates(df, 1, 1).first()["ds"].date()) == expected


def test_bounds_are_enforced(spark):
    df = make(spark, {"a": np.arange(10.0)})
    with pytest.raises(ValueError):
        W.forecast(df, "ds", "y", confidence=0.5)
    with pytest.raises(ValueError):
        W.forecast(df, "ds", "y", horizon=0)
    with pytest.raises(ValueError):
        W.forecast(df, "ds", "y", method="other")
    with pytest.raises(ValueError):
        S.seasonal_decompose(df.drop("station"), 12)
