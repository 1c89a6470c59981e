"""Registered queries: time series per station."""

from pyspark.sql import functions as F

from borehole.operators import forecast as W
from borehole.operators import rolling as R
from borehole.operators import series as S
from borehole.operators import smoothing as H
from borehole.plans import views as V
from borehole.plans.registry import query

STATION = ["station"]

ROLLING = """framed as (
  select *, count(*) over f as c, avg(level) over f as m, stddev_samp(level) over f as s
  from {source} where level is not null
  window f as (partition by station order by {order} rows between 15 preceding and 14 following)),
scored as (
  select *, case when c = 30 then m end as rolling_mean, case when c = 30 then s end as rolling_std,
    case when c = 30 then abs((level - m) / nullif(s, 0)) end as z_score from framed)"""


@query(f"""with {V.READINGS}, {ROLLING.format(source="readings", order="ds")}
select station, strftime(ds, '%Y-%m-%d') as ds, round(level, 4) as value,
  round(rolling_mean, 4) as rolling_mean, round(rolling_std, 4) as rolling_std,
  round(z_score, 4) as z_score, round(rolling_mean - 3 * rolling_std, 4) as expected_low,
  round(rolling_mean + 3 * rolling_std, 4) as expected_high, coalesce(z_score > 3, false) as is_anomaly
from scored""")
def temporal_anomalies(spark, sf):
    df = R.temporal_anomalies(V.readings(spark, sf), "ds", "level", keys=STATION)
    return V.day_text(V.rounded(df))


@query(f"""with {V.RAW_READINGS}, {ROLLING.format(source="raw_readings", order="ds, id")}
select station, id, strftime(ds, '%Y-%m-%d') as ds, round(level, 4) as value,
  round(z_score, 4) as z_score from scored where z_score > 2""")
def temporal_anomalies_flagged(spark, sf):
    df = V.raw_readings(spark, sf)
    scored = R.temporal_anomalies(df, "ds", "level", ["id"], STATION, threshold=2)
    flagged = scored.where("is_anomaly").select("station", "id", "ds", "value", "z_score")
    return V.day_text(V.rounded(flagged))


@query(f"""with {V.RAW_READINGS}, {ROLLING.format(source="raw_readings", order="ds, id")}
select station, count(*) as total_points, count(*) filter (z_score > 2) as anomalies_detected,
  round(count(*) filter (z_score > 2) / count(*)::double, 4) as anomaly_rate
from scored group by 1""")
def temporal_anomaly_summary(spark, sf):
    df = V.raw_readings(spark, sf)
    scored = R.temporal_anomalies(df, "ds", "level", ["id"], STATION, threshold=2)
    return V.rounded(R.temporal_summary(scored, STATION))


@query(f"""with {V.RAW_READINGS} select station, strftime(ds, '%Y-%m-%d') as ds,
  round(avg(level), 4) as y from raw_readings group by station, ds""")
def prepared_series(spark, sf):
    df = S.prepare_series(V.raw_readings(spark, sf), "ds", "level", STATION)
    return V.day_text(V.rounded(df))


def _split_sql(source: str, view: str, period: int, horizon: int) -> str:
    return f"""{view}, numbered as (
  select station, ds, level as y, row_number() over (partition by station order by ds) - 1 as pos,
    count(*) over (partition by station) as n
  from {source} where level is not null),
split as (
  select *, n - least({horizon}, n // 4) as n_train,
    case when n < {2 * period} then 1 else {period} end as period from numbered)"""


SPLIT = _split_sql("readings", V.READINGS, 12, 6)
SPLIT_DAILY = _split_sql("readings_daily", V.DAILY, 7, 6)


def _series(spark, sf):
    return S.prepare_series(V.readings(spark, sf), "ds", "level", STATION)


def _daily(spark, sf):
    return S.prepare_series(V.readings_daily(spark, sf), "ds", "level", STATION)


@query(f"""with {SPLIT} select station, strftime(ds, '%Y-%m-%d') as ds, round(y, 4) as y, pos, n,
  n_train, pos < n_train as is_train, cast(period as int) as period from split""")
def train_validation_split(spark, sf):
    return V.day_text(V.rounded(S.train_validation_split(_series(spark, sf), 12, 6, STATION)))


DRIFT = """fit as (
  select station, avg(y) as mean, arg_min(y, ds) as first, arg_max(y, ds) as last, count(*) as n
  from split where pos < n_train group by station),
drift as (
  select station, step, mean + step * ((last - first) / n) as yhat
  from fit, range(1, 7) r(step))"""


@query(f"""with {SPLIT}, {DRIFT}
select station, cast(step as int) as step, round(yhat, 4) as yhat from drift""")
def mean_drift_forecast(spark, sf):
    return V.rounded(S.mean_drift_forecast(_series(spark, sf), 6, 12, STATION))


@query(f"""with {SPLIT}, {DRIFT}, pairs as (
  select t.station, t.y, t.y - d.yhat as e from split t join drift d
    on d.station = t.station and d.step = t.pos - t.n_train + 1 where t.pos >= t.n_train)
select station, round(avg(abs(e)), 4) as mae, round(sqrt(avg(e * e)), 4) as rmse,
  round(100 * avg(abs(e / nullif(y, 0))), 4) as mape, count(*) filter (y = 0) as zero_actuals
from pairs group by station""")
def forecast_metrics(spark, sf):
    return V.rounded(S.mean_drift_errors(_series(spark, sf), 6, 12, STATION))


@query(f"""with {V.DAILY}, ends as (select station, max(ds) as last from readings_daily group by 1)
select station, cast(step as int) as step,
  strftime(last + to_days(cast(step as int)), '%Y-%m-%d') as ds from ends, range(1, 7) r(step)""")
def forecast_dates(spark, sf):
    """Daily readings: the step is found to be one day."""
    return V.day_text(S.forecast_dates(_daily(spark, sf), 6, 7, STATION))


MONTHLY = """monthly as (
  select o_orderpriority as station, date_trunc('month', o_orderdate)::timestamp as ds,
    avg(o_totalprice) / 9973e0 as level from orders group by 1, 2)"""


@query(f"""with {_split_sql("monthly", MONTHLY, 12, 6)}, gaps as (
  select *, (year(ds) * 12 + month(ds)) - lag(year(ds) * 12 + month(ds))
    over (partition by station order by ds) as gap from split),
ends as (
  select station, max(ds) filter (pos < n_train) as last, min(gap) = max(gap) as even,
    min(gap) as gap from gaps group by 1)
select station, cast(step as int) as step,
  strftime(case when even then last + to_months(cast(step * gap as int))
    else last + to_days(cast(step as int)) end, '%Y-%m-%d') as ds
from ends, range(1, 7) r(step)""")
def forecast_dates_monthly(spark, sf):
    """Monthly readings, dates counted from the last training month."""
    month = F.to_date(F.trunc("ds", "month")).cast("timestamp_ntz")
    df = V.raw_readings(spark, sf).withColumn("ds", month)
    series = S.prepare_series(df, "ds", "level", STATION)
    return V.day_text(S.forecast_dates(series, 6, 12, STATION, refit=False))


def _decompose_sql(period: int) -> str:
    half = period // 2
    ends = (
        f"(lag(y, {half}) over w + lead(y, {half}) over w) / 2" if period % 2 == 0 else "0"
    )
    return f"""moving as (
  select *, (sum(y) over (w rows between {half} preceding and {half} following) - {ends}) / {period} as t
  from numbered window w as (partition by station order by ds)),
trended as (
  select station, ds, y, pos, pos % {period} as slot,
    case when pos >= {half} and pos < n - {half} then t end as trend from moving),
slots as (select station, slot, avg(y - trend) as m from trended group by 1, 2),
seasons as (select station, slot, m - avg(m) over (partition by station) as seasonal from slots),
parts as (
  select station, ds, y as observed, trend, seasonal, y - trend - seasonal as resid
  from trended join seasons using (station, slot))"""


PARTS = """select station, strftime(ds, '%Y-%m-%d') as ds, round(observed, 4) as observed,
  round(trend, 4) as trend, round(seasonal, 4) as seasonal, round(resid, 4) as resid from parts"""


@query(f"with {SPLIT}, {_decompose_sql(12)} {PARTS}")
def seasonal_decomposition(spark, sf):
    return V.day_text(V.rounded(S.seasonal_decompose(_series(spark, sf), 12, STATION)))


@query(f"with {SPLIT_DAILY}, {_decompose_sql(7)} {PARTS}")
def seasonal_decomposition_weekly(spark, sf):
    return V.day_text(V.rounded(S.seasonal_decompose(_daily(spark, sf), 7, STATION)))


@query(f"""with {SPLIT_DAILY}, {_decompose_sql(7)}
select station, case when arg_max(trend, ds) filter (trend is not null)
    > arg_min(trend, ds) filter (trend is not null)
  then 'Upward trend detected' else 'Downward trend detected' end as trend,
  'Seasonal pattern with period 7' as seasonality, round(stddev_pop(resid), 4) as residual_std
from parts group by station""")
def decomposition_summary(spark, sf):
    parts = S.seasonal_decompose(_daily(spark, sf), 7, STATION)
    return V.rounded(S.decomposition_summary(parts, 7, STATION))


@query(f"""with {V.READINGS} select station, round(arg_max(level, ds), 4) as last_observed_value
from readings group by 1""")
def last_observed(spark, sf):
    return V.rounded(S.last_observed(_series(spark, sf), STATION))


# --- fitted forecasts -------------------------------------------------------------------

GRID = """grid as (
  select a.v as alpha, b.v as beta, g.v as gamma
  from (values (0.1e0), (0.3e0), (0.5e0), (0.7e0), (0.9e0)) a(v),
    (values (0.01e0), (0.1e0), (0.3e0), (0.5e0), (0.9e0)) b(v),
    (values (0.01e0), (0.1e0), (0.3e0), (0.5e0), (0.9e0)) g(v))"""

# The recursion of the fit, stepped row by row for every parameter set: the season is a list
# turned by one place per step.
HOLT_WINTERS = f"""{GRID}, starts as (
  select station, avg(y) filter (pos < 7) as l0, avg(y) filter (pos >= 7 and pos < 14) as l1,
    list(y order by pos) filter (pos < 7) as ys, max(n) as n, max(n_train) as n_train
  from split group by 1),
run as (
  select station, alpha, beta, gamma, 0::bigint as t, l0 as l, (l1 - l0) / 7 as b,
    list_transform(ys, lambda v: v - l0) as s, 0e0 as sse, n, n_train from starts, grid
  union all
  select r.station, alpha, beta, gamma, t + 1, l + b + alpha * e.e, b + alpha * beta * e.e,
    list_append(s[2:], s[1] + gamma * e.e), sse + e.e * e.e, r.n, r.n_train
  from run r join split x on x.station = r.station and x.pos = r.t,
    lateral (select x.y - l - b - s[1] as e) e),
best as (
  select *, row_number() over (partition by station order by sse, alpha, beta, gamma) as r
  from run where t = n_train),
last as (
  select r.* from run r join best b using (station, alpha, beta, gamma) where b.r = 1 and r.t = r.n)"""

RECURSIVE = f"with recursive {SPLIT_DAILY}, {HOLT_WINTERS}"


@query(f"""{RECURSIVE}
select station, alpha, beta, gamma, round(sse, 4) as sse, n, n_train from best where r = 1""")
def holt_winters_fit(spark, sf):
    fits = H.fit_holt_winters(_daily(spark, sf), 7, 6, STATION)
    return V.rounded(fits.select("station", "alpha", "beta", "gamma", "sse", "n", "n_train"))


Z95 = "1.959963984540054e0"


@query(f"""{RECURSIVE}, steps as (
  select station, step, l + step * b + s[(step - 1) % 7 + 1] as yhat, sse / n as variance,
    (select coalesce(sum(pow(alpha + alpha * beta * j, 2)), 0) from range(1, step) q(j)) as spread
  from last, range(1, 7) h(step))
select f.station, cast(step as int) as step, round(yhat, 4) as yhat,
  round(yhat - {Z95} * sqrt(variance * (1 + spread)), 4) as lower,
  round(yhat + {Z95} * sqrt(variance * (1 + spread)), 4) as upper,
  strftime(d.last + to_days(cast(step as int)), '%Y-%m-%d') as ds, 'holt_winters' as method
from steps f join (select station, max(ds) as last from readings_daily group by 1) d using (station)""")
def forecast(spark, sf):
    """Holt-Winters forecast with intervals; the horizon is within one season."""
    df = V.readings_daily(spark, sf)
    found = W.forecast(df, "ds", "level", STATION, period=7, horizon=6)
    return V.day_text(V.rounded(found.forecast))


@query(f"""{RECURSIVE}, pairs as (
  select b.station, x.y, x.y - (l + k * b + s[(k - 1) % 7 + 1]) as e
  from best b join (select *, pos - n_train + 1 as k from split) x on x.station = b.station
    and x.pos >= x.n_train where b.r = 1)
select station, round(avg(abs(e)), 4) as mae, round(sqrt(avg(e * e)), 4) as rmse,
  round(100 * avg(abs(e / nullif(y, 0))), 4) as mape, count(*) filter (y = 0) as zero_actuals
from pairs group by 1""")
def forecast_validation(spark, sf):
    df = V.readings_daily(spark, sf)
    return V.rounded(W.forecast(df, "ds", "level", STATION, period=7, horizon=6).metrics)


@query()
def forecast_sarimax(spark, sf):
    df = V.readings(spark, sf)
    found = W.forecast(df, "ds", "level", STATION, period=12, horizon=6, method="sarimax")
    return V.day_text(V.rounded(found.forecast))
