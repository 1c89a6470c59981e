"""Choosing and running analyses on a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from borehole.operators import alerts as L
from borehole.operators import anomaly as A
from borehole.operators import clean as C
from borehole.operators import forecast as W
from borehole.operators import geo
from borehole.operators import tabular as T
from borehole.session import materialise

TABULAR, FORECAST, MAP, ANOMALY, ALERTS = "tabular", "forecast", "geospatial", "anomaly", "alerts"


@dataclass(frozen=True)
class Roles:
    """Which column plays which part; what is not given is taken from the profile."""

    id_col: str
    date: str | None = None
    lat: str | None = None
    lon: str | None = None
    value: str | None = None
    target: str | None = None
    keys: Sequence[str] = field(default_factory=tuple)


def offered_analyses(profile: C.Profile) -> list[str]:
    """Analyses that make sense for a table of this profile."""
    found = [TABULAR]
    if profile.date_columns:
        found.append(FORECAST)
    if profile.coordinates:
        found.append(MAP)
    return [*found, ANOMALY, ALERTS]


def complete_roles(profile: C.Profile, roles: Roles) -> Roles:
    taken = {roles.id_col, *roles.keys, *profile.coordinates}
    values = [c for c in (*profile.targets, *profile.numeric) if c not in taken]
    lat, lon = profile.coordinates or (None, None)
    return Roles(
        id_col=roles.id_col,
        date=roles.date or next(iter(profile.date_columns), None),
        lat=roles.lat or lat,
        lon=roles.lon or lon,
        value=roles.value or next(iter(values), None),
        target=roles.target,
        keys=roles.keys,
    )


def run_analysis(df: DataFrame, kind: str, roles: Roles, **options) -> dict[str, DataFrame]:
    """One analysis as named result tables; ``options`` go to its operator."""
    if kind == TABULAR:
        trained = T.train_and_predict(df, roles.id_col, roles.target, **options)
        return {
            "metrics": trained.metrics,
            "predictions": T.sample_predictions(trained.predictions, roles.id_col),
            "importance": T.feature_importance(df, trained.model, trained.feature_names),
        }
    if kind == FORECAST:
        made = W.forecast(df, roles.date, roles.value, roles.keys, **options)
        tables = {
            "forecast": made.forecast,
            "metrics": made.metrics,
            "last_observed": made.last_observed,
        }
        return tables | ({"components": made.components} if made.components else {})
    if kind == ANOMALY:
        scored = A.detect(df, roles.id_col, keys=roles.keys, **options)
        features = [c for c in A.choose_features(df, options.get("features"),
                                                 [roles.id_col, *roles.keys])]
        return {
            "scored": scored,
            "statistics": A.anomaly_statistics(scored, roles.keys),
            "features": A.feature_analysis(scored, features, roles.keys),
            "top": A.top_anomalies(scored, roles.id_col, keys=roles.keys),
        }
    if kind == MAP:
        return map_data(df, roles, **options)
    if kind == ALERTS:
        alerts = L.with_alerts(df, roles.value, keys=roles.keys, **options)
        return {
            "alerts": alerts,
            "summary": L.alert_summary(alerts, roles.keys),
            "distribution": L.alert_distribution(alerts, roles.keys),
            "top": L.top_risks(alerts, [roles.id_col], keys=roles.keys),
        }
    raise ValueError(f"unknown analysis: {kind}")


def map_data(
    df: DataFrame, roles: Roles, cluster: bool = False, n_clusters: int = 5
) -> dict[str, DataFrame]:
    """Stations with bounds, centre, heat points and GeoJSON, clustered on demand."""
    points = geo.stations(df, roles.lat, roles.lon, roles.value, roles.id_col)
    points = materialise(points, "stations")
    if points.isEmpty():
        raise ValueError("no valid coordinates found")
    tables = {}
    if cluster:
        points = geo.cluster_stations(points, n_clusters)
        tables["clusters"] = geo.cluster_stats(points)
    return tables | {
        "stations": points,
        "bounds": geo.bounds(points),
        "center": geo.center(points),
        "heat_points": geo.heat_points(points),
        "geojson": geo.to_geojson(points, roles.value or "value"),
    }


def auto_analyze(
    df: DataFrame, roles: Roles, options: dict[str, dict] | None = None,
    kinds: Sequence[str] | None = None,
) -> tuple[C.Profile, dict[str, dict[str, DataFrame]]]:
    """Profile a table and run every analysis it allows; the input is written once for all."""
    stored = materialise(df, "analysed")
    profile = C.detect_dataset_type(stored, [roles.id_col])
    roles = complete_roles(profile, roles)
    wanted = [k for k in offered_analyses(profile) if kinds is None or k in kinds]
    if roles.value is None:
        wanted = [k for k in wanted if k not in (FORECAST, ALERTS)]
    options = options or {}
    return profile, {k: run_analysis(stored, k, roles, **options.get(k, {})) for k in wanted}
