"""Every query with an oracle gives the oracle's rows, also when its groups must be split."""

import pytest
from compare import differences

from borehole.plans.catalog import ORACLES, QUERIES

SPLIT = """temporal_anomalies temporal_anomalies_flagged train_validation_split mean_drift_forecast
forecast_metrics forecast_dates_monthly seasonal_decomposition alert_thresholds record_alerts
fill_missing_auto fill_missing_median encode_label encode_many_categories stratified_split
random_split station_projection impute_median""".split()

ROWS_ONLY = """station_clusters isolation_forest isolation_forest_by_station isolation_trees
forecast_sarimax feature_importance sample_predictions forest_regression forest_classification
stored_model_predictions list_datasets auto_analysis""".split()


def check(name, spark, sf, sql):
    got = QUERIES[name](spark, sf).toPandas()
    want = sql.execute(ORACLES[name]).df()
    assert differences(got, want)[:3] == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(name, spark, sf, sql):
    check(name, spark, sf, sql)


@pytest.mark.parametrize("name", SPLIT)
def test_split_groups_match_oracle(name, spark, sf, sql, small_groups):
    check(name, spark, sf, sql)


def test_queries_without_oracle_are_the_known_ones():
    assert sorted(set(QUERIES) - set(ORACLES)) == sorted(ROWS_ONLY)


@pytest.mark.parametrize("name", ["station_clusters", "isolation_trees", "list_datasets"])
def test_rows_only(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
