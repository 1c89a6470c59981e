"""Cleaning, detection, quality and files on small tables with known answers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from borehole.operators import alerts
from borehole.operators import clean as C
from borehole.operators import quality as Q
from borehole.session import scratch_path
from borehole.sources import files, sinks


def write_text(spark, name, text):
    path = scratch_path(spark, "csv") + f"-{name}"
    rows = [(line,) for line in text.splitlines()]
    spark.createDataFrame(rows, "value string").coalesce(1).write.text(path)
    return path


MESSY = """Station ID; Level (m) ;Day;Empty;Mixed;Whole;Flag;Sparse
A;1.5;01/02/2020;;1;1;True;
B;x;01/03/2020;;n/a;2;False;2.5
;;;;;;;
C;3.5;01/04/2020;;x;3;True;
D;4.5;bad;;y;4;True;"""


def test_read_delimited(spark):
    df = files.read_delimited(spark, write_text(spark, "a.csv", MESSY))
    assert df.dtypes == [
        ("Station_ID", "string"), ("Level_m", "double"), ("Day", "timestamp_ntz"),
        ("Mixed", "string"), ("Whole", "bigint"), ("Flag", "boolean"), ("Sparse", "double"),
    ]
    rows = {r["Station_ID"]: r for r in df.collect()}
    assert sorted(rows) == ["A", "B", "C", "D"]
    assert rows["A"]["Day"] == dt.datetime(2020, 1, 2) and rows["D"]["Day"] is None
    assert rows["B"]["Level_m"] is None and rows["B"]["Mixed"] is None
    assert rows["B"]["Sparse"] == 2.5


@pytest.mark.parametrize(
    "text, expected",
    [("a;b;c\n1,5;2;3", ";"), ("a\tb", "\t"), ("a|b|c", "|"), ("a,b;c", ","), ("abc", ","), ("", ",")],
)
def test_delimiters(text, expected):
    assert files.detect_delimiter(text) == expected


def test_extensions(spark):
    with pytest.raises(ValueError, match="spreadsheets"):
        files.read_delimited(spark, "x/data.xlsx")
    with pytest.raises(ValueError, match="unsupported"):
        files.read_delimited(spark, "x/data.json")


def test_read_many_names_each_dataset(spark):
    folder = scratch_path(spark, "many")
    for name, rows in (("s1", [(1, 2.5), (2, None)]), ("s2", [(3, 4.5)])):
        df = spark.createDataFrame(rows, "id int, v double")
        df.coalesce(1).write.option("header", True).csv(f"{folder}/{name}.csv")
    got = files.read_many(spark, f"{folder}/*.csv", dataset_pattern=r"([^/]+)\.csv/[^/]+$")
    assert sorted(tuple(r) for r in got.collect()) == [("s1", 1, 2.5), ("s1", 2, None), ("s2", 3, 4.5)]


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2)], " a b , c$".split(","))
    assert C.clean_column_names(df).columns == ["a_b", "c"]
    with pytest.raises(ValueError):
        C.clean_column_names(spark.createDataFrame([(1, 2)], ["a$", "a"]))


def test_numbers_with_suffixes_are_texts(spark):
    df = spark.createDataFrame([("1d",), ("2f",), ("3",), ("1e3",), (" 4 ",)], "v string")
    got = [r[0] for r in C.coerce_numeric(df).collect()]
    assert got == [None, None, 3.0, 1000.0, 4.0]


def test_half_is_not_more_than_half(spark):
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    assert C.coerce_numeric(df).dtypes == [("v", "string")]
    df = spark.createDataFrame([("2020-01-01",), ("x",)], "v string")
    assert C.date_like_columns(df, ["v"]) == []


def test_first_ten_values_decide(spark):
    df = spark.range(40).select(
        "id", F.when(F.col("id") < 10, F.lit("on 2020-01-01 at noon")).otherwise("x").alias("v")
    )
    assert C.date_like_columns(df, ["id"]) == ["v"]
    assert C.date_like_columns(df.withColumn("id", -F.col("id")), ["id"]) == []


def profile(spark, columns, rows=20):
    return C.detect_dataset_type(spark.range(rows).select(*[c.alias(n) for n, c in columns.items()]))


def test_dataset_types(spark):
    day = F.current_timestamp().cast("timestamp_ntz")
    number, text = F.rand(), F.lit("x")
    assert profile(spark, {"Date": day, "lat": number, "lon": number}).kind == "timeseries"
    assert profile(spark, {"Date": day, "v": number}, rows=10).kind == "tabular"
    geo = profile(spark, {"Latitude": number, "Longitude": number, "Water_Level_m": number})
    assert geo.kind == "geospatial" and geo.coordinates == ("Latitude", "Longitude")
    assert geo.targets == ("Water_Level_m",)
    plain = profile(spark, {"humidity": number, "plate": number, "soil": text})
    assert plain.kind == "tabular" and plain.identifiers == ("humidity",)
    assert plain.features["potential_targets"] == "Numeric columns: humidity, plate"
    assert plain.features["data_quality"] == "0.0% missing values"
    assert C.recommendations("tabular")[-1] == C.ALWAYS_RECOMMENDED


def test_fill_by_group(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("a", 3.0), ("b", 10.0), ("b", None)], "k string, v double"
    )
    got = sorted(tuple(r) for r in C.fill_median(df, keys=["k"]).collect())
    assert got == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 10.0), ("b", 10.0)]
    with pytest.raises(ValueError):
        C.fill_missing(df, "other")
    dated = df.withColumn("d", F.when(F.coalesce("v", F.lit(0.0)) < 9, F.current_timestamp()))
    with pytest.raises(ValueError, match="order_by"):
        C.fill_missing(dated, "auto")


def test_few_groups_are_scaled_without_moving_their_rows(spark):
    """Rows of one key are not sent to one partition to meet the statistics of their key."""
    path = scratch_path(spark, "scaled")
    spark.range(60_000).select((F.col("id") % 3).alias("k"), (F.rand(5) * 100).alias("v")).write.parquet(path)
    df = spark.read.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000b")  # the rows are larger
    try:
        for made in (C.standardize(df, ["v"], ["k"]), C.fill_mean(df, ["k"]), alerts.with_alerts(df, "v", keys=["k"])):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        got = C.standardize(df, ["v"], ["k"]).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 3 and all(r["m"] == pytest.approx(0, abs=1e-9) and r["s"] == pytest.approx(1) for r in got)


def test_medians_are_looked_for_only_where_values_are_missing(spark, monkeypatch):
    asked = []
    whole = C.G.exact_quantiles

    def noted(df, cols, *rest):
        asked.append(list(cols))
        return whole(df, cols, *rest)

    monkeypatch.setattr(C.G, "exact_quantiles", noted)
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 3, None), ("b", 5, float("nan")), ("a", 7, 6.0)], "k string, x int, y double")
    for keys, want in (([], 4.0), (["k"], None)):
        got = C.fill_median(df, ["x", "y"], keys)
        assert got.dtypes == [("k", "string"), ("x", "double"), ("y", "double")]
        assert {r["x"]: r["y"] for r in got.collect()} == {1.0: 2.0, 3.0: 4.0, 5.0: want, 7.0: 6.0}
    assert asked == [["y"], ["y"]]
    assert C.fill_median(df.select("x"), ["x"]).dtypes == [("x", "double")] and len(asked) == 2


def test_label_of_null_is_nan(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("z",)], "v string")
    assert [r[0] for r in C.encode_label(df).collect()] == [1, 2, 0, 3]
    hot = C.encode_onehot(df)
    assert hot.columns == ["v_b", "v_z"] and tuple(hot.collect()[1]) == (False, False)


def test_empty_dataset_is_invalid(spark):
    empty = spark.createDataFrame([], "a int")
    assert not Q.is_valid(Q.validate_dataset(empty))
    one = spark.createDataFrame([(1,)], "a int")
    assert Q.is_valid(Q.validate_dataset(one))
    report = {r["metric"] for r in Q.validate_dataset(one, 2, 2).where("severity = 'error'").collect()}
    assert report == {"too_few_rows", "too_few_columns"}


def test_coordinates_at_one_place(spark):
    df = spark.createDataFrame([(10.0, 20.0)] * 3, "lat double, lon double")
    found = {r["metric"] for r in Q.validate_coordinates(df, "lat", "lon").collect()}
    assert {"all_identical", "very_small_range"} <= found
    assert not Q.is_valid(Q.validate_coordinates(df, "lat", "nope"))


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    stats = {r["metric"]: r["value"] for r in Q.validate_numeric_columns(df, ["v"]).collect()}
    assert stats["max"] == 1.0 and stats["unique_values"] == 1.0


def test_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert sinks.json_lines(df).first()[0] == '{"a":1,"b":null}'
    assert sinks.result_envelope(df, "t").first()[0] == (
        '{"success":true,"task":"t","data":{"a":1,"b":null}}'
    )


def _document(spark, path):
    """The parts of a written collection, joined in the order of its manifest."""
    text = ""
    for r in sinks.read_manifest(spark, path).collect():
        with open(r["file"].removeprefix("file:"), encoding="utf-8") as part:
            text += part.read()
    return json.loads(text)


def test_a_collection_in_parts_is_one_document(spark, tmp_path):
    path = str(tmp_path / "map")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _check_collection(spark, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _check_collection(spark, path):
    made = [(i, f'{{"type":"Feature","properties":{{"id":{i},"name":"é {i}"}}}}') for i in range(500)]
    # the first feature three times, another one twice, one without text
    rows = made + [made[0], made[0], made[7], (3, None)]
    features = spark.createDataFrame(rows, "id long, feature string").repartition(5)
    manifest = sinks.write_feature_collection(features, path).collect()
    assert len(manifest) > 1 and sum(r["features"] for r in manifest) == 503
    assert [r["part"] for r in manifest] == sorted(r["part"] for r in manifest) and all(r["bytes"] > 0 for r in manifest)
    document = _document(spark, path)
    assert document["type"] == "FeatureCollection"
    assert [f["properties"]["id"] for f in document["features"]] == sorted([r[0] for r in rows if r[1]])
    back = sinks.read_feature_collection(spark, path).collect()
    assert sorted(r["feature"] for r in back) == sorted(r[1] for r in rows if r[1])
    # written again: the manifest names the new parts only
    sinks.write_feature_collection(features.where("id = 3"), path)
    assert [f["properties"]["id"] for f in _document(spark, path)["features"]] == [3]
    assert sinks.read_feature_collection(spark, path).count() == 1


def test_an_empty_collection(spark, tmp_path):
    path = str(tmp_path / "map")
    nothing = spark.createDataFrame([(1, None)], "id long, feature string")
    assert sum(r["features"] for r in sinks.write_feature_collection(nothing, path).collect()) == 0
    assert _document(spark, path) == {"type": "FeatureCollection", "features": []}
    assert sinks.read_feature_collection(spark, path).count() == 0


def test_registering_again_replaces_one_dataset(spark):
    folder = scratch_path(spark, "datasets")
    for name, n in (("a", 3), ("b", 5), ("a", 7)):
        files.register_dataset(spark.range(n), name, folder)
    got = files.load_datasets(spark, folder).groupBy("dataset_id").count().collect()
    assert {r[0]: r[1] for r in got} == {"a": 7, "b": 5}


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(i, nan if i % 5 == 0 else float(i)) for i in range(20)], "id long, x double")
    good = df.select("id", F.when(~F.isnan("x"), F.col("x")).alias("x"))
    for made in (C.fill_mean, C.fill_median, C.fill_mode, lambda d: C.standardize(d, ["x"]),
                 C.missing_percentage, Q.missing_stats, Q.validate_dataset,
                 lambda d: Q.validate_numeric_columns(d, ["x"]), lambda d: alerts.alert_thresholds(d, "x"),
                 lambda d: C.drop_sparse_columns(d, 0.1)):
        left, right = made(df), made(good)
        assert sorted(left.columns) == sorted(right.columns)
        assert sorted(map(str, left.collect())) == sorted(map(str, right.collect())) or "x" not in left.columns
    level = alerts.alert_level(F.col("x"), F.lit(15.0), F.lit(3.0))
    assert df.where(F.isnan("x")).select(level.alias("l")).distinct().first()["l"] == alerts.NORMAL
