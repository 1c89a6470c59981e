"""Forests, maps, streams and whole analyses."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from borehole.operators import alerts as L
from borehole.operators import geo
from borehole.operators import tabular as T
from borehole.plans import analyze
from borehole.session import scratch_path
from borehole.streaming import rowwise


@pytest.fixture(scope="module")
def wells(spark):
    rng = np.random.default_rng(0)
    n = 300
    pdf = pd.DataFrame({
        "row": np.arange(n),
        "rain": rng.normal(800, 200, n),
        "depth": rng.uniform(10, 100, n),
        "soil": rng.choice(["Sandy", "Clay", "Loamy"], n),
        "well_name": [f"w{i}" for i in range(n)],
    })
    pdf["level"] = pdf["depth"] / 10 + (pdf["soil"] == "Clay") * 5
    pdf.loc[::17, "rain"] = np.nan
    pdf.loc[5, "level"] = np.nan
    return spark.createDataFrame(pdf)


def test_forest_beats_the_mean(wells):
    trained = T.train_and_predict(wells, "row", trees=20)
    assert (trained.target, trained.task, trained.n_samples) == ("level", "regression", 299)
    assert trained.feature_names == ["rain", "depth", "soil_Loamy", "soil_Sandy"]
    m = trained.metrics.first()
    assert m["r2"] > 0.9 and m["mae"] <= m["rmse"]
    assert trained.predictions.count() == 60
    importance = T.feature_importance(wells, trained.model, trained.feature_names).collect()
    assert importance[0]["feature"] == "depth"
    assert sum(r["importance"] for r in importance) == pytest.approx(1)


@pytest.mark.parametrize("target", ["level", "deep"])
def test_forests_do_not_depend_on_the_cores(spark, wells, target):
    """Other numbers of partitions, shuffle partitions and file splits give the same model."""
    df = wells.withColumn("deep", F.when(F.col("depth") > 50, "yes").when(F.col("depth") > 20, "no"))
    df = df.drop("depth") if target == "deep" else df
    measured = []
    for parts in (2, 4, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.files.maxPartitionBytes", f"{parts * 1000}b")
        trained = T.train_and_predict(df.repartition(parts), "row", target, trees=10, seed=5)
        weights = [round(float(v), 9) for v in T._forest_stage(trained.model).featureImportances.toArray()]
        predicted = [tuple(r) for r in trained.predictions.orderBy("row").select("row", "predicted").collect()]
        measured.append((weights, [round(v, 9) for v in trained.metrics.first()], predicted))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert measured[0][:2] == measured[1][:2] == measured[2][:2]
    for one in measured[1:]:
        assert [p for _, p in one[2]] == (pytest.approx([p for _, p in measured[0][2]]) if target == "level" else [p for _, p in measured[0][2]])


def test_regression_splits_few_nodes_at_a_time(wells, monkeypatch):
    """Smaller passes than MLlib's own give the same forest; wide features keep its limit."""
    fitted = []
    for nodes in (T.PASS_NODES, 10**6):
        monkeypatch.setattr(T, "PASS_NODES", nodes)
        trained = T.train_and_predict(wells, "row", trees=20)
        forest = T._forest_stage(trained.model)
        predicted = [r["predicted"] for r in trained.predictions.orderBy("row").collect()]
        fitted.append((forest.getOrDefault("maxMemoryInMB"), forest.totalNumNodes, forest.featureImportances.toArray(), predicted))
    few, whole = fitted
    assert few[0] < whole[0] == 256 and few[1] == whole[1]
    assert few[2] == pytest.approx(whole[2], rel=1e-9) and few[3] == pytest.approx(whole[3], rel=1e-9)
    monkeypatch.undo()
    assert T.pass_memory(1) == 1 and T.pass_memory(12) == 8 and T.pass_memory(10_000) == 256


@pytest.mark.parametrize("kinds", [0, 2, 3])
def test_forests_are_those_of_mllib(spark, wells, monkeypatch, kinds):
    """The same nodes, features drawn for them and leaves, while MLlib itself fits two rows; also over several passes and sums."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    names = F.when(F.col("depth") > 70, "a").when(F.col("depth") > 40, "b").otherwise("c" if kinds == 3 else "a")
    df = wells.where("level is not null").withColumn("_target", names).withColumn("flat", F.lit(1.0))
    features = T.fit_features(df.drop("depth") if kinds else df, ["row", "level", "_target"])
    label = T.StringIndexer(inputCol="_target", outputCol="_label", stringOrderType="alphabetAsc").fit(df)
    data = PipelineModel(features.stages).transform(T.dealt(df, "row"))
    data = (label.transform(data) if kinds else data.withColumnRenamed("level", "_label")).select("features", "_label")
    common = dict(labelCol="_label", numTrees=12, maxDepth=6, seed=3, maxMemoryInMB=1)
    kind = RandomForestClassifier if kinds else RandomForestRegressor
    forest = kind(**common) if kinds else kind(featureSubsetStrategy="all", **common)
    want = forest.fit(data)
    seen, few = [], data.limit(2)
    whole = kind.fit
    monkeypatch.setattr(kind, "fit", lambda self, rows: seen.append(rows.count()) or whole(self, rows))
    for groups, nbytes in ((32, 1 << 20), (3, 1 << 12)):
        monkeypatch.setattr(T.forests, "GROUPS", groups)
        monkeypatch.setattr(T.forests, "PASS_BYTES", nbytes * 8)
        monkeypatch.setattr(T.forests, "BLOCK_BYTES", nbytes)
        got = T.forests.fit(forest, data, few, kinds)
        assert got.totalNumNodes == want.totalNumNodes and got.numFeatures == want.numFeatures
        if kinds or groups == 32:  # other sums of decimals differ in their last digit
            assert [t.toDebugString.split("\n", 1)[1] for t in got.trees] == [t.toDebugString.split("\n", 1)[1] for t in want.trees]
            assert got.featureImportances == want.featureImportances
        assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), rel=1e-9)
    assert seen == [2, 2]


@pytest.mark.parametrize("target", ["level", "class"])
def test_predictions_are_those_of_mllib(spark, wells, target, monkeypatch):
    """Numbers, classes and shares to the last bit, for missing, infinite and unseen values too; MLlib's model does not see a row."""
    df = wells.withColumn("class", F.when(F.col("depth") > 70, "a").when(F.col("depth") > 40, "b").otherwise("c"))
    trained = T.train_and_predict(df.drop("level" if target == "class" else "class"), "row", target, trees=15)
    odd = [(900, float("nan"), 20.0, "Clay"), (901, None, float("inf"), "Loamy"), (902, 1.0, -1.0, None), (903, 700.0, 50.0, "Gravel")]
    rows = wells.select("row", "rain", "depth", "soil").union(spark.createDataFrame(odd, "row long, rain double, depth double, soil string"))
    want = trained.model.transform(rows)
    shares = T.forests.vector_to_array("probability") if target == "class" else F.array()
    want = {r["row"]: (r["predicted"], r["p"]) for r in want.select("row", "predicted", shares.alias("p")).collect()}
    stored = T.load_model(T.save_model(trained.model, scratch_path(spark, "models"), "m"))
    for model in (trained.model, stored):
        stage = type(T._forest_stage(model))
        with monkeypatch.context() as held:
            held.setattr(stage, "transform", None)
            got = T.predict(model, rows).collect()
        assert {r["row"]: (r["predicted"], r["probabilities"] if target == "class" else []) for r in got} == want and len(got) == len(want)


def test_forest_without_a_split(spark):
    """Constant features make trees of one leaf."""
    df = spark.range(40).select(F.col("id").alias("row"), F.lit(1.0).alias("x"), (F.col("id") % 3 + 0.5).alias("level"))
    trained = T.train_and_predict(df, "row", "level", task="regression", trees=3)
    assert T._forest_stage(trained.model).totalNumNodes == 3


def test_classifier_survives_storage(spark, wells):
    df = wells.withColumn("class", F.when(F.col("depth") > 50, "deep").otherwise("flat"))
    trained = T.train_and_predict(df, "row", "class", trees=20)
    assert trained.task == "classification" and trained.classes == ["deep", "flat"]
    assert trained.metrics.first()["accuracy"] > 0.9
    path = T.save_model(trained.model, scratch_path(spark, "models"), "m1")
    # a category never seen and missing values
    new = wells.limit(5).withColumn("soil", F.lit("Gravel")).withColumn("rain", F.lit(None).cast("double"))
    got = T.load_and_predict(path, new).collect()
    assert {r["predicted"] for r in got} <= {"deep", "flat"}
    assert all(sum(r["probabilities"]) == pytest.approx(1) for r in got)
    assert T.model_classes(T.load_model(path)) == ["deep", "flat"]


def test_numeric_classes_sort_as_numbers(wells):
    df = wells.withColumn("grade", (F.floor(F.col("depth") / 40) * 5 + 5).cast("int"))
    trained = T.train_and_predict(df, "row", "grade", trees=5, max_depth=4)
    assert trained.task == "classification" and trained.classes == [5.0, 10.0, 15.0]


def test_split_orders_only_the_rows_at_its_limit(spark, monkeypatch):
    """The rows of smallest hash per group, as a window over the whole group gives them, from a small part of the rows."""
    seen = []
    whole = T.G.ordered

    def counted(df, *rest):
        seen.append(df.count())
        return whole(df, *rest)

    monkeypatch.setattr(T.G, "ordered", counted)
    group = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 7 < 3, "a").otherwise("b")
    df = spark.range(30_000).select(F.col("id").alias("row"), group.alias("kind"))
    for keys in ([], ["kind"]):
        got = {r["row"]: r["is_test"] for r in T.train_test_split(df, "row", 0.3, stratify=keys).collect()}
        draw = F.md5(F.concat_ws(":", F.lit(42), F.col("row")))
        place = Window.partitionBy(*keys).orderBy(draw, "row")
        share = F.row_number().over(place) <= F.ceil(F.count("*").over(Window.partitionBy(*keys)) * 0.3)
        assert got == {r["row"]: r["t"] for r in df.select("row", share.alias("t")).collect()}
    assert len(seen) == 2 and max(seen) < 300
    # rows of one id are told apart as well: the number of test rows is exact
    same = spark.createDataFrame([(1, None)] * 7 + [(None, "x")] * 5, "row int, kind string")
    found = T.train_test_split(same, "row", 0.3, stratify=["kind"]).groupBy("kind").agg(F.count_if("is_test").alias("n"))
    assert {r["kind"]: r["n"] for r in found.collect()} == {None: 3, "x": 2}
    assert T.train_test_split(same.where("false"), "row").isEmpty()


def test_bad_targets(wells):
    with pytest.raises(ValueError):
        T.choose_target(wells, "nope")
    with pytest.raises(ValueError):
        T.choose_target(wells.select("soil"))
    with pytest.raises(ValueError):
        T.train_test_split(wells, "row", 0.9)


def test_any_number_of_categories(spark):
    df = spark.range(3000).select(
        "id", F.col("id").cast("string").alias("residence"), F.lit("a").alias("well_name"), (F.col("id") % 7).alias("level")
    )
    features = T.fit_features(df, ["id", "level"])
    names = " ".join(features.names)
    assert "residence" in names and "well_name" not in names


def test_clusters_are_the_best_of_their_starts(spark):
    rng = np.random.default_rng(1)
    centers = [(10, 70), (10, 90), (30, 70), (30, 90)]
    rows = [(f"{i}-{j}", float(la + rng.normal(0, 0.2)), float(lo + rng.normal(0, 0.2)))
            for i, (la, lo) in enumerate(centers) for j in range(25)]
    df = spark.createDataFrame(rows, "sid string, lat double, lon double")
    points = geo.stations(df, "lat", "lon", None, "sid")
    found = geo.cluster_stations(points, k=4)
    groups = found.select(F.split("id", "-")[0].alias("g"), "cluster").distinct().collect()
    assert sorted((r["g"], r["cluster"]) for r in groups) == [("0", 0), ("1", 1), ("2", 2), ("3", 3)]
    stats = geo.cluster_stats(found).orderBy("cluster_id").collect()
    assert [r["station_count"] for r in stats] == [25] * 4
    few = geo.cluster_stations(points.limit(2), k=4)
    assert few.where("cluster is not null").isEmpty()


def test_similar_stations_errors(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, None)], "sid string, lat double, lon double, v double")
    with pytest.raises(ValueError, match="not found"):
        geo.similar_stations(df, "lat", "lon", "v", "sid", "b")
    assert geo.similar_stations(df, "lat", "lon", "v", "sid", "a").isEmpty()


def test_copies_at_one_place_weigh_in_the_heatmap(spark):
    rows = [(0.0, 0.0, 1.0)] * 3 + [(1.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "lat double, lon double, v double")
    got = {(r["i"], r["j"]): r["intensity"] for r in geo.idw_heatmap(df, "lat", "lon", "v", 2).collect()}
    assert got[0, 0] == pytest.approx(1.0, abs=1e-4) and got[1, 1] == pytest.approx(5.0, abs=1e-4)
    assert got[0, 1] == pytest.approx((3 * 1 + 5) / 4, rel=1e-3)


def test_zero_thresholds_have_no_relative_risk(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (None,)], "v double")
    got = [tuple(r)[1:] for r in L.with_alerts(df, "v", 0.0, 0.0).collect()]
    assert got == [("HIGH", None), ("LOW", None), ("NORMAL", 0.0)]


def test_stream_gives_the_batch_rows(spark, sf, wells):
    trained = T.train_and_predict(wells, "row", trees=5, max_depth=4)
    folder = scratch_path(spark, "in")
    wells.write.parquet(folder)
    stream = rowwise.read_folder(spark, folder, wells.schema)
    made = T.predict(trained.model, L.with_alerts(stream, "level", 9, 2)).select("row", "alert", "predicted")
    out = scratch_path(spark, "out")
    rowwise.write_folder(made, out, scratch_path(spark, "checkpoint")).awaitTermination()
    got = spark.read.parquet(out).orderBy("row").collect()
    want = T.predict(trained.model, L.with_alerts(wells, "level", 9, 2)).select("row", "alert", "predicted")
    assert got == want.orderBy("row").collect()


def test_auto_analysis(spark):
    n = 60
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({
        "Date": pd.date_range("2020-01-01", periods=n), "row": np.arange(n),
        "Latitude": rng.normal(25, 1, n), "Longitude": rng.normal(81, 1, n),
        "Water_Level_m": rng.normal(15, 1, n), "Rainfall_mm": rng.normal(800, 50, n),
    })
    df = spark.createDataFrame(pdf).withColumn("Date", F.col("Date").cast("timestamp_ntz"))
    options = {"tabular": {"trees": 5, "max_depth": 3}, "forecast": {"period": 7},
               "geospatial": {"cluster": True, "n_clusters": 3}}
    profile, found = analyze.auto_analyze(df, analyze.Roles("row"), options)
    assert profile.kind == "timeseries"
    assert sorted(found) == ["alerts", "anomaly", "forecast", "geospatial", "tabular"]
    assert found["forecast"]["forecast"].count() == 6
    assert found["geospatial"]["clusters"].count() == 3
    assert found["alerts"]["summary"].first()["total_records"] == n
    assert found["anomaly"]["statistics"].first()["total_samples"] == n
    with pytest.raises(ValueError):
        analyze.run_analysis(df, "other", analyze.Roles("row"))


def _stations(n, seed=0, places=10**6):
    """Stations with few places and values, so that scores tie, and a third of them at one place."""
    rng = np.random.default_rng(seed)
    lat, lon = rng.uniform(-85, 85, n).round(1), rng.uniform(-180, 180, n).round(1)
    lat[::3], lon[::3] = 10.0, 179.9
    value = rng.integers(0, 40, n) / 4.0
    value[::3] = 3.0
    return [(f"s{i:05d}", float(a), float(o), float(v)) for i, (a, o, v) in enumerate(zip(lat, lon, value, strict=True))]


STATION = "sid string, lat double, lon double, v double"


def _most_alike(rows, target, k):
    from math import asin, cos, radians, sin, sqrt

    def score(a, b):
        h = sin(radians(b[1] - a[1]) / 2) ** 2 + cos(radians(a[1])) * cos(radians(b[1])) * sin(radians(b[2] - a[2]) / 2) ** 2
        km = 2 * 6371 * asin(sqrt(min(1, h)))
        return 0.3 * max(0, 1 - km / 1000) + 0.7 / (1 + abs(a[3] - b[3]))

    found = sorted((-round(score(target, r), 9), r[0]) for r in rows if r[0] != target[0])
    return [-s for s, _ in found[:k]]


@pytest.mark.parametrize(("leaf_rows", "part_rows", "ask_rows"), [(1024, 4096, 8192), (16, 24, 40)])
def test_every_station_finds_its_most_alike(spark, monkeypatch, leaf_rows, part_rows, ask_rows):
    from borehole.operators import similarity as S

    monkeypatch.setattr(S, "PART_ROWS", part_rows)
    monkeypatch.setattr(S, "ASK_ROWS", ask_rows)
    rows = _stations(700)
    df = spark.createDataFrame(rows + [("gone", None, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], STATION)
    points = df.toDF("station_id", "lat", "lon", "value").na.drop()
    search = S.Search(points, leaf_rows)
    got = {}
    for r in search.best(S.targets_of(points), 5).orderBy("target_id", "rank").collect():
        got.setdefault(r.target_id, []).append((round(r.combined_score, 9), r.station_id))
    assert set(got) == {r[0] for r in rows}
    for r in rows:
        assert [s for s, _ in got[r[0]]] == pytest.approx(_most_alike(rows, r, 5), abs=2e-9)
    # all stations at the hot place are alike: the smallest ids win
    assert [i for _, i in got["s00003"]] == ["s00000", "s00006", "s00009", "s00012", "s00015"]


def test_similarity_over_many_targets(spark):
    rows = _stations(1200, seed=4)
    df = spark.createDataFrame(rows + [("gone", None, 1.0, None)], STATION)
    few = geo.similar_stations(df, "lat", "lon", "v", "sid", ["s00001", "s00008"], k=3)
    listed = geo.similar_stations(df, "lat", "lon", "v", "sid", [r[0] for r in rows[:1100]], k=3)
    every = geo.similar_stations(df, "lat", "lon", "v", "sid", k=3)
    asked = geo.similar_stations(df, "lat", "lon", "v", "sid", spark.createDataFrame([("s00001",), ("s00008",), ("none",)], "x string"), k=3)

    def of(found):
        return sorted((r.target_id, r["rank"], round(r.combined_score, 9)) for r in found.where("target_id in ('s00001', 's00008')").collect())

    assert of(few) == of(listed) == of(every) == of(asked) and len(of(few)) == 6
    assert listed.select("target_id").distinct().count() == 1100 and asked.count() == 6
    with pytest.raises(ValueError, match="not found.*nowhere"):
        geo.similar_stations(df, "lat", "lon", "v", "sid", [r[0] for r in rows] + ["nowhere"])
    alone = geo.similar_stations(df.where("sid = 's00001'"), "lat", "lon", "v", "sid")
    assert alone.isEmpty() and geo.similar_stations(df.where("false"), "lat", "lon", "v", "sid").isEmpty()


def test_compared_pairs_grow_below_the_square(spark):
    from borehole.operators import similarity as S

    def compared(n):
        rng = np.random.default_rng(n)
        rows = [(i, float(a), float(o), float(v)) for i, (a, o, v) in enumerate(zip(
            rng.uniform(8, 37, n), rng.uniform(68, 97, n), rng.uniform(0, 200, n), strict=True))]
        points = spark.createDataFrame(rows, "station_id long, lat double, lon double, value double")
        return S.Search(points, 64).compared(S.targets_of(points), 5)

    small, large = compared(2000), compared(16_000)
    assert large < 0.2 * 16_000**2
    assert large < 8**1.8 * small


@pytest.mark.parametrize(("width", "share"), [(200, 0.3), (1e4, 1.0), (1e9, 1.0), (0, 1.0)])
def test_cuts_follow_what_tells_stations_apart(width, share):
    """Rows asked, against a tree of values and places in turn: fewer where values lie close together, never more."""
    from borehole.operators import similarity as S

    rng = np.random.default_rng(7)
    n = 8000
    x = S._space(rng.uniform(8, 37, n), rng.uniform(68, 97, n), rng.uniform(0, 1, n) * width)
    probes = x[:200]
    least = np.array([np.partition(S._score(np.abs(x - p)), -6)[-6] for p in probes])
    turns, found = S.Tree(x, 64), S.planned(x, 64)
    asked = S._asked(found, x, probes, least)
    assert asked <= share * S._asked(turns, x, probes, least) and asked < 0.2 * n * len(probes)
    assert sorted(np.unique(found.assign(x))) == list(range(found.leaves))


@pytest.mark.parametrize("spread", [0, 1e-3, 3, 1e7])
def test_ceilings_lie_just_above_the_scores(spread):
    from borehole.operators import similarity as S

    rng = np.random.default_rng(3)
    n, k = 400, 4
    near = rng.uniform(0, 1, n) < 0.5
    lat, lon = np.where(near, 20, rng.uniform(-90, 90, n)), np.where(near, rng.choice([179.999, -179.999], n), rng.uniform(-180, 180, n))
    lat = lat + np.where(near, rng.choice([0, 1e-9, 0.01, 5], n), 0)
    rows = pd.DataFrame({"station_id": np.arange(n), "lat": lat, "lon": lon, "value": rng.uniform(0, 1, n) * spread})
    asked = rows.set_axis(["target_id", "target_lat", "target_lon", "target_value"], axis=1).assign(least=-np.inf)
    whole = S.best_pairs(asked, rows, n).pivot(index="target_id", columns="station_id", values="combined_score").to_numpy()
    x = S._space(*(rows[c].to_numpy(float) for c in ("lat", "lon", "value")))
    over = (S._ceilings(x, x) - whole)[~np.eye(n, dtype=bool)]
    assert 0 <= over.min() and over.max() < S.CHORD_GAP
    few = S.best_pairs(asked, rows, k)
    np.fill_diagonal(whole, -np.inf)
    for i, best in few.groupby("target_id"):
        assert best["station_id"].tolist() == np.lexsort((np.arange(n), -whole[int(i)]))[:k].tolist()
