"""Outlier factor against brute force, isolation forest by its properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from borehole.operators import anomaly as A
from borehole.operators import isolation, neighbours


def brute_lof(x, k):
    """Minus the outlier factor of each row; ties by the place, then the row."""
    n = len(x)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), neighbours.DIGITS)
    place = np.array([np.flatnonzero((x == row).all(1))[0] for row in x])
    near = np.array([
        [j for j in sorted(range(n), key=lambda j: (d[i, j], place[j], j)) if j != i][:k]
        for i in range(n)
    ])
    kdist = np.array([d[i, near[i, -1]] for i in range(n)])
    reach = np.array([np.maximum(kdist[near[i]], d[i, near[i]]).mean() for i in range(n)])
    lrd = 1 / (reach + 1e-10)
    return -lrd[near].mean(1) / lrd


def points(n=400, dims=2, seed=2):
    """Two clouds, a third of all rows at one place, and a few far out."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x[: n // 3] = 0.5
    x[n // 3 : n // 2] += 8
    x[-4:] *= 30
    return x


def frame(spark, x, key=None):
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(x.shape[1])])
    pdf["id"] = np.arange(len(x))
    if key is not None:
        pdf["k"] = key
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("leaf_rows", [20, 2000])
@pytest.mark.parametrize("dims", [1, 3])
def test_lof_equals_brute_force(spark, leaf_rows, dims):
    x = points(dims=dims)
    got = neighbours.lof_scores(frame(spark, x), [f"f{i}" for i in range(dims)], "id", leaf_rows=leaf_rows)
    got = got.orderBy("id").toPandas()["raw"].to_numpy()
    np.testing.assert_allclose(got, brute_lof(x, 20), rtol=1e-6)


def test_lof_by_group_equals_brute_force(spark):
    big, small = points(300, seed=3), points(40, seed=4)
    x = np.vstack([big, small])
    key = np.array(["big"] * 300 + ["small"] * 40)
    got = neighbours.lof_scores(frame(spark, x, key), ["f0", "f1"], "id", ["k"], leaf_rows=25)
    got = got.orderBy("id").toPandas()["raw"].to_numpy()
    np.testing.assert_allclose(got[:300], brute_lof(big, 15), rtol=1e-6)
    np.testing.assert_allclose(got[300:], brute_lof(small, 5), rtol=1e-6)


def test_many_questions_to_one_leaf_are_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 5)
    x = points(200)
    got = neighbours.lof_scores(frame(spark, x), ["f0", "f1"], "id", leaf_rows=20)
    got = got.orderBy("id").toPandas()["raw"].to_numpy()
    np.testing.assert_allclose(got, brute_lof(x, 10), rtol=1e-6)


def test_lof_needs_enough_rows(spark):
    with pytest.raises(ValueError):
        neighbours.lof_scores(frame(spark, np.zeros((2, 1))), ["f0"], "id")


def planted(spark, n=500):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3))
    x[::20] += 6
    return frame(spark, x)


def test_planted_outliers_are_found(spark):
    df = planted(spark)
    scored = A.detect(df, "id", contamination=0.05)
    pdf = scored.toPandas()
    flagged = set(pdf[pdf["is_anomaly"]]["id"])
    assert len(flagged & set(range(0, 500, 20))) >= 23
    assert pdf["anomaly_score"].between(0, 1).all()
    assert pdf.loc[pdf["raw"].idxmin(), "anomaly_score"] == 1.0
    stats = A.anomaly_statistics(scored).first()
    assert stats["anomalies_detected"] == len(flagged) and stats["total_samples"] == 500
    assert stats["mean_anomaly_score"] > stats["mean_normal_score"]


def test_forest_does_not_depend_on_partitioning(spark):
    df = planted(spark, 300)
    features = ["f0", "f1", "f2"]
    one = isolation.isolation_scores(df.coalesce(1), features, "id").orderBy("id").toPandas()
    many = isolation.isolation_scores(df.repartition(13), features, "id").orderBy("id").toPandas()
    assert (one["raw"] == many["raw"]).all()


def test_large_groups_are_scored_in_parts(spark, monkeypatch):
    df = planted(spark, 300).withColumn("k", F.when(F.col("id") < 200, "a").otherwise("b"))
    features = ["f0", "f1", "f2"]
    whole = isolation.isolation_scores(df, features, "id", ["k"]).orderBy("id").toPandas()
    monkeypatch.setattr(isolation, "SCORE_ROWS", 16)
    parts = isolation.isolation_scores(df, features, "id", ["k"]).orderBy("id").toPandas()
    assert len(parts) == 300 and (whole["raw"] == parts["raw"]).all()
    alone = isolation.isolation_scores(df.where("k = 'a'"), features, "id").orderBy("id").toPandas()
    np.testing.assert_allclose(alone["raw"], whole["raw"][:200])


def test_trees_see_the_sample_size(spark):
    df = spark.range(5000).select("id", F.rand(1).alias("v"))
    trees = isolation.build_forest(df, ["v"], "id").toPandas()
    assert len(trees) == 100 and (trees["sampled"] == 256).all()


def test_equal_rows_score_one_half(spark):
    df = spark.range(50).select("id", F.lit(1.0).alias("v"))
    pdf = A.detect(df, "id").toPandas()
    assert (pdf["anomaly_score"] == 0.5).all() and not pdf["is_anomaly"].any()


def test_contamination_bounds(spark):
    with pytest.raises(ValueError):
        A.check_contamination(0.9)
    assert A.check_contamination(0.9, clamp=True) == 0.1
    with pytest.raises(ValueError):
        A.choose_features(spark.range(1), ["nope"])


def test_nulls_and_empty_features(spark):
    df = spark.range(60).select(
        "id",
        F.when(F.col("id") % 7 != 0, F.col("id").cast("double")).alias("a"),
        F.lit(None).cast("double").alias("b"),
    )
    pdf = A.detect(df, "id", method="local_outlier_factor").toPandas()
    assert len(pdf) == 60 and pdf["raw"].notna().all()


def test_batch_keeps_failures_apart(spark):
    df = planted(spark, 100).withColumn(
        "d", F.when(F.col("id") < 2, "tiny").when(F.col("id") < 50, "a").otherwise("b")
    )
    results, top = A.batch_anomalies(
        df, "d", "id", method="local_outlier_factor", datasets=["a", "b", "tiny", "none"]
    )
    got = {r["d"]: (r["success"], r["error"]) for r in results.collect()}
    assert got["a"] == (True, None) and got["b"] == (True, None)
    assert not got["tiny"][0] and "not enough" in got["tiny"][1]
    assert got["none"] == (False, "dataset not found")
    assert {r["d"] for r in top.collect()} <= {"a", "b"}
    assert top.groupBy("d").count().agg(F.max("count")).first()[0] <= 5
    assert A.batch_summary(results).first()["failed_analyses"] == 2


@pytest.mark.parametrize("method", ["local_outlier_factor", "isolation_forest"])
def test_batch_where_all_fail(spark, method):
    df = planted(spark, 100).withColumn("d", F.lit("a")).where("id < 2")
    results, top = A.batch_anomalies(df, "d", "id", method=method, datasets=["none"])
    assert [tuple(r) for r in results.select("d", "success", "error").collect()] == [("none", False, "dataset not found")]
    assert top.count() == 0 and A.batch_summary(results).first()["failed_analyses"] == 1


def _write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


def test_files_of_different_layouts(spark, tmp_path):
    from borehole.sources.layouts import read_datasets

    number = "\n".join(f"{i},{i % 7},{i * 0.5}" for i in range(60))
    _write(tmp_path, "a.csv", "id,Water Level (m),depth\n" + number + "\n,,\n99,1000,-\n")
    _write(tmp_path, "b.csv", "\n  \nid,Water Level (m),depth\n" + number.replace("1", "2") + "\n")  # blank lines first
    _write(tmp_path, "c.csv", "depth;note;id\n" + "\n".join(f"{i % 5}.5;word {i};c{i}" for i in range(40)) + "\n500;far;cx\n")
    _write(tmp_path, "d.csv", "id|remark\n1|dry\n2|wet\n")
    _write(tmp_path, "e.csv", "id,Water Level (m),depth\n")  # only a header
    _write(tmp_path, "f.csv", "station,depth\ns1,1\ns2,2\n")  # no id column
    _write(tmp_path, "g.csv", "")
    data = read_datasets(spark, str(tmp_path))
    assert sorted(r.dataset_id for r in data.known.collect()) == list("abcdef")
    assert len(data.layouts) == 4  # a, b and e share one
    assert {r.dataset_id: r["count"] for r in data.rows.groupBy("dataset_id").count().collect()} == {
        "a": 61, "b": 60, "c": 41, "d": 2, "f": 2}
    features = {r.dataset_id: r.features for r in data.features(["id"]).collect()}
    both = ["Water_Level_m", "depth"]
    assert features == {"a": both, "b": both, "c": ["depth"], "d": [], "e": [], "f": ["depth"]}
    assert data.table(["depth"]).where("dataset_id = 'a' and depth is null").count() == 0

    results, top = A.batch_layouts(data, "id", wanted=[*"abcdef", "none"], method="isolation_forest", contamination=0.05)
    by = {r.dataset_id: r for r in results.collect()}
    assert {d for d, r in by.items() if r.success} == {"a", "b", "c"}
    assert by["d"].error == by["e"].error == "no numeric features found"
    assert by["f"].error == "id column not found: id" and by["none"].error == "dataset not found"
    assert by["a"].features == both and by["c"].features == ["depth"] and by["a"].anomalies_detected > 0
    best = {r.dataset_id: r for r in top.where("rank = 1").collect()}
    assert best["a"]["id"] == "99" and best["a"]["values"]["Water_Level_m"] == 1000.0
    assert set(best["c"]["values"]) == {"depth"}
    assert A.batch_summary(results).first().asDict() == {
        "total_datasets": 7, "successful_analyses": 3, "failed_analyses": 4,
        "total_anomalies_detected": sum(r.anomalies_detected or 0 for r in by.values())}


def test_feature_lists_per_dataset(spark, tmp_path):
    from borehole.sources.layouts import read_datasets

    for name, shift in (("a", 0), ("b", 3)):
        _write(tmp_path, f"{name}.csv", "id,x,y\n" + "\n".join(f"{i},{i % 11},{(i + shift) % 13}" for i in range(50)))
    data = read_datasets(spark, str(tmp_path))
    lists = spark.createDataFrame([("a", ["y"]), ("b", ["x", "y"])], "dataset_id string, features array<string>")
    results, top = A.batch_layouts(data, "id", lists, method="local_outlier_factor", id_type="bigint")
    assert {r.dataset_id: r.features for r in results.where("success").collect()} == {"a": ["y"], "b": ["x", "y"]}
    assert top.schema["id"].dataType.simpleString() == "bigint"
    nothing, none = A.batch_layouts(data, "id", lists, wanted=["z"])
    assert nothing.first().error == "dataset not found" and none.count() == 0
