"""Anomalies among rows of numbers: isolation forest or local outlier factor."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borehole.functions import parsing as P
from borehole.operators import clean as C
from borehole.operators import grouping as G
from borehole.operators import isolation, neighbours
from borehole.session import materialise
from borehole.sources.layouts import Datasets

METHODS = {
    "isolation_forest": isolation.isolation_scores,
    "local_outlier_factor": neighbours.lof_scores,
}
LOWEST, HIGHEST, FALLBACK = 0.01, 0.5, 0.1


def check_contamination(contamination: float, clamp: bool = False) -> float:
    if LOWEST <= contamination <= HIGHEST:
        return contamination
    if clamp:
        return FALLBACK
    raise ValueError(f"contamination must be from {LOWEST} to {HIGHEST}")


def choose_features(
    df: DataFrame, features: Sequence[str] | None = None, leave_out: Sequence[str] = ()
) -> list[str]:
    """The given columns, which must exist, or all numeric ones."""
    if features is None:
        found = [c for c in P.numeric_columns(df) if c not in leave_out]
        if not found:
            raise ValueError("no numeric features found")
        return found
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"features not found: {missing}")
    return list(features)


def prepared_features(
    df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), scale: bool = True
) -> DataFrame:
    """Medians for nulls, then zero mean and unit deviation. All-null features become 0."""
    numbers = df.select(
        *[P.try_number(df, c).alias(c) if c in features else F.col(c) for c in df.columns]
    )
    filled = C.impute_median(numbers, features, keys)
    if scale:
        filled = C.standardize(filled, features, keys)
    return filled.na.fill(0.0, subset=list(features))


def flags_and_scores(
    raw: DataFrame, contamination: float, keys: Sequence[str] = ()
) -> DataFrame:
    """``is_anomaly`` strictly below the ``contamination`` quantile of ``raw``;
    ``anomaly_score`` from 0 to 1, 1 for the most anomalous, 0.5 when all are equal."""
    limits = raw.groupBy(*keys).agg(F.min("raw").alias("_low"), F.max("raw").alias("_high"))
    cut = G.exact_quantiles(raw, ["raw"], [contamination], keys)
    spread = F.col("_high") - F.col("_low")
    score = F.coalesce(F.try_divide(F.col("_high") - F.col("raw"), spread), F.lit(0.5))
    return (
        G.attach_stats(raw, G.attach(limits, cut, keys), keys)
        .withColumn("anomaly_score", score)
        .withColumn("is_anomaly", F.col("raw") < F.col("raw_q0"))
        .drop("_low", "_high", "raw_q0")
    )


def detect(
    df: DataFrame,
    id_col: str,
    features: Sequence[str] | None = None,
    contamination: float = 0.1,
    method: str = "isolation_forest",
    scale: bool = True,
    keys: Sequence[str] = (),
    clamp: bool = False,
) -> DataFrame:
    """``keys, id, features`` as given, with ``raw``, ``anomaly_score`` and ``is_anomaly``.

    Everything is fitted within each group of ``keys``. The raw scores are written once,
    because ranks, flags and reports each read them again.
    """
    contamination = check_contamination(contamination, clamp)
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    features = choose_features(df, features, [id_col, *keys])
    # read by the medians, the scaling, the fit and, row by row in Python, a forest's scoring
    store = G.spread if method == "isolation_forest" else materialise
    rows = store(df.select(*keys, id_col, *features), "features")
    inner = {c: f"x{i}" for i, c in enumerate(features)}
    both = rows.select("*", *[P.try_number(rows, c).alias(x) for c, x in inner.items()])
    ready = prepared_features(both, list(inner.values()), keys, scale)
    scored = METHODS[method](ready, list(inner.values()), id_col, keys).drop(*inner.values())
    return flags_and_scores(materialise(scored, "scores"), contamination, keys)


def anomaly_statistics(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, rate, and the mean score of either side (0 for an empty side)."""
    flag, score = F.col("is_anomaly"), F.col("anomaly_score")
    found = F.count_if(flag)
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_samples"),
        found.alias("anomalies_detected"),
        F.try_divide(found, F.count(F.lit(1))).alias("anomaly_rate"),
        F.coalesce(F.avg(F.when(flag, score)), F.lit(0.0)).alias("mean_anomaly_score"),
        F.coalesce(F.avg(F.when(~flag, score)), F.lit(0.0)).alias("mean_normal_score"),
    )


def anomaly_counters(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Anomalies, their percentage, and the mean score of all rows, for display."""
    return scored.groupBy(*keys).agg(
        F.count_if("is_anomaly").alias("anomalies_detected"),
        F.try_divide(F.lit(100.0) * F.count_if("is_anomaly"), F.count(F.lit(1))).alias(
            "anomaly_percentage"
        ),
        F.avg("anomaly_score").alias("mean_score"),
    )


def feature_analysis(
    scored: DataFrame, features: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Per feature: mean on either side and their distance in deviations of the normal rows."""
    aggs = []
    for i, c in enumerate(features):
        value, flag = F.col(c).cast("double"), F.col("is_anomaly")
        aggs += [
            F.avg(F.when(flag, value)).alias(f"a{i}"),
            F.avg(F.when(~flag, value)).alias(f"n{i}"),
            F.stddev_samp(F.when(~flag, value)).alias(f"s{i}"),
        ]
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"a{i}").alias("anomaly_mean"),
            F.col(f"n{i}").alias("normal_mean"),
            F.coalesce(
                F.try_divide(F.abs(F.col(f"a{i}") - F.col(f"n{i}")), F.col(f"s{i}")), F.lit(0.0)
            ).alias("difference_ratio"),
        )
        for i, c in enumerate(features)
    ]
    return (
        scored.groupBy(*keys)
        .agg(*aggs)
        .select(*keys, F.inline(F.array(*rows)))
        .where(F.col("anomaly_mean").isNotNull() & F.col("normal_mean").isNotNull())
    )


def top_anomalies(
    scored: DataFrame, id_col: str, n: int = 10, keys: Sequence[str] = ()
) -> DataFrame:
    """Flagged rows by falling score, ties by id, with their feature values."""
    order = [F.col("anomaly_score").desc(), F.col(id_col)]
    return G.top_per_group(scored.where("is_anomaly"), keys, order, n)


# --- many datasets ----------------------------------------------------------------------


def batch_anomalies(
    df: DataFrame,
    dataset_col: str,
    id_col: str,
    features: Sequence[str] | None = None,
    contamination: float = 0.1,
    method: str = "isolation_forest",
    datasets: Sequence[str] | None = None,
    top: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """Detection in each dataset of one table: (results, top anomalies).

    A dataset that cannot be analysed has ``success = false`` and its ``error``; the others
    are not affected. ``datasets`` names the wanted ones, all by default.
    """
    features = choose_features(df, features, [id_col, dataset_col])
    keys = [dataset_col]
    has_data = [F.count(P.try_number(df, c)) > 0 for c in features]
    any_data = has_data[0]
    for one in has_data[1:]:
        any_data = any_data | one
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), any_data.alias("_any"))
    error = F.when(~F.col("_any"), F.lit("no numeric features found"))
    if method == "local_outlier_factor":
        few = neighbours.neighbour_count(F.col("_rows")) < 2
        error = error.when(few, F.lit("not enough samples for a local outlier factor"))
    state = sizes.select(*keys, error.alias("error"))
    if datasets is not None:
        id_type = df.schema[dataset_col].dataType
        wanted = df.sparkSession.createDataFrame([(d,) for d in datasets], "wanted string")
        wanted = wanted.select(F.col("wanted").cast(id_type).alias(dataset_col))
        known = state.withColumn("_known", F.lit(True))
        state = G.attach(wanted, known, keys).select(
            *keys,
            F.when(F.col("_known").isNull(), F.lit("dataset not found"))
            .otherwise(F.col("error"))
            .alias("error"),
        )
    state = materialise(state, "datasets")
    good = state.where(F.col("error").isNull()).select(*keys)
    if good.isEmpty():
        scored = df.select(*keys, id_col, *features).where(F.lit(False)).withColumns(
            {"raw": F.lit(0.0), "anomaly_score": F.lit(0.0), "is_anomaly": F.lit(False)}
        )
    else:
        usable = df.alias("l").join(good.alias("r"), G.same_keys("l", "r", keys), "left_semi")
        scored = detect(usable, id_col, features, contamination, method, keys=keys)
    stats = anomaly_statistics(scored, keys).select(*keys, "anomalies_detected", "anomaly_rate")
    results = G.attach(
        state.withColumn("success", F.col("error").isNull()).select(*keys, "success", "error"),
        stats,
        keys,
    )
    return results, top_anomalies(scored, id_col, top, keys)


def batch_layouts(
    datasets: Datasets,
    id_col: str,
    features: DataFrame | None = None,
    contamination: float = 0.1,
    method: str = "isolation_forest",
    wanted: Sequence[str] | None = None,
    top: int = 5,
    id_type: str = "string",
) -> tuple[DataFrame, DataFrame]:
    """:func:`batch_anomalies` over datasets of different layouts, each with features of its own.

    ``features`` has ``dataset_id, features``; by default a dataset's numeric columns. Datasets with equal feature
    lists are analysed together, so there is one plan per list. Ids are read as ``id_type``, whose order breaks ties. Results are ``dataset_id, success, error,
    anomalies_detected, anomaly_rate, features``; top anomalies have ``dataset_id``, the id, ``anomaly_score, is_anomaly,
    rank`` and the features' ``values`` in a map. A dataset without rows, features or ``id_col`` fails alone.
    """
    rows = datasets.rows
    spark = rows.sparkSession
    lists = materialise(features or datasets.features([id_col]), "features")
    has_id = rows.groupBy("dataset_id").agg(F.bool_or(F.map_contains_key("cells", id_col)).alias("_id"))
    state = datasets.known.select("dataset_id").distinct().join(lists, "dataset_id", "left").join(has_id, "dataset_id", "left")
    error = (
        F.when(F.coalesce(F.size("features"), F.lit(0)) == 0, F.lit("no numeric features found"))
        .when(~F.coalesce("_id", F.lit(False)), F.lit(f"id column not found: {id_col}"))
    )
    state = state.select("dataset_id", "features", error.alias("error"))
    if wanted is not None:
        asked = spark.createDataFrame([(d,) for d in wanted], "dataset_id string").distinct()
        known = state.withColumn("_known", F.lit(True))
        missing = F.when(F.col("_known").isNull(), F.lit("dataset not found")).otherwise(F.col("error"))
        state = asked.join(known, "dataset_id", "left").select("dataset_id", "features", missing.alias("error"))
    state = materialise(state, "datasets")
    good = state.where("error is null")
    # one row per distinct list of features
    plans = [tuple(r["features"]) for r in good.select("features").distinct().orderBy("features").collect()]
    counts = ["anomalies_detected", "anomaly_rate"]
    results = [state.where("error is not null").select(
        "dataset_id", F.lit(False).alias("success"), "error", F.lit(None).cast("long").alias(counts[0]),
        F.lit(None).cast("double").alias(counts[1]),
    )]
    tops = []
    for names in plans:
        mine = good.where(F.col("features") == F.array(*[F.lit(c) for c in names])).select("dataset_id")
        inner = {c: f"f{i}" for i, c in enumerate(names)}
        df = rows.join(mine, "dataset_id", "left_semi").select(
            "dataset_id", F.col("cells")[id_col].try_cast(id_type).alias("_id"), *[F.col("cells")[c].alias(x) for c, x in inner.items()]
        )
        found, best = batch_anomalies(df, "dataset_id", "_id", list(inner.values()), contamination, method, None, top)
        results.append(found.select("dataset_id", "success", "error", *counts))
        values = F.map_from_arrays(
            F.array(*[F.lit(c) for c in names]), F.array(*[P.try_number(best, x) for x in inner.values()])
        )
        tops.append(best.select("dataset_id", F.col("_id").alias(id_col), "anomaly_score", "is_anomaly", "rank", values.alias("values")))
    result = reduce(DataFrame.unionByName, results).join(state.select("dataset_id", "features"), "dataset_id")
    empty = f"dataset_id string, `{id_col}` {id_type}, anomaly_score double, is_anomaly boolean, rank int, values map<string,double>"
    return result, reduce(DataFrame.unionByName, tops) if tops else spark.createDataFrame([], empty)


def batch_summary(results: DataFrame) -> DataFrame:
    """Datasets, successes, failures, and all anomalies found."""
    return results.agg(
        F.count(F.lit(1)).alias("total_datasets"),
        F.count_if("success").alias("successful_analyses"),
        F.count_if(~F.col("success")).alias("failed_analyses"),
        F.coalesce(F.sum("anomalies_detected"), F.lit(0)).alias("total_anomalies_detected"),
    )
