"""Random forests on tabular data: target, task, features, split, fit, metrics, prediction."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import (
    IndexToString,
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borehole.functions import parsing as P
from borehole.operators import clean as C
from borehole.operators import forest as forests
from borehole.operators import grouping as G
from borehole.session import materialise

#: Partitions that a forest's rows are dealt to at least, and rows of one.
LEAST_PARTS, PART_ROWS = 16, 200_000
TREES = 100
#: Nodes of a regression forest that a pass of MLlib splits, bytes of a feature's statistics in a node, and MLlib's own limit in MB.
PASS_NODES, FEATURE_BYTES, MOST_MB = 640, 32 * 4 * 8, 256
CELL_DIGITS = 3  # of a hash; a split orders one row in 16 ** 3
CLASS_LIMIT = 10  # fewer distinct targets make a classification
REGRESSION, CLASSIFICATION = "regression", "classification"


def choose_target(df: DataFrame, target: str | None = None) -> str:
    """The given column, or the last numeric one."""
    if target is None:
        numeric = P.numeric_columns(df)
        if not numeric:
            raise ValueError("no numeric columns found for target")
        return numeric[-1]
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    return target


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is known."""
    return P.clean_nans(df).where(F.col(target).isNotNull())


def choose_task(df: DataFrame, target: str, task: str = "auto") -> str:
    """``auto``: classification for a text target or one of fewer than ten distinct values."""
    if task in (REGRESSION, CLASSIFICATION):
        return task
    if task != "auto":
        raise ValueError(f"unknown task: {task}")
    if P.is_text(df.schema[target].dataType):
        return CLASSIFICATION
    distinct = df.where(F.col(target).isNotNull()).select(target).distinct()
    return CLASSIFICATION if distinct.limit(CLASS_LIMIT).count() < CLASS_LIMIT else REGRESSION


def _check_test_size(test_size: float) -> None:
    if not 0.1 <= test_size <= 0.5:
        raise ValueError("test_size must be from 0.1 to 0.5")


def train_test_split(
    df: DataFrame,
    id_col: str,
    test_size: float = 0.2,
    seed: int = 42,
    stratify: Sequence[str] = (),
) -> DataFrame:
    """Add ``is_test``: the ``ceil(n * test_size)`` rows of smallest hash, per ``stratify`` group.

    The hash of (seed, id) gives every row its place whatever the partitioning. Rows are counted by the first digits of
    their hash; these settle all rows but those of the one cell per group that the limit falls into, and only that cell
    is ordered.
    """
    _check_test_size(test_size)
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col)))
    cell = F.conv(F.substring(draw, 1, CELL_DIGITS), 16, 10).cast("int")
    drawn = materialise(df.withColumn("_cell", cell), "drawn")
    counts = drawn.groupBy(*stratify, "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*stratify)
    upto = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = counts.select(
        *stratify, F.col("_cell").alias("_edge"), (F.sum("_rows").over(upto) - F.col("_rows")).alias("_before"), "_rows",
        F.ceil(F.sum("_rows").over(whole) * test_size).alias("_wanted"),
    )
    edges = edges.where(F.col("_wanted").between(F.col("_before") + 1, F.col("_before") + F.col("_rows")))
    edges = edges.select(*stratify, "_edge", (F.col("_wanted") - F.col("_before")).alias("_left"))
    placed = G.attach_stats(drawn, edges, stratify)
    settled = placed.where(F.col("_cell") != F.col("_edge")).withColumn("is_test", F.col("_cell") < F.col("_edge"))
    close = materialise(placed.where(F.col("_cell") == F.col("_edge")).withColumn("_draw", draw), "edge")
    rows = G.ordered(close, stratify, ["_draw", id_col])
    ranked = rows.core(rows.df.withColumn("is_test", F.col("_pos") < F.col("_left"))).drop("_pos", "_n", "_draw")
    return settled.unionByName(ranked).drop("_cell", "_edge", "_left")


# --- features ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Features:
    """Fitted feature stages and the names of the vector they assemble in ``features``."""

    stages: list[Transformer]
    names: list[str]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fit_features(
    df: DataFrame, leave_out: Sequence[str] = (), include_ids: bool = False
) -> Features:
    """Numbers pass (nulls as the exact median); texts become one column per category but the
    alphabetically first, zeros for categories not seen; vectors are sparse, so a text may have
    any number of categories. Dates and booleans are not used, nor are texts with a whole part of
    their name that says identifier (``station_name``, not ``residence``) unless ``include_ids``.
    """
    numbers = [c for c in P.numeric_columns(df) if c not in leave_out]
    words = set(C.IDENTIFIER_WORDS)
    ids = set() if include_ids else {c for c in df.columns if words & set(re.split("[^a-z0-9]+", c.lower()))}
    texts = [c for c in P.text_columns(df) if c not in leave_out and c not in ids]
    row = G.exact_quantiles(df, numbers, [0.5]).first() if numbers else None
    parts = []
    for c in numbers:
        middle = row[f"{c}_q0"] if row[f"{c}_q0"] is not None else 0.0
        parts.append(f"coalesce(cast({_quoted(c)} as double), {middle!r}D) as {_quoted('num_' + c)}")
    parts += [f"coalesce({_quoted(c)}, 'nan') as {_quoted('cat_' + c)}" for c in texts]
    if not parts:
        raise ValueError("no usable features found")
    prepare = SQLTransformer(statement=f"select *, {', '.join(parts)} from __THIS__")
    stages: list[Transformer] = [prepare]
    inputs, names = [f"num_{c}" for c in numbers], list(numbers)
    if texts:
        indexer = StringIndexer(
            inputCols=[f"cat_{c}" for c in texts],
            outputCols=[f"index_{c}" for c in texts],
            stringOrderType="alphabetAsc",
            handleInvalid="keep",
        ).fit(prepare.transform(df))
        # the slot for categories not seen is the last one, which the encoder drops
        encoder = OneHotEncoder(
            inputCols=[f"index_{c}" for c in texts], outputCols=[f"hot_{c}" for c in texts]
        ).fit(indexer.transform(prepare.transform(df.limit(1))))
        stages += [indexer, encoder]
        for c, labels in zip(texts, indexer.labelsArray):
            if len(labels) < 2:
                continue
            rest = list(range(1, len(labels)))
            stages.append(VectorSlicer(inputCol=f"hot_{c}", outputCol=f"rest_{c}", indices=rest))
            inputs.append(f"rest_{c}")
            names += [f"{c}_{label}" for label in labels[1:]]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return Features(stages, names)


# --- fitting ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Trained:
    """A fitted model with what was measured on its test rows."""

    model: PipelineModel
    task: str
    target: str
    feature_names: list[str]
    classes: list
    predictions: DataFrame  # test rows: id, target, prediction
    metrics: DataFrame
    n_samples: int


def dealt(df: DataFrame, id_col: str) -> DataFrame:
    """Rows in partitions that follow from the data alone: their number from the rows, their content from the ids.

    A forest draws its bootstrap by partition and row, so this keeps the model the same on any number of cores.
    """
    parts = max(LEAST_PARTS, -(-df.count() // PART_ROWS))
    return df.repartition(parts, F.xxhash64(id_col)).sortWithinPartitions(id_col)


def pass_memory(features: int) -> int:
    """MB for the statistics of one pass of MLlib: few nodes at a time stay in the processor's cache, and more passes cost less than that.

    Wide features keep MLlib's limit. Passes of :mod:`borehole.operators.forest` have their own.
    """
    return min(MOST_MB, -(-features * PASS_NODES * FEATURE_BYTES // 2**20))


def fit_forest(
    train: DataFrame, target: str, task: str, features: Features, seed: int = 42,
    max_depth: int = 10, trees: int = TREES, id_col: str | None = None,
) -> tuple[PipelineModel, list]:
    """The pipeline from raw columns to ``predicted``, and the sorted classes.

    With ``id_col`` (unique) the rows are :func:`dealt` first. A regression looks at all features of a node, so its passes may
    be of any size; a classification draws them by the order of the nodes, which the size of a pass would change.
    """
    prepare = PipelineModel(features.stages).transform
    rows, few = prepare(train if id_col is None else dealt(train, id_col)), prepare(train.limit(2))
    common = dict(
        featuresCol="features", labelCol="_label", numTrees=trees, maxDepth=max_depth, seed=seed
    )
    if task == REGRESSION:
        label = F.col(target).cast("double").alias("_label")
        forest = RandomForestRegressor(
            featureSubsetStrategy="all", maxMemoryInMB=pass_memory(len(features.names)), **common
        )
        fitted = forests.fit(forest, rows.select("features", label), few.select("features", label))
        decode = SQLTransformer(statement="select *, prediction as predicted from __THIS__")
        return PipelineModel([*features.stages, fitted, decode]), []
    text = F.col(target).cast("string").alias("_target")
    labels = StringIndexer(
        inputCol="_target", outputCol="_label", stringOrderType="alphabetAsc"
    ).fit(train.select(text))
    data, sample = (labels.transform(x.select("features", text)).select("features", "_label") for x in (rows, few))
    fitted = forests.fit(RandomForestClassifier(**common), data, sample, len(labels.labels))
    decode = IndexToString(inputCol="prediction", outputCol="predicted", labels=labels.labels)
    return PipelineModel([*features.stages, fitted, decode]), classes(labels, train, target)


def classes(labels: StringIndexerModel, df: DataFrame, target: str) -> list:
    """Sorted class labels, numbers as numbers."""
    if P.is_numeric(df.schema[target].dataType):
        return sorted(float(x) for x in labels.labels)
    return list(labels.labels)


def train_and_predict(
    df: DataFrame,
    id_col: str,
    target: str | None = None,
    task: str = "auto",
    test_size: float = 0.2,
    seed: int = 42,
    max_depth: int = 10,
    trees: int = TREES,
    include_ids: bool = False,
) -> Trained:
    """Fit a random forest on the training rows and measure it on the test rows."""
    target = choose_target(df.drop(id_col), target)
    known = with_target(df, target)
    task = choose_task(known, target, task)
    stratify = [target] if task == CLASSIFICATION else []
    # read by the feature fit, the forest and the metrics
    rows = materialise(train_test_split(known, id_col, test_size, seed, stratify), "split")
    features = fit_features(rows, [id_col, target, "is_test"], include_ids)
    train = rows.where(~F.col("is_test"))
    model, found = fit_forest(train, target, task, features, seed, max_depth, trees, id_col)
    scored = forests.transform(model, rows.where("is_test")).select(
        id_col, F.col(target).alias("actual"), "predicted"
    )
    scored = materialise(scored, "predictions")
    measure = regression_metrics if task == REGRESSION else classification_metrics
    return Trained(
        model, task, target, features.names, found, scored, measure(scored), rows.count()
    )


# --- metrics and reports ----------------------------------------------------------------


def regression_metrics(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    df = P.clean_nans(df).where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    y, e = F.col(actual).cast("double"), F.col(actual) - F.col(predicted)
    return df.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(F.lit(1)))).alias("r2"),
    )


def classification_metrics(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Accuracy, and F1 per class weighted by its rows, from the confusion counts."""
    pairs = df.groupBy(
        F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p")
    ).agg(F.count(F.lit(1)).alias("n"))
    # each count adds to its actual and its predicted class, so no join is needed
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("label"), F.col("n").alias("support"),
                         F.lit(0).cast("long").alias("claimed"),
                         F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
                F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"),
                         F.col("n").alias("claimed"), F.lit(0).cast("long").alias("hits")),
            )
        )
    )
    per_class = sides.groupBy("label").agg(
        F.sum("support").alias("support"),
        F.sum("claimed").alias("claimed"),
        F.sum("hits").alias("hits"),
    )
    f1 = F.coalesce(
        F.try_divide(2 * F.col("hits"), F.col("support") + F.col("claimed")), F.lit(0.0)
    )
    rows = F.sum("support")
    return per_class.agg(
        F.try_divide(F.sum("hits"), rows).alias("accuracy"),
        F.try_divide(F.sum(f1 * F.col("support")), rows).alias("f1"),
    )


def _forest_stage(model: PipelineModel):
    return next(s for s in model.stages if hasattr(s, "featureImportances"))


def feature_importance(df: DataFrame, model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """``feature, importance`` from the highest down; ``df`` gives the session."""
    values = _forest_stage(model).featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")


def sample_predictions(predictions: DataFrame, id_col: str, n: int = 10) -> DataFrame:
    """The first test rows by id with their actual and predicted values."""
    return predictions.orderBy(id_col).limit(n)


# --- stored models ----------------------------------------------------------------------


def save_model(model: PipelineModel, folder: str, model_id: str) -> str:
    """Write the whole pipeline under ``folder/model_id``."""
    path = f"{folder.rstrip('/')}/{model_id}"
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``predicted`` for every row (and ``probabilities`` by sorted class); also on a stream."""
    scored = forests.transform(model, df)
    extra: list[Column] = []
    if isinstance(_forest_stage(model), RandomForestClassificationModel):
        extra.append(F.col("_probabilities").alias("probabilities"))
    return scored.select(*[F.col(c) for c in df.columns], "predicted", *extra)


def model_classes(model: PipelineModel) -> list[str]:
    """Class labels of a stored classifier, in the order of ``probabilities``."""
    stage = model.stages[-1]
    return list(stage.getLabels()) if isinstance(stage, IndexToString) else []


def load_and_predict(path: str, df: DataFrame) -> DataFrame:
    return predict(load_model(path), df)
