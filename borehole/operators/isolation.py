"""Isolation forest (Liu, Ting and Zhou 2008), one forest per group.

Each tree sees at most 256 rows, drawn by a hash of (seed, tree, row id), so the draw does not
depend on how the data is partitioned. Trees are built side by side, one small group each.
Scoring is a pass over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borehole.operators import grouping as G

TREES = 100
SAMPLE = 256
POOL = TREES * SAMPLE  # rows of one group that may enter any tree
SCORE_ROWS = 100_000  # rows of one group scored by one task
SCORE_BLOCK = 512  # rows taken through all trees at a time

FOREST = (
    "tree int, sampled int, feature array<int>, threshold array<double>, left array<int>, "
    "right array<int>, length array<double>"
)


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(2**53)


def average_path(n):
    """Mean depth of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3)
    value = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, value))


def _draw(
    df: DataFrame, features: Sequence[str], id_col: str, keys: Sequence[str], trees: int,
    sample: int, seed: int,
) -> DataFrame:
    """``keys, tree, u, features``: the rows of each tree, ``u`` giving them an order."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    ident = F.col(id_col)
    pool = G.attach_stats(df.select(*keys, id_col, *features), counts, keys).where(
        _uniform(F.lit(seed), ident) < F.lit(float(trees * sample)) / F.col("_rows")
    )
    # twice as many candidates as a tree takes, then the exact number of smallest hashes
    share = 2.0 * sample / F.least(F.col("_rows"), F.lit(trees * sample))
    every_tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    candidates = (
        pool.withColumn("_share", share)
        .select(*keys, id_col, *features, "_share", every_tree.alias("tree"))
        .withColumn("u", _uniform(F.lit(seed), F.col("tree"), ident))
        .where(F.col("u") < F.col("_share"))
        .drop("_share")
    )
    # the partitions of this window are also those of the tree building
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    candidates = candidates.repartition(parts, *keys, "tree")
    order = Window.partitionBy(*keys, "tree").orderBy("u", id_col)
    return candidates.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= sample
    )


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """A random tree over the rows of ``x``; inner nodes send ``value <= threshold`` left."""
    depth_limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: dict[str, list] = {c: [] for c in ("feature", "threshold", "left", "right", "length")}
    stack = [(np.arange(len(x)), 0, -1, "left")]
    while stack:
        rows, depth, parent, side = stack.pop()
        me = len(nodes["feature"])
        if parent >= 0:
            nodes[side][parent] = me
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= depth_limit or len(rows) <= 1 or len(varied) == 0:
            values = (-1, 0.0, -1, -1, depth + float(average_path(len(rows))))
        else:
            f = int(rng.choice(varied))
            cut = float(rng.uniform(low[f], high[f]))
            values = (f, cut, -1, -1, 0.0)
            goes_left = part[:, f] <= cut
            stack.append((rows[~goes_left], depth + 1, me, "right"))
            stack.append((rows[goes_left], depth + 1, me, "left"))
        for c, v in zip(nodes, values):
            nodes[c].append(v)
    return nodes


def build_forest(
    df: DataFrame, features: Sequence[str], id_col: str, keys: Sequence[str] = (),
    trees: int = TREES, sample: int = SAMPLE, seed: int = 42,
) -> DataFrame:
    """One row per tree, its nodes as arrays."""
    drawn = _draw(df, features, id_col, keys, trees, sample, seed)
    schema = T.StructType([df.schema[k] for k in keys])
    schema = T.StructType(schema.fields + T.StructType.fromDDL(FOREST).fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        tree = int(pdf["tree"].iloc[0])
        nodes = grow_tree(pdf[list(features)].to_numpy(float), np.random.default_rng([seed, tree]))
        row = {k: [pdf[k].iloc[0]] for k in keys} | {"tree": [tree], "sampled": [len(pdf)]}
        return pd.DataFrame(row | {c: [v] for c, v in nodes.items()})

    return drawn.groupBy(*keys, "tree").applyInPandas(run, schema)


def complete_tree(tree: dict, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree with all leaves at ``depth``: children of slot i are 2i + 1 and 2i + 2.

    An early leaf sends everything left until the bottom. Gives feature and threshold per
    slot, and the path length per bottom slot.
    """
    slots = 2 ** (depth + 1) - 1
    feature, cut, length = np.zeros(slots, np.int64), np.full(slots, np.inf), np.zeros(slots)
    stack = [(0, 0, 0)]
    while stack:
        node, slot, level = stack.pop()
        if tree["feature"][node] >= 0:
            feature[slot], cut[slot] = tree["feature"][node], tree["threshold"][node]
            stack.append((tree["left"][node], 2 * slot + 1, level + 1))
            stack.append((tree["right"][node], 2 * slot + 2, level + 1))
        else:
            length[2 ** (depth - level) * (slot + 1) - 1] = tree["length"][node]
    return feature, cut, length


def path_scores(forest: Sequence[dict], x: np.ndarray) -> np.ndarray:
    """Minus the anomaly score of each row of ``x``: lower is more anomalous."""
    sampled = max((t["sampled"] for t in forest), default=0)
    scale = float(average_path(sampled))
    if scale == 0:
        return np.full(len(x), -0.5)
    depth = int(np.ceil(np.log2(max(sampled, 2))))
    trees = [complete_tree(t, depth) for t in forest]
    feature, cut, length = (np.concatenate(part) for part in zip(*trees))
    first = (np.arange(len(trees)) * len(trees[0][0]))[:, None]
    total = np.empty(len(x))
    for start in range(0, len(x), SCORE_BLOCK):
        block = x[start : start + SCORE_BLOCK]
        values, row = block.ravel(), np.arange(len(block)) * x.shape[1]
        slot = np.zeros((len(trees), len(block)), dtype=np.int64)
        for _ in range(depth):
            at = slot + first
            slot = 2 * slot + 1 + (values.take(feature.take(at) + row) > cut.take(at))
        total[start : start + SCORE_BLOCK] = length.take(slot + first).sum(axis=0)
    return -np.power(2.0, -total / len(trees) / scale)


def isolation_scores(
    df: DataFrame, features: Sequence[str], id_col: str, keys: Sequence[str] = (),
    trees: int = TREES, sample: int = SAMPLE, seed: int = 42,
) -> DataFrame:
    """Every row with ``raw``, lower for more anomalous rows. Features must not be null."""
    forest = build_forest(df, features, id_col, keys, trees, sample, seed)
    if keys:
        return _score_groups(df, forest, features, id_col, keys)
    # at most `trees` rows of 2 x `sample` nodes, whatever the size of the data
    nodes = [r.asDict() for r in forest.orderBy("tree").collect()]
    shared = df.sparkSession.sparkContext.broadcast(nodes)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(path_scores(shared.value, x.to_numpy(float)))

    return df.withColumn("raw", score(F.struct(*features)))


def _score_groups(
    df: DataFrame, forest: DataFrame, features: Sequence[str], id_col: str, keys: Sequence[str]
) -> DataFrame:
    """Score each group with its own forest; large groups go to several tasks."""
    counts = df.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / SCORE_ROWS).cast("long").alias("_tasks")
    )
    rows = G.attach_stats(df, counts, keys).withColumn(
        "_task", F.pmod(F.xxhash64(id_col), F.col("_tasks"))
    ).drop("_tasks")
    forests = G.attach(forest, counts, keys).withColumn(
        "_task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tasks") - 1))
    ).drop("_tasks")
    schema = T.StructType(df.schema.fields + [T.StructField("raw", T.DoubleType())])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.drop(columns=["_task"])
        trees = right.sort_values("tree").to_dict("records")
        return left.assign(raw=path_scores(trees, left[list(features)].to_numpy(float)))

    by = [*keys, "_task"]
    return G.python_groups(rows, by).cogroup(G.python_groups(forests, by)).applyInPandas(run, schema)
