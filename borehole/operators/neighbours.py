"""Local outlier factor (Breunig et al. 2000) on exact nearest neighbours.

No all-pairs join: space is cut into leaves of bounded size by a k-d tree over a small sample.
Each place first finds its neighbours inside its own leaf, which bounds how far away its true
neighbours can be; only the leaves within that distance are asked a second time. Rows at the
same place are one weighted place, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borehole.operators import grouping as G
from borehole.session import materialise

LEAF_ROWS = 2_000
MAX_LEAVES = 131_072  # bounds the tree every task gets to about 10 MB; leaves grow beyond
SAMPLE_PER_LEAF = 16
QUERY_ROWS = 20_000  # second-round questions to one leaf per task
DIGITS = 9  # distances equal to this many digits are ties, broken by id
SMALLEST_K, LARGEST_K, K_SHARE = 5, 50, 0.05
TINY = 1e-10


def neighbour_count(n: Column) -> Column:
    """5 % of the rows, from 5 to 50, less than the rows."""
    k = F.least(F.greatest(F.floor(n * K_SHARE), F.lit(SMALLEST_K)), F.lit(LARGEST_K))
    return F.least(k, n - 1).cast("int")


# --- space ------------------------------------------------------------------------------


def split_space(sample: np.ndarray, per_leaf: int) -> dict[str, np.ndarray]:
    """A k-d tree: ``dim`` (-1 for a leaf), ``cut``, ``left``, ``right``, ``leaf`` per node."""
    dim, cut, left, right, leaf = [], [], [], [], []
    stack = [(np.arange(len(sample)), -1, left)]
    leaves = 0
    while stack:
        rows, parent, side = stack.pop()
        me = len(dim)
        if parent >= 0:
            side[parent] = me
        part = sample[rows]
        spread = part.max(axis=0) - part.min(axis=0) if len(rows) else np.zeros(1)
        d = int(np.argmax(spread))
        value = float(np.median(part[:, d])) if len(rows) > per_leaf and spread[d] > 0 else 0.0
        goes_left = part[:, d] <= value if len(rows) else np.zeros(0, bool)
        for a in (left, right):
            a.append(-1)
        if len(rows) <= per_leaf or spread[d] == 0 or goes_left.all():
            dim.append(-1)
            cut.append(0.0)
            leaf.append(leaves)
            leaves += 1
            continue
        dim.append(d)
        cut.append(value)
        leaf.append(-1)
        stack.append((rows[~goes_left], me, right))
        stack.append((rows[goes_left], me, left))
    return {
        "dim": np.array(dim), "cut": np.array(cut), "left": np.array(left),
        "right": np.array(right), "leaf": np.array(leaf),
    }


def leaves_within(
    tree: dict[str, np.ndarray], x: np.ndarray, radius: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that may hold a point within ``radius`` of a row."""
    row, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    found_row, found_leaf = [], []
    while len(row):
        d = tree["dim"][node]
        at_leaf = d < 0
        found_row.append(row[at_leaf])
        found_leaf.append(tree["leaf"][node[at_leaf]])
        row, node, d = row[~at_leaf], node[~at_leaf], d[~at_leaf]
        gap = x[row, d] - tree["cut"][node]
        go_left, go_right = gap - radius[row] <= 0, gap + radius[row] > 0
        row, node = (
            np.concatenate([row[go_left], row[go_right]]),
            np.concatenate([tree["left"][node[go_left]], tree["right"][node[go_right]]]),
        )
    return np.concatenate(found_row), np.concatenate(found_leaf)


def _group_key(pdf: pd.DataFrame, keys: Sequence[str]):
    """Rows of a batch by group, as (key tuple, positions)."""
    if not keys:
        yield (), np.arange(len(pdf))
        return
    for _, at in pdf.groupby(list(keys), dropna=False, sort=False).indices.items():
        yield _plain_key(pdf.iloc[at[0]], keys), at


def _plain_key(row, keys: Sequence[str]) -> tuple:
    return tuple(None if pd.isna(row[k]) else row[k] for k in keys)


def _grow_trees(
    places: DataFrame, features: Sequence[str], keys: Sequence[str], leaf_rows: int
) -> dict[tuple, dict[str, np.ndarray]]:
    """Trees of the groups too large for one leaf, from a sample by hash."""
    total = places.count()
    leaf_rows = max(leaf_rows, -(-total // MAX_LEAVES))
    sizes = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("_places"))
    share = min(1.0, SAMPLE_PER_LEAF / leaf_rows)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(7), *features), 11) / float(2**53)
    sample = (
        G.attach_stats(places.select(*keys, *features), sizes, keys)
        .where((F.col("_places") > leaf_rows) & (chance < share))
        .select(*keys, *features)
        .toPandas()  # about SAMPLE_PER_LEAF rows for each of at most MAX_LEAVES leaves
    )
    per_leaf = max(2, int(leaf_rows * share))
    return {
        key: split_space(sample.iloc[at][list(features)].to_numpy(float), per_leaf)
        for key, at in _group_key(sample, keys)
        if len(at)
    }


# --- nearest neighbours -----------------------------------------------------------------

EDGE = "_q {id}, _q_mult long, _o {id}, _o_mult long, _d double"


def _nearest(
    queries: pd.DataFrame, others: pd.DataFrame, features: Sequence[str], k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its ``k`` nearest others by (distance, id): positions and distances."""
    others_x = others[list(features)].to_numpy(float)
    x = queries[list(features)].to_numpy(float)
    ids, own = others["_place"].to_numpy(), queries["_place"].to_numpy()
    keep = min(k + 1, len(others))  # one more: the query itself may be among them
    block = max(1, 4_000_000 // max(len(others), 1))
    rows, cols, dist = [], [], []
    for start in range(0, len(x), block):
        part = x[start : start + block]
        d2 = np.zeros((len(part), len(others)))
        for j in range(x.shape[1]):
            d2 += (part[:, j, None] - others_x[None, :, j]) ** 2
        # all that may tie with the last one wanted, then in order of (distance, id)
        last = np.sqrt(np.partition(d2, keep - 1, axis=1)[:, keep - 1]) + 2 * 10.0**-DIGITS
        r, c = np.nonzero(d2 <= (last * last)[:, None])
        d = np.round(np.sqrt(d2[r, c]), DIGITS)
        order = np.lexsort((c, d, r))
        r, c, d = r[order], c[order], d[order]
        other = ids[c] != own[start + r]
        r, c, d = r[other], c[other], d[other]
        first = np.searchsorted(r, np.arange(len(part)))
        nearest = np.arange(len(r)) - first[r] < k
        rows.append(r[nearest] + start)
        cols.append(c[nearest])
        dist.append(d[nearest])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


def _edges(
    queries: pd.DataFrame, others: pd.DataFrame, features: Sequence[str], keys: Sequence[str]
) -> pd.DataFrame:
    others = others.sort_values("_place", ignore_index=True)
    queries = queries.reset_index(drop=True)
    rows, cols, dist = _nearest(queries, others, features, int(queries["_k"].iloc[0]))
    out = pd.DataFrame({f: queries[f].to_numpy()[rows] for f in keys})
    out["_q"] = queries["_place"].to_numpy()[rows]
    out["_q_mult"] = queries["_mult"].to_numpy()[rows]
    out["_o"] = others["_place"].to_numpy()[cols]
    out["_o_mult"] = others["_mult"].to_numpy()[cols]
    out["_d"] = dist
    return out


def _cut_to_k(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The edges that hold the ``k`` nearest rows; ``_take`` rows of the place are used."""
    upto = (
        Window.partitionBy(*keys, "_q")
        .orderBy("_d", "_o")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    left = F.col("_k") - F.least(F.col("_q_mult") - 1, F.col("_k"))
    before = F.sum("_o_mult").over(upto) - F.col("_o_mult")
    return (
        edges.withColumn("_left", left)
        .withColumn("_take", F.least(F.col("_o_mult"), F.col("_left") - before))
        .where(F.col("_take") > 0)
    )


def nearest_places(
    places: DataFrame, features: Sequence[str], keys: Sequence[str], leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """Exact neighbours of every place: ``keys, _q, _q_mult, _o, _o_mult, _d, _k, _take``.

    ``places`` has ``keys, features, _place, _mult, _k``.
    """
    id_type = places.schema["_place"].dataType.simpleString()
    fields = [places.schema[c] for c in keys]
    edge_schema = T.StructType(fields + T.StructType.fromDDL(EDGE.format(id=id_type)).fields)
    trees = _grow_trees(places, features, keys, leaf_rows)
    per_key_k = places.groupBy(*keys).agg(F.first("_k").alias("_k"))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        return _edges(pdf, pdf, features, keys)

    shared = places.sparkSession.sparkContext.broadcast(trees)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Add the leaves within ``_radius`` of each row, but not its own ``_home``."""
        for pdf in batches:
            for key, at in _group_key(pdf, keys):
                part = pdf.iloc[at].reset_index(drop=True)
                tree = shared.value.get(key)
                if tree is None:
                    row, leaf = np.arange(len(part)), np.zeros(len(part), dtype=np.int64)
                else:
                    x = part[list(features)].to_numpy(float)
                    row, leaf = leaves_within(tree, x, part["_radius"].to_numpy(float))
                out = part.iloc[row].assign(_leaf=leaf)
                yield out[out["_leaf"] != out["_home"]]

    routed_schema = T.StructType(
        places.schema.fields
        + [T.StructField("_radius", T.DoubleType()), T.StructField("_home", T.LongType()),
           T.StructField("_leaf", T.LongType())]
    )

    homes = places.withColumn("_radius", F.lit(0.0)).withColumn("_home", F.lit(-1).cast("long"))
    homes = materialise(homes.mapInPandas(route, routed_schema).drop("_radius", "_home"), "homes")
    first = G.python_groups(homes, [*keys, "_leaf"]).applyInPandas(local, edge_schema)
    first = materialise(first, "edges")
    first = G.attach(first, per_key_k, keys)

    # a place that found enough neighbours at home knows how far the others can be
    reached = _cut_to_k(first, keys).groupBy(*keys, "_q").agg(
        F.sum("_take").alias("_got"), F.first("_left").alias("_left"), F.max("_d").alias("_far")
    )
    own = F.least(F.col("_mult") - 1, F.col("_k"))
    by_place = reached.withColumnRenamed("_q", "_place")
    asked = (
        G.attach(homes, by_place, [*keys, "_place"])
        .where(own < F.col("_k"))
        .withColumn(
            "_radius",
            F.when(F.col("_got") >= F.col("_left"), F.col("_far") + 10.0**-DIGITS).otherwise(
                F.lit(float("inf"))
            ),
        )
        .withColumn("_home", F.col("_leaf"))
        .select(*places.columns, "_radius", "_home")
        .mapInPandas(route, routed_schema)
    )
    second = _ask_leaves(materialise(asked, "asked"), homes, features, keys, edge_schema)
    edges = first.unionByName(G.attach(second, per_key_k, keys))
    return _cut_to_k(edges, keys)


def _ask_leaves(
    asked: DataFrame, homes: DataFrame, features: Sequence[str], keys: Sequence[str],
    schema: T.StructType,
) -> DataFrame:
    """Neighbours of the asking places in the leaves they were routed to."""
    at = [*keys, "_leaf"]
    tasks = asked.groupBy(*at).agg(
        F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("long").alias("_tasks")
    )
    queries = G.attach(asked, tasks, at).withColumn(
        "_task", F.pmod(F.xxhash64("_place"), F.col("_tasks"))
    ).drop("_tasks")
    others = (
        G.attach(homes, tasks, at)
        .where(F.col("_tasks").isNotNull())
        .withColumn("_task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tasks") - 1)))
        .drop("_tasks")
    )

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        return _edges(left, right, features, keys)

    by = [*at, "_task"]
    return G.python_groups(queries, by).cogroup(G.python_groups(others, by)).applyInPandas(run, schema)


# --- outlier factor ---------------------------------------------------------------------


def lof_scores(
    df: DataFrame, features: Sequence[str], id_col: str, keys: Sequence[str] = (),
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Every row with ``raw``, minus its local outlier factor. Features must not be null.

    A group of no more than ``leaf_rows`` places is scored by one task; many such groups take
    one shuffle together. Larger groups are spread over leaves.
    """
    exact = df.select(
        *[(F.col(c) + F.lit(0.0)).alias(c) if c in features else F.col(c) for c in df.columns]
    )  # no negative zeros: they would group apart
    places = exact.groupBy(*keys, *features).agg(
        F.min(id_col).alias("_place"), F.count(F.lit(1)).alias("_mult")
    )
    places = materialise(places, "places")
    sizes = places.groupBy(*keys).agg(
        neighbour_count(F.sum("_mult")).alias("_k"), F.count(F.lit(1)).alias("_places")
    )
    limits = sizes.agg(F.min("_k").alias("k"), F.min("_places").alias("low"),
                       F.max("_places").alias("high")).first()
    if limits["k"] is None or limits["k"] < 2:
        raise ValueError("not enough samples for a local outlier factor")
    sized = G.attach_stats(places, sizes, keys)
    small, large = F.col("_places") <= leaf_rows, F.col("_places") > leaf_rows
    found = []
    if limits["low"] <= leaf_rows:
        found.append(_small_groups(sized.where(small).drop("_places"), features, keys))
    if limits["high"] > leaf_rows:
        one = materialise(sized.where(large).drop("_places"), "places")
        found.append(_large_groups(one, features, keys, leaf_rows))
    by_place = reduce(DataFrame.unionByName, found)
    return G.attach(exact, by_place, [*keys, *features])


def _small_groups(
    places: DataFrame, features: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """``keys, features, raw`` of groups that fit one task."""
    kept = [places.schema[c] for c in (*keys, *features)]
    schema = T.StructType([*kept, T.StructField("raw", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place", ignore_index=True)
        k, mult, n = int(pdf["_k"].iloc[0]), pdf["_mult"].to_numpy(), len(pdf)
        # edges come by place and by (distance, id) within a place
        q, o, d = _nearest(pdf, pdf, features, k)
        before = np.cumsum(mult[o]) - mult[o]
        start = np.searchsorted(q, np.arange(n))
        before = before - np.append(before, 0)[start][q]
        own = np.minimum(mult - 1, k)
        take = np.clip(np.minimum(mult[o], (k - own)[q] - before), 0, None)
        kdist = np.zeros(n)
        np.maximum.at(kdist, q, np.where(take > 0, d, 0.0))
        reach = np.bincount(q, take * np.maximum(kdist[o], d), n) + own * kdist
        lrd = 1 / (reach / k + TINY)
        around = np.bincount(q, take * lrd[o], n) + own * lrd
        return pdf[[*keys, *features]].assign(raw=-around / k / lrd)

    groups = G.python_groups(places, keys) if keys else places.groupBy()
    return groups.applyInPandas(run, schema)


def _large_groups(
    places: DataFrame, features: Sequence[str], keys: Sequence[str], leaf_rows: int
) -> DataFrame:
    """``keys, features, raw`` by joins along the neighbour edges."""
    edges = materialise(nearest_places(places, features, keys, leaf_rows), "neighbours")

    own = F.least(F.col("_mult") - 1, F.col("_k"))
    at_q = [*keys, "_place"]
    reach = edges.groupBy(*keys, F.col("_q").alias("_place")).agg(F.max("_d").alias("_kdist"))
    with_k = G.attach(places, reach, at_q).withColumn("_kdist", F.coalesce("_kdist", F.lit(0.0)))
    with_k = materialise(with_k.select(*keys, "_place", "_mult", "_k", "_kdist"), "reach")

    far = with_k.select(*keys, F.col("_place").alias("_o"), F.col("_kdist").alias("_o_kdist"))
    sums = (
        G.attach(edges, far, [*keys, "_o"])
        .groupBy(*keys, F.col("_q").alias("_place"))
        .agg(F.sum(F.col("_take") * F.greatest("_o_kdist", "_d")).alias("_reach"))
    )
    density = G.attach(with_k, sums, at_q).withColumn(
        "_lrd", 1 / ((F.coalesce("_reach", F.lit(0.0)) + own * F.col("_kdist")) / F.col("_k") + TINY)
    )
    density = materialise(density.select(*keys, "_place", "_mult", "_k", "_lrd"), "density")

    near = density.select(*keys, F.col("_place").alias("_o"), F.col("_lrd").alias("_o_lrd"))
    totals = (
        G.attach(edges, near, [*keys, "_o"])
        .groupBy(*keys, F.col("_q").alias("_place"))
        .agg(F.sum(F.col("_take") * F.col("_o_lrd")).alias("_around"))
    )
    factor = (F.coalesce("_around", F.lit(0.0)) + own * F.col("_lrd")) / F.col("_k") / F.col("_lrd")
    by_place = G.attach(density, totals, at_q).withColumn("raw", -factor)
    scored = G.attach(places, by_place.select(*at_q, "raw"), at_q)
    return scored.select(*keys, *features, "raw")
