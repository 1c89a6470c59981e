"""The stations most like each station, without comparing all pairs.

The score of two stations falls with their distance and with the difference of their values. A k-d tree over a
bounded sample cuts places on the sphere and values in turn, so that a leaf is a small region with a small range of
values; how many value cuts follow each other is what asks fewest rows for some stations of the sample. What a station can score against a leaf at most follows from the leaf's box: 0.3 times the nearness of its
closest corner and 0.7 / (1 + the least difference of values). Each target first looks through a part of its own leaf; its k-th
score there is beaten only in leaves whose bound reaches it, and only those are asked. Within a leaf the straight line between
two places, a product of matrices, tells which pairs can be among the best; only these are measured on the sphere.

Leaves hold about ``LEAF_ROWS`` rows up to ``MAX_LEAVES`` leaves (some 67 million stations) and grow beyond. A leaf is
dealt in parts, and the targets that ask it in groups, so one place may hold any share of the stations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borehole.functions.geodesy import EARTH_RADIUS_KM
from borehole.operators import grouping as G
from borehole.session import materialise

GEO_WEIGHT, VALUE_WEIGHT = 0.3, 0.7
RELEVANT_KM = 1000.0
LEAF_ROWS = 1024
MAX_LEAVES = 65_536
SAMPLE_PER_LEAF = 8
#: Rows of a leaf in one part, targets in one group, and pairs scored at once.
PART_ROWS, ASK_ROWS, PAIRS = 4096, 8192, 1 << 17
#: Orders of the cuts (true: by value) that a tree may repeat from its root, the stations they are tried for, and how many best
#: of each.
TURNS, PROBES, BEST = ((True, False), (True,), (True, True, True, False), (True, False, False, False), (False,)), 128, 8
#: Allowance for rounding in a bound, in the square of a chord, and the most that a score by chords may lie above the true one.
SLACK, CHORD_SLACK, CHORD_GAP = 1e-9, 4e-15, 1e-3


def _space(lat: np.ndarray, lon: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places as points of the unit sphere, and the value."""
    la, lo = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la), value])


def _score(gap: np.ndarray) -> np.ndarray:
    """The score of two stations by the gaps between their points and values."""
    chord = np.sqrt((gap[:, :3] ** 2).sum(axis=1))
    km = 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(chord / 2, 1))
    return GEO_WEIGHT * np.maximum(1 - km / RELEVANT_KM, 0) + VALUE_WEIGHT / (1 + gap[:, 3])


class Tree:
    """Nodes by number: ``dim`` (-1 for a leaf), ``cut``, children and leaf number; boxes are set later."""

    def __init__(self, sample: np.ndarray, per_leaf: int, turns: tuple[bool, ...] = TURNS[0]):
        self.turns = turns
        self.dim, self.cut, self.kids, self.leaf = [], [], [], []
        self.leaves = 0
        self._split(sample, per_leaf)
        self.low = np.full((len(self.dim), 4), np.inf)
        self.high = np.full((len(self.dim), 4), -np.inf)

    def _split(self, sample: np.ndarray, per_leaf: int) -> None:
        stack = [(np.arange(len(sample)), 0, None)]
        while stack:
            rows, depth, parent = stack.pop()
            me = len(self.dim)
            if parent is not None:
                self.kids[parent[0]][parent[1]] = me
            part = sample[rows]
            spread = np.ptp(part, axis=0) if len(rows) else np.zeros(4)
            wide = int(np.argmax(spread[:3]))
            d = 3 if (self.turns[depth % len(self.turns)] and spread[3] > 0) or spread[wide] == 0 else wide
            value = float(np.median(part[:, d])) if len(rows) > per_leaf else 0.0
            left = part[:, d] <= value if len(rows) > per_leaf else np.ones(len(rows), bool)
            if len(rows) > per_leaf and left.all():
                left = part[:, d] < value
            self.kids.append([-1, -1])
            if left.all() or not left.any():
                self.dim.append(-1)
                self.cut.append(0.0)
                self.leaf.append(self.leaves)
                self.leaves += 1
                continue
            self.dim.append(d)
            # rows equal to the cut go left
            self.cut.append(float(part[left, d].max()))
            self.leaf.append(-1)
            stack.append((rows[~left], depth + 1, (me, 1)))
            stack.append((rows[left], depth + 1, (me, 0)))
        self.dim, self.cut, self.kids, self.leaf = map(np.array, (self.dim, self.cut, self.kids, self.leaf))

    def assign(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            open_ = np.flatnonzero(self.dim[node] >= 0)
            if not len(open_):
                return self.leaf[node]
            at = node[open_]
            node[open_] = self.kids[at, (x[open_, self.dim[at]] > self.cut[at]).astype(int)]

    def set_boxes(self, leaf: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Boxes of the leaves, from all rows, and of the nodes above them; a leaf without rows keeps an empty one."""
        node = np.full(self.leaves, -1)
        node[self.leaf[self.leaf >= 0]] = np.flatnonzero(self.leaf >= 0)
        self.low[node[leaf]], self.high[node[leaf]] = low, high
        for me in range(len(self.dim) - 1, -1, -1):  # children come after their parent
            if self.dim[me] >= 0:
                a, b = self.kids[me]
                self.low[me], self.high[me] = np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b])

    def bound(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The highest score that each row can reach in its node."""
        gap = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0)
        return np.where(self.low[node, 0] <= self.high[node, 0], _score(gap) + SLACK, -np.inf)

    def reach(self, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf in which a row may score ``least`` or more."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(row):
            go = self.bound(x[row], node) >= least[row]
            row, node = row[go], node[go]
            end = self.dim[node] < 0
            rows.append(row[end])
            leaves.append(self.leaf[node[end]])
            row, node = np.repeat(row[~end], 2), self.kids[node[~end]].ravel()
        return np.concatenate(rows), np.concatenate(leaves)


def planned(sample: np.ndarray, per_leaf: int, share: float = 1.0) -> Tree:
    """The tree whose order of cuts, of those in ``TURNS``, asks fewest rows of the sample, a ``share`` of all, for some of them.

    Where values lie close together a narrow range of values holds a target's best; where they lie far apart places do.
    """
    if len(sample) <= per_leaf:
        return Tree(sample, per_leaf)
    probes = sample[np.linspace(0, len(sample) - 1, min(PROBES, len(sample))).astype(int)]
    last = -1 - min(max(1, round(BEST * share)), len(sample) - 1)  # the highest score is a probe's own
    least = np.array([np.partition(_score(np.abs(sample - x)), last)[last] for x in probes])
    trees = [Tree(sample, per_leaf, turns) for turns in TURNS]
    return min(trees, key=lambda tree: _asked(tree, sample, probes, least))


def _asked(tree: Tree, sample: np.ndarray, probes: np.ndarray, least: np.ndarray) -> int:
    """Rows of the sample in the leaves where ``probes`` may score ``least``."""
    held = pd.DataFrame(sample).groupby(tree.assign(sample))
    sizes, low, high = held.size(), held.min(), held.max()
    tree.set_boxes(sizes.index.to_numpy(), low.to_numpy(), high.to_numpy())
    return int(sizes.reindex(tree.reach(probes, least)[1]).sum())


def _ceilings(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A score for all pairs of points and values that is never below the true one, nor above it by ``CHORD_GAP``."""
    chord = x[:, :3] @ rows[:, :3].T
    chord *= -2
    chord += 2 - CHORD_SLACK
    np.maximum(chord, 0, out=chord)
    np.sqrt(chord, out=chord)
    chord *= -GEO_WEIGHT * EARTH_RADIUS_KM / RELEVANT_KM
    chord += GEO_WEIGHT
    np.maximum(chord, 0, out=chord)
    alike = x[:, 3, None] - rows[:, 3]
    np.abs(alike, out=alike)
    alike += 1
    np.divide(VALUE_WEIGHT, alike, out=alike)
    alike += chord
    alike += SLACK
    return alike


def best_pairs(targets: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best rows for each target by (score, id) that reach its ``least`` score; never its own id."""
    asked, held = targets["target_id"].to_numpy(object), rows["station_id"].to_numpy(object)
    order = np.unique(np.concatenate([asked, held]), return_inverse=True)[1]
    mine, theirs = order[: len(asked)], order[len(asked) :]
    lat, lon, value = (rows[c].to_numpy(float) for c in ("lat", "lon", "value"))
    t_lat, t_lon, t_value = (targets[f"target_{c}"].to_numpy(float) for c in ("lat", "lon", "value"))
    points, t_points = _space(lat, lon, value), _space(t_lat, t_lon, t_value)
    la, lo, t_la, t_lo = (np.radians(c) for c in (lat, lon, t_lat, t_lon))
    least = targets["least"].to_numpy(float) - SLACK
    out = []
    step = max(1, PAIRS // max(len(rows), 1))
    for at in range(0, len(targets) if len(rows) else 0, step):
        part = slice(at, at + step)
        top, enough = _ceilings(t_points[part], points), least[part]
        top[mine[part, None] == theirs] = -np.inf
        if top.shape[1] > k and np.isinf(enough).any():
            # rows above the k-th ceiling by less than its error may still be among the best
            enough = np.maximum(enough, np.partition(top, top.shape[1] - k, axis=1)[:, -k] - CHORD_GAP)
        t, r = np.nonzero((top >= enough[:, None]) & (top > -np.inf))
        t += at
        half_lat, half_lon = np.sin((la[r] - t_la[t]) / 2), np.sin((lo[r] - t_lo[t]) / 2)
        h = half_lat * half_lat + np.cos(t_la)[t] * np.cos(la)[r] * half_lon * half_lon
        km = 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
        alike = 1 / (1 + np.abs(t_value[t] - value[r]))
        score = GEO_WEIGHT * np.maximum(0.0, 1 - km / RELEVANT_KM) + VALUE_WEIGHT * alike
        first = np.lexsort((theirs[r], -score, t))
        first = first[score[first] >= least[t[first]]]
        first = first[np.arange(len(first)) - np.searchsorted(t[first], t[first]) < k]
        t, r = t[first], r[first]
        out.append((asked[t], held[r], lat[r], lon[r], value[r], km[first], alike[first], score[first]))
    empty = (np.zeros(0, object), np.zeros(0, object), *[np.zeros(0)] * 6)
    columns = [np.concatenate(c) for c in zip(empty, *out, strict=True)]
    return pd.DataFrame({name: pd.Series(c, dtype=c.dtype) for name, c in zip(_FOUND, columns, strict=True)})


_FOUND = ["target_id", "station_id", "lat", "lon", "value", "distance_km", "value_similarity", "combined_score"]


def _found_schema(id_type: T.DataType) -> T.StructType:
    fields = [T.StructField(c, id_type if c.endswith("_id") else T.DoubleType()) for c in _FOUND]
    return T.StructType(fields)


class Search:
    """Points (``station_id, lat, lon, value``, none null) in leaves; ``targets`` are asked in all leaves that matter."""

    def __init__(self, points: DataFrame, leaf_rows: int = LEAF_ROWS):
        self.points = materialise(points, "stations")
        self.id_type = points.schema["station_id"].dataType
        total = self.points.count()
        leaf_rows = max(leaf_rows, -(-total // MAX_LEAVES))
        share = min(1.0, SAMPLE_PER_LEAF / leaf_rows)
        chance = F.shiftrightunsigned(F.xxhash64("station_id", "lat", "lon"), 11) / float(2**53)
        # about SAMPLE_PER_LEAF rows for each of at most MAX_LEAVES leaves
        sample = self.points.where(chance < share).select("lat", "lon", "value").toPandas()
        space = _space(*(sample[c].to_numpy(float) for c in ("lat", "lon", "value")))
        self.tree = planned(space, max(2, int(leaf_rows * share)), share)
        self.rows = materialise(self._place(self.points), "leaves")
        x = [f"x{i}" for i in range(4)]
        boxes = self.rows.groupBy("leaf").agg(
            F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in x]
        )
        boxes = boxes.toPandas()  # a row per leaf
        self.tree.set_boxes(boxes["leaf"].to_numpy(int), *(boxes[[f"{f}_{c}" for c in x]].to_numpy(float) for f in ("min", "max")))
        self.sizes = np.zeros(self.tree.leaves, np.int64)
        self.sizes[boxes["leaf"].to_numpy(int)] = boxes["n"].to_numpy(int)

    def _place(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.tree)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = _space(*(pdf[c].to_numpy(float) for c in ("lat", "lon", "value")))
                yield pdf.assign(leaf=shared.value.assign(x), **{f"x{i}": x[:, i] for i in range(4)})

        extra = [T.StructField("leaf", T.LongType()), *[T.StructField(f"x{i}", T.DoubleType()) for i in range(4)]]
        return df.mapInPandas(run, T.StructType([*df.schema.fields, *extra]))

    def _parts(self, leaf: str) -> DataFrame:
        """``leaf, parts``: bounded by the number of leaves."""
        parts = [(int(i), int(-(-n // PART_ROWS))) for i, n in enumerate(self.sizes) if n]
        spark = self.points.sparkSession
        return F.broadcast(spark.createDataFrame(parts, f"{leaf} long, parts long"))

    def _ask(self, targets: DataFrame, k: int, all_parts: bool) -> DataFrame:
        """The ``k`` best rows of each asked part; ``targets`` has ``leaf`` and ``least``."""
        spread = F.xxhash64("target_id")
        asks = targets.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / ASK_ROWS).cast("long").alias("asks"))
        asks = F.broadcast(materialise(asks, "asks"))  # a row per leaf
        parts = self._parts("leaf")
        left = targets.join(asks, "leaf").join(parts, "leaf")
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)) if all_parts else F.pmod(spread, F.col("parts"))
        left = left.withColumn("ask", F.pmod(spread, F.col("asks"))).withColumn("part", part).drop("asks", "parts")
        right = self.rows.join(asks, "leaf").join(parts, "leaf")
        right = right.withColumn("part", F.pmod(F.xxhash64("station_id", "lat", "lon", "value"), F.col("parts")))
        right = right.withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asks") - 1)))
        right = right.select("leaf", "part", "ask", "station_id", "lat", "lon", "value")

        def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            return best_pairs(asked, rows, k)

        by = ["leaf", "part", "ask"]
        return G.python_groups(left, by).cogroup(G.python_groups(right, by)).applyInPandas(run, _found_schema(self.id_type))

    def routed(self, targets: DataFrame, k: int) -> DataFrame:
        """``target_id, target_lat, target_lon, target_value, least, leaf``: the leaves that may hold one of the ``k`` best."""
        homes = self._place(targets).drop("x0", "x1", "x2", "x3").withColumn("least", F.lit(float("-inf")))
        homes = homes.withColumnsRenamed({c: f"target_{c}" for c in ("lat", "lon", "value")})
        homes = materialise(homes, "targets")
        near = self._ask(homes, k, all_parts=False)
        kth = near.groupBy("target_id").agg(F.count(F.lit(1)).alias("_n"), F.min("combined_score").alias("_kth"))
        asking = homes.drop("least", "leaf").join(kth, "target_id", "left")
        asking = asking.withColumn("least", F.when(F.col("_n") >= k, F.col("_kth")).otherwise(F.lit(float("-inf")))).drop("_n", "_kth")
        shared = targets.sparkSession.sparkContext.broadcast(self.tree)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in range(0, len(whole), 1000):
                    pdf = whole.iloc[at : at + 1000]
                    x = _space(*(pdf[c].to_numpy(float) for c in ("target_lat", "target_lon", "target_value")))
                    row, leaf = shared.value.reach(x, pdf["least"].to_numpy(float) - SLACK)
                    yield pdf.astype({"target_id": object}).iloc[row].assign(leaf=leaf)

        return asking.mapInPandas(run, T.StructType([*asking.schema.fields, T.StructField("leaf", T.LongType())]))

    def best(self, targets: DataFrame, k: int) -> DataFrame:
        asked = materialise(self.routed(targets, k), "asked")
        found = self._ask(asked, k, all_parts=True)
        return G.top_per_group(found, ["target_id"], [F.col("combined_score").desc(), F.col("station_id")], k)

    def compared(self, targets: DataFrame, k: int) -> int:
        """How many pairs of target and row :meth:`best` scores in the leaves that it asks."""
        held = self.points.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(self.sizes)], "leaf long, n long")
        return self.routed(targets, k).join(F.broadcast(held), "leaf").agg(F.sum("n")).first()[0] or 0


def targets_of(points: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One row per station as ``target_id, lat, lon, value`` (the first, should an id occur twice); ``wanted`` has ``target_id``."""
    first = F.min(F.struct("lat", "lon", "value")).alias("_t")
    one = points.groupBy(F.col("station_id").alias("target_id")).agg(first).select("target_id", "_t.*")
    return one if wanted is None else one.join(wanted.distinct(), "target_id", "left_semi")
