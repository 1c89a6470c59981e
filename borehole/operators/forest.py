"""Growing MLlib's random forests in few passes over binned rows.

MLlib chooses the split candidates, bins the rows and draws the bootstrap. Its own passes then walk boxed maps for every
row and tree and shuffle the statistics of every partition. Here the binned rows and their draws are stored once as arrays
of bytes. A pass sums the statistics of many nodes at a time in numpy, in at most ``GROUPS`` sums whatever the rows, and
finds their best splits by block of nodes. Sums, candidates, ties, the features drawn for a node and the pruned leaves
follow MLlib to the bit as long as its sums are added by ascending partition, so the model is the one that ``fit`` returns.

A task holds the statistics of a pass (``PASS_BYTES``, or one node), and one piece of rows. Features are numbers or have two
categories; a forest with any others is left to MLlib.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borehole.session import scratch_path, ship_package

#: Sums that a pass adds up for a node, at most; bytes of statistics that a task holds, and of one block of them.
GROUPS, PASS_BYTES, BLOCK_BYTES = 32, 64 << 20, 1 << 20
#: Trees whose draws are stored in one column; features above which rows stay sparse.
DRAWN_TREES, WIDE = 10, 512
EPSILON = np.finfo(float).eps
_MASK = (1 << 64) - 1


# --- what MLlib prepares ------------------------------------------------------------------


def _module(spark: SparkSession, name: str):
    return spark._jvm.java.lang.Class.forName(f"{name}$").getField("MODULE$").get(None)


def _seq(spark: SparkSession, *items):
    held = spark._jvm.java.util.ArrayList()
    for x in items:
        held.add(x)
    return spark._jvm.scala.jdk.javaapi.CollectionConverters.asScala(held).toSeq()


@dataclass(frozen=True)
class Layout:
    """What a forest's statistics look like: bins of each feature, which have two categories, features of a node."""

    bins: np.ndarray
    paired: np.ndarray
    counted: np.ndarray  # the bins that MLlib counts: among several classes one side of a pair is enough
    subset: int
    classes: int  # 0 for a regression

    @property
    def width(self) -> int:
        """Statistics of a bin: count, sum and sum of squares, or a count per class."""
        return self.classes or 3

    @property
    def kept(self) -> type:
        """What holds a bin; the largest number is left to nodes without split."""
        return np.uint8 if self.bins.max() < 256 else np.uint16

    def counts(self, sums: np.ndarray) -> np.ndarray:
        return sums.sum(axis=0) if self.classes else sums[0]

    def impurity(self, sums: np.ndarray) -> np.ndarray:
        n = self.counts(sums)
        with np.errstate(divide="ignore", invalid="ignore"):
            if not self.classes:
                return np.where(n == 0, 0.0, (sums[2] - sums[1] * sums[1] / n) / n)
            found = np.ones(n.shape)
            for one in sums:
                found -= (one / n) * (one / n)
            return np.where(n == 0, 0.0, found)

    def centroid(self, sums: np.ndarray) -> np.ndarray:
        """What MLlib orders categories by; those without rows come last."""
        n = self.counts(sums)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(n == 0, np.finfo(float).max, sums[1] if self.classes else sums[1] / n)

    def prediction(self, sums: Sequence[float]) -> float:
        if self.classes:
            return float(np.argmax(sums))
        return sums[1] / sums[0] if sums[0] else 0.0


def _prepared(forest: Estimator, data: DataFrame, classes: int):
    """The layout, the thresholds of each feature, the rows (label, bins, draws) and their partitions; None where MLlib is needed."""
    spark = data.sparkSession
    jvm = spark._jvm
    impl, tree = "org.apache.spark.ml.tree.impl.", "org.apache.spark.mllib.tree.configuration."
    forest._transfer_params_to_java()
    own = forest._java_obj
    arities = _module(spark, "org.apache.spark.ml.util.MetadataUtils").getCategoricalFeatures(data._jdf.schema().apply("features"))
    pairs = {int(k): int(v) for k, v in (x.strip("()").split(",") for x in arities.toSeq().mkString(";").split(";") if x)}
    if classes == 1 or any(v != 2 for v in pairs.values()):
        return None
    algo = _module(spark, f"{tree}Algo")
    wanted = jvm.scala.Some(classes) if classes else _module(spark, "scala.None")
    rows = _module(spark, "org.apache.spark.ml.util.DatasetUtils").extractInstances(own, data._jdf, wanted)
    strategy = own.getOldStrategy(arities, classes, algo.Classification() if classes else algo.Regression(), own.getOldImpurity())
    trees, seed = forest.getNumTrees(), forest.getSeed()
    meta = _module(spark, f"{impl}DecisionTreeMetadata").buildMetadata(rows, strategy, trees, forest.getFeatureSubsetStrategy())
    splits = _module(spark, f"{impl}RandomForest").findSplits(rows, meta, seed)
    counted = np.array([int(x) for x in jvm.java.util.Arrays.toString(meta.numBins()).strip("[]").split(",")])
    paired = np.zeros(len(counted), bool)
    paired[list(pairs)] = True
    thresholds = [[] if paired[f] else [s.threshold() for s in splits[f]] for f in range(len(counted))]
    points = _module(spark, f"{impl}TreePoint").convertToTreeRDD(rows, splits, meta)
    bagged = _module(spark, f"{impl}BaggedPoint")
    weight = getattr(bagged, "convertToBaggedRDD$default$5")()
    drawn = bagged.convertToBaggedRDD(points, forest.getSubsamplingRate(), trees, forest.getBootstrap(), weight, seed)
    return Layout(np.where(paired, 2, counted), paired, counted, meta.numFeaturesPerNode(), classes), thresholds, _as_rows(spark, drawn), drawn.getNumPartitions()


def _as_rows(spark: SparkSession, drawn) -> DataFrame:
    """MLlib's drawn points as ``label, bins, draws``."""
    jvm = spark._jvm
    expr, types = jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql.types
    point = "org.apache.spark.ml.tree.impl."
    none, named = _module(spark, "scala.None"), jvm.java.lang.Class.forName

    def held(name: str):
        return types.ObjectType(named(name))

    def call(on, method: str, kind):
        return expr.objects.Invoke(on, method, kind, _seq(spark), _seq(spark), True, False, True)

    def array(on, method: str):
        ints = types.ArrayType(_module(spark, "org.apache.spark.sql.types.IntegerType"), False)
        made = named("org.apache.spark.sql.catalyst.expressions.UnsafeArrayData")
        return expr.objects.StaticInvoke(
            made, ints, "fromPrimitiveArray", _seq(spark, call(on, method, held("[I"))), _seq(spark), True, False, True, none
        )

    def alias(of, name: str):
        return expr.Alias(of, name, expr.NamedExpression.newExprId(), _seq(spark), none, _seq(spark))

    row = expr.AttributeReference(
        "row", held(f"{point}BaggedPoint"), False, types.Metadata.empty(), expr.NamedExpression.newExprId(), _seq(spark)
    )
    datum = call(row, "datum", held(f"{point}TreePoint"))
    columns = _seq(
        spark,
        alias(call(datum, "label", _module(spark, "org.apache.spark.sql.types.DoubleType")), "label"),
        alias(array(datum, "binnedFeatures"), "bins"),
        alias(array(row, "subsampleCounts"), "draws"),
    )
    session = spark._jsparkSession
    source = jvm.org.apache.spark.sql.execution.ExternalRDD(row, drawn, session)
    plan = jvm.org.apache.spark.sql.catalyst.plans.logical.Project(columns, source)
    return DataFrame(_module(spark, "org.apache.spark.sql.classic.Dataset").ofRows(session, plan), spark)


def _stored(rows: DataFrame, trees: int, parts: int, kept: type) -> DataFrame:
    """Pieces of rows as bytes: labels, bins by row, and draws by tree. Pieces of one sum lie in one file, in order."""
    columns = [f"draws_{at}" for at in range(0, trees, DRAWN_TREES)]

    def pieces(batches):
        part = TaskContext.get().partitionId()  # of MLlib's draws: no stage lies between
        for at, batch in enumerate(b for b in batches if b.num_rows):
            n = batch.num_rows
            bins = batch.column(1).flatten().to_numpy().astype(kept)
            draws = batch.column(2).flatten().to_numpy().reshape(n, trees).T
            kind = np.uint8 if draws.max(initial=0) < 256 else np.int32
            blocks = [draws[t : t + DRAWN_TREES].astype(kind).tobytes() for t in range(0, trees, DRAWN_TREES)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([at], pa.int32()),
                 pa.array([batch.column(0).to_numpy().tobytes()], pa.binary()), pa.array([bins.tobytes()], pa.binary()),
                 *(pa.array([b], pa.binary()) for b in blocks)],
                names=["part", "at", "labels", "bins", *columns],
            )

    schema = ", ".join(["part int", "at int", "labels binary", "bins binary", *(f"{c} binary" for c in columns)])
    made = rows.mapInArrow(pieces, schema)
    if parts > GROUPS:  # neighbouring parts share a sum, by their numbers alone
        made = made.repartitionById(GROUPS, F.floor(F.col("part") * GROUPS / parts).cast("int")).sortWithinPartitions("part", "at")
    spark = rows.sparkSession
    path = scratch_path(spark, "drawn")
    made.write.option("compression", "zstd").parquet(path)
    # a session of its own, where each file is a task: packed by size, they would leave most cores idle in the last wave
    apart = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for name in ("maxPartitionBytes", "openCostInBytes"):
        apart.conf.set(f"spark.sql.files.{name}", "128m")
    return apart.read.schema(made.schema).parquet(path)


# --- trees ------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes as lists; a node without split is its own left child, and no row goes to the right of it."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    turned: list[bool] = field(default_factory=list)  # the first category goes right
    left: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    impurity: list[float] = field(default_factory=list)
    gain: list[float | None] = field(default_factory=list)  # None: no valid split was found
    sums: list[list[float] | None] = field(default_factory=list)

    def add(self, depth: int, impurity: float, sums: list[float] | None) -> int:
        node = len(self.left)
        for values, x in zip(
            (self.feature, self.cut, self.turned, self.left, self.depth, self.impurity, self.gain, self.sums),
            (0, 1 << 30, False, node, depth, impurity, 0.0, sums), strict=True,
        ):
            values.append(x)
        return node

    def arrays(self, layout: Layout) -> tuple[np.ndarray, ...]:
        """For each node the column that decides (turned pairs have one of their own), its cut and the left child."""
        own = len(layout.bins) + np.cumsum(layout.paired) - 1
        feature, turned = np.array(self.feature), np.array(self.turned)
        cut = np.minimum(self.cut, np.iinfo(layout.kept).max).astype(layout.kept)
        return np.where(turned, own[feature], feature), cut, np.array(self.left)


class _Draws:
    """The features of nodes as MLlib draws them: a Java generator seeds a reservoir for each node."""

    def __init__(self, seed: int, features: int, subset: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)
        self.features, self.subset = features, subset

    def _next(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return (self.state >> 16) - ((self.state >> 47) << 32)

    def seeds(self, n: int) -> tuple[np.ndarray, list[int]]:
        """The next ``n`` seeds, and the generator's state after each."""
        found, states = np.empty(n, np.uint64), []
        for i in range(n):
            found[i] = ((self._next() << 32) + self._next()) & _MASK
            states.append(self.state)
        return found, states

    def subsets(self, seeds: np.ndarray) -> np.ndarray:
        low = _murmur(seeds, np.full(len(seeds), 0x3C074A61, np.uint32))
        state = (_murmur(seeds, low).astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)
        kept = np.tile(np.arange(self.subset), (len(seeds), 1))

        def bits(n: int) -> np.ndarray:
            nonlocal state
            state = state ^ (state << np.uint64(21))
            state ^= state >> np.uint64(35)
            state ^= state << np.uint64(4)
            return state & np.uint64((1 << n) - 1)

        for f in range(self.subset, self.features):
            share = ((bits(26) << np.uint64(27)) + bits(27)).astype(float) * 2.0**-53
            at = (share * (f + 1)).astype(np.int64)
            hit = np.flatnonzero(at < self.subset)
            kept[hit, at[hit]] = f
        return kept


def _murmur(values: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """MurmurHash3 of the eight bytes of a number, the highest first, as Scala computes it."""
    def turn(x, by):
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    h = seed.astype(np.uint32)
    for half in ((values >> np.uint64(32)).astype(np.uint32), values.astype(np.uint32)):
        k = turn(half.byteswap() * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


# --- passes -----------------------------------------------------------------------------


@dataclass
class Pass:
    """Nodes whose statistics are summed at once. A node has the bins of its features one after another, in cells."""

    layout: Layout
    tree: np.ndarray
    node: np.ndarray
    features: np.ndarray  # of each node, in MLlib's order
    impurity: np.ndarray  # NaN for a root: not known before
    steps: dict[int, int]  # of each tree: levels down to its nodes
    trees: dict[int, tuple[np.ndarray, ...]]

    def __post_init__(self):
        size = self.layout.bins[self.features]
        ends = np.cumsum(size.ravel())
        self.start = (ends - size.ravel()).reshape(size.shape)
        self.cells = int(ends[-1])
        self.block = self.start[:, 0] * self.layout.width * 8 // BLOCK_BYTES

    def _slots(self) -> dict[int, np.ndarray]:
        found = {}
        for t, (_, _, left) in self.trees.items():
            own = np.flatnonzero(self.tree == t)
            found[t] = np.full(len(left), -1)
            found[t][self.node[own]] = own
        return found

    def summed(self, batches) -> Iterator[pa.RecordBatch]:
        """``block, part, at, sums``: the statistics of each block of nodes, summed from this part and piece on."""
        layout, slots = self.layout, self._slots()
        whole = layout.subset == len(layout.bins)
        offset = np.cumsum(layout.bins) - layout.bins
        per_cell = layout.classes or 1
        features = [np.ascontiguousarray(x) for x in self.features.T]
        starts = [x * per_cell for x in self.start.T]
        sums, key = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column(0)[i].as_py()
                own = part * GROUPS // self.parts if self.parts > GROUPS else part
                if key is None or own != key[0]:
                    if sums is not None:
                        yield from self._blocks(sums, key)
                    sums, key = self._zeros(), (own, part, batch.column(1)[i].as_py())
                labels = np.frombuffer(batch.column(2)[i].as_buffer())
                n = len(labels)
                bins = np.frombuffer(batch.column(3)[i].as_buffer(), layout.kept).reshape(n, -1)
                columns = np.hstack((bins, 1 - bins[:, layout.paired]))
                lines, codes = np.arange(n) * columns.shape[1], columns.ravel()
                placed = (bins.astype(np.int64) + (offset if whole else 0)) * per_cell
                if layout.classes:
                    placed += labels.astype(np.int64)[:, None]
                placed = placed.T.copy() if whole else placed.ravel()
                for t, (feature, cut, left) in self.trees.items():
                    kept = batch.column(f"draws_{t - t % DRAWN_TREES}")[i].as_buffer()
                    block = min(DRAWN_TREES, self.n_trees - (t - t % DRAWN_TREES))
                    kind = np.uint8 if kept.size == block * n else np.int32
                    draws = np.frombuffer(kept, kind).reshape(block, -1)[t % DRAWN_TREES]
                    rows = np.flatnonzero(draws)
                    at, line = np.zeros(len(rows), np.int64), lines.take(rows)
                    for _ in range(self.steps[t]):
                        right = codes.take(line + feature.take(at)) > cut.take(at)
                        at = left.take(at)
                        at += right
                    slot = slots[t].take(at)
                    if self.steps[t]:
                        open_ = np.flatnonzero(slot >= 0)
                        rows, slot = rows.take(open_), slot.take(open_)
                    weight = draws.take(rows).astype(float)
                    values = [weight]
                    if not layout.classes:
                        label, both = labels.take(rows), np.empty(len(rows), complex)
                        both.real = weight * label
                        both.imag = both.real * label
                        values.append(both)
                    base, line = (starts[0].take(slot), None) if whole else (None, rows * len(layout.bins))
                    for k in range(layout.subset):
                        if whole:
                            cell = placed[k].take(rows)
                            cell += base
                        else:
                            cell = placed.take(line + features[k].take(slot))
                            cell += starts[k].take(slot)
                        for held, value in zip(sums, values, strict=True):
                            np.add.at(held, cell, value)
        if sums is not None:
            yield from self._blocks(sums, key)

    def _bounds(self) -> list[tuple[int, int, int]]:
        """Of each block: its number, its first node and the node after its last."""
        edge = np.flatnonzero(np.diff(self.block)) + 1
        return [(int(self.block[a]), int(a), int(b)) for a, b in zip([0, *edge], [*edge, len(self.block)], strict=True)]

    def _span(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a, 0]), int(self.start[b, 0]) if b < len(self.start) else self.cells

    def _zeros(self) -> list[np.ndarray]:
        """Counts per class; or counts, and sums with those of squares as one complex number, which takes one addition."""
        if self.layout.classes:
            return [np.zeros(self.cells * self.layout.classes)]
        return [np.zeros(self.cells), np.zeros(self.cells, complex)]

    def _blocks(self, sums: list[np.ndarray], key: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
        width = self.layout.width
        by_cell = sums[0].reshape(-1, width) if self.layout.classes else np.column_stack((sums[0], sums[1].real, sums[1].imag))
        for number, a, b in self._bounds():
            lo, hi = self._span(a, b)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32()),
                 pa.array([np.ascontiguousarray(by_cell[lo:hi]).tobytes()], pa.binary())],
                names=["block", "part", "at", "sums"],
            )

    SPLIT = "slot int, feature int, cut int, turned boolean, gain double, own array<double>, low array<double>, high array<double>"

    def split(self, table: pa.Table) -> pa.Table:
        """The best split of each node of a block; ``feature`` is -1 where none is valid."""
        layout = self.layout
        number = table.column("block")[0].as_py()
        a, b = next((a, b) for n, a, b in self._bounds() if n == number)
        lo, _ = self._span(a, b)
        pieces = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "at", "sums")), strict=True), key=lambda x: x[:2])
        total = np.frombuffer(pieces[0][2]).copy()
        for piece in pieces[1:]:
            total += np.frombuffer(piece[2])
        total = np.ascontiguousarray(total.reshape(-1, layout.width).T)
        features, start, impurity = self.features[a:b], self.start[a:b] - lo, self.impurity[a:b].copy()
        n = b - a
        best, feature, cut = np.full(n, -np.inf), np.full(n, -1), np.zeros(n, np.int64)
        turned = np.zeros(n, bool)
        low, high, own = (np.zeros((layout.width, n)) for _ in range(3))
        root = np.isnan(impurity)
        for k in range(layout.subset):
            f = features[:, k]
            for size, paired in {(int(x), bool(y)) for x, y in zip(layout.bins[f], layout.paired[f], strict=True)}:
                rows = np.flatnonzero((layout.bins[f] == size) & (layout.paired[f] == paired))
                bins = total[:, start[rows, k][:, None] + np.arange(size)]
                swap = np.zeros(len(rows), bool)
                if paired and layout.classes <= 2:
                    middle = layout.centroid(bins)
                    swap = middle[:, 1] < middle[:, 0]
                    bins = np.where(swap[:, None], bins[:, :, ::-1], bins)
                summed = np.cumsum(bins, axis=2)
                if size == 1:  # nothing to split; a root's rows are known by it
                    first = rows[root[rows] & np.isnan(impurity[rows])]
                    own[:, first] = summed[:, np.searchsorted(rows, first), 0]
                    continue
                left, right = summed[:, :, :-1], summed[:, :, -1:] - summed[:, :, :-1]
                fresh = np.flatnonzero(np.isnan(impurity[rows]))
                own[:, rows[fresh]] = left[:, fresh, 0] + right[:, fresh, 0]
                impurity[rows[fresh]] = layout.impurity(own[:, rows[fresh]])
                n_left, n_right = layout.counts(left), layout.counts(right)
                both = n_left + n_right
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = impurity[rows][:, None] - n_left / both * layout.impurity(left) - n_right / both * layout.impurity(right)
                gain = np.where((n_left >= 1) & (n_right >= 1) & (gain >= 0), gain, -np.inf)
                at = np.argmax(gain, axis=1)
                line = np.arange(len(rows))
                found = np.flatnonzero(gain[line, at] > best[rows])
                to, at = rows[found], at[found]
                best[to], feature[to], cut[to], turned[to] = gain[found, at], f[to], at, swap[found]
                low[:, to], high[:, to] = left[:, found, at], right[:, found, at]
        return pa.table({
            "slot": pa.array(np.arange(a, b), pa.int32()), "feature": pa.array(feature, pa.int32()), "cut": pa.array(cut, pa.int32()),
            "turned": pa.array(turned), "gain": pa.array(best), **{
                c: pa.array(list(x.T), pa.list_(pa.float64())) for c, x in (("own", own), ("low", low), ("high", high))
            },
        })

    def run(self, pieces: DataFrame, n_trees: int, parts: int) -> list[tuple]:
        self.n_trees, self.parts = n_trees, parts
        columns = [f"draws_{t}" for t in sorted({t - t % DRAWN_TREES for t in self.trees})]
        made = pieces.select("part", "at", "labels", "bins", *columns)
        made = made.mapInArrow(self.summed, "block int, part int, at int, sums binary")
        found = made.groupBy("block").applyInArrow(lambda table: self.split(table), self.SPLIT).toArrow()
        return sorted(zip(*(found.column(c).to_pylist() for c in found.column_names), strict=True))


# --- growing ----------------------------------------------------------------------------


def fit(forest: Estimator, data: DataFrame, few: DataFrame, classes: int = 0) -> Model:
    """``forest.fit(data)``. ``few`` are some rows of the same columns; ``classes`` counts the labels of a classification."""
    ship_package(data.sparkSession)
    prepared = _prepared(forest, data, classes)
    if prepared is None or (prepared[0].bins == 1).all():
        return forest.fit(data)
    layout, thresholds, rows, parts = prepared
    pieces = _stored(rows, forest.getNumTrees(), parts, layout.kept)
    return _model(forest, few, layout, thresholds, grow(forest, layout, pieces, parts))


def grow(forest: Estimator, layout: Layout, pieces: DataFrame, parts: int) -> list[Tree]:
    trees = [Tree() for _ in range(forest.getNumTrees())]
    draws = _Draws(forest.getSeed(), len(layout.bins), layout.subset)
    deepest = forest.getMaxDepth()
    waiting = [(t, tree.add(0, np.nan, None)) for t, tree in enumerate(trees)]  # taken from the end, as MLlib does
    while waiting:
        chosen, features = _chosen(waiting, layout, draws, forest.getMaxMemoryInMB() << 20)
        found = {}
        for one in _passes(trees, chosen, features, layout):
            for slot, *split in one.run(pieces, len(trees), parts):
                found[int(one.tree[slot]), int(one.node[slot])] = split
        for t, node in _in_order(pieces.sparkSession, chosen, layout):
            feature, cut, turned, gain, own, low, high = found[t, node]
            tree = trees[t]
            if tree.sums[node] is None:
                tree.sums[node] = own
                tree.impurity[node] = float(layout.impurity(np.array(own)))
            tree.gain[node] = None if feature < 0 else gain
            if feature < 0 or gain <= 0 or tree.depth[node] == deepest:
                continue
            depth = tree.depth[node] + 1
            sides = [(float(layout.impurity(np.array(x))), x) for x in (low, high)]
            children = [tree.add(depth, impurity, sums) for impurity, sums in sides]
            tree.feature[node], tree.cut[node], tree.turned[node], tree.left[node] = feature, cut, turned, children[0]
            waiting += [(t, c) for c, (impurity, _) in zip(children, sides, strict=True) if depth < deepest and abs(impurity) >= EPSILON]
    return trees


def _chosen(waiting: list[tuple[int, int]], layout: Layout, draws: _Draws, memory: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The next nodes and their features. Drawn features follow the order and size of MLlib's passes; else all nodes are next."""
    n = len(waiting)
    chosen = waiting[::-1]
    if layout.subset == len(layout.bins):
        waiting.clear()
        return chosen, np.tile(np.arange(layout.subset), (n, 1))
    seeds, states = draws.seeds(n)
    features = draws.subsets(seeds)
    used = np.cumsum(layout.counted[features].sum(axis=1) * layout.width * 8)
    taken = max(1, int(np.searchsorted(used, memory, "right")))
    draws.state = states[min(taken, n - 1)]  # the node that no longer fits has drawn too
    del waiting[n - taken :]
    return chosen[:taken], features[:taken]


def _in_order(spark: SparkSession, chosen: list[tuple[int, int]], layout: Layout) -> list[tuple[int, int]]:
    """The nodes by tree, in the order in which Scala's map of a pass returns its trees."""
    by_tree: dict[int, list[tuple[int, int]]] = {}
    for t, node in chosen:
        by_tree.setdefault(t, []).append((t, node))
    order = list(by_tree)
    if layout.subset < len(layout.bins):
        held = spark._jvm.scala.collection.mutable.HashMap()
        for t in order:
            held.put(t, t)
        kept = getattr(_module(spark, "scala.collection.immutable.Map"), "from")(held)
        order = [int(t) for t in kept.keysIterator().mkString(",").split(",")]
    return [x for t in order for x in by_tree[t]]


def _passes(trees: list[Tree], chosen: list[tuple[int, int]], features: np.ndarray, layout: Layout) -> Iterator[Pass]:
    order = sorted(range(len(chosen)), key=lambda i: chosen[i])
    size = layout.bins[features].sum(axis=1) * layout.width * 8
    at = 0
    while at < len(order):
        to = at + max(1, int(np.searchsorted(np.cumsum(size[order[at:]]), PASS_BYTES, "right")))
        own = order[at:to]
        tree, node = np.array([chosen[i] for i in own]).T
        yield Pass(
            layout, tree, node, features[own], np.array([trees[t].impurity[x] for t, x in zip(tree, node, strict=True)]),
            {int(t): max(trees[t].depth[x] for x in node[tree == t]) for t in np.unique(tree)},
            {int(t): trees[t].arrays(layout) for t in np.unique(tree)},
        )
        at = to


# --- the model --------------------------------------------------------------------------

_NODE = pa.struct([
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
    ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
    ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])),
])


def _nodes(tree: Tree, layout: Layout, thresholds: list[list[float]]) -> list[dict]:
    """The nodes as MLlib stores them, numbered from the root leftwards; two leaves that predict alike are one."""
    count = len(tree.left)
    predicted = [layout.prediction(x) for x in tree.sums]
    leaf = [tree.left[i] == i for i in range(count)]
    for i in reversed(range(count)):  # children come after their parent
        if not leaf[i]:
            a, b = tree.left[i], tree.left[i] + 1
            if leaf[a] and leaf[b] and predicted[a] == predicted[b]:
                leaf[i], predicted[i] = True, predicted[a]
    found: list[dict] = []
    waiting: list[tuple[int, dict | None]] = [(0, None)]
    while waiting:
        i, above = waiting.pop()
        number = len(found)
        if above is not None:
            above["rightChild"] = number
        sums, split = tree.sums[i], {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}
        f = tree.feature[i]
        if not leaf[i]:
            side = [float(tree.turned[i])] if layout.paired[f] else [thresholds[f][tree.cut[i]]]
            split = {"featureIndex": f, "leftCategoriesOrThreshold": side, "numCategories": 2 if layout.paired[f] else -1}
        found.append({
            "id": number, "prediction": predicted[i], "impurity": -1.0 if tree.gain[i] is None else tree.impurity[i],
            "impurityStats": list(sums), "rawCount": int(sum(sums) if layout.classes else sums[0]),
            "gain": -1.0 if leaf[i] else tree.gain[i], "leftChild": -1 if leaf[i] else number + 1, "rightChild": -1, "split": split,
        })
        if not leaf[i]:
            waiting += [(tree.left[i] + 1, found[-1]), (tree.left[i], None)]
    return found


def _model(forest: Estimator, few: DataFrame, layout: Layout, thresholds: list[list[float]], trees: list[Tree]) -> Model:
    """A forest fitted to ``few`` rows gives the frame; its trees are exchanged in MLlib's stored form."""
    spark = few.sparkSession
    path = scratch_path(spark, "forest")
    forest.fit(few).write().save(path)
    nodes = [(t, x) for t, tree in enumerate(trees) for x in _nodes(tree, layout, thresholds)]
    table = pa.table({"treeID": pa.array([t for t, _ in nodes], pa.int32()), "nodeData": pa.array([x for _, x in nodes], _NODE)})
    spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/data")
    kind = RandomForestClassificationModel if isinstance(forest, RandomForestClassifier) else RandomForestRegressionModel
    found = kind.load(path)
    found.stored_nodes = table
    return found


# --- predictions ------------------------------------------------------------------------


@dataclass(frozen=True)
class Walk:
    """All nodes of a forest; the two children of a node lie side by side, the one for low values first."""

    roots: list[int]
    depth: list[int]
    feature: np.ndarray
    cut: np.ndarray  # infinite for a leaf, which is its own low child
    low: np.ndarray
    value: np.ndarray  # a number, or the share of each class

    def leaves(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """The leaf of every row in each tree. What is not a number goes right, as in MLlib."""
        values = np.where(np.isnan(rows), np.inf, rows).ravel()
        first = np.arange(len(rows)) * rows.shape[1]
        for root, depth in zip(self.roots, self.depth, strict=True):
            at = np.full(len(rows), root)
            for _ in range(depth):
                high = values.take(first + self.feature.take(at)) > self.cut.take(at)
                at = self.low.take(at)
                at += high
            yield at

    def predicted(self, rows: np.ndarray) -> np.ndarray:
        """The prediction of every row, and before it the shares of the votes of a classification."""
        total = np.zeros((len(rows), *self.value.shape[1:]))
        for at in self.leaves(rows):
            total += self.value.take(at, axis=0)
        if total.ndim == 1:
            return (total / len(self.roots))[:, None]
        votes = np.zeros(len(rows))
        for one in total.T:
            votes += one
        with np.errstate(invalid="ignore"):
            shares = np.where(votes[:, None] == 0, total, total / votes[:, None])
        return np.column_stack((shares, total.argmax(axis=1)))


def _walk(model: Model, spark: SparkSession) -> Walk | None:
    """The nodes of a model, or None if one has more than two categories."""
    table = getattr(model, "stored_nodes", None)
    if table is None:
        path = scratch_path(spark, "forest")
        model.write().save(path)
        table = spark.read.parquet(f"{path}/data").toArrow()
    nodes = table.column("nodeData").combine_chunks()
    split = nodes.field("split")
    tree, number, left, right, feature, categories = (
        x.to_numpy() for x in (table.column("treeID"), nodes.field("id"), nodes.field("leftChild"), nodes.field("rightChild"),
                               split.field("featureIndex"), split.field("numCategories"))
    )
    if (categories > 2).any():
        return None
    stats = np.array(nodes.field("impurityStats").to_pylist())
    if isinstance(model, RandomForestClassificationModel):
        with np.errstate(invalid="ignore"):
            value = stats / stats.sum(axis=1, keepdims=True)
        value[stats.sum(axis=1) == 0] = 0
    else:
        value = nodes.field("prediction").to_numpy()
    cuts = split.field("leftCategoriesOrThreshold").to_pylist()
    of = {(int(t), int(i)): at for at, (t, i) in enumerate(zip(tree, number, strict=True))}
    order, low, roots, depths = [], [], [], []
    for t in sorted(set(tree.tolist())):
        roots.append(len(order))
        order.append(of[t, 0])
        at, level, deepest = roots[-1], {roots[-1]: 0}, 0
        while at < len(order):
            row = order[at]
            if left[row] < 0:
                low.append(at)
            else:
                low.append(len(order))
                sides = [of[t, int(left[row])], of[t, int(right[row])]]
                deepest = max(deepest, level[at] + 1)
                level[len(order)] = level[len(order) + 1] = level[at] + 1
                order += sides[::-1] if categories[row] == 2 and cuts[row] == [1.0] else sides
            at += 1
        depths.append(deepest)
    leaf = left[order] < 0
    cut = np.array([np.inf if x else 0.5 if categories[i] == 2 else cuts[i][0] for i, x in zip(order, leaf, strict=True)])
    return Walk(roots, depths, np.where(leaf, 0, feature[order]).astype(np.int64), cut, np.array(low), value[order])


def transform(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``model.transform(df)`` with ``prediction``, and ``_probabilities`` of a classification; tree after tree over many rows.

    Wide features, which are sparse, are left to MLlib.
    """
    ship_package(df.sparkSession)
    place, forest = next((i, s) for i, s in enumerate(model.stages) if hasattr(s, "featureImportances"))
    classifies = isinstance(forest, RandomForestClassificationModel)
    taken = {"prediction", "probability", "rawPrediction"} & set(df.columns)
    walk = None if taken or forest.numFeatures > WIDE else _walk(forest, df.sparkSession)
    if walk is None:
        made = model.transform(df)
        return made.withColumn("_probabilities", vector_to_array("probability")) if classifies else made

    @F.arrow_udf("array<double>")
    def predicted(features: pa.Array) -> pa.Array:
        found = walk.predicted(features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1))
        return pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float64()))

    made = PipelineModel(model.stages[:place]).transform(df)
    made = made.withColumn("_predicted", predicted(vector_to_array("features")))
    made = made.withColumn("prediction", F.element_at("_predicted", -1))
    if classifies:
        made = made.withColumn("_probabilities", F.slice("_predicted", 1, forest.numClasses))
    return PipelineModel(model.stages[place + 1 :]).transform(made)
