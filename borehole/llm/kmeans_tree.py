"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a sample of at most ``SAMPLE`` vectors (those with the smallest hash of
their id) and is small enough to share; every row is then put into a leaf. A query visits leaves
in the order of a priority queue over the tree's nodes, best centroid first. How many leaves is
calibrated: the true neighbours of at most ``CALIBRATION`` queries are found by brute force over
all rows, and the visits are widened until the share of true neighbours in visited leaves reaches
``RECALL``. Neighbouring leaves share a bin; a query goes once to each bin with the leaves it visits
there, and k rows come back. Bins and their queries are dealt in parts of bounded size, so a leaf
may hold any share of the rows; copies of a vector are scored once.

Nearness is the inner product in double precision, of the vectors as given; ties go to the smaller
id, and a query's own id is no candidate. Vectors that are null, hold null or non-finite
components, have only zeros, or a length other than the commonest take no part; repeated ids count
once. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from borehole.llm.hamming import usable_vectors
from borehole.session import materialise, ship_package

SAMPLE = 16_384
#: Vectors of the table per leaf that the tree aims at, and sampled vectors per leaf at least.
LEAF_ROWS = 256
LEAF_SAMPLE = 16
BRANCH = 8
CALIBRATION = 256
RECALL = 0.97
PART = 1 << 16
ASK = 512


@dataclass
class Tree:
    """Nodes by number; ``children`` of a leaf is empty and ``leaf`` its number."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector, down the nearest centres."""
        out = np.zeros(len(vectors), np.int64)
        work = [(0, np.arange(len(vectors)))]
        while work:
            node, rows = work.pop()
            kids = self.children[node]
            if not len(kids):
                out[rows] = self.leaf[node]
                continue
            best = nearest(vectors[rows], self.centres[kids])
            work.extend((int(kid), rows[best == i]) for i, kid in enumerate(kids) if (best == i).any())
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves of a best-bin-first walk."""
        near = self.centres @ query
        heap, out = [(0.0, 0)], []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if len(kids):
                for kid in kids.tolist():
                    heapq.heappush(heap, (-near[kid], kid))
            else:
                out.append(int(self.leaf[node]))
        return out


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * vectors @ centres.T).argmin(axis=1)


def grow(sample: np.ndarray, leaves: int, seed: int = 20260104) -> Tree:
    """Split the fullest node by k-means until there are enough leaves."""
    rng = np.random.default_rng(seed)
    centres, children = [sample.mean(axis=0)], [np.zeros(0, np.int64)]
    heap = [(-len(sample), 0, np.arange(len(sample)))]
    done = 1
    while heap and done < leaves:
        size, node, rows = heapq.heappop(heap)
        if -size < 2 * LEAF_SAMPLE:
            break
        points = np.unique(sample[rows], axis=0)
        k = min(BRANCH, len(points), leaves - done + 1)
        if k < 2:
            continue
        own = points[rng.choice(len(points), k, replace=False)]
        for _ in range(12):
            best = nearest(sample[rows], own)
            own = np.stack([sample[rows[best == i]].mean(axis=0) if (best == i).any() else own[i] for i in range(k)])
        best = nearest(sample[rows], own)
        kept = [i for i in range(k) if (best == i).any()]
        if len(kept) < 2:
            continue
        kids = []
        for i in kept:
            kids.append(len(centres))
            centres.append(own[i])
            children.append(np.zeros(0, np.int64))
            part = rows[best == i]
            heapq.heappush(heap, (-len(part), kids[-1], part))
        children[node] = np.array(kids)
        done += len(kept) - 1
    leaf = np.full(len(centres), -1, np.int64)
    ends = [i for i, c in enumerate(children) if not len(c)]
    leaf[ends] = np.arange(len(ends))
    return Tree(np.stack(centres), children, leaf)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1))


def best_of(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
    leaf: np.ndarray | None = None, asked: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best; equal vectors are scored once.

    With the ``leaf`` of each row, ``asked`` holds pairs of a query's position (rising) and a leaf: a query then sees only the
    rows of its leaves. All leaves are scored into one table, so a query's best are picked once and not leaf by leaf.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
    # copies that rounding put into two leaves are two
    cells = vectors if leaf is None else np.column_stack([vectors, leaf[order]])
    raw = cells.view(f"V{cells.shape[1] * 8}").ravel()
    _, first, which = np.unique(raw, return_index=True, return_inverse=True)
    by = np.argsort(which, kind="stable")
    begin = np.searchsorted(which[by], np.arange(len(first)))
    end = np.append(begin[1:], len(by))
    if leaf is not None:
        place = leaf[order][first]
        along = np.argsort(place, kind="stable")
        first, begin, end, place = first[along], begin[along], end[along], place[along]
    own = vectors[first]
    out = []
    for at in range(0, len(queries), 128):
        q = queries[at : at + 128]
        if leaf is None:
            rough = q @ own.T
        else:
            rough = np.full((len(q), len(own)), -np.inf)
            pairs = slice(*np.searchsorted(asked[0], (at, at + len(q))))
            who, of = asked[0][pairs] - at, asked[1][pairs]
            together = np.argsort(of, kind="stable")
            for mine in np.split(together, np.flatnonzero(np.diff(of[together])) + 1) if len(of) else ():
                here = slice(*np.searchsorted(place, (of[mine[0]], of[mine[0]] + 1)))
                rough[who[mine], here] = q[who[mine]] @ own[here].T
        wanted = min(k + 1, len(own))
        cut = np.partition(rough, len(own) - wanted, axis=1)[:, len(own) - wanted]
        least = np.where(np.isfinite(cut), cut - 1e-9 * (1 + np.abs(cut)), -np.inf)
        for i in range(len(q)):
            near = np.flatnonzero((rough[i] >= least[i]) & (rough[i] > -np.inf))
            if not len(near):
                continue
            score = (own[near] * q[i]).sum(axis=1)
            found, points = [], []
            for n, s in zip(near.tolist(), score.tolist(), strict=True):
                same = ids[by[begin[n] : min(begin[n] + k + 1, end[n])]]
                found.append(same)
                points.append(np.full(len(same), s))
            found, points = np.concatenate(found), np.concatenate(points)
            ok = found != query_ids[at + i]
            found, points = found[ok], points[ok]
            top = np.lexsort((found, -points))[:k]
            out.append((np.full(len(top), query_ids[at + i]), found[top], points[top]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def in_bins(sizes: list[int]) -> tuple[list[int], list[int]]:
    """The bin of each leaf, of at most ``PART`` rows unless one leaf has more, and each bin's parts."""
    bins, held = [], [0]
    for n in sizes:
        if held[-1] and held[-1] + n > PART:
            held.append(0)
        held[-1] += n
        bins.append(len(held) - 1)
    return bins, [max(1, -(-n // PART)) for n in held]


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def true_neighbours(vectors: DataFrame, queries: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` of a bounded set of queries, by brute force over all rows."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        ids, asked = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                out = best_of(part.column(0).to_numpy(), _matrix(part.column(1)), ids, asked, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["query_id", "vec_id", "score"])

    found = vectors.select("vec_id", "vector").mapInArrow(run, "query_id long, vec_id long, score double")
    return _top(found, k)


def calibrate(tree: Tree, leaves: DataFrame, k: int, recall: float) -> int:
    """The fewest leaf visits that hold the wanted share of true neighbours."""
    picked = leaves.where("vec_id % 20 = 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION)
    table = picked.select("vec_id", "vector").toArrow()
    if not table.num_rows:
        return 1
    ids, asked = table.column("vec_id").to_numpy(), _matrix(table.column("vector"))
    truth = true_neighbours(leaves, (ids, asked), k).join(leaves.select("vec_id", "leaf"), "vec_id")
    rows = truth.select("query_id", "leaf").toArrow()
    place = {int(q): {leaf: i for i, leaf in enumerate(tree.visits(v, tree.leaves))} for q, v in zip(ids, asked, strict=True)}
    ranks = sorted(
        place[q][leaf] for q, leaf in zip(rows["query_id"].to_pylist(), rows["leaf"].to_pylist(), strict=True)
    )
    if not ranks:
        return 1
    visits = 1
    while visits < tree.leaves and np.searchsorted(ranks, visits) < recall * len(ranks):
        visits += 1
    return visits


def nearest_vectors(
    table: DataFrame, k: int = 20, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: every row whose id is divisible by 20 against all rows."""
    spark = table.sparkSession
    ship_package(spark)
    vectors = materialise(usable_vectors(table, id_col, vector_col), "vectors")
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    sample = _matrix(picked.column("vector"))
    wanted = min(-(-vectors.count() // LEAF_ROWS), max(1, len(sample) // LEAF_SAMPLE))
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = grow(sample, wanted)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.assign(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["vec_id", "vector", "leaf"])

    leaves = materialise(vectors.mapInArrow(place, "vec_id long, vector array<double>, leaf long"), "leaves")
    visits = calibrate(tree, leaves, k, recall)

    # a row per leaf; the tree bounds their number
    sizes = {r["leaf"]: r["count"] for r in leaves.groupBy("leaf").count().collect()}
    bins, parts = in_bins([sizes.get(i, 0) for i in range(tree.leaves)])

    def ask(batches):
        for batch in batches:
            rows, bin_, seen = [], [], []
            for row, vector in enumerate(_matrix(batch.column(1)) if batch.num_rows else ()):
                own: dict[int, list[int]] = {}
                for leaf in shared.value.visits(vector, visits):
                    own.setdefault(bins[leaf], []).append(leaf)
                rows += [row] * len(own)
                bin_ += own.keys()
                seen += own.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(bin_, pa.int64()),
                 pa.array(seen, pa.list_(pa.int64()))],
                names=["query_id", "query", "bin", "seen"],
            )

    queries = leaves.where("vec_id % 20 = 0").select("vec_id", "vector")
    queries = materialise(
        queries.mapInArrow(ask, "query_id long, query array<double>, bin long, seen array<long>"), "asked"
    )
    counts = {r["bin"]: r["count"] for r in queries.groupBy("bin").count().collect()}  # a row per bin
    asks = [-(-counts.get(b, 0) // ASK) for b in range(len(parts))]

    def of(values: list[int], at: str):
        return F.get(F.array(*[F.lit(v) for v in values]), F.col(at).cast("int"))

    def numbers(n):
        return F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))

    left = leaves.withColumn("bin", of(bins, "leaf").cast("long"))
    left = (
        left.withColumn("part", F.pmod(F.xxhash64("vec_id"), of(parts, "bin")).cast("int"))
        .withColumn("ask", numbers(of(asks, "bin")))
        .select("bin", "part", "ask", "leaf", "vec_id", "vector")
    )
    right = (
        queries.withColumn("ask", F.pmod(F.xxhash64("query_id"), of(asks, "bin")).cast("int"))
        .withColumn("part", numbers(of(parts, "bin")))
        .select("bin", "part", "ask", "query_id", "query", "seen")
    )

    def score(key: tuple[pa.Scalar, ...], own: pa.Table, asked: pa.Table) -> pa.Table:
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if own.num_rows and asked.num_rows:
            leaf, ids, vectors = own.column("leaf").to_numpy(), own.column("vec_id").to_numpy(), _matrix(own.column("vector"))
            query_ids, points = asked.column("query_id").to_numpy(), _matrix(asked.column("query"))
            seen = asked.column("seen").combine_chunks()
            who, which = np.repeat(np.arange(len(query_ids)), np.diff(seen.offsets.to_numpy())), seen.flatten().to_numpy()
            out = best_of(ids, vectors, query_ids, points, k, leaf, (who, which))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, out), strict=True)))

    by = ("bin", "part", "ask")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(score, "query_id long, vec_id long, score double")
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
