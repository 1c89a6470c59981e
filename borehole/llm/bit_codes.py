"""Hard negatives by rotated one-bit codes whose error has a hard bound.

A vector x is turned into ``EXPAND`` times as many dimensions by orthonormal columns, and its code b is the sign of
each. With s the part of b that lies in the space of the turned vectors, ``x = a s + r``, r at right angles to s; a, the
length of s and the length of r are stored beside the code. A query q is turned too and rounded to ``PLANES`` bits, so that
``<b, q>`` is a few popcounts, right to within the summed rounding errors of q. Then ``<x, q> = a <b, q> + <r, q>``,
and by Cauchy-Schwarz the last term is at most ``|r| sqrt(|q|^2 - (<b, q> / |s|)^2)``. That gives each row a certain
interval for its score. Rows are scored in whole numbers in the order of their upper ends, and the search ends where the upper
end can't beat the k-th score found; in a search for scores in a range, rows whose interval misses all ranges are
left out. So results are exact.

Two searches: the first finds an anchor's positives among the rows of its label, dealt into blocks per label; the second
finds the negatives in blocks of all rows. Each block meets the anchors in groups, both of bounded size, and the best of all
blocks are merged per anchor. Copies of a vector are rows like others: a hot vector is spread over the blocks by id.

* Rows without id or label, and those whose vector is null, empty or holds null or non-finite components, take no
  part. Equal rows count once. An id with several vectors or labels is several rows, none of them a candidate of the
  others; as an anchor, each has its own result.
* Ties go to the smaller id. Fewer rows than asked for: all there are. An empty table, or one without anchors, gives no rows.
* Vectors of several lengths raise ``ValueError``, and scores beyond 64 bits ``OverflowError``. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borehole.llm.integer_vectors import EXACT_DOUBLE, integer_rows, matrix, one_length
from borehole.session import materialise, ship_package

#: Code bits per component, and bits of a rounded query component.
EXPAND, PLANES = 4, 6
#: Components of the vectors in one block at most; rows of a block at least, and blocks aimed at.
BLOCK_COMPONENTS, LEAST_ROWS, BLOCKS = 1 << 22, 1024, 64
#: Anchors of one group.
ASK = 2048
#: Pairs of query and row whose intervals a task holds at once, and rows scored before the next look at the bound.
PAIRS, STEP = 1 << 20, 256
#: Allowance for rounding, as a share of the product of the lengths.
SLACK = 1e-9


def rotation(dims: int, expand: int = EXPAND, seed: int = 20260203) -> np.ndarray:
    """``dims`` orthonormal columns, the same in every task."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dims * expand, dims)))[0]


@dataclass
class Codes:
    """Codes as 64-bit words, with the factor ``a`` and the lengths of ``s`` and ``r`` (see above)."""

    words: np.ndarray
    scale: np.ndarray
    span: np.ndarray
    rest: np.ndarray


def encode(x: np.ndarray, turn: np.ndarray) -> Codes:
    bits = x @ turn.T > 0
    signs = np.where(bits, 1.0, -1.0)
    inside = signs @ turn
    square = np.einsum("ij,ij->i", inside, inside)
    scale = np.einsum("ij,ij->i", inside, x) / square
    rest = np.linalg.norm(x - scale[:, None] * inside, axis=1)
    packed = np.packbits(bits, axis=1, bitorder="little")
    packed = np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))))
    return Codes(packed.view(np.uint64), scale, np.sqrt(square), rest)


def intervals(codes: Codes, queries: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of every query's (rows) score with every code (columns)."""
    z = queries @ turn.T
    low = z.min(axis=1)
    step = np.maximum((z.max(axis=1) - low) / ((1 << PLANES) - 1), 1e-300)
    rounded = np.rint((z - low[:, None]) / step[:, None]).astype(np.int64)
    off = np.abs(z - low[:, None] - step[:, None] * rounded).sum(axis=1)
    count = np.zeros((len(z), len(codes.words)))
    for j in range(PLANES):
        plane = np.packbits((rounded >> j) & 1, axis=1, bitorder="little")
        plane = np.ascontiguousarray(np.pad(plane, ((0, 0), (0, -plane.shape[1] % 8)))).view(np.uint64)
        for word in range(plane.shape[1]):
            count += np.bitwise_count(codes.words[None, :, word] & plane[:, word, None]) * float(1 << j)
    ones = np.bitwise_count(codes.words).sum(axis=1)
    # <b, q> with b of signs: twice the sum over the ones, less the sum over all
    along = low[:, None] * (2.0 * ones - z.shape[1]) + step[:, None] * (2 * count - rounded.sum(axis=1)[:, None])
    length = np.linalg.norm(queries, axis=1)
    least = np.maximum(np.abs(along) - off[:, None], 0) / codes.span
    across = codes.rest * np.sqrt(np.maximum(length[:, None] ** 2 - least**2, 0))
    own = np.hypot(codes.scale * codes.span, codes.rest)
    half = across + np.abs(codes.scale) * off[:, None] + SLACK * (1 + length[:, None] * own)
    return codes.scale * along - half, codes.scale * along + half


def products(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers with one."""
    bound = int(np.abs(x).max(initial=0)) * int(np.abs(query).sum())
    if bound < EXACT_DOUBLE:
        return (x.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if bound >= 1 << 63:
        raise OverflowError("scores exceed 64 bits")
    return x @ query


def best_in_ranges(
    x: np.ndarray, ids: np.ndarray, query: np.ndarray, low: np.ndarray, high: np.ndarray, ranges: list[tuple[int, int]], k: int
) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], int]:
    """Per range of scores (both ends in it) its ``k`` best rows: (number, ids, scores); and how many rows were scored.

    ``low`` and ``high`` are the rows' intervals; a row out of all of them is never scored.
    """
    open_ = [i for i, (a, b) in enumerate(ranges) if a <= b]
    if not open_ or not len(x):
        return [], 0
    a, b = (np.array([ranges[i][end] for i in open_], np.float64) for end in (0, 1))
    near = np.flatnonzero((high >= a.min()) & (low <= b.max()))
    near = near[np.argsort(-high[near], kind="stable")]
    best = {i: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for i in open_}
    least = a.copy()  # a row must reach this to matter to a range
    done = 0
    while done < len(near):
        # rows come by falling upper end: what none of the ranges can use ends the search
        if high[near[done]] < least.min():
            break
        rows = near[done : done + STEP]
        done += len(rows)
        score = products(x[rows], query)
        for at, i in enumerate(open_):
            fits = (score >= ranges[i][0]) & (score <= ranges[i][1])
            if fits.any():
                found, points = np.r_[best[i][0], ids[rows[fits]]], np.r_[best[i][1], score[fits]]
                top = np.lexsort((found, -points))[:k]
                best[i] = (found[top], points[top])
                if len(top) == k:
                    least[at] = max(a[at], points[top][-1])
    return [(i, *best[i]) for i in open_ if len(best[i][0])], done


def _codes_of(table: pa.Table) -> Codes:
    words = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint64).reshape(table.num_rows, -1)
    return Codes(words, *(table.column(c).to_numpy() for c in ("scale", "span", "rest")))


def _slice(codes: Codes, rows: np.ndarray) -> Codes:
    return Codes(codes.words[rows], codes.scale[rows], codes.span[rows], codes.rest[rows])


def _chunks(queries: int, rows: int):
    step = max(1, PAIRS // max(rows, 1))
    return ((at, min(at + step, queries)) for at in range(0, queries, step))


_FOUND = "anchor_id long, variant long, positive int, vec_id long, score long"
_NAMES = ["anchor_id", "variant", "positive", "vec_id", "score"]


def _table(out: list[tuple]) -> pa.Table:
    """Rows of (anchor, variant, number, ids, scores) as a table."""
    sizes = [len(o[3]) for o in out]
    columns = [np.repeat(np.array([o[c] for o in out], np.int64), sizes) for c in range(3)]
    columns[2] = columns[2].astype(np.int32)
    columns += [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in (3, 4)]
    return pa.table(dict(zip(_NAMES, map(pa.array, columns), strict=True)))


def _search(left: DataFrame, right: DataFrame, by: list[str], turn: np.ndarray, k: int, negatives: tuple[int, int] | None) -> DataFrame:
    """The best rows of each block for each anchor of a group; ``negatives`` is the range in percent of a positive's score."""
    shared = left.sparkSession.sparkContext.broadcast(turn)

    def run(_key: tuple[pa.Scalar, ...], own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and asked.num_rows:
            x, ids, codes = matrix(own.column("x")), own.column("vec_id").to_numpy(), _codes_of(own)
            labels = np.array(own.column("label").to_pylist(), object)
            queries, anchors = matrix(asked.column("anchor")), asked.column("anchor_id").to_numpy()
            variants, their = asked.column("variant").to_numpy(), asked.column("anchor_label").to_pylist()
            scores = asked.column("scores").to_pylist() if negatives else None
            for first, last in _chunks(len(queries), len(x)):
                low, high = intervals(codes, queries[first:last].astype(np.float64), shared.value)
                for at in range(first, last):
                    same = labels == their[at]
                    rows = np.flatnonzero((~same if negatives else same) & (ids != anchors[at]))
                    lo, hi = low[at - first, rows], high[at - first, rows]
                    if negatives:
                        # whole scores in [p a / 100, p b / 100]
                        ranges = [(-(-p * negatives[0] // 100), p * negatives[1] // 100) for p in scores[at]]
                    else:
                        ranges = [(-(1 << 62), 1 << 62)]
                    best, _ = best_in_ranges(x[rows], ids[rows], queries[at], lo, hi, ranges, k)
                    out += [(anchors[at], variants[at], i, found, points) for i, found, points in best]
        return _table(out)

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, _FOUND)


def _numbers(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def hard_negatives(
    table: DataFrame, label: str | Column = "label", anchors: Column | None = None, positives: int = 5, negatives: int = 3,
    least: int = 50, most: int = 95, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on the table (default: id divisible by 50). A negative has another label than its anchor and
    from ``least`` to ``most`` percent of the positive's score.
    """
    spark = table.sparkSession
    ship_package(spark)
    of = F.col(label) if isinstance(label, str) else label
    asks_for = F.pmod(F.col(id_col), F.lit(50)) == 0 if anchors is None else anchors
    usable = table.where(F.col(id_col).isNotNull() & of.isNotNull())
    rows = integer_rows(usable, id_col, vector_col, of.cast("string").alias("label"), asks_for.alias("asks"))
    rows = rows.withColumn("vec_id", F.col("vec_id").cast("long")).distinct()
    dims = one_length(rows)
    turn = rotation(dims) if dims else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(turn)

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                made = encode(matrix(batch.column(1)).astype(np.float64), shared.value)
                words = [row.tobytes() for row in made.words]
                columns = [pa.array(words, pa.binary()), *map(pa.array, (made.scale, made.span, made.rest))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    names = [*rows.columns, "code", "scale", "span", "rest"]
    schema = "vec_id long, x array<long>, label string, asks boolean, code binary, scale double, span double, rest double"
    coded = materialise(rows.mapInArrow(code, schema), "codes")
    size = min(max(LEAST_ROWS, -(-coded.count() // BLOCKS)), max(1, BLOCK_COMPONENTS // max(dims, 1)))

    def parts(n: Column, each: int) -> Column:
        return F.greatest(F.ceil(n / each), F.lit(1).cast("long"))

    held = ["vec_id", "x", "label", "code", "scale", "span", "rest"]
    asking = coded.where("asks").select(
        F.col("vec_id").alias("anchor_id"), F.col("x").alias("anchor"), F.col("label").alias("anchor_label"),
        F.xxhash64("x", "label").alias("variant"),
    )
    spread = F.xxhash64("vec_id", "x")
    spread_anchors = F.xxhash64("anchor_id", "anchor")
    of_anchor = asking.columns
    asked = [F.count(F.lit(1)).alias("rows"), F.count_if("asks").alias("anchors")]
    per_label = coded.groupBy("label").agg(*asked).where("anchors > 0")
    per_label = materialise(
        per_label.select("label", parts(F.col("rows"), size).alias("parts"), parts(F.col("anchors"), ASK).alias("groups")),
        "labels",
    )
    left = coded.join(per_label, "label").withColumn("part", F.pmod(spread, F.col("parts")))
    left = left.select(*held, F.col("label").alias("own"), "part", _numbers(F.col("groups")).alias("ask"))
    right = asking.join(per_label.withColumnRenamed("label", "own"), F.col("anchor_label") == F.col("own"))
    right = right.withColumn("ask", F.pmod(spread_anchors, F.col("groups")))
    right = right.select(*of_anchor, "own", "ask", _numbers(F.col("parts")).alias("part"))
    found = _search(left, right, ["own", "part", "ask"], turn, positives, None)
    anchor = ["anchor_id", "variant"]
    order = Window.partitionBy(*anchor).orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    listed = F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score")))
    chosen = best.groupBy(*anchor).agg(listed.alias("list"))
    chosen = materialise(chosen, "positives")

    whole = coded.agg(*asked).first()
    blocks, groups = max(1, -(-whole["rows"] // size)), max(1, -(-whole["anchors"] // ASK))
    left = coded.withColumn("part", F.pmod(spread, F.lit(blocks))).select(
        *held, "part", _numbers(F.lit(groups).cast("long")).alias("ask")
    )
    right = asking.join(chosen, anchor).withColumn("ask", F.pmod(spread_anchors, F.lit(groups)))
    right = right.select(
        *of_anchor, F.col("list.score").alias("scores"), "ask", _numbers(F.lit(blocks).cast("long")).alias("part")
    )
    found = _search(left, right, ["part", "ask"], turn, negatives, (least, most))
    order = Window.partitionBy(*anchor, "positive").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    positive = F.get("list", F.col("positive"))
    return best.join(chosen, anchor).select(
        "anchor_id", positive["vec_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )
