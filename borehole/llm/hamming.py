"""Exact top-k search of binary codes by incremental multi-index hashing.

A code is the sign bits of a vector, cut into segments of about 16 bits. The codes are dealt into
blocks of bounded size; in each block every segment has a table from its value to the codes that
hold it. A query looks up all segment values within radius 0, then 1, 2 and so on, and verifies
the full distance of what it finds. After radius r over m segments every code nearer than
``m * (r + 1)`` has been seen, so a query is done when its k-th verified distance is below that.
The best of all blocks are merged by a window over each query.

A task holds one block of codes and one block of queries, and searches a slice of them at a time.
Equal codes are held once with their k+1
smallest ids, which is all that ties can need, so copies don't widen a bucket.

Ties go to the smaller id. A query's own id is no candidate. With fewer than k candidates all are
returned. Vectors that are null, hold null or non-finite components, have only zeros, or a length
other than the commonest (the smaller one of equals) take no part; repeated ids count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borehole.session import materialise, ship_package

BLOCK = 1 << 16
QUERIES = 1 << 13
#: Blocks at least, so that small tables keep several tasks busy too.
BLOCKS = 8
#: Pairs of query and code that a task holds at once.
PAIRS = 1 << 22
SEGMENT = 16


def usable(vector: Column) -> Column:
    """Whether a vector has finite components only, and one that isn't zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def usable_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` of the rows that take part."""
    rows = table.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
    ).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = size["n"] if size else 0
    return rows.where(F.size("vector") == dims).dropDuplicates(["vec_id"])


def sign_codes(batches):
    """The sign bits of each vector, packed into bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(1)
        flat = column.flatten().to_numpy().reshape(batch.num_rows, -1)
        packed = np.packbits(flat > 0, axis=1)
        codes = [row.tobytes() for row in packed]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], names=["vec_id", "code"])


def segment_values(codes: np.ndarray, bits: int) -> list[tuple[np.ndarray, int]]:
    """The value and width of every segment; ``codes`` are rows of bytes."""
    plain = np.unpackbits(codes, axis=1)[:, :bits]
    out = []
    for part in np.array_split(np.arange(bits), max(1, -(-bits // SEGMENT))):
        weight = 1 << np.arange(len(part), dtype=np.int64)
        out.append((plain[:, part].astype(np.int64) @ weight, len(part)))
    return out


def _words(codes: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words, padded with zeros."""
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)


def _fresh_pairs(table: tuple, asked: np.ndarray, open_: np.ndarray, size: int, radius: int) -> Iterator[np.ndarray]:
    """``query * size + code`` of the pairs that differ by ``radius`` bits in one segment.

    Few neighbouring values are looked up; where there would be more of them than codes, the
    values that codes hold are compared instead.
    """
    values, sort, edge, width = table
    if radius > width:
        return
    if comb(width, radius) * 16 <= size:
        for flip in combinations(range(width), radius):
            value = asked[open_] ^ sum(1 << f for f in flip)
            n = edge[value + 1] - edge[value]
            hit = np.flatnonzero(n)
            if len(hit):
                n = n[hit]
                at = np.repeat(edge[value[hit]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                yield np.repeat(open_[hit], n) * size + sort[at]
        return
    query, code = np.nonzero(np.bitwise_count(asked[open_][:, None] ^ values[None]) == radius)
    yield open_[query] * size + code


def search_block(
    ids: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of each query's k nearest in one block, exactly.

    Queries are taken in slices of at most ``PAIRS`` pairs of query and code, which bounds memory
    even where every code has to be verified.
    """
    order = np.argsort(ids, kind="stable")
    ids, codes = ids[order], np.ascontiguousarray(codes[order])
    wide = codes.shape[1]
    _, first, which = np.unique(codes.view(f"V{wide}").ravel(), return_index=True, return_inverse=True)
    distinct = codes[first]
    by = np.argsort(which, kind="stable")
    begin = np.searchsorted(which[by], np.arange(len(first)))
    rank = np.arange(len(ids)) - np.repeat(begin, np.diff(np.append(begin, len(ids))))
    by = by[rank < k + 1]
    held = np.bincount(which[by], minlength=len(first))
    start = np.cumsum(held) - held
    tables = []
    for values, width in segment_values(distinct, wide * 8):
        sort = np.argsort(values, kind="stable")
        edge = np.searchsorted(values[sort], np.arange((1 << width) + 1))
        tables.append((values.astype(np.uint32), sort, edge, width))
    words = _words(distinct)
    step = max(1, PAIRS // len(distinct))
    out = []
    for lo in range(0, len(queries), step):
        asked, asked_ids = queries[lo : lo + step], query_ids[lo : lo + step]
        q, code, d = _nearest_distinct(tables, words, held, asked, np.isin(asked_ids, ids), wide * 8, k)
        n = held[code]
        at = by[np.repeat(start[code] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        q, d = np.repeat(q, n), np.repeat(d, n)
        other = ids[at] != asked_ids[q]
        q, d, at = q[other], d[other], at[other]
        sort = np.lexsort((ids[at], d, q))
        q, d, at = q[sort], d[sort], at[sort]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        out.append((asked_ids[q[keep]], ids[at[keep]], d[keep].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _nearest_distinct(
    tables: list[tuple], words: np.ndarray, held: np.ndarray, queries: np.ndarray, own: np.ndarray, bits: int, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, code, distance) of all codes that hold one of a query's k nearest ids, ties included.

    ``held`` counts the ids of a code; ``own`` tells which queries are among the ids themselves.
    """
    size = len(words)
    asked = [v.astype(np.uint32) for v, _ in segment_values(queries, bits)]
    query_words = _words(queries)
    seen = np.zeros(len(queries) * size, bool)
    near = np.zeros((len(queries), bits + 1), np.int64)  # ids verified, by distance
    verified = np.zeros(len(queries), np.int64)
    open_ = np.arange(len(queries))
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for radius in range(max(w for *_, w in tables) + 1):
        for table, values in zip(tables, asked, strict=True):
            for pairs in _fresh_pairs(table, values, open_, size, radius):
                pairs = pairs[~seen[pairs]]
                if not len(pairs):
                    continue
                seen[pairs] = True
                query, code = pairs // size, pairs % size
                distance = np.bitwise_count(query_words[query] ^ words[code]).sum(axis=1, dtype=np.int64)
                cells = np.bincount(query * (bits + 1) + distance, held[code], near.size)
                near += cells.astype(np.int64).reshape(near.shape)
                verified += np.bincount(query, minlength=len(queries))
                kept.append((pairs, distance.astype(np.int16)))
        # all codes nearer than this have been seen
        covered = min(len(tables) * (radius + 1), bits + 1)
        enough = near[open_, :covered].sum(axis=1) - own[open_] >= k
        open_ = open_[~enough & (verified[open_] < size)]
        if not len(open_):
            break
    pairs, distance = (np.concatenate(x) for x in zip(*kept, strict=True))
    # the distance by which k ids beside the query's own have been verified; farther ones can't be among them
    cut = (np.cumsum(near, axis=1) < k + own[:, None]).sum(axis=1)
    wanted = distance <= cut[pairs // size]
    pairs = pairs[wanted]
    return pairs // size, pairs % size, distance[wanted]


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, distance``; both tables have ``vec_id, code`` (binary, one length)."""
    spark = codes.sparkSession
    ship_package(spark)
    codes = materialise(codes, "codes")
    queries = materialise(queries, "queries")
    blocks = max(BLOCKS, -(-codes.count() // BLOCK))
    asks = max(1, -(-queries.count() // QUERIES))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = codes.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("ask", numbers(asks))
    right = queries.withColumn("ask", F.pmod(F.xxhash64("vec_id"), F.lit(asks))).withColumn("block", numbers(blocks))

    def run(key: tuple[pa.Scalar, ...], own: pa.Table, asked: pa.Table) -> pa.Table:
        parts = (np.zeros(0, np.int64),) * 3
        if own.num_rows and asked.num_rows:
            a, b = (np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1)
                    for t in (own, asked))
            parts = search_block(own.column("vec_id").to_numpy(), a, asked.column("vec_id").to_numpy(), b, k)
        return pa.table(dict(zip(("query_id", "vec_id", "distance"), map(pa.array, parts), strict=True)))

    by = ("block", "ask")
    right = right.select(F.col("block").cast("long").alias("block"), F.col("ask").cast("long").alias("ask"), "vec_id", "code")
    left = left.select(F.col("block").cast("long").alias("block"), F.col("ask").cast("long").alias("ask"), "vec_id", "code")
    # rows are few bytes and much work: a given number keeps Spark from merging groups by size
    tasks = min(2 * blocks * asks, max(2 * BLOCKS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    left, right = left.repartition(tasks, *by), right.repartition(tasks, *by)
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "query_id long, vec_id long, distance long")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance"))


def nearest_by_sign(table: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every row whose id is divisible by 20 as a query against all rows, on sign bits."""
    ship_package(table.sparkSession)
    vectors = usable_vectors(table, id_col, vector_col)
    codes = materialise(vectors.mapInArrow(sign_codes, "vec_id long, code binary"), "codes")
    return nearest_codes(codes, codes.where("vec_id % 20 = 0"), k)
