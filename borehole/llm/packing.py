"""Packing into optimal length buckets and batches of a token budget.

The histogram of lengths over all documents is made by Spark; the driver gets one row per cell,
where lengths up to ``EXACT`` are cells of their own and longer ones share cells of a width of
1/64 of their length, so the number of cells grows with the logarithm of the longest document
only. Dynamic programming over the cells chooses the bucket boundaries with the least padding.
Inside a bucket, documents are dealt into shares of about ``SHARE`` rows by a hash of their id,
and each share is numbered and cut into batches of ``budget // boundary`` documents, so that a
bucket may hold any share of the rows. A document above the budget is a batch of its own.

The length is the number of words (or a given column; null counts as 0). Null and empty texts have
length 0 and are packed too. Equal ids are numbered in the order of their lengths. An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borehole.session import materialise

BUDGET = 32_768
BUCKETS = 16
EXACT = 2048
SHARE = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def cell(n: Column) -> Column:
    """The histogram cell of a length: its upper end."""
    wide = F.pow(F.lit(2.0), F.floor(F.log2(n)) - 6)
    return F.when(n <= EXACT, n).otherwise((F.ceil(n / wide) * wide).cast("long"))


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper ends of at most ``buckets`` buckets that make total padding least.

    ``lengths`` ascend. best[j] is the least padded size of the first j cells; a layer adds one
    bucket that ends at cell j and starts after cell i.
    """
    size = len(lengths)
    if not size:
        return []
    total = np.concatenate(([0], np.cumsum(counts))).astype(float)
    best = np.concatenate(([0.0], total[1:] * lengths))
    choice = []
    for _ in range(1, min(buckets, size)):
        after = best.copy()
        back = np.full(size + 1, -1)
        for j in range(1, size + 1):
            cost = best[:j] + (total[j] - total[:j]) * lengths[j - 1]
            i = int(cost.argmin())
            if cost[i] < after[j]:
                after[j], back[j] = cost[i], i
        choice.append(back)
        best = after
    out, j = [], size
    for back in reversed(choice):
        if j > 0 and back[j] >= 0:
            out.append(int(lengths[j - 1]))
            j = int(back[j])
    if j > 0:
        out.append(int(lengths[j - 1]))
    return out[::-1]


def pack(
    docs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text",
    length_col: str | None = None,
) -> DataFrame:
    """``doc_id, n_tokens, bucket, bucket_tokens, batch, slot, padding`` of every document."""
    length = F.col(length_col) if length_col else F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens")
    )
    rows = materialise(rows, "lengths")
    cells = rows.groupBy(cell(F.col("n_tokens")).alias("cell")).agg(
        F.max("n_tokens").alias("longest"), F.count("*").alias("n")
    )
    table = sorted((r["longest"], r["n"]) for r in cells.collect())
    ends = boundaries(np.array([x for x, _ in table]), np.array([n for _, n in table]), buckets) or [0]
    held = np.zeros(len(ends), np.int64)
    for longest, n in table:
        held[np.searchsorted(ends, longest)] += n
    bounds = F.array(*[F.lit(int(e)) for e in ends])
    shares = F.array(*[F.lit(int(max(1, -(-n // SHARE)))) for n in held])
    room = F.array(*[F.lit(int(max(1, budget // max(1, e)))) for e in ends])
    n = F.col("n_tokens")
    dealt = rows.withColumn("bucket", F.size(F.filter(bounds, lambda e: e < n)))
    dealt = dealt.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.get(shares, F.col("bucket"))).cast("int"))
    order = Window.partitionBy("bucket", "share").orderBy("doc_id", "n_tokens")
    numbered = dealt.withColumn("at", F.row_number().over(order) - 1)
    fits = F.get(room, F.col("bucket"))
    end = F.get(bounds, F.col("bucket")).cast("long")
    return numbered.select(
        "doc_id", "n_tokens", "bucket", end.alias("bucket_tokens"),
        F.concat_ws("-", "bucket", "share", F.floor(F.col("at") / fits).cast("long")).alias("batch"),
        (F.col("at") % fits).cast("int").alias("slot"), (end - n).alias("padding"),
    )
