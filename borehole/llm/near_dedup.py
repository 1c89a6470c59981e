"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact confirmation.

A document's set is its distinct five-word shingles, lower-cased in A-Z, words split at ASCII
white space; shorter documents have one shingle, empty ones none. Two documents are linked if
``100 * |A & B| >= 75 * |A | B|``.

1. ``sketch``: set size, a digest of the whole set, and 128 min-hashes per document. Documents
   with equal sets are one class, represented by the smallest id.
2. Signatures are cut into 32 bands of four. In every bucket each member is a candidate pair
   with the bucket's smallest id, so a bucket of m members makes m pairs, not m squared.
3. Signatures of candidates are compared 32 values at a time. After each batch a pair is dropped
   when the posterior probability of a similarity of at least 0.75, given the matches so far and
   a uniform prior, is below ``MISS``.
4. Survivors are confirmed on their full sets; links become components.
5. Members of buckets that still hold several components meet again by the rare part of their sets:
   with shingles in one order of all sets, counted ones last, a link shares a shingle of the first
   seventh (and one) of the smaller set and the first quarter (and one) of the larger. So pages of
   one source that share less than a link seldom meet. A group of any size is compared in pairs of
   blocks of ``BLOCK``: what two sets hold from the shared shingle on must suffice for a link. The
   pairs that pass go through 3 and 4.

Shingles are compared as 64-bit hashes of all their words.

Null or empty texts have no shingles and stay alone. Repeated rows of one id give repeated rows
with one result. Columns other than the two named ones pass through; the added names are fixed,
and columns of the input that clash with them are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borehole.llm.cleanup import release
from borehole.llm.components import connected_components
from borehole.llm.hashing import (
    LOWER, U64, chunks, grams, mix, signed, text_buffers, word_bounds, word_hashes,
)
from borehole.session import materialise, ship_package

WORDS = 5
PERCENT = 75
HASHES = 128
ROWS = 4
BATCH = 32
#: A pair is pruned when the posterior probability that it is a link is below this.
MISS = 1e-6
#: Members of a group that are compared with as many others in one step.
BLOCK = 256
#: Cells of the table of counts that orders shingles: rare cells first.
CELL_BITS = 18

_FACTORS = np.random.default_rng(20260102).integers(1, 2**63, HASHES, dtype=np.int64).astype(U64) | U64(1)
_PREFIX = "key long, doc_id long, component long, small boolean, behind long, n_shingles long"
_BLOCKS = ("key", "doc_id", "component", "behind", "n_shingles", "part", "x", "y")
_SKETCH = "doc_id long, n_shingles long, digest long, digest2 long, signature binary"


@cache
def least_matches(percent: int = PERCENT, miss: float = MISS) -> tuple[int, ...]:
    """For 32, 64, 96 and 128 compared values, the matches below which a pair is pruned.

    The posterior of the similarity after m matches in n is Beta(m + 1, n - m + 1); its tail above
    the threshold is a binomial sum.
    """
    limit = percent / 100
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * limit**m * (1 - limit) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append(m)
    return tuple(out)


def shingle_sets(chunk) -> Iterator[tuple[int, np.ndarray]]:
    """The sorted distinct shingle hashes of each document of a chunk."""
    data = LOWER[chunk.data]
    starts, ends = word_bounds(data, chunk.bounds)
    words = word_hashes(data, starts, ends)
    cut = np.searchsorted(starts, chunk.bounds)
    five = grams(words, WORDS)
    for i in range(len(chunk.ids)):
        lo, hi = cut[i], cut[i + 1]
        n = hi - lo
        if n >= WORDS:
            yield i, np.unique(five[lo : hi - WORDS + 1])
        elif n:
            yield i, grams(words[lo:hi], int(n))
        else:
            yield i, words[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.empty(HASHES, np.uint32)
    for lo in range(0, HASHES, 8):
        part = np.multiply.outer(_FACTORS[lo : lo + 8], shingles[:4096])
        best = part.min(axis=1)
        for at in range(4096, len(shingles), 4096):
            np.minimum(best, np.multiply.outer(_FACTORS[lo : lo + 8], shingles[at : at + 4096]).min(axis=1), best)
        out[lo : lo + 8] = mix(best) & U64(0xFFFFFFFF)
    return out


def _sketch(batches):
    for batch in batches:
        for chunk in chunks([batch]):
            n, one, two, sig = [], [], [], []
            for _, s in shingle_sets(chunk):
                n.append(len(s))
                one.append(int(signed(mix(s).sum(dtype=U64).reshape(1))[0]))
                two.append(int(signed(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).reshape(1))[0]))
                sig.append(signature(s).tobytes() if len(s) else None)
            ids = batch.column(0).slice(int(chunk.rows[0]), len(chunk.rows))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "digest2", "signature"],
            )


def _bands(batches):
    """A row for each document and band: the band's key and the id."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
        keys = band_keys(sig)
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(keys.ravel())), pa.array(np.repeat(ids, keys.shape[1]))], names=["band", "doc_id"]
        )


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    parts = sig.reshape(len(sig), -1, ROWS).astype(U64)
    out = np.zeros(parts.shape[:2], U64)
    for r in range(ROWS):
        out = mix(out * U64(0xD1342543DE82EF95) + parts[:, :, r])
    return mix(out + np.arange(parts.shape[1], dtype=U64) * U64(0x9E3779B97F4A7C15))


def bayes_keep(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature tables survive the batchwise posterior test."""
    keep = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for k, least in enumerate(least_matches()):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[keep] += (a[keep, part] == b[keep, part]).sum(axis=1, dtype=np.int32)
        keep = keep[matches[keep] >= least]
    out = np.zeros(len(a), bool)
    out[keep] = True
    return out


def _sizes_agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def _prune(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        table = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        a, b = (
            np.frombuffer(b"".join(table[x].to_pylist()), np.uint32).reshape(-1, HASHES) for x in ("sig_a", "sig_b")
        )
        ok = _sizes_agree(table["n_a"].to_numpy(), table["n_b"].to_numpy()) & bayes_keep(a, b)
        yield pa.RecordBatch.from_arrays(
            [table["a"].filter(pa.array(ok)), table["b"].filter(pa.array(ok))], names=["a", "b"]
        )


def _full_sets(batches):
    for chunk in chunks(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk.ids, pa.int64()), pa.array([s.tobytes() for _, s in shingle_sets(chunk)], pa.binary())],
            names=["doc_id", "shingles"],
        )


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two sorted sets."""
    if not len(a) or not len(b):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < PERCENT * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _confirm(batches):
    for batch in batches:
        a, b, left, right = (batch.column(i) for i in range(4))
        ok = [
            linked(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64))
            for x, y in zip(left, right, strict=True)
        ]
        ok = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], names=["a", "b"])


def _possible(rows: np.ndarray) -> np.ndarray:
    """Pairs of the two blocks of a group that lie in different components and may still share enough."""
    ids, comp, behind, size, part, x, y = rows.T[1:]
    left, right = np.flatnonzero(part == x), np.flatnonzero(part == y)
    # all that two sets can share from their first common shingle on
    enough = (100 + PERCENT) * np.minimum.outer(behind[left], behind[right]) >= PERCENT * np.add.outer(
        size[left], size[right]
    )
    i, j = np.nonzero(enough & (comp[left][:, None] != comp[right]))
    return np.sort(np.stack([ids[left[i]], ids[right[j]]], axis=1), axis=1)


def _block_pairs(batches):
    """``_possible`` for every pair of blocks; rows come sorted, a pair of blocks without a break."""
    rest = np.zeros((0, len(_BLOCKS)), np.int64)

    def pairs(rows: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        found = [_possible(rows[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        both = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for batch in batches:
        rows = np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
        group = rows[:, [0, -2, -1]]
        cuts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)][: len(rows)])
        rest = rows[cuts[-1] :] if len(rows) else rows
        if len(cuts) > 1:
            yield pairs(rows, cuts)
    if len(rest):
        yield pairs(rest, np.array([0, len(rest)]))


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles) >> U64(64 - CELL_BITS)).astype(np.int64)


def _cell_counts(batches):
    total = np.zeros(1 << CELL_BITS, np.int64)
    for batch in batches:
        at, raw = text_buffers(batch.column(1))
        total += np.bincount(_cell(np.frombuffer(raw[at[0] : at[-1]].tobytes(), U64)), minlength=len(total))
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells])], names=["cell", "n"])


def prefix(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles of a set in the common order, and how many it needs towards larger sets.

    Linked sets of n <= m shingles have at least 6/7 n and 3/4 m in common, so less than that
    can't lie behind both prefixes.
    """
    n = len(shingles)
    order = np.lexsort((shingles, counts[_cell(shingles)]))
    return shingles[order[: n + 1 + (-PERCENT * n // 100)]], n + 1 + (-2 * PERCENT * n // (100 + PERCENT))


def _prefix_rows(counts: np.ndarray):
    def rows(batches):
        for batch in batches:
            keys, sizes, small, behind, whole = [], [], [], [], []
            for x in batch.column(1):
                s = np.frombuffer(x.as_buffer(), U64)
                own, n = prefix(s, counts)
                keys.append(own)
                sizes.append(len(own))
                small.append(np.arange(len(own)) < n)
                behind.append(len(s) - np.arange(len(own)))
                whole.append(len(s))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(keys))), pa.array(np.repeat(batch.column(0).to_numpy(), sizes)),
                     pa.array(np.repeat(batch.column(2).to_numpy(), sizes)), pa.array(np.concatenate(small)),
                     pa.array(np.concatenate(behind)), pa.array(np.repeat(whole, sizes))],
                    names=["key", "doc_id", "component", "small", "behind", "n_shingles"],
                )

    return rows


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = materialise(texts.mapInArrow(_sketch, _SKETCH), "sketch")
    filled = sketch.where("signature is not null and doc_id is not null")
    same = ["digest", "digest2", "n_shingles"]
    classes = materialise(filled.groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")
    members = filled.select("doc_id", *same).join(classes, same).select("doc_id", "rep").distinct()
    reps = materialise(
        filled.join(classes, [*same]).where("doc_id = rep").dropDuplicates(["doc_id"])
        .select("doc_id", "n_shingles", "signature"),
        "representatives",
    )
    bands = reps.select("doc_id", "signature").mapInArrow(_bands, "band long, doc_id long")
    leaders = bands.groupBy("band").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    crowded = materialise(bands.join(leaders, "band"), "buckets")

    sets = materialise(_sets_of(crowded.select("doc_id"), texts), "sets")
    del bands, leaders
    release(spark)

    star = crowded.where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))
    edges = _links(star, reps, sets)
    components = connected_components(edges)
    crowded = crowded.join(components, crowded.doc_id == components.node, "left").select(
        "band", "leader", "doc_id", F.coalesce("component", "doc_id").alias("component")
    )
    crowded = materialise(crowded.where("doc_id <> leader"), "followers")
    edges = materialise(edges.union(_rest_links(crowded, reps, sets)), "links")
    components = connected_components(edges)
    classes = members.join(components, members.rep == components.node, "left").select(
        F.col("doc_id").alias("id"), F.coalesce("component", "rep").alias("component_id")
    )
    return (
        sketch.join(classes, sketch.doc_id == F.col("id"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _sets_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    # one plan for all sizes: the ids are never broadcast
    wanted = texts.join(ids.distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return wanted.mapInArrow(_full_sets, "doc_id long, shingles binary")


def _links(pairs: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are links: signatures first, full sets for the survivors."""

    def side(x: str) -> DataFrame:
        return reps.select(
            F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"sig_{x}")
        )

    likely = materialise(
        pairs.distinct().join(side("a"), "a").join(side("b"), "b").mapInArrow(_prune, "a long, b long"), "likely"
    )
    full = likely.hint("merge").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")), "b"
    )
    return materialise(full.select("a", "b", "left", "right").mapInArrow(_confirm, "a long, b long"), "links")


def _rest_links(followers: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of one bucket that lie in different components so far.

    Members of buckets with one component do not take part. The others meet by the shingles of their
    prefixes. A group is one shingle: one of a pair has it in its short prefix, and one lies outside
    of the group's largest component, so the rarer of the two kinds is compared with all, in pairs
    of blocks, by size and by position of the shingle in both orders. What passes goes on to the
    signatures.
    """
    sizes = followers.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_ = sizes.where("lo < hi").select("band")
    members = followers.join(open_, "band").select("doc_id", "component").distinct()
    wide = materialise(
        members.hint("merge").join(sets, "doc_id").select("doc_id", "shingles", "component"), "wide"
    )
    cells = wide.mapInArrow(_cell_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << CELL_BITS, np.int64)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    keys = wide.mapInArrow(_prefix_rows(counts), _PREFIX)
    keys = materialise(keys, "prefixes")
    kinds = keys.groupBy("key", "component").agg(F.count("*").alias("n"), F.count_if("small").alias("short"))
    groups = kinds.groupBy("key").agg(
        F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum("short").alias("short"),
        (F.sum("n") - F.max("n")).alias("outside"), F.max_by("component", "n").alias("top"),
    ).where("kinds > 1 and short > 0")
    asking = F.when(F.col("short") <= F.col("outside"), F.col("small")).otherwise(F.col("component") != F.col("top"))
    asked = F.least("short", "outside")
    rows = keys.join(groups, "key").select(
        "key", "doc_id", "component", "behind", "n_shingles", asking.alias("asking"),
        F.ceil(asked / BLOCK).cast("int").alias("ours"),
        F.ceil((F.col("n") - asked) / BLOCK).cast("int").alias("others"),
    )
    deal = F.xxhash64("doc_id")
    part = F.when(F.col("asking"), F.pmod(deal, F.col("ours"))).otherwise(F.col("ours") + F.pmod(deal, F.col("others")))
    last = F.when(F.col("asking"), F.col("ours") + F.col("others")).otherwise(F.col("ours")) - 1
    spread = (
        rows.withColumn("part", part.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        .withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other")})
        .select(*[F.col(c).cast("long") for c in _BLOCKS])
    )
    met = spread.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return _links(met.mapInArrow(_block_pairs, "a long, b long"), reps, sets)
