"""Ordered and ranked work over groups of any size.

A window over ``partitionBy(station)`` puts a whole station into one task. That is the
cheapest plan while every station fits a task, and it fails when one station holds a large
share of the rows. The helpers here look at the size of the largest group first and use the
plain window only below ``spark.borehole.maxGroupRows``; above it they split groups by range.
Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borehole.session import materialise

MAX_GROUP_ROWS = "spark.borehole.maxGroupRows"
DEFAULT_MAX_GROUP_ROWS = 2_000_000
PERCENTILE_CELLS = 1_000_000  # values of a group that may all be kept in memory by one task
#: Size of a quantile sketch, the shares it is read at, the margin added, and rows between two bounds that one task ranks.
SKETCH_SIZE, SKETCH_STEPS, SKETCH_ERROR, RANKED_ROWS = 2_000, 500, 0.008, 500_000
#: Parts of a spread table at least, and rows of one.
LEAST_PARTS, SPREAD_ROWS = 16, 500_000


def max_group_rows(spark: SparkSession) -> int:
    """How many rows of one group a single task may hold."""
    return int(spark.conf.get(MAX_GROUP_ROWS, str(DEFAULT_MAX_GROUP_ROWS)))


_SIZES: WeakKeyDictionary[DataFrame, dict[tuple[str, ...], int]] = WeakKeyDictionary()


def largest_group(df: DataFrame, keys: Sequence[str] = ()) -> int:
    """Rows of the largest group; counted map-side first, so hot groups cost nothing extra.

    Remembered per DataFrame object, because one analysis orders the same table several times.
    """
    known = _SIZES.setdefault(df, {})
    if tuple(keys) not in known:
        if keys:
            size = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        else:
            size = df.count()
        known[tuple(keys)] = size
    return known[tuple(keys)]


def python_groups(df: DataFrame, cols: Sequence[str]) -> GroupedData:
    """Groups for a Python function that is heavy for its input.

    Adaptive execution merges small shuffle partitions by bytes and would run such groups one
    after another; a stated number of partitions is kept. The grouping reuses this shuffle.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *cols).groupBy(*cols)


def spread(df: DataFrame, label: str) -> DataFrame:
    """A stored copy for several passes, in parts whose number follows from its rows.

    A small table often comes from one file split and would stay one task in every pass.
    """
    stored = materialise(df, label)
    parts = max(LEAST_PARTS, -(-stored.count() // SPREAD_ROWS))  # from the file footers
    return materialise(stored.repartition(parts), label)


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Join condition on ``keys`` between two aliases, null equal to null."""
    pairs = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, pairs, F.lit(True))


def attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of a one-row-per-key table to every row of ``df``.

    Without keys the single row becomes literals (nulls when there is none). With keys it is a plain equi-join: adaptive
    execution broadcasts ``per_key`` when its measured size allows and splits hot keys when not.
    """
    if not keys:
        row = per_key.first()
        values = row.asDict() if row else {}
        return df.select("*", *[_literal(values.get(f.name), f) for f in per_key.schema])
    added = [c for c in per_key.columns if c not in keys]
    return (
        df.alias("l")
        .join(per_key.alias("r"), same_keys("l", "r", keys), "left")
        .select("l.*", *[F.col(f"r.{c}") for c in added])
    )


def attach_stats(df: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`attach` for statistics of few rows beside ``df``, which are stored first.

    The join is planned by their stored size. Computed within the same query, their size is known only after all rows of ``df``
    have been shuffled by key, and those of a hot key then lie in one partition.
    """
    return attach(df, materialise(per_key, "stats") if keys else per_key, keys)


def _literal(value, field: T.StructField) -> Column:
    """A collected value as a column of its own type."""
    if isinstance(field.dataType, T.TimestampNTZType) and value is not None:
        value = value.isoformat(sep=" ")  # as a datetime it would pass through a time zone
    return F.lit(value).cast(field.dataType).alias(field.name)


@dataclass(frozen=True)
class Ordered:
    """Rows with their place in their group.

    ``df`` has ``_pos`` (from 0), ``_n`` (rows of the group) and ``_core``. A split group
    repeats the neighbouring rows a frame needs at the edge of each piece; those copies have
    ``_core = false`` and are dropped by :meth:`core` after the window functions ran.
    """

    df: DataFrame
    partition: tuple[str, ...]
    order: tuple[str, ...]
    largest: int

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy(*self.order)

    def core(self, df: DataFrame) -> DataFrame:
        return df.where("_core").drop("_core", "_chunk")


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: int = 0,
    after: int = 0,
) -> Ordered:
    """Order each group by ``order``, which must be unique within the group.

    ``before``/``after`` are the rows a later window frame reaches back and ahead.
    """
    limit = max_group_rows(df.sparkSession)
    largest = largest_group(df, keys)
    if largest <= limit:
        whole = Window.partitionBy(*keys)
        numbered = (
            df.withColumn("_pos", F.row_number().over(whole.orderBy(*order)).cast("long") - 1)
            .withColumn("_n", F.count(F.lit(1)).over(whole))
            .withColumn("_chunk", F.lit(0).cast("long"))
            .withColumn("_core", F.lit(True))
        )
        return Ordered(numbered, tuple(keys), tuple(order), largest)

    chunk = F.floor(F.col("_pos") / limit)
    first = F.floor(F.greatest(F.col("_pos") - after, F.lit(0)) / limit)
    last = F.floor(F.least(F.col("_pos") + before, F.col("_n") - 1) / limit)
    pieces = (
        numbered_by_range(df, keys, order, limit)
        .withColumn("_chunk", F.explode(F.sequence(first, last)))
        .withColumn("_core", F.col("_chunk") == chunk)
    )
    return Ordered(pieces, (*keys, "_chunk"), ("_pos",), largest)


def numbered_by_range(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_part: int
) -> DataFrame:
    """``_pos`` and ``_n`` per group without gathering a group in one task.

    Rows are range-partitioned by (keys, order), so a hot group spreads over many parts. The
    sorted parts are written once; one small row per (group, part) then gives each part's
    starting position.
    """
    total = df.count()
    parts = max(2, -(-total // rows_per_part))
    width = 33  # the low bits of monotonically_increasing_id count rows within a part
    stored = materialise(
        df.repartitionByRange(parts, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_row", width)),
        "ordered",
    )
    runs = stored.groupBy(*keys, "_part").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = runs.select(
        *keys,
        "_part",
        (F.sum("_rows").over(upto) - F.col("_rows") - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("_n"),
    )
    return (
        stored.alias("l")
        .join(starts.alias("r"), same_keys("l", "r", [*keys, "_part"]))
        .select(
            *[F.col(f"l.{c}") for c in df.columns],
            (F.col("l._row") + F.col("r._shift")).alias("_pos"),
            F.col("r._n"),
        )
    )


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int
) -> DataFrame:
    """The first ``n`` rows of each group, with their ``rank``.

    Spark cuts each map task to ``n`` rows per group before the shuffle (window group limit),
    and without keys ``orderBy().limit()`` keeps only ``n`` rows per task.
    """
    if not keys:
        df = df.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per key, columns ``{col}_q{i}``.

    Small groups use ``percentile``, which keeps every distinct value of a group in memory.
    Larger groups first bracket each quantile with approximate sketches, check the ranks of the bracket, and rank
    only the values inside: the result is exact, the memory bounded.
    """
    numbers = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    largest = largest_group(df, keys)
    small = largest <= max_group_rows(df.sparkSession)
    if small and largest * len(cols) <= PERCENTILE_CELLS:
        aggs = [
            F.percentile(c, F.lit(float(p))).alias(f"{c}_q{i}")
            for c in cols
            for i, p in enumerate(probs)
        ]
        return numbers.groupBy(*keys).agg(*aggs)
    return bracketed_quantiles(numbers, cols, [float(p) for p in probs], keys, largest)


def _sketched(df: DataFrame, values: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """One quantile sketch ``_s{i}`` per group and value column, merged in two levels.

    Each map task sends its sketch to one of about square root many merging tasks, so no task receives the
    sketches of all of them.
    """
    # tasks of the scan are not known before it runs; the shuffle's number is of their order
    salts = max(2, round(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    names = [f"_s{i}" for i in range(len(values))]
    salt = F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt")
    rows = df.select(*keys, salt, *[v.alias(n) for v, n in zip(values, names, strict=True)])
    first = rows.groupBy(*keys, "_salt").agg(
        *[F.kll_sketch_agg_double(n, F.lit(SKETCH_SIZE)).alias(n) for n in names],
        *[F.count(n).alias(f"_n{n}") for n in names],
    )
    filled = [F.when(F.col(f"_n{n}") > 0, F.col(n)).alias(n) for n in names]
    merged = [F.kll_merge_agg_double(n, F.lit(SKETCH_SIZE)).alias(n) for n in names]
    return first.select(*keys, *filled).groupBy(*keys).agg(*merged)


def bracketed_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], keys: Sequence[str], largest: int
) -> DataFrame:
    """:func:`exact_quantiles` for groups of any size.

    Each quantile is known to lie between two values, at first the extremes. A sketch of the values between them
    proposes a narrower pair; the rows below and up to it are counted, and it is taken only if the wanted ranks are
    inside. A pair that misses is tried again wider from the last sure one. This goes on until few rows are left between, and only
    those are ranked.
    """
    asked = [(c, p) for c in cols for p in probs]
    every = range(len(asked))
    rank = [F.lit(p) * (F.col("_n")[q] - 1) for q, (_, p) in enumerate(asked)]
    first = df.groupBy(*keys).agg(
        F.array(*[F.count(c) for c, _ in asked]).alias("_n"),
        F.array(*[F.min(c) for c, _ in asked]).alias("_lo"),
        F.array(*[F.max(c) for c, _ in asked]).alias("_hi"),
    )
    bounds = first.withColumns({"_below": F.transform("_n", lambda n: n * 0), "_inside": F.col("_n")})
    bounds = materialise(bounds, "bounds")
    # a sketch is read at fixed shares only
    steps = F.lit(np.linspace(0, 1, SKETCH_STEPS + 1))
    width = SKETCH_ERROR
    while True:
        wide = [(F.col("_inside")[q] > RANKED_ROWS) & (F.col("_lo")[q] < F.col("_hi")[q]) for q in every]
        if bounds.where(reduce(lambda a, b: a | b, wide)).isEmpty():
            break
        bounded = attach(df, bounds, keys)
        between = [
            F.when(wide[q] & F.col(c).between(F.col("_lo")[q], F.col("_hi")[q]), F.col(c)) for q, (c, _) in enumerate(asked)
        ]
        sketches = _sketched(bounded, between, keys)
        read = [F.when(F.kll_sketch_get_n_double(f"_s{q}") > 0, F.kll_sketch_get_quantile_double(f"_s{q}", steps)).alias(f"_s{q}") for q in every]
        sketches = attach(bounds, materialise(sketches.select(*keys, *read), "sketches"), keys)

        def edge(q: int, side: int, wide=wide, width=width) -> Column:
            """A value just beyond the wanted ranks by the sketch, or the end known so far."""
            old = F.col("_hi" if side > 0 else "_lo")[q]
            share = (rank[q] - F.col("_below")[q]) / F.greatest(F.col("_inside")[q] - 1, F.lit(1)) + side * width
            step = (F.ceil if side > 0 else F.floor)(share * SKETCH_STEPS).cast("int")
            within = wide[q] & share.between(0, 1)
            return F.coalesce(F.when(within, F.get(f"_s{q}", step)), old)

        tried = materialise(sketches.select(
            *keys, "_n", "_lo", "_hi", "_below", "_inside",
            F.array(*[edge(q, -1) for q in every]).alias("_a"), F.array(*[edge(q, 1) for q in every]).alias("_b"),
        ), "tried")
        counted = attach(df, tried.select(*keys, "_a", "_b"), keys).groupBy(*keys).agg(
            F.array(*[F.count_if(F.col(c) < F.col("_a")[q]) for q, (c, _) in enumerate(asked)]).alias("_lower"),
            F.array(*[F.count_if(F.col(c) <= F.col("_b")[q]) for q, (c, _) in enumerate(asked)]).alias("_upto"),
        )
        checked = attach(tried, counted, keys)
        holds = [(F.col("_lower")[q] <= F.floor(rank[q])) & (F.col("_upto")[q] > F.ceil(rank[q])) for q in every]

        def taken(new: str, old: str, holds=holds) -> Column:
            return F.array(*[F.when(holds[q], F.col(new)[q]).otherwise(F.col(old)[q]) for q in every])

        size = F.array(*[F.when(holds[q], F.col("_upto")[q] - F.col("_lower")[q]).otherwise(F.col("_inside")[q]) for q in every])
        missed = reduce(lambda a, b: a | b, [wide[q] & ~holds[q] for q in every])
        smaller = reduce(lambda a, b: a | b, [wide[q] & (size[q] < 0.9 * F.col("_inside")[q]) for q in every])
        bounds = materialise(checked.select(
            *keys, "_n", taken("_a", "_lo").alias("_lo"), taken("_b", "_hi").alias("_hi"),
            taken("_lower", "_below").alias("_below"), size.alias("_inside"), missed.alias("_miss"), smaller.alias("_less"),
        ), "bounds")
        state = bounds.agg(F.bool_or("_miss").alias("miss"), F.bool_or("_less").alias("less")).first()
        if not state["miss"] and not state["less"]:
            break  # what is left between are copies of a few values, which are ranked as one row each
        # a miss is tried with a wider margin next time
        width = width * 8 if state["miss"] else SKETCH_ERROR
    below = bounds.select(*keys, "_below")
    bounded = attach(df, bounds.select(*keys, "_n", "_lo", "_hi"), keys)
    candidates = F.array(
        *[
            F.struct(
                F.lit(q).alias("_q"),
                F.when(F.col(c).between(F.col("_lo")[q], F.col("_hi")[q]), F.col(c)).alias("_v"),
                F.col("_n")[q].alias("_rows"),
            )
            for q, (c, _) in enumerate(asked)
        ]
    )
    # equal values are counted before they are ranked, so heavy ties stay one row
    inside = (
        bounded.select(*keys, F.inline(candidates))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_q", "_v")
        .agg(F.count(F.lit(1)).alias("_c"), F.first("_rows").alias("_rows"))
    )
    ranked = attach(inside, below, keys)
    upto = (
        Window.partitionBy(*keys, "_q")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    prob = F.array(*[F.lit(p) for _, p in asked])[F.col("_q")]
    rank = prob * (F.col("_rows") - 1)
    reached = F.sum("_c").over(upto) + F.col("_below")[F.col("_q")]
    ends = (
        ranked.withColumn("_cum", reached)
        .withColumn("_rank", rank)
        .groupBy(*keys, "_q")
        .agg(
            F.min(F.when(F.col("_cum") > F.floor("_rank"), F.col("_v"))).alias("_v0"),
            F.min(F.when(F.col("_cum") > F.ceil("_rank"), F.col("_v"))).alias("_v1"),
            F.first(F.col("_rank") - F.floor("_rank")).alias("_part"),
        )
    )
    value = F.col("_v0") + F.col("_part") * (F.col("_v1") - F.col("_v0"))
    names = [f"{c}_q{i}" for c in cols for i in range(len(probs))]
    found = ends.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_q") == q, value)).alias(name) for q, name in enumerate(names)]
    )
    return attach(bounds.select(*keys), found, keys) if keys else found


def modes(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent non-null value per column, smallest on ties: one row per key.

    Values are counted in a shuffle by (key, value), so no task holds a whole column.
    """
    result = df.select(*keys).distinct() if keys else None
    for c in cols:
        value = F.col(c).alias("_v")
        one = (
            df.where(F.col(c).isNotNull())
            .groupBy(*keys, value)
            .agg(F.count(F.lit(1)).alias("_c"))
            .groupBy(*keys)
            .agg(F.min_by("_v", F.struct(-F.col("_c"), F.col("_v"))).alias(c))
        )
        result = one if result is None else attach(result, one, keys)
    return result
