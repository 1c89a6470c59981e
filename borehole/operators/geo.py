"""Stations on the map: filtering, clustering, similarity, heatmaps."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borehole.functions import parsing as P
from borehole.functions.geodesy import haversine_km, linspace
from borehole.operators import grouping as G
from borehole.operators import similarity as S
from borehole.operators.similarity import GEO_WEIGHT, RELEVANT_KM, VALUE_WEIGHT
from borehole.session import materialise

SAME_PLACE_WEIGHT = 1e6
PLACES_PER_TASK = 100_000
LITERAL_TARGETS = 1000  # more targets are looked for through the tree of all stations


def valid_coordinates(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Rows with both coordinates in range; text coordinates count when they are numbers."""
    return df.where(
        P.try_number(df, lat).between(-90, 90) & P.try_number(df, lon).between(-180, 180)
    )


def stations(
    df: DataFrame,
    lat: str,
    lon: str,
    value: str | None = None,
    id_col: str | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """One station per row with valid coordinates: ``id, lat, lon, value, cluster, anomaly``.

    Without ``id_col`` stations are numbered ST000, ST001, ... in ``order_by`` over all rows,
    also those without valid coordinates.
    """
    if id_col is None:
        if not order_by:
            raise ValueError("name an id_col, or order_by to number the stations")
        df = G.ordered(df, (), order_by).df.withColumn(
            "_id", F.format_string("ST%03d", F.col("_pos"))
        )
        id_col = "_id"
    number = P.try_number(df, value) if value else F.lit(None).cast("double")
    return valid_coordinates(df, lat, lon).select(
        F.col(id_col).cast("string").alias("id"),
        P.try_number(df, lat).alias("lat"),
        P.try_number(df, lon).alias("lon"),
        number.alias("value"),
        F.lit(None).cast("int").alias("cluster"),
        F.lit(False).alias("anomaly"),
    )


def flag_anomalies(points: DataFrame, flagged: DataFrame, id_col: str = "id") -> DataFrame:
    """Set ``anomaly`` on the stations whose id is in ``flagged``."""
    ids = flagged.select(F.col(id_col).cast("string").alias("_id")).distinct()
    return points.join(ids, F.col("id") == F.col("_id"), "left").select(
        *[F.col("_id").isNotNull().alias(c) if c == "anomaly" else F.col(c) for c in points.columns]
    )


def cluster_stations(
    points: DataFrame, k: int = 5, starts: int = 10, seed: int = 42
) -> DataFrame:
    """KMeans on (lat, lon), the best of several starts, into column ``cluster``.

    Stations at one place are one weighted point. Clusters are numbered by (lat, lon) of
    their centre. Fewer rows than clusters: left as is.
    """
    if not 2 <= k <= 20:
        raise ValueError("the number of clusters must be from 2 to 20")
    places = points.groupBy("lat", "lon").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    places = materialise(places, "places")
    size = places.agg(
        F.sum("weight").alias("rows"),
        F.count(F.lit(1)).alias("places"),
        ((F.var_pop("lat") + F.var_pop("lon")) / 2).alias("variance"),
    ).first()
    if (size["rows"] or 0) < k:
        return points
    vectors = VectorAssembler(inputCols=["lat", "lon"], outputCol="features")
    # every iteration is a pass over the places: no more tasks than they fill
    dense = places.coalesce(-(-size["places"] // PLACES_PER_TASK))
    tolerance = (1e-4 * size["variance"]) ** 0.5
    model = best_kmeans(vectors.transform(dense), k, starts, seed, tolerance)
    centers = [tuple(c) for c in model.clusterCenters()]
    number = {old: new for new, old in enumerate(sorted(range(len(centers)), key=centers.__getitem__))}
    renumber = F.array(*[F.lit(number[i]) for i in range(len(number))])
    scored = model.transform(vectors.transform(points.drop("cluster")))
    return scored.withColumn("cluster", renumber[F.col("prediction")]).select(*points.columns)


def best_kmeans(
    vectors: DataFrame, k: int, starts: int, seed: int, tolerance: float
) -> KMeansModel:
    """The fit of lowest cost; its input is read once into memory for all starts."""
    cached = vectors.persist()

    def fit(start: int) -> KMeansModel:
        kmeans = KMeans(k=k, seed=seed + start, weightCol="weight", maxIter=300, tol=tolerance)
        return kmeans.fit(cached)

    # the starts are independent jobs of many short stages, so they share the executors
    with ThreadPool(min(starts, 8)) as pool:
        fits = pool.map(inheritable_thread_target(vectors.sparkSession)(fit), range(starts))
    cached.unpersist()
    return min(fits, key=lambda m: m.summary.trainingCost)


def cluster_stats(clustered: DataFrame) -> DataFrame:
    """Stations and centre of each cluster."""
    return (
        clustered.where(F.col("cluster").isNotNull())
        .groupBy(F.col("cluster").alias("cluster_id"))
        .agg(
            F.count(F.lit(1)).alias("station_count"),
            F.avg("lat").alias("center_lat"),
            F.avg("lon").alias("center_lon"),
        )
    )


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(
        F.max("lat").alias("north"),
        F.min("lat").alias("south"),
        F.max("lon").alias("east"),
        F.min("lon").alias("west"),
    )


def center(points: DataFrame) -> DataFrame:
    return points.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def heat_points(points: DataFrame) -> DataFrame:
    return points.where(F.col("value").isNotNull()).select("lat", "lon", "value")


def to_geojson(points: DataFrame, value_name: str = "value") -> DataFrame:
    """One GeoJSON ``feature`` text per station; nulls are kept."""
    fixed = ("id", "lat", "lon", "value")
    rest = [F.col(c) for c in points.columns if c not in fixed]
    properties = [F.col("id"), F.col("lat"), F.col("lon"), F.col("value").alias(value_name), *rest]
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")
        ).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    return points.select("id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def similar_stations(
    df: DataFrame,
    lat: str,
    lon: str,
    value: str,
    id_col: str,
    targets: str | int | Sequence | DataFrame | None = None,
    k: int = 5,
) -> DataFrame:
    """The ``k`` stations most like each target by place and value, best first.

    ``targets`` is an id, some ids, a table whose first column holds ids, or ``None`` for every station. The rows of a
    few ids become literals: every station is scored where it lies, and only ``k`` rows per target and task are
    shuffled. More targets go through :class:`~borehole.operators.similarity.Search`. Missing values count as 0;
    stations without id or coordinates are left out. Ids of a list must exist, those of a table may be absent.
    """
    points = df.select(
        F.col(id_col).alias("station_id"),
        P.try_number(df, lat).alias("lat"),
        P.try_number(df, lon).alias("lon"),
        F.coalesce(P.try_number(df, value), F.lit(0.0)).alias("value"),
    ).where("station_id is not null and lat is not null and lon is not null")
    if targets is None or isinstance(targets, DataFrame):
        wanted = targets if targets is None else targets.select(F.col(targets.columns[0]).alias("target_id"))
        search = S.Search(points)
        return search.best(S.targets_of(search.points, wanted), k)
    wanted = [targets] if isinstance(targets, (str, int)) else list(targets)
    if len(wanted) > LITERAL_TARGETS:
        listed = df.sparkSession.createDataFrame([(w,) for w in wanted], T.StructType([T.StructField("target_id", df.schema[id_col].dataType)]))
        missing = [r["target_id"] for r in listed.join(points, F.col("target_id") == F.col("station_id"), "left_anti").limit(10).collect()]
        if missing:
            raise ValueError(f"target stations not found: {sorted(map(str, missing))}")
        return similar_stations(df, lat, lon, value, id_col, listed, k)
    # the first row of an id, should it occur twice
    found = (
        points.where(F.col("station_id").isin(wanted))
        .groupBy("station_id")
        .agg(F.min(F.struct("lat", "lon", "value")).alias("t"))
        .select("station_id", "t.*")
        .collect()
    )
    absent = sorted({str(w) for w in wanted} - {str(r["station_id"]) for r in found})
    if absent:
        raise ValueError(f"target stations not found: {absent}")
    id_type = df.schema[id_col].dataType
    literal = F.array(
        *[
            F.struct(
                F.lit(r["station_id"]).cast(id_type).alias("target_id"),
                F.lit(r["lat"]).cast("double").alias("target_lat"),
                F.lit(r["lon"]).cast("double").alias("target_lon"),
                F.lit(r["value"]).cast("double").alias("target_value"),
            )
            for r in found
        ]
    )
    km = haversine_km(F.col("target_lat"), F.col("target_lon"), F.col("lat"), F.col("lon"))
    near = F.greatest(F.lit(0.0), 1 - F.col("distance_km") / RELEVANT_KM)
    alike = 1 / (1 + F.abs(F.col("target_value") - F.col("value")))
    scored = (
        points.select("*", F.inline(literal))
        .where(F.col("station_id") != F.col("target_id"))
        .withColumn("distance_km", km)
        .withColumn("value_similarity", alike)
        .withColumn("combined_score", GEO_WEIGHT * near + VALUE_WEIGHT * F.col("value_similarity"))
        .select("target_id", "station_id", "lat", "lon", "value", "distance_km",
                "value_similarity", "combined_score")
    )
    order = [F.col("combined_score").desc_nulls_last(), F.col("station_id")]
    # one target needs no groups: each task then keeps its best k in a heap instead of sorting
    return G.top_per_group(scored, ["target_id"] if len(found) > 1 else [], order, k)


def idw_heatmap(
    df: DataFrame, lat: str, lon: str, value: str, grid_size: int = 20
) -> DataFrame:
    """Inverse-distance-weighted ``intensity`` on an inclusive grid: ``i, j, lat, lon``.

    Readings at one place weigh the same, so they are summed first; each place then adds its
    share to every grid cell, combined map-side into ``grid_size`` squared rows per task.
    """
    if grid_size < 1:
        raise ValueError("grid_size must be at least 1")
    points = df.select(
        P.try_number(df, lat).alias("lat"),
        P.try_number(df, lon).alias("lon"),
        P.try_number(df, value).alias("value"),
    ).na.drop()
    places = points.groupBy("lat", "lon").agg(
        F.sum("value").alias("total"), F.count(F.lit(1)).alias("n")
    )
    box = bounds(places).first()
    if box["north"] is None:
        raise ValueError("no valid data for a heatmap")
    grid = heat_grid(box, grid_size)
    km = haversine_km(F.col("c.lat"), F.col("c.lon"), F.col("p.lat"), F.col("p.lon"))
    weight = F.when(F.col("km") == 0, F.lit(SAME_PLACE_WEIGHT)).otherwise(1 / (1 + F.col("km")))
    return (
        places.select(
            F.struct("lat", "lon").alias("p"), "total", "n", F.explode(grid).alias("c")
        )
        .withColumn("km", km)
        .withColumn("w", weight)
        .groupBy("c.i", "c.j", "c.lat", "c.lon")
        .agg((F.sum(F.col("w") * F.col("total")) / F.sum(F.col("w") * F.col("n"))).alias("intensity"))
    )


def heat_grid(box, grid_size: int):
    """Array of grid cells ``(i, j, lat, lon)`` over the bounds, both ends included."""
    lats = linspace(F.lit(box["south"]), F.lit(box["north"]), grid_size)
    lons = linspace(F.lit(box["west"]), F.lit(box["east"]), grid_size)
    rows = F.transform(
        lats,
        lambda la, i: F.transform(
            lons,
            lambda lo, j: F.struct(i.alias("i"), j.alias("j"), la.alias("lat"), lo.alias("lon")),
        ),
    )
    return F.flatten(rows)
