"""Registered queries: stations on the map and threshold alerts."""

from pyspark.sql import functions as F

from borehole.operators import alerts as L
from borehole.operators import geo
from borehole.plans import views as V
from borehole.plans.registry import query

VALID = """select * from {source} where try_cast(lat as double) between -90 and 90
  and try_cast(lon as double) between -180 and 180"""


@query(f"""with {V.DIRTY}, valid as ({VALID.format(source="stations_dirty")})
select station_id, round(lat, 4) as lat, lon, value from valid""")
def valid_coordinates(spark, sf):
    return V.rounded(geo.valid_coordinates(V.stations_dirty(spark, sf), "lat", "lon"))


@query(f"""with {V.DIRTY}, numbered as (
  select *, row_number() over (order by station_id) - 1 as pos from stations_dirty),
valid as ({VALID.format(source="numbered")})
select printf('ST%03d', pos) as id, round(lat, 4) as lat, round(try_cast(lon as double), 4) as lon,
  round(value, 4) as value, cluster is null as unclustered, false as anomaly
from (select *, null as cluster from valid)""")
def station_projection(spark, sf):
    df = V.stations_dirty(spark, sf)
    points = geo.stations(df, "lat", "lon", "value", order_by=["station_id"])
    return V.rounded(points.withColumn("unclustered", F.col("cluster").isNull()).drop("cluster"))


def _points(spark, sf):
    return geo.stations(V.stations_large(spark, sf), "lat", "lon", "value", "station_id")


@query()
def station_clusters(spark, sf):
    return V.rounded(geo.cluster_stations(_points(spark, sf), k=5))


@query(f"""with {V.STATIONS_LARGE}, c as (
  select *, cast(station_id % 5 as int) as cluster_id from stations_large)
select cluster_id, count(*) as station_count, round(avg(lat), 4) as center_lat,
  round(avg(lon), 4) as center_lon from c group by 1""")
def cluster_statistics(spark, sf):
    df = _points(spark, sf).withColumn("cluster", (F.col("id").cast("long") % 5).cast("int"))
    return V.rounded(geo.cluster_stats(df))


@query(f"""with {V.STATIONS_LARGE} select round(max(lat), 4) as north, round(min(lat), 4) as south,
  round(max(lon), 4) as east, round(min(lon), 4) as west from stations_large""")
def map_bounds(spark, sf):
    return V.rounded(geo.bounds(_points(spark, sf)))


@query(f"""with {V.STATIONS_LARGE}
select round(avg(lat), 4) as lat, round(avg(lon), 4) as lon from stations_large""")
def map_center(spark, sf):
    return V.rounded(geo.center(_points(spark, sf)))


@query(f"""with {V.STATIONS_LARGE} select round(lat, 4) as lat, round(lon, 4) as lon,
  round(value, 4) as value from stations_large where value is not null""")
def heat_points(spark, sf):
    return V.rounded(geo.heat_points(_points(spark, sf)))


@query(f"""with {V.STATIONS_LARGE} select station_id::varchar as id, 'Feature' as type,
  'Point' as shape, round(lon, 4) as x, round(lat, 4) as y, round(value, 4) as level,
  'false' as anomaly from stations_large""")
def geojson_features(spark, sf):
    """The GeoJSON text, read back field by field so that number formats do not matter."""
    text = geo.to_geojson(_points(spark, sf), "level")
    schema = """type string, geometry struct<type: string, coordinates: array<double>>,
        properties struct<id: string, level: double, cluster: int, anomaly: string>"""
    f = text.select(F.from_json("feature", schema).alias("f"))
    return V.rounded(
        f.select(
            "f.properties.id", "f.type", F.col("f.geometry.type").alias("shape"),
            F.col("f.geometry.coordinates")[0].alias("x"),
            F.col("f.geometry.coordinates")[1].alias("y"),
            "f.properties.level", "f.properties.anomaly",
        )
    )


HAVERSINE = """2 * 6371.0::double * asin(sqrt(least(1.0::double,
  pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)
  + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"""

KM = HAVERSINE.format(lat1="t.lat", lon1="t.lon", lat2="s.lat", lon2="s.lon")


@query(f"""with {V.STATIONS_LARGE}, t as (select 20.5937::double as lat, 78.9629::double as lon)
select station_id, round({KM}, 4) as km from stations_large s, t""")
def distances_to_point(spark, sf):
    df = V.stations_large(spark, sf)
    km = geo.haversine_km(F.lit(20.5937), F.lit(78.9629), F.col("lat"), F.col("lon"))
    return V.rounded(df.select("station_id", km.alias("km")))


SIMILAR = f"""scored as (
  select t.station_id as target_id, s.station_id, s.lat, s.lon, coalesce(s.value, 0) as value,
    {KM} as distance_km,
    1 / (1 + abs(coalesce(t.value, 0) - coalesce(s.value, 0))) as value_similarity
  from stations_large s join stations_large t on t.station_id in (1, 7, 42)
    and t.station_id <> s.station_id),
ranked as (
  select *, 0.3 * greatest(0, 1 - distance_km / 1000) + 0.7 * value_similarity as combined_score
  from scored),
best as (
  select *, row_number() over (partition by target_id order by combined_score desc, station_id)
    as rank from ranked)"""


@query(f"""with {V.STATIONS_LARGE}, {SIMILAR}
select target_id, station_id, round(lat, 4) as lat, round(lon, 4) as lon, round(value, 4) as value,
  round(distance_km, 4) as distance_km, round(value_similarity, 4) as value_similarity,
  round(combined_score, 4) as combined_score, cast(rank as int) as rank from best where rank <= 5""")
def similar_stations(spark, sf):
    df = V.stations_large(spark, sf)
    found = geo.similar_stations(df, "lat", "lon", "value", "station_id", [1, 7, 42], k=5)
    return V.rounded(found)


EVERY = SIMILAR.replace("on t.station_id in (1, 7, 42)\n    and t.station_id", "on t.station_id")


@query(f"""with {V.STATIONS_LARGE}, {EVERY}
select target_id, station_id, round(lat, 4) as lat, round(lon, 4) as lon, round(value, 4) as value,
  round(distance_km, 4) as distance_km, round(value_similarity, 4) as value_similarity,
  round(combined_score, 4) as combined_score, cast(rank as int) as rank from best where rank <= 5""")
def similar_to_each_station(spark, sf):
    """Every station as a target."""
    return V.rounded(geo.similar_stations(V.stations_large(spark, sf), "lat", "lon", "value", "station_id", k=5))


GRID = """box as (
  select min(lat) as s, max(lat) as n, min(lon) as w, max(lon) as e from stations_large),
grid as (
  select i, j, case when i = 19 then n else s + i * ((n - s) / 19) end as lat,
    case when j = 19 then e else w + j * ((e - w) / 19) end as lon
  from box, range(20) a(i), range(20) b(j))"""


@query(f"""with {V.STATIONS_LARGE}, {GRID},
d as (select t.i, t.j, t.lat, t.lon, s.value, {KM} as km
  from grid t, stations_large s where s.value is not null),
w as (select *, case when km = 0 then 1e6 else 1 / (1 + km) end as w from d)
select cast(i as int) as i, cast(j as int) as j, round(lat, 4) as lat, round(lon, 4) as lon,
  round(sum(w * value) / sum(w), 3) as intensity from w group by i, j, lat, lon""")
def idw_heatmap(spark, sf):
    df = geo.idw_heatmap(V.stations_large(spark, sf), "lat", "lon", "value", grid_size=20)
    return V.rounded(df.withColumn("intensity", F.round("intensity", 3)))


@query(f"""with {V.STATIONS_LARGE}, {GRID}
select cast(i as int) as i, cast(j as int) as j, round(lat, 4) as lat, round(lon, 4) as lon
from grid""")
def heatmap_grid(spark, sf):
    boxes = geo.bounds(_points(spark, sf)).collect()
    df = spark.range(1).select(F.inline(geo.heat_grid(boxes[0], 20)))
    return V.rounded(df)


# --- alerts -----------------------------------------------------------------------------

LIMITS = """limits as (
  select o_orderstatus, quantile_cont(o_totalprice, 0.9) as upper,
    quantile_cont(o_totalprice, 0.1) as lower
  from orders group by 1)"""
ALERTS = f"""{LIMITS}, alerts as (
  select o.*,
    case when o_totalprice > upper then 'HIGH' when o_totalprice < lower then 'LOW'
      else 'NORMAL' end as alert,
    case when o_totalprice > upper then least((o_totalprice - upper) / nullif(abs(upper), 0), 1)
      when o_totalprice < lower then least((lower - o_totalprice) / nullif(abs(lower), 0), 1)
      else 0 end as risk_score
  from orders o join limits l using (o_orderstatus))"""
STATUS = ["o_orderstatus"]


def _alerts(spark, sf):
    return L.with_alerts(V.table(spark, sf, "orders"), "o_totalprice", keys=STATUS)


@query(f"""with {LIMITS} select o_orderstatus, round(upper, 4) as upper, round(lower, 4) as lower
from limits""")
def alert_thresholds(spark, sf):
    df = V.table(spark, sf, "orders")
    return V.rounded(L.alert_thresholds(df, "o_totalprice", keys=STATUS))


@query("""select round(quantile_cont(o_totalprice, 0.9), 4) as upper,
  round(quantile_cont(o_totalprice, 0.1), 4) as lower from orders""")
def alert_thresholds_overall(spark, sf):
    return V.rounded(L.alert_thresholds(V.table(spark, sf, "orders"), "o_totalprice"))


@query("""select o_orderkey, case when o_totalprice > 400000 then 'HIGH'
  when o_totalprice < 50000 then 'LOW' else 'NORMAL' end as alert from orders""")
def alert_levels(spark, sf):
    df = L.with_alerts(V.table(spark, sf, "orders"), "o_totalprice", 400000, 50000)
    return df.select("o_orderkey", "alert")


@query("""select c_custkey, round(case when c_acctbal > 9000 then least((c_acctbal - 9000) / 9000, 1)
  when c_acctbal < -500 then least((-500 - c_acctbal) / 500, 1) else 0 end, 4) as risk_score,
  round(case when c_acctbal > 9000 then least((c_acctbal - 9000) / 9000, 1)
  when c_acctbal < -500 then least((-500 - c_acctbal) / -500, 1) else 0 end, 4) as signed_score
from customer""")
def risk_scores(spark, sf):
    df = V.table(spark, sf, "customer")
    c, upper, lower = F.col("c_acctbal"), F.lit(9000.0), F.lit(-500.0)
    return V.rounded(
        df.select(
            "c_custkey",
            L.risk_score(c, upper, lower).alias("risk_score"),
            L.risk_score(c, upper, lower, signed=True).alias("signed_score"),
        )
    )


@query(f"""with {ALERTS} select o_orderstatus, count(*) as total_records,
  count(*) filter (alert = 'HIGH') as high_alerts, count(*) filter (alert = 'LOW') as low_alerts,
  count(*) filter (alert = 'NORMAL') as normal, round(avg(risk_score), 4) as avg_risk_score
from alerts group by 1""")
def alert_summary(spark, sf):
    return V.rounded(L.alert_summary(_alerts(spark, sf), STATUS))


@query(f"""with {ALERTS}, ranked as (
  select *, row_number() over (partition by o_orderstatus order by risk_score desc, o_orderkey)
    as rank from alerts where alert <> 'NORMAL')
select o_orderstatus, o_orderkey, alert, round(risk_score, 4) as risk_score,
  cast(rank as int) as rank from ranked where rank <= 10""")
def top_risks(spark, sf):
    found = L.top_risks(_alerts(spark, sf), ["o_orderkey"], 10, STATUS)
    return V.rounded(found.select(*STATUS, "o_orderkey", "alert", "risk_score", "rank"))


@query(f"with {ALERTS} select alert, count(*) as count from alerts group by 1")
def alert_distribution(spark, sf):
    return L.alert_distribution(_alerts(spark, sf))


@query(f"with {ALERTS} select o_orderkey, alert, round(risk_score, 4) as risk_score from alerts")
def record_alerts(spark, sf):
    return V.rounded(_alerts(spark, sf).select("o_orderkey", "alert", "risk_score"))
