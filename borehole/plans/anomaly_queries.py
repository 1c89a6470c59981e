"""Registered queries: anomalies among rows of numbers."""

from borehole.operators import anomaly as A
from borehole.operators import geo, isolation, neighbours
from borehole.plans import views as V
from borehole.plans.registry import query
from borehole.session import scratch_path
from borehole.sources.layouts import read_datasets
from pyspark.sql import functions as F

FEATURES = ["balance", "nation"]


def _lof_sql(group: str) -> str:
    """Local outlier factor by comparing all pairs of rows within each group."""
    return f"""grouped as (select *, {group} as g from samples_planted),
scaled as (
  select id, g, balance, nation, (balance - avg(balance) over w) / stddev_pop(balance) over w as x,
    (nation - avg(nation) over w) / stddev_pop(nation) over w as y,
    least(greatest(floor(count(*) over w * 0.05), 5), 50, count(*) over w - 1) as k
  from grouped window w as (partition by g)),
spots as (select *, min(id) over (partition by g, balance, nation) as place from scaled),
pairs as (
  select p.g, p.id as p, o.id as o, p.k, round(sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2)), 9) as d,
    o.place from spots p join spots o on p.g = o.g and p.id <> o.id),
near as (
  select * from (select *, row_number() over (partition by p order by d, place, o) as r from pairs)
  where r <= k),
kd as (select p, max(d) as kdist from near group by 1),
lrd as (
  select n.p, 1 / (sum(greatest(kd.kdist, n.d)) / max(n.k) + 1e-10) as lrd
  from near n join kd on kd.p = n.o group by 1),
lof as (
  select n.p as id, round(-(sum(lo.lrd) / max(n.k)) / max(lp.lrd), 9) as raw
  from near n join lrd lo on lo.p = n.o join lrd lp on lp.p = n.p group by 1),
cuts as (
  select g, quantile_cont(raw, 0.1) as cut, min(raw) as low, max(raw) as high
  from lof join scaled using (id) group by 1),
scored as (
  select s.g, s.id, s.balance, s.nation, l.raw, l.raw < c.cut as is_anomaly,
    coalesce((c.high - l.raw) / nullif(c.high - c.low, 0), 0.5) as anomaly_score
  from lof l join scaled s using (id) join cuts c on c.g = s.g)"""


LOF = f"with {V.PLANTED}, {_lof_sql('0')}"
LOF_BY_SEGMENT = f"with {V.PLANTED}, {_lof_sql('segment')}"


def _lof(spark, sf, keys=()):
    df = V.samples_planted(spark, sf)
    return A.detect(df, "id", FEATURES, 0.1, "local_outlier_factor", keys=keys)


@query(f"""{LOF} select id, round(balance, 4) as balance, nation, round(raw, 4) as raw,
  round(anomaly_score, 4) as anomaly_score, is_anomaly from scored""")
def local_outlier_factor(spark, sf):
    return V.rounded(_lof(spark, sf))


@query(f"""{LOF}, {V.STATIONS_LARGE} select s.station_id::varchar as id, round(s.lat, 4) as lat,
  round(s.lon, 4) as lon, round(s.value, 4) as value, coalesce(c.is_anomaly, false) as anomaly
from stations_large s left join scored c on c.id = s.station_id""")
def map_anomalies(spark, sf):
    """Stations of a map, with those marked whose readings are anomalous."""
    points = geo.stations(V.stations_large(spark, sf), "lat", "lon", "value", "station_id")
    marked = geo.flag_anomalies(points, _lof(spark, sf).where("is_anomaly"))
    return V.rounded(marked.drop("cluster"))


@query(f"""with {V.PLANTED}, n as (select count(*) as n from samples_planted)
select n, cast(least(greatest(floor(n * 0.05), 5), 50, n - 1) as int) as k from n""")
def neighbour_count(spark, sf):
    df = V.samples_planted(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    return df.select("n", neighbours.neighbour_count(F.col("n")).alias("k"))


@query(f"""{LOF_BY_SEGMENT} select g as segment, id, round(anomaly_score, 4) as anomaly_score,
  is_anomaly from scored""")
def local_outlier_factor_by_segment(spark, sf):
    scored = _lof(spark, sf, ["segment"])
    return V.rounded(scored.select("segment", "id", "anomaly_score", "is_anomaly"))


@query(f"""{LOF} select count(*) as total_samples, count(*) filter (is_anomaly) as anomalies_detected,
  round(count(*) filter (is_anomaly) / count(*)::double, 4) as anomaly_rate,
  round(coalesce(avg(anomaly_score) filter (is_anomaly), 0), 4) as mean_anomaly_score,
  round(coalesce(avg(anomaly_score) filter (not is_anomaly), 0), 4) as mean_normal_score
from scored""")
def anomaly_statistics(spark, sf):
    return V.rounded(A.anomaly_statistics(_lof(spark, sf)))


@query(f"""{LOF} select count(*) filter (is_anomaly) as anomalies_detected,
  round(100e0 * count(*) filter (is_anomaly) / count(*), 4) as anomaly_percentage,
  round(avg(anomaly_score), 4) as mean_score from scored""")
def anomaly_counters(spark, sf):
    return V.rounded(A.anomaly_counters(_lof(spark, sf)))


@query(f"""{LOF} {" union all ".join(f'''select '{c}' as feature,
  round(avg({c}) filter (is_anomaly), 4) as anomaly_mean,
  round(avg({c}) filter (not is_anomaly), 4) as normal_mean,
  round(abs(avg({c}) filter (is_anomaly) - avg({c}) filter (not is_anomaly))
    / stddev_samp({c}) filter (not is_anomaly), 4) as difference_ratio from scored'''
  for c in FEATURES)}""")
def feature_analysis(spark, sf):
    return V.rounded(A.feature_analysis(_lof(spark, sf), FEATURES))


@query(f"""{LOF}, ranked as (
  select *, row_number() over (order by anomaly_score desc, id) as rank from scored where is_anomaly)
select id, round(balance, 4) as balance, nation, round(anomaly_score, 4) as anomaly_score,
  cast(rank as int) as rank from ranked where rank <= 10""")
def top_anomalies(spark, sf):
    top = A.top_anomalies(_lof(spark, sf), "id", 10)
    return V.rounded(top.select("id", *FEATURES, "anomaly_score", "rank"))


def _batch(spark, sf, method):
    df = V.samples_planted(spark, sf)
    wanted = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NOWHERE"]
    return A.batch_anomalies(df, "segment", "id", FEATURES, 0.1, method, datasets=wanted)


@query(f"""{LOF_BY_SEGMENT} select g as segment, true as success, null::varchar as error,
  count(*) filter (is_anomaly)::double as anomalies_detected,
  round(count(*) filter (is_anomaly) / count(*)::double, 4) as anomaly_rate from scored group by 1
union all select 'NOWHERE', false, 'dataset not found', null, null""")
def batch_anomalies(spark, sf):
    results, _ = _batch(spark, sf, "local_outlier_factor")
    return V.rounded(results.withColumn("anomalies_detected", F.col("anomalies_detected").cast("double")))


@query(f"""{LOF_BY_SEGMENT}, ranked as (
  select *, row_number() over (partition by g order by anomaly_score desc, id) as rank
  from scored where is_anomaly)
select g as segment, id, round(anomaly_score, 4) as anomaly_score, cast(rank as int) as rank
from ranked where rank <= 5""")
def batch_top_anomalies(spark, sf):
    _, top = _batch(spark, sf, "local_outlier_factor")
    return V.rounded(top.select("segment", "id", "anomaly_score", "rank"))


@query(f"""{LOF_BY_SEGMENT} select 6::bigint as total_datasets, 5::bigint as successful_analyses,
  1::bigint as failed_analyses, count(*) filter (is_anomaly) as total_anomalies_detected from scored""")
def batch_summary(spark, sf):
    results, _ = _batch(spark, sf, "local_outlier_factor")
    return A.batch_summary(results)


LAYOUTS = {"AUTOMOBILE": 0, "BUILDING": 0, "FURNITURE": 1, "MACHINERY": 2}


def _layouts(spark, sf):
    """Segments as files of three layouts: two with numbers under other names and delimiters, one of texts only."""
    df = V.samples_planted(spark, sf)
    path = scratch_path(spark, "layouts")
    forms = (
        (",", ["id", "balance", "nation"]),
        ("|", [F.lit("kept").alias("Remark"), F.col("nation").alias("Nation No."), "id", F.col("balance").alias("Balance ($)")]),
        (";", ["id", F.concat(F.lit("no. "), "nation").alias("remark")]),
    )
    for number, (delimiter, columns) in enumerate(forms):
        names = [name for name, n in LAYOUTS.items() if n == number]
        part = df.where(F.col("segment").isin(*names)).select("segment", *columns)
        part.write.partitionBy("segment").option("header", True).option("sep", delimiter).csv(f"{path}/{number}")
    return read_datasets(spark, f"{path}/*/segment=*", dataset_pattern=r"segment=([^/]+)/")


def _batch_layouts(spark, sf):
    wanted = [*LAYOUTS, "NOWHERE"]
    return A.batch_layouts(_layouts(spark, sf), "id", method="local_outlier_factor", wanted=wanted, id_type="bigint")


USABLE = "('AUTOMOBILE', 'BUILDING', 'FURNITURE')"


@query(f"""with {V.PLANTED} select segment as dataset_id, count(*) as n_rows,
  case segment when 'FURNITURE' then 'Balance_|Nation_No' when 'MACHINERY' then '' else 'balance|nation' end as features
from samples_planted where segment in {USABLE} or segment = 'MACHINERY' group by 1""")
def read_layouts(spark, sf):
    """Rows and numeric columns of each dataset, of three layouts."""
    found = _layouts(spark, sf)
    counted = found.rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_rows"))
    listed = found.features(["id"]).select("dataset_id", F.array_join("features", "|").alias("features"))
    return counted.join(listed, "dataset_id")


@query(f"""{LOF_BY_SEGMENT} select g as dataset_id, true as success, null::varchar as error,
  count(*) filter (is_anomaly)::double as anomalies_detected,
  round(count(*) filter (is_anomaly) / count(*)::double, 4) as anomaly_rate from scored where g in {USABLE} group by 1
union all select 'MACHINERY', false, 'no numeric features found', null, null
union all select 'NOWHERE', false, 'dataset not found', null, null""")
def batch_layouts(spark, sf):
    """Datasets of two layouts, one without numbers and one that is not there, in one batch."""
    results, _ = _batch_layouts(spark, sf)
    return V.rounded(results.withColumn("anomalies_detected", F.col("anomalies_detected").cast("double")).drop("features"))


@query(f"""{LOF_BY_SEGMENT}, ranked as (
  select *, row_number() over (partition by g order by anomaly_score desc, id) as rank
  from scored where is_anomaly and g in {USABLE})
select g as dataset_id, id, round(anomaly_score, 4) as anomaly_score, cast(rank as int) as rank,
  round(balance, 4) as balance, nation from ranked where rank <= 5""")
def batch_layouts_top(spark, sf):
    _, top = _batch_layouts(spark, sf)

    def either(a, b):
        return F.coalesce(F.try_element_at("values", F.lit(a)), F.try_element_at("values", F.lit(b)))

    values = {"balance": either("balance", "Balance_"), "nation": either("nation", "Nation_No")}
    return V.rounded(top.withColumns(values).drop("values", "is_anomaly"))


@query()
def isolation_forest(spark, sf):
    df = V.samples(spark, sf)
    features = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice", "l_extendedprice"]
    scored = A.detect(df, "row_id", features, 0.1, "isolation_forest")
    return V.rounded(scored.drop("raw"))


@query()
def isolation_forest_by_station(spark, sf):
    """One forest per station of the raw readings."""
    df = V.raw_readings(spark, sf).withColumn("weekday", F.dayofweek("ds"))
    scored = A.detect(df, "id", ["level", "weekday"], 0.1, "isolation_forest", keys=["station"])
    return V.rounded(scored.drop("raw"))


@query()
def isolation_trees(spark, sf):
    """Size of every tree of a forest over the order values."""
    df = V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    trees = isolation.build_forest(df, ["o_totalprice"], "o_orderkey")
    return trees.select("tree", "sampled", F.size("feature").alias("nodes"))
