"""Registered queries: tabular prediction, files, streams and whole analyses."""

from borehole.operators import alerts as L
from borehole.operators import clean as C
from borehole.operators import geo
from borehole.operators import tabular as T
from borehole.plans import analyze
from borehole.plans import views as V
from borehole.plans.registry import query
from borehole.session import scratch_path
from borehole.sources import files, sinks
from borehole.streaming import rowwise
from pyspark.sql import functions as F

# --- tabular ----------------------------------------------------------------------------


@query(f"""with {V.SAMPLES} select 'l_extendedprice' as target, count(*) as known_targets,
  case when count(distinct l_extendedprice) < 10 then 'classification' else 'regression' end as task
  from samples union all
select 'l_returnflag', count(l_returnflag), 'classification' from samples union all
select 'l_tax', count(l_tax),
  case when count(distinct l_tax) < 10 then 'classification' else 'regression' end from samples""")
def target_and_task(spark, sf):
    df = V.samples(spark, sf)
    rows = []
    for wanted in (None, "l_returnflag", "l_tax"):
        target = T.choose_target(df, wanted)
        known = T.with_target(df, target)
        rows.append((target, known.count(), T.choose_task(known, target)))
    return spark.createDataFrame(rows, "target string, known_targets long, task string")


@query(f"""with {V.SAMPLES}, ranked as (
  select row_id, l_returnflag, row_number() over (partition by l_returnflag
      order by md5('42:' || row_id), row_id) as r, count(*) over (partition by l_returnflag) as n
  from samples)
select row_id, l_returnflag, r <= ceil(n * 0.2e0) as is_test from ranked""")
def stratified_split(spark, sf):
    df = V.samples(spark, sf).select("row_id", "l_returnflag")
    return T.train_test_split(df, "row_id", stratify=["l_returnflag"])


@query("""with ranked as (
  select c_custkey, row_number() over (order by md5('7:' || c_custkey), c_custkey) as r,
    count(*) over () as n from customer)
select c_custkey, r <= ceil(n * 0.3e0) as is_test from ranked""")
def random_split(spark, sf):
    df = V.table(spark, sf, "customer").select("c_custkey")
    return T.train_test_split(df, "c_custkey", 0.3, seed=7)


@query("""select distinct p_type as label,
  dense_rank() over (order by p_type) - 1 as code from part""")
def target_labels(spark, sf):
    codes = C.label_dictionary(V.table(spark, sf, "part"), "p_type")
    return codes.select(F.col("value").alias("label"), "code")


@query("""with p as (select l_extendedprice as y, 1500 * l_quantity as p from lineitem)
select round(sqrt(avg((y - p) * (y - p))), 2) as rmse, round(avg(abs(y - p)), 2) as mae,
  round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) as r2 from p""")
def regression_metrics(spark, sf):
    df = V.table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("actual"), (1500 * F.col("l_quantity")).alias("predicted")
    )
    found = T.regression_metrics(df)
    return found.select(F.round("rmse", 2).alias("rmse"), F.round("mae", 2).alias("mae"),
                        F.round("r2", 4).alias("r2"))


@query("""with p as (
  select l_returnflag as a, case when l_quantity > 40 then 'R' when l_tax > 0.05 then 'N' else 'A' end as p
  from lineitem),
per_class as (
  select c.label, count(*) filter (a = c.label) as support, count(*) filter (p = c.label) as claimed,
    count(*) filter (a = c.label and p = c.label) as hits
  from p, (values ('A'), ('N'), ('R')) c(label) group by 1)
select round(sum(hits) / sum(support)::double, 4) as accuracy,
  round(sum(support * (2e0 * hits / (support + claimed))) / sum(support), 4) as f1 from per_class""")
def classification_metrics(spark, sf):
    guess = F.when(F.col("l_quantity") > 40, "R").when(F.col("l_tax") > 0.05, "N").otherwise("A")
    df = V.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("actual"), guess.alias("predicted")
    )
    return V.rounded(T.classification_metrics(df))


def _train(spark, sf, target):
    return T.train_and_predict(V.samples(spark, sf), "row_id", target)


@query()
def forest_regression(spark, sf):
    """Errors of a random forest for the price of a line item."""
    return V.rounded(_train(spark, sf, "l_extendedprice").metrics)


@query()
def forest_classification(spark, sf):
    """Errors of a random forest for the return flag, stratified by it."""
    return V.rounded(_train(spark, sf, "l_returnflag").metrics)


@query()
def feature_importance(spark, sf):
    trained = _train(spark, sf, "l_extendedprice")
    df = V.samples(spark, sf)
    return V.rounded(T.feature_importance(df, trained.model, trained.feature_names))


@query()
def sample_predictions(spark, sf):
    trained = _train(spark, sf, "l_extendedprice")
    return V.rounded(T.sample_predictions(trained.predictions, "row_id"))


@query()
def stored_model_predictions(spark, sf):
    """A classifier is written, read back and applied to all rows, with class probabilities."""
    trained = _train(spark, sf, "l_returnflag")
    path = T.save_model(trained.model, scratch_path(spark, "models"), "flags")
    scored = T.load_and_predict(path, V.samples(spark, sf).drop("l_returnflag"))
    labels = F.array(*[F.lit(c) for c in T.model_classes(T.load_model(path))])
    return scored.select(
        "row_id", "predicted", F.round(F.array_max("probabilities"), 4).alias("probability"),
        F.size(labels).alias("classes"),
    )


@query("select l_returnflag as class, count(*) as rows from lineitem group by 1")
def target_classes(spark, sf):
    """Class labels as the target encoder sees them, with the rows of each."""
    df = V.table(spark, sf, "lineitem")
    codes = C.label_dictionary(df, "l_returnflag").select(F.col("value").alias("class"))
    rows = df.groupBy(F.col("l_returnflag").alias("class")).agg(F.count(F.lit(1)).alias("rows"))
    return codes.join(rows, "class")


# --- files ------------------------------------------------------------------------------


def _messy_file(spark, sf) -> str:
    path = scratch_path(spark, "messy") + ".csv"
    lines = V.messy_lines(spark, sf)
    # each part file needs the header line first
    header = F.when(F.col("row") == 0, F.array(F.lit(V.MESSY_HEADER), F.col("value")))
    numbered = lines.select("value", F.monotonically_increasing_id().alias("id")).select(
        "value", F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("row")
    )
    numbered.select(F.explode(header.otherwise(F.array("value"))).alias("value")).write.text(path)
    return path


@query("""select s_suppkey as "Station_ID", case when s_suppkey % 4 <> 3 then s_acctbal end as "Balance_",
  strftime(date '2021-01-01' + cast(s_suppkey % 900 as int), '%Y-%m-%d') as "Date_Seen",
  s_name as "Name" from supplier""")
def read_delimited(spark, sf):
    df = files.read_delimited(spark, _messy_file(spark, sf))
    return V.day_text(df.withColumn("Station_ID", F.col("Station_ID").cast("long")), "Date_Seen")


@query("""select case when count(*) > 0 then ';' end as delimiter, count(*) as lines from supplier""")
def detect_delimiter(spark, sf):
    path = _messy_file(spark, sf)
    found = files.detect_delimiter(files.sample_text(spark, path))
    lines = spark.read.text(path).where(F.col("value").rlike("Supplier"))
    return lines.agg(F.lit(found).alias("delimiter"), F.count(F.lit(1)).alias("lines"))


@query("""select c_mktsegment as dataset_id, count(*) as rows, round(avg(c_acctbal), 4) as balance
from customer group by 1""")
def read_many(spark, sf):
    path = scratch_path(spark, "many")
    df = V.table(spark, sf, "customer").withColumn("part", F.col("c_mktsegment"))
    df.write.partitionBy("part").option("header", True).csv(path)
    many = files.read_many(spark, f"{path}/part=*", dataset_pattern=r"part=([^/]+)/")
    return V.rounded(
        many.groupBy("dataset_id").agg(
            F.count(F.lit(1)).alias("rows"), F.avg("c_acctbal").alias("balance")
        )
    )


@query()
def list_datasets(spark, sf):
    return files.list_datasets(spark, sf, ["parquet"]).drop("upload_time")


@query(f"""with {V.STATIONS_LARGE} select 'north' as dataset_id, 'geospatial' as kind,
  count(*) as n_rows, round(avg(value), 4) as value from stations_large where lat >= 20
union all select 'south', 'geospatial', count(*), round(avg(value), 4) from stations_large where lat < 20""")
def register_dataset(spark, sf):
    folder = scratch_path(spark, "datasets")
    df = V.stations_large(spark, sf)
    kinds = {
        name: files.register_dataset(part, name, folder).kind
        for name, part in (("north", df.where("lat >= 20")), ("south", df.where("lat < 20")))
    }
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("dataset_id")]
    stored = files.load_datasets(spark, folder, ["north", "south"])
    return V.rounded(
        stored.groupBy("dataset_id").agg(
            F.first(kind).alias("kind"), F.count(F.lit(1)).alias("n_rows"), F.avg("value").alias("value")
        )
    )


@query(f"""with {V.STATIONS_LARGE} select station_id::varchar as id, 'Feature' as type,
  round(lat, 4) as lat from stations_large""")
def write_geojson(spark, sf):
    path = scratch_path(spark, "geojson")
    points = geo.stations(V.stations_large(spark, sf), "lat", "lon", "value", "station_id")
    sinks.write_geojson(geo.to_geojson(points), path)
    schema = "type string, properties struct<id: string, lat: double>"
    back = spark.read.schema(schema).json(path)
    return V.rounded(back.select("properties.id", "type", "properties.lat"))


def _written_collection(spark, sf):
    path = scratch_path(spark, "collection")
    points = geo.stations(V.stations_large(spark, sf), "lat", "lon", "value", "station_id")
    return path, sinks.write_feature_collection(geo.to_geojson(points), path)


@query(f"""with {V.STATIONS_LARGE} select 'FeatureCollection' as type, count(*) as features
from stations_large""")
def feature_collection(spark, sf):
    """Kind of the document, from its opening, and the features of all its parts by the manifest."""
    _, manifest = _written_collection(spark, sf)
    total = manifest.agg(F.sum("features").alias("features"))
    opening = spark.read.text(manifest.first()["file"]).where(F.col("value").startswith('{"type":'))
    kind = F.from_json(F.concat("value", F.lit("]}")), "type string, features array<string>")["type"]
    return opening.select(kind.alias("type")).join(total)


@query(f"""with {V.STATIONS_LARGE} select station_id::varchar as id, 'Feature' as type,
  round(lat, 4) as lat, round(value, 4) as value from stations_large""")
def collection_features(spark, sf):
    """The features of a collection written in parts, read back field by field."""
    path, _ = _written_collection(spark, sf)
    schema = "type string, properties struct<id: string, lat: double, value: double>"
    back = sinks.read_feature_collection(spark, path).select(F.from_json("feature", schema).alias("f"))
    return V.rounded(back.select("f.properties.id", "f.type", "f.properties.lat", "f.properties.value"))


@query(f"""with {V.STATIONS_LARGE} select station_id, true as success, 'stations' as task,
  round(value, 4) as value, lat > 20 as north from stations_large""")
def result_envelopes(spark, sf):
    """The envelope of each result, read back field by field."""
    df = V.stations_large(spark, sf).select("station_id", "value", (F.col("lat") > 20).alias("north"))
    schema = "success boolean, task string, data struct<station_id: long, value: double, north: boolean>"
    back = sinks.result_envelope(df, "stations").select(F.from_json("value", schema).alias("r"))
    return V.rounded(back.select("r.data.station_id", "r.success", "r.task", "r.data.value", "r.data.north"))


@query(f"""with {V.GAPPY} select id, segment, balance, segment is null as wrote_null from gappy""")
def write_json(spark, sf):
    path = scratch_path(spark, "json")
    df = V.gappy_customers(spark, sf).select("id", "segment", "balance")
    sinks.write_json(df, path)
    back = spark.read.text(path)
    parsed = F.from_json("value", "id long, segment string, balance double")
    wrote_null = F.col("value").contains('"segment":null')
    return back.select(parsed.alias("r"), wrote_null.alias("wrote_null")).select("r.*", "wrote_null")


# --- streams ----------------------------------------------------------------------------


def _streamed(spark, sf, name, transform):
    schema = V.table(spark, sf, name).schema
    stream = rowwise.read_folder(spark, sf, schema, f"{name}.parquet")
    path = scratch_path(spark, "stream")
    made = transform(stream)
    rowwise.write_folder(made, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{path}/out")


@query("""select o_orderkey, case when o_totalprice > 400000 then 'HIGH'
  when o_totalprice < 50000 then 'LOW' else 'NORMAL' end as alert,
  round(case when o_totalprice > 400000 then least((o_totalprice - 400000) / 400000, 1)
    when o_totalprice < 50000 then least((50000 - o_totalprice) / 50000, 1) else 0 end, 4) as risk_score
from orders""")
def streamed_alerts(spark, sf):
    out = _streamed(
        spark, sf, "orders", lambda s: L.with_alerts(s, "o_totalprice", 400000, 50000)
        .select("o_orderkey", "alert", "risk_score"),
    )
    return V.rounded(out)


@query(f"""with {V.STATIONS} select station_id::varchar as id, round(lat, 4) as lat from stations""")
def streamed_stations(spark, sf):
    def transform(stream):
        df = V._stations(stream, "s_suppkey", "s_acctbal")
        return geo.stations(df, "lat", "lon", "value", "station_id").select("id", "lat")

    return V.rounded(_streamed(spark, sf, "supplier", transform))


# --- whole analyses ---------------------------------------------------------------------


@query(f"""with {V.STATIONS_LARGE} select 'bounds' as part, round(max(lat), 4) as a,
  round(min(lat), 4) as b from stations_large
union all select 'center', round(avg(lat), 4), round(avg(lon), 4) from stations_large
union all select 'stations', count(*)::double, null from stations_large""")
def map_analysis(spark, sf):
    df = V.stations_large(spark, sf)
    roles = analyze.Roles("station_id", lat="lat", lon="lon", value="value")
    found = analyze.run_analysis(df, analyze.MAP, roles)
    parts = [
        found["bounds"].select(F.lit("bounds").alias("part"), F.col("north").alias("a"), F.col("south").alias("b")),
        found["center"].select(F.lit("center"), "lat", "lon"),
        found["stations"].agg(F.lit("stations"), F.count(F.lit(1)).cast("double"), F.lit(None).cast("double")),
    ]
    return V.rounded(parts[0].unionAll(parts[1]).unionAll(parts[2]))


@query()
def auto_analysis(spark, sf):
    """Every analysis a mixed table allows, with the rows of each result table."""
    df = V.raw_readings(spark, sf).withColumns({
        "lat": F.lit(8.0) + F.col("id") % 29, "lon": F.lit(68.0) + F.col("id") % 31,
    })
    roles = analyze.Roles("id", keys=["station"], target="level")
    profile, found = analyze.auto_analyze(df, roles)
    rows = [
        table.agg(
            F.lit(profile.kind).alias("kind"), F.lit(kind).alias("analysis"),
            F.lit(name).alias("result"), F.count(F.lit(1)).alias("rows"),
        )
        for kind, tables in found.items()
        for name, table in tables.items()
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out
