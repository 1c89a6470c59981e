"""Registered queries: cleaning, type detection and data quality."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borehole.operators import clean as C
from borehole.operators import quality as Q
from borehole.plans import views as V
from borehole.plans.registry import query


@query("select l_orderkey, l_linenumber, l_quantity from lineitem")
def clean_column_names(spark, sf):
    df = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return C.clean_column_names(df.toDF(" l orderkey ", "l_linenumber($)", "l-_quantity"))


@query("""select c_acctbal as a, c_mktsegment as b from customer where c_custkey % 4 <> 1""")
def drop_empty_rows(spark, sf):
    keep = F.col("c_custkey") % 4 != 1
    df = V.table(spark, sf, "customer").select(
        F.when(keep, F.col("c_acctbal")).alias("a"), F.when(keep, F.col("c_mktsegment")).alias("b")
    )
    return C.drop_empty_rows(df)


@query(f"with {V.GAPPY} select id, segment, balance from gappy")
def drop_empty_columns(spark, sf):
    df = V.gappy_customers(spark, sf).select("id", "segment", "balance")
    return C.drop_empty_columns(df.withColumn("void", F.lit(None).cast("string")))


@query(f"""with {V.TEXTS} select id, try_cast(balance as double) as balance, seen, name
from texts""")
def coerce_numeric(spark, sf):
    return C.coerce_numeric(V.texts(spark, sf))


DATE_RE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}|\d{4}/\d{2}/\d{2}"


@query(f"""with {V.TEXTS},
firsts as (
  select 'balance' as column_name, balance as v, row_number() over (order by id) as r from texts
  union all select 'seen', seen, row_number() over (order by id) from texts
  union all select 'name', name, row_number() over (order by id) from texts)
select column_name, avg(regexp_matches(v, '{DATE_RE}')::int) > 0.5 as is_date
from firsts where r <= 10 group by 1""")
def date_columns(spark, sf):
    df = V.texts(spark, sf)
    found = C.date_like_columns(df, ["id"])
    rows = [(c, c in found) for c in ("balance", "seen", "name")]
    return spark.createDataFrame(rows, "column_name string, is_date boolean")


@query(f"""with {V.TEXTS}
select id, coalesce(strftime(try_strptime(seen, '%Y-%m-%d'), '%Y-%m-%d'),
  strftime(try_strptime(seen, '%m/%d/%Y'), '%Y-%m-%d'),
  strftime(try_strptime(seen, '%Y/%m/%d'), '%Y-%m-%d')) as seen from texts""")
def coerce_dates(spark, sf):
    df = V.texts(spark, sf).select("id", "seen")
    return V.day_text(C.coerce_dates(df, C.date_like_columns(df, ["id"])), "seen")


def _profile_row(spark, profile: C.Profile) -> DataFrame:
    row = (
        profile.kind,
        profile.rows,
        len(profile.dtypes),
        round(profile.missing_percentage, 4),
        ",".join(profile.date_columns),
        ",".join(profile.coordinates),
        ",".join(profile.identifiers),
        ",".join(profile.targets),
    )
    schema = """kind string, n_rows long, n_columns long, missing_percentage double, dates string,
        coordinates string, identifiers string, targets string"""
    return spark.createDataFrame([row], schema)


@query(f"""with {V.DIRTY} select case when count(*) > 0 then 'geospatial' end as kind,
  count(*) as n_rows, 4::bigint as n_columns,
  round(100.0::double * count(*) filter (lat is null) / (count(*) * 4), 4) as missing_percentage,
  '' as dates, 'lat,lon' as coordinates, 'station_id' as identifiers, '' as targets
from stations_dirty""")
def detect_geospatial(spark, sf):
    return _profile_row(spark, C.detect_dataset_type(V.stations_dirty(spark, sf)))


@query(f"""with {V.GAPS} select case when count(*) > 10 then 'timeseries' else 'tabular' end as kind,
  count(*) as n_rows, 3::bigint as n_columns,
  round(100.0::double * count(*) filter (level is null) / (count(*) * 3), 4) as missing_percentage,
  'ds' as dates, '' as coordinates, 'station' as identifiers, 'level' as targets
from readings_gaps""")
def detect_timeseries(spark, sf):
    return _profile_row(spark, C.detect_dataset_type(V.readings_gaps(spark, sf)))


@query("""select 'tabular' as kind, count(*) as n_rows, 3::bigint as n_columns,
  0.0::double as missing_percentage, '' as dates, '' as coordinates, '' as identifiers, '' as targets
from part""")
def detect_tabular(spark, sf):
    df = V.table(spark, sf, "part").select("p_name", "p_size", "p_retailprice")
    return _profile_row(spark, C.detect_dataset_type(df))


@query(f"""with {V.DIRTY} select unnest(case when count(*) > 0
  then ['Suitable for geospatial mapping and clustering',
        'Can always run anomaly detection on any dataset'] end) as recommendation
from stations_dirty""")
def recommendations(spark, sf):
    kind = C.detect_dataset_type(V.stations_dirty(spark, sf)).kind
    return spark.createDataFrame([(r,) for r in C.recommendations(kind)], "recommendation string")


@query(f"""with {V.GAPPY} select round(100.0::double * sum(
  (segment is null)::int + (balance is null)::int + (nation is null)::int + (seen is null)::int
  + (sparse is null)::int) / (count(*) * 6), 4) as missing_percentage from gappy""")
def missing_percentage(spark, sf):
    return V.rounded(C.missing_percentage(V.gappy_customers(spark, sf)))


TYPED = """(values ('id', 'bigint'), ('segment', 'string'), ('balance', 'double'),
  ('nation', 'double'), ('seen', 'timestamp_ntz'), ('sparse', 'double')) t(column_name, dtype)"""


@query(f"""with {V.GAPPY}, counts as ({" union all ".join(f"""
  select '{c}' as column_name, count(*) - count({c}) as missing from gappy"""
  for c in ("id", "segment", "balance", "nation", "seen", "sparse"))})
select column_name, dtype, missing from counts join {TYPED} using (column_name)""")
def column_types(spark, sf):
    """Every column with its type and missing values."""
    df = V.gappy_customers(spark, sf)
    missing = Q.missing_stats(df).select("column_name", F.col("count").alias("missing"))
    return C.column_types(df).join(missing, "column_name")


# --- missing values ---------------------------------------------------------------------

SEEN = "strftime(seen, '%Y-%m-%d') as seen"


@query(f"with {V.GAPPY} select id, segment, balance, nation, {SEEN} from gappy")
def drop_sparse_columns(spark, sf):
    return V.day_text(C.drop_sparse_columns(V.gappy_customers(spark, sf)), "seen")


def _mode(column: str) -> str:
    return f"""(select {column} from gappy where {column} is not null group by 1
      order by count(*) desc, 1 limit 1)"""


@query(f"""with {V.GAPPY}
select id, coalesce(segment, {_mode("segment")}) as segment,
  round(coalesce(balance, (select quantile_cont(balance, 0.5) from gappy)), 4) as balance,
  round(coalesce(nation, (select quantile_cont(nation::double, 0.5) from gappy)), 4) as nation,
  strftime(last_value(seen ignore nulls) over (order by id), '%Y-%m-%d') as seen
from gappy""")
def fill_missing_auto(spark, sf):
    df = C.fill_missing(V.gappy_customers(spark, sf), "auto", order_by=["id"])
    return V.day_text(V.rounded(df), "seen")


@query(f"""with {V.GAPPY} select id, segment, balance, nation, {SEEN} from gappy
where segment is not null and balance is not null and nation is not null and seen is not null""")
def fill_missing_drop(spark, sf):
    return V.day_text(C.fill_missing(V.gappy_customers(spark, sf), "drop"), "seen")


@query(f"""with {V.GAPPY} select round(id::double, 4) as id, segment,
  round(coalesce(balance, avg(balance) over ()), 4) as balance,
  round(coalesce(nation, avg(nation) over ()), 4) as nation, {SEEN} from gappy""")
def fill_missing_mean(spark, sf):
    return V.day_text(V.rounded(C.fill_missing(V.gappy_customers(spark, sf), "fill_mean")), "seen")


@query(f"""with {V.GAPPY} select round(id::double, 4) as id, segment,
  round(coalesce(balance, (select quantile_cont(balance, 0.5) from gappy)), 4) as balance,
  round(coalesce(nation, (select quantile_cont(nation::double, 0.5) from gappy)), 4) as nation,
  {SEEN} from gappy""")
def fill_missing_median(spark, sf):
    df = C.fill_missing(V.gappy_customers(spark, sf), "fill_median")
    return V.day_text(V.rounded(df), "seen")


@query(f"""with {V.GAPPY} select id, coalesce(segment, {_mode("segment")}) as segment,
  coalesce(balance, {_mode("balance")}) as balance, coalesce(nation, {_mode("nation")}) as nation,
  strftime(coalesce(seen, {_mode("seen")}), '%Y-%m-%d') as seen from gappy""")
def fill_missing_mode(spark, sf):
    df = C.fill_missing(V.gappy_customers(spark, sf), "fill_mode")
    return V.day_text(df, "seen")


@query(f"""with {V.GAPS} select station, strftime(ds, '%Y-%m-%d') as ds,
  round(last_value(level ignore nulls) over (partition by station order by ds), 4) as level
from readings_gaps""")
def forward_fill(spark, sf):
    df = C.forward_fill(V.readings_gaps(spark, sf), ["level"], ["ds"], ["station"])
    return V.day_text(V.rounded(df))


# --- encoding and scaling ---------------------------------------------------------------


@query(f"""with {V.GAPPY} select id,
  coalesce(segment = 'BUILDING', false) as "segment_BUILDING",
  coalesce(segment = 'FURNITURE', false) as "segment_FURNITURE",
  coalesce(segment = 'HOUSEHOLD', false) as "segment_HOUSEHOLD",
  coalesce(segment = 'MACHINERY', false) as "segment_MACHINERY" from gappy""")
def encode_onehot(spark, sf):
    return C.encode_categorical(V.gappy_customers(spark, sf).select("id", "segment"))


@query(f"""with {V.GAPPY} select id,
  dense_rank() over (order by coalesce(segment, 'nan')) - 1 as segment from gappy""")
def encode_label(spark, sf):
    return C.encode_label(V.gappy_customers(spark, sf).select("id", "segment"))


@query("""with codes as (select c_name, row_number() over (order by c_name) - 1 as code
  from (select distinct c_name from customer))
select c_custkey, code as c_name from customer join codes using (c_name)""")
def encode_many_categories(spark, sf):
    """More than twenty names: one-hot gives way to label codes."""
    return C.encode_categorical(V.table(spark, sf, "customer").select("c_custkey", "c_name"))


@query(f"""with {V.GAPPY} select id,
  round(coalesce(balance, (select quantile_cont(balance, 0.5) from gappy)), 4) as balance,
  round(coalesce(nation, (select quantile_cont(nation::double, 0.5) from gappy)), 4) as nation
from gappy""")
def impute_median(spark, sf):
    df = V.gappy_customers(spark, sf).select("id", "balance", "nation")
    return V.rounded(C.impute_median(df, ["balance", "nation"]))


@query("""select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag,
  round((l_quantity - avg(l_quantity) over w) / stddev_pop(l_quantity) over w, 4) as l_quantity,
  round((l_extendedprice - avg(l_extendedprice) over w) / stddev_pop(l_extendedprice) over w, 4)
    as l_extendedprice, round(l_tax * 0, 4) as constant
from lineitem window w as (partition by l_returnflag)""")
def standardize(spark, sf):
    df = V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
        "l_quantity", "l_extendedprice", F.lit(7.0).alias("constant"),
    )
    features = ["l_quantity", "l_extendedprice", "constant"]
    return V.rounded(C.standardize(df, features, ["l_returnflag"]))


@query("""select event_id, user_id, event_type, value from events order by ts, event_id limit 10""")
def preview(spark, sf):
    df = C.preview(V.table(spark, sf, "events"), ["ts", "event_id"])
    return df.select("event_id", "user_id", "event_type", "value")


@query("""select event_id, user_id, event_type, value from (
  select *, row_number() over (partition by event_type order by ts desc, event_id desc) as r
  from events) where r <= 50""")
def latest_points(spark, sf):
    df = C.tail(V.table(spark, sf, "events"), ["ts", "event_id"], 50, ["event_type"])
    return df.select("event_id", "user_id", "event_type", "value")


# --- quality ----------------------------------------------------------------------------


def _union(frames):
    return V.rounded(reduce(DataFrame.unionByName, frames))


GAPPY_COLUMNS = ("id", "segment", "balance", "nation", "seen", "sparse")


def _dataset_sql() -> str:
    parts = [
        "select null as column_name, 'rows' as metric, n::double as value, null as detail, 'info' as severity from s",
        "select null, 'columns', 7, null, 'info'",
        "select null, 'duplicate_rows', copies, null, case when copies > 0 then 'warning' else 'info' end from d",
        "select null, 'dtype_columns', 1, 'bigint', 'info'",
        "select null, 'dtype_columns', 2, 'string', 'info'",
        "select null, 'dtype_columns', 3, 'double', 'info'",
        "select null, 'dtype_columns', 1, 'timestamp_ntz', 'info'",
        "select 'void', 'all_missing', null, null, 'warning'",
    ]
    for c in (*GAPPY_COLUMNS, "void"):
        parts += [
            f"select '{c}', 'missing_count', n_{c}, null, 'info' from s",
            f"select '{c}', 'missing_percentage', 100.0::double * n_{c} / n, null, 'info' from s",
            f"""select '{c}', 'over_half_missing', 100.0::double * n_{c} / n, null, 'warning' from s
                where 2 * n_{c} > n""",
        ]
    counts = ", ".join(f"count(*) - count({c}) as n_{c}" for c in (*GAPPY_COLUMNS, "void"))
    return f"""with {V.GAPPY}, twice as (
  select *, null::varchar as void from gappy
  union all select *, null::varchar from gappy where id % 10 = 3),
s as (select count(*) as n, {counts} from twice),
d as (select sum(c - 1)::double as copies from (
  select count(*) as c from twice group by {", ".join(GAPPY_COLUMNS)}, void)),
report as ({" union all ".join(parts)})
select 'dataset' as check, column_name, metric, round(value, 4) as value, detail, severity from report"""


def _copied(spark, sf):
    df = V.gappy_customers(spark, sf).withColumn("void", F.lit(None).cast("string"))
    return df.unionByName(df.where(F.col("id") % 10 == 3))


@query(_dataset_sql())
def validate_dataset(spark, sf):
    return V.rounded(Q.validate_dataset(_copied(spark, sf)))


@query(f"""with {V.GAPPY}
{" union all ".join(f'''select '{c}' as column_name, count(*) - count({c}) as count,
  round(100.0::double * (count(*) - count({c})) / count(*), 4) as percentage from gappy'''
  for c in GAPPY_COLUMNS)}""")
def missing_stats(spark, sf):
    return V.rounded(Q.missing_stats(V.gappy_customers(spark, sf)))


@query("""select cast(count(*) - (select count(*) from (
  select distinct l_returnflag, l_linestatus, l_quantity, l_discount, l_tax from lineitem)) as bigint)
  as duplicate_rows from lineitem""")
def duplicate_rows(spark, sf):
    df = V.table(spark, sf, "lineitem")
    return Q.duplicate_rows(
        df.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
    )


@query("""select dtype, columns, n as rows from (values ('bigint', 3::bigint), ('int', 1),
  ('double', 4), ('string', 2), ('timestamp_ntz', 1)) t(dtype, columns),
  (select count(*) as n from lineitem)""")
def dtype_histogram(spark, sf):
    df = V.table(spark, sf, "lineitem")
    return Q.dtype_histogram(df).withColumn("rows", F.lit(df.count()).cast("long"))


@query("""select 'columns' as check, column_name, metric, null::double as value,
  null::varchar as detail, severity from (values
    ('c_size', 'missing_required', 'error'), ('c_note', 'missing_optional', 'warning'),
    ('c_acctbal', 'extra', 'info'), ('c_custkey', 'found', 'info'), ('c_acctbal', 'found', 'info'),
    ('c_custkey', 'required_found', 'info')) t(column_name, metric, severity)
union all select 'numeric', 'c_custkey', unnest(['missing_count', 'min', 'max', 'mean', 'std',
    'unique_values']), unnest([count(*) - count(c_custkey), min(c_custkey), max(c_custkey),
    round(avg(c_custkey), 4), round(stddev_samp(c_custkey), 4), count(distinct c_custkey)]), null,
  'info' from customer
union all select 'numeric', 'c_custkey', 'data_type', null, 'bigint', 'info'""")
def validate_columns(spark, sf):
    """Which expected columns are there, and what is in those that are."""
    df = V.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    required = ["c_custkey", "c_size"]
    there = [c for c in required if c in df.columns]
    return _union([
        Q.validate_columns(df, required, ["c_note"]), Q.validate_numeric_columns(df, there)
    ])


@query(f"""with {V.TEXTS}, {V.GAPPY}, n as (
  select 'nation' as column_name, count(*) - count(nation) as missing, min(nation)::double as min,
    max(nation)::double as max, avg(nation) as mean, stddev_samp(nation) as std,
    count(distinct nation)::double as d from gappy
  union all select 'balance', count(*) - count(balance), min(balance), max(balance), avg(balance),
    stddev_samp(balance), count(distinct balance) from gappy),
report as (
  select column_name, 'missing_count' as metric, missing::double as value, null as detail, 'info' as severity from n
  union all select column_name, 'min', min, null, 'info' from n
  union all select column_name, 'max', max, null, 'info' from n
  union all select column_name, 'mean', mean, null, 'info' from n
  union all select column_name, 'std', std, null, 'info' from n
  union all select column_name, 'unique_values', d, null, 'info' from n
  union all select column_name, 'has_missing', null, null, 'error' from n
  union all select 'nation', 'data_type', null, 'double', 'info'
  union all select 'balance', 'data_type', null, 'double', 'info'
  union all select 'absent', 'not_found', null, null, 'error'
  union all select 'balance_text', 'missing_count', 0, null, 'info'
  union all select 'balance_text', 'data_type', null, 'string', 'info'
  union all select 'balance_text', 'non_numeric_values', count(*), null, 'warning' from texts
    where try_cast(balance as double) is null)
select 'numeric' as check, column_name, metric, round(value, 4) as value, detail, severity from report""")
def validate_numeric(spark, sf):
    gappy = V.gappy_customers(spark, sf)
    texts = V.texts(spark, sf).withColumnRenamed("balance", "balance_text")
    strict = Q.validate_numeric_columns(gappy, ["nation", "balance", "absent"], allow_missing=False)
    return _union([strict, Q.validate_numeric_columns(texts, ["balance_text"])])


@query(f"""with {V.TEXTS}, {V.RAW_READINGS}, parsed as (
  select seen, coalesce(try_strptime(seen, '%Y-%m-%d'), try_strptime(seen, '%m/%d/%Y'),
    try_strptime(seen, '%Y/%m/%d')) as day from texts),
p as (select count(*) filter (day is null) as bad, count(day) as n, min(day) as lo, max(day) as hi,
  count(distinct day) as d from parsed),
o as (select count(*) as n, min(ds) as lo, max(ds) as hi, count(distinct ds) as d from raw_readings),
all2 as (select 'seen' as column_name, 0 as typed, n, lo, hi, d from p
  union all select 'ds', 1, n, lo, hi, d from o),
report as (
  select column_name, 'is_datetime' as metric, typed::double as value, null as detail, 'info' as severity from all2
  union all select column_name, 'min_date', null, strftime(lo, '%Y-%m-%d'), 'info' from all2
  union all select column_name, 'max_date', null, strftime(hi, '%Y-%m-%d'), 'info' from all2
  union all select column_name, 'total_days', date_diff('day', lo, hi), null, 'info' from all2
  union all select column_name, 'unique_dates', d, null, 'info' from all2
  union all select column_name, 'duplicate_dates', n - d, null, 'warning' from all2 where n > d
  union all select 'seen', 'conversion_failures', bad, null,
    case when bad > 0 then 'warning' else 'info' end from p
  union all select 'absent', 'not_found', null, null, 'error')
select 'date' as check, column_name, metric, round(value, 4) as value, detail, severity from report""")
def validate_dates(spark, sf):
    return _union([
        Q.validate_date_columns(V.texts(spark, sf), ["seen", "absent"]),
        Q.validate_date_columns(V.raw_readings(spark, sf), ["ds"]),
    ])


@query(f"""with {V.DIRTY}, c as (
  select lat, lon as raw_lon, try_cast(lon as double) as lon from stations_dirty),
s as (select count(*) as n, count(*) filter (lat between -90 and 90 and lon between -180 and 180) as ok,
  min(lat) as lat0, max(lat) as lat1, min(lon) as lon0, max(lon) as lon1,
  count(*) filter (lat not between -90 and 90) as out_lat,
  count(*) filter (lon is null and raw_lon is not null) as bad_lon from c),
report as (
  select 'lat' as column_name, 'out_of_range' as metric, out_lat::double as value, 'warning' as severity from s
  union all select 'lon', 'non_numeric_values', bad_lon, 'warning' from s
  union all select 'lat', 'min', lat0, 'info' from s union all select 'lat', 'max', lat1, 'info' from s
  union all select 'lon', 'min', lon0, 'info' from s union all select 'lon', 'max', lon1, 'info' from s
  union all select null, 'total_records', n, 'info' from s
  union all select null, 'valid_coordinates', ok, 'info' from s
  union all select null, 'invalid_coordinates', n - ok, 'info' from s)
select 'coordinates' as check, column_name, metric, round(value, 4) as value, null::varchar as detail,
  severity from report""")
def validate_coordinates(spark, sf):
    return V.rounded(Q.validate_coordinates(V.stations_dirty(spark, sf), "lat", "lon"))
