"""Station views over the given tables, once as DataFrames and once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Amounts are turned into levels by odd divisors: means of whole cents would often lie exactly
# between two rounded values, and the two engines could then round apart. DOUBLE in both.
PRICE_UNIT = "9973e0"
VALUE_UNIT = "97e0"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema
        ]
    )


def day_text(df: DataFrame, *cols: str) -> DataFrame:
    """Timestamps as ``yyyy-MM-dd`` text."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in cols or ("ds",)})


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """About 1,700 dates with gaps for each of five stations (at sf0.01)."""
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("station"), F.col("o_orderdate").alias("ds"))
        .agg((F.avg("o_totalprice") / float(PRICE_UNIT)).alias("level"))
    )


READINGS = f"""readings as (
  select o_orderpriority as station, o_orderdate as ds,
    avg(o_totalprice) / {PRICE_UNIT} as level
  from orders group by 1, 2)"""


def raw_readings(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: dates repeat."""
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("station"),
        F.col("o_orderdate").alias("ds"),
        (F.col("o_totalprice") / float(PRICE_UNIT)).alias("level"),
        F.col("o_orderkey").alias("id"),
    )


RAW_READINGS = f"""raw_readings as (
  select o_orderpriority as station, o_orderdate as ds, o_totalprice / {PRICE_UNIT} as level,
    o_orderkey as id
  from orders)"""


def readings_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Five stations with one value on each of 30 days."""
    return (
        table(spark, sf, "events")
        .groupBy(
            F.col("event_type").alias("station"),
            F.to_date("ts").cast("timestamp_ntz").alias("ds"),
        )
        .agg((F.avg("value") / float(VALUE_UNIT)).alias("level"))
    )


DAILY = f"""readings_daily as (
  select event_type as station, cast(cast(ts as date) as timestamp) as ds,
    avg(value) / {VALUE_UNIT} as level
  from events group by 1, 2)"""


def readings_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """The daily series with a missing level every week."""
    gap = F.day("ds") % 7 == 3
    return readings_daily(spark, sf).withColumn("level", F.when(~gap, F.col("level")))


GAPS = f"""{DAILY}, readings_gaps as (
  select station, ds, case when day(ds) % 7 = 3 then null else level end as level
  from readings_daily)"""


def _stations(df: DataFrame, key: str, value: str) -> DataFrame:
    def degrees(start: int, factor: int):
        return (F.lit(start) + (F.col(key) * factor % 2900).cast("double") / 100).cast("double")

    return df.select(
        F.col(key).alias("station_id"),
        degrees(8, 37).alias("lat"),
        degrees(68, 53).alias("lon"),
        F.col(value).alias("value"),
    )


def stations(spark: SparkSession, sf: str) -> DataFrame:
    return _stations(table(spark, sf, "supplier"), "s_suppkey", "s_acctbal")


def stations_large(spark: SparkSession, sf: str) -> DataFrame:
    return _stations(table(spark, sf, "customer"), "c_custkey", "c_acctbal")


def _stations_sql(name: str, source: str, key: str, value: str) -> str:
    return f"""{name} as (
  select {key} as station_id,
    8 + cast({key} * 37 % 2900 as double) / 100 as lat,
    68 + cast({key} * 53 % 2900 as double) / 100 as lon,
    {value} as value
  from {source})"""


STATIONS = _stations_sql("stations", "supplier", "s_suppkey", "s_acctbal")
STATIONS_LARGE = _stations_sql("stations_large", "customer", "c_custkey", "c_acctbal")


def stations_dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Stations with missing, impossible and non-numeric coordinates; lon is text."""
    digit = F.col("station_id") % 10
    return stations_large(spark, sf).select(
        "station_id",
        F.when(digit == 3, F.lit(None))
        .when(digit == 7, F.lit(95.0))
        .otherwise(F.col("lat"))
        .alias("lat"),
        F.when(digit == 9, F.lit("n/a"))
        .otherwise(F.format_string("%.2f", "lon"))
        .alias("lon"),
        "value",
    )


DIRTY = f"""{STATIONS_LARGE}, stations_dirty as (
  select station_id,
    case station_id % 10 when 3 then null when 7 then 95.0 else lat end::double as lat,
    case station_id % 10 when 9 then 'n/a' else printf('%.2f', lon) end as lon, value
  from stations_large)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with their part: numbers, two categories and a row id."""
    line = table(spark, sf, "lineitem")
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.concat_ws(
            "-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            F.date_format("l_shipdate", "yyyyMMdd"),
            F.round(F.col("l_extendedprice") * 100).cast("long"),
        ).alias("row_id"),
        "l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice", "p_type",
        "l_returnflag", "l_extendedprice",
    )


SAMPLES = """samples as (
  select concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber,
           strftime(l_shipdate, '%Y%m%d'), cast(round(l_extendedprice * 100) as bigint)) as row_id,
    l_quantity, l_discount, l_tax, p_size, p_retailprice, p_type, l_returnflag, l_extendedprice
  from lineitem join part on l_partkey = p_partkey)"""


def samples_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Customers; every tenth has its balance moved far out."""
    df = table(spark, sf, "customer")
    far = df.agg((F.avg("c_acctbal") + 5 * F.stddev_samp("c_acctbal")).alias("v")).first()["v"]
    return df.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 10 == 5, F.lit(far)).otherwise(F.col("c_acctbal")).alias("balance"),
        F.col("c_nationkey").cast("double").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    )


PLANTED = """samples_planted as (
  select c_custkey as id,
    case when c_custkey % 10 = 5
      then (select avg(c_acctbal) + 5 * stddev_samp(c_acctbal) from customer)
      else c_acctbal end as balance,
    c_nationkey::double as nation, c_mktsegment as segment
  from customer)"""


def gappy_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with missing text, numbers and dates, and one nearly empty column."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("id"),
        F.when(key % 5 != 1, F.col("c_mktsegment")).alias("segment"),
        F.when(key % 4 != 2, F.col("c_acctbal")).alias("balance"),
        F.when(key % 3 != 1, F.col("c_nationkey").cast("double")).alias("nation"),
        F.when(key % 6 != 4, F.date_add(F.lit("2020-01-01").cast("date"), (key % 700).cast("int")).cast("timestamp_ntz")).alias("seen"),
        F.when(key % 9 == 0, F.col("c_acctbal")).alias("sparse"),
    )


GAPPY = """gappy as (
  select c_custkey as id,
    case when c_custkey % 5 <> 1 then c_mktsegment end as segment,
    case when c_custkey % 4 <> 2 then c_acctbal end as balance,
    case when c_custkey % 3 <> 1 then c_nationkey::double end as nation,
    case when c_custkey % 6 <> 4
      then cast(date '2020-01-01' + cast(c_custkey % 700 as int) as timestamp) end as seen,
    case when c_custkey % 9 = 0 then c_acctbal end as sparse
  from customer)"""


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as untyped text: numbers with some junk, dates in one of four shapes."""
    key = F.col("s_suppkey")
    day = F.date_add(F.lit("2021-01-01").cast("date"), (key % 900).cast("int"))
    shape = key % 4
    return table(spark, sf, "supplier").select(
        key.alias("id"),
        F.when(shape == 3, F.lit("x")).otherwise(F.format_string("%.2f", "s_acctbal")).alias("balance"),
        F.when(shape == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(shape == 1, F.date_format(day, "MM/dd/yyyy"))
        .when(shape == 2, F.date_format(day, "yyyy/MM/dd"))
        .otherwise(F.lit("unknown"))
        .alias("seen"),
        F.col("s_name").alias("name"),
    )


TEXTS = """days as (
  select *, date '2021-01-01' + cast(s_suppkey % 900 as int) as day from supplier),
texts as (
  select s_suppkey as id,
    case when s_suppkey % 4 = 3 then 'x' else printf('%.2f', s_acctbal) end as balance,
    case s_suppkey % 4 when 0 then strftime(day, '%Y-%m-%d') when 1 then strftime(day, '%m/%d/%Y')
      when 2 then strftime(day, '%Y/%m/%d') else 'unknown' end as seen,
    s_name as name
  from days)"""


def messy_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as lines of a badly kept delimited file: its data rows, without header."""
    key = F.col("s_suppkey")
    day = F.date_add(F.lit("2021-01-01").cast("date"), (key % 900).cast("int"))
    line = F.concat_ws(
        ";",
        key,
        F.when(key % 4 == 3, F.lit("x")).otherwise(F.format_string("%.2f", "s_acctbal")),
        F.date_format(day, "MM/dd/yyyy"),
        F.lit(""),
        F.col("s_name"),
    )
    empty = F.when(key % 5 == 0, F.lit(";;;;"))
    return table(spark, sf, "supplier").select(
        F.explode(F.array_compact(F.array(line, empty))).alias("value")
    )


MESSY_HEADER = "Station ID; Balance ($) ;Date Seen;Empty;Name"
