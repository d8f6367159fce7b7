"""The transit model projected onto general tables, in Spark and in SQL.

Stations are 0..99, a station's country is its number mod 25, stations below 50 are
airports ("A"), the others rail ("R").  Events (scheduled legs) come from all days of
``events``, transfers join stations of one country, train stops come from ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itinera.session import table

STATIONS, COUNTRIES = 100, 25
#: The day whose midnight is minute 0 of the events.
FIRST_DAY = "2024-01-01"


def stations(spark: SparkSession, d: str) -> DataFrame:
    """station, country, name, label, modality."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("country"), F.col("n_name").alias("name"))
    ids = spark.range(STATIONS).select(F.col("id").cast("int").alias("station"), (F.col("id") % COUNTRIES).cast("int").alias("country"))
    joined = ids.join(F.broadcast(nation), "country")
    label = F.concat(F.lit("S"), F.col("station").cast("string"), F.lit(" ("), F.col("name"), F.lit(")"))
    return joined.select("station", "country", "name", label.alias("label"), F.when(F.col("station") < 50, "A").otherwise("R").alias("modality"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """event_id, origin, dest, dep, arr, country (of dest), bit."""
    raw = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    dep = (F.hour("ts") * 60 + F.minute("ts") + F.datediff("ts", F.lit(FIRST_DAY)) * 1440).cast("bigint")
    legs = raw.select(
        "event_id", (F.col("user_id") % STATIONS).cast("int").alias("origin"), F.pmod(k * 7 + F.col("event_id"), F.lit(STATIONS)).cast("int").alias("dest"),
        dep.alias("dep"), (dep + 30 + F.col("event_id") % 150).alias("arr"),
    )
    crossing = legs.where(F.col("origin") % COUNTRIES != F.col("dest") % COUNTRIES)
    country = (F.col("dest") % COUNTRIES).cast("int")
    return crossing.withColumn("country", country).withColumn("bit", F.expr("shiftleft(1L, country)"))


def transfers(spark: SparkSession) -> DataFrame:
    """u, v, minutes between different stations of one country."""
    u = spark.range(STATIONS).select(F.col("id").cast("int").alias("u"), (F.col("id") % COUNTRIES).alias("c"))
    v = spark.range(STATIONS).select(F.col("id").cast("int").alias("v"), (F.col("id") % COUNTRIES).alias("c"))
    return u.join(v, "c").where("u <> v").select("u", "v", (10 + (F.col("u") * 7 + F.col("v") * 13) % 231).cast("int").alias("minutes"))


def stops(spark: SparkSession, d: str) -> DataFrame:
    """route, pos, station, clock (minute of the day) of train routes."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("route"), pos.alias("pos"), (F.col("l_suppkey") % STATIONS).cast("int").alias("station"),
        ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 53) % 1440).alias("clock"),
    )


STATIONS_SQL = """
stations as (
  select cast(i as int) as station, cast(i % 25 as int) as country, n_name as name, 'S' || i || ' (' || n_name || ')' as label,
    case when i < 50 then 'A' else 'R' end as modality
  from range(100) r(i) join nation on n_nationkey = i % 25)
"""
EVENTS_SQL = """
legs as (
  select event_id, cast(user_id % 100 as int) as origin,
    cast(((cast(json_extract_string(props, '$.k') as bigint) * 7 + event_id) % 100 + 100) % 100 as int) as dest,
    cast(hour(ts) * 60 + minute(ts) + date_diff('day', date '2024-01-01', cast(ts as date)) * 1440 as bigint) as dep
  from events),
ev as materialized (
  select event_id, origin, dest, dep, dep + 30 + event_id % 150 as arr, cast(dest % 25 as int) as country, cast(1 as bigint) << (dest % 25) as bit
  from legs where origin % 25 <> dest % 25)
"""
TRANSFERS_SQL = """
transfers as (
  select cast(a.i as int) as u, cast(b.i as int) as v, cast(10 + (a.i * 7 + b.i * 13) % 231 as int) as minutes
  from range(100) a(i), range(100) b(i) where a.i % 25 = b.i % 25 and a.i <> b.i)
"""
AON_SQL = """
reach as (
  select event_id as src, dest as place, arr as ready from ev
  union all select event_id, v, arr + minutes from ev join transfers on u = dest),
picked as (
  select src, b.event_id as dst, row_number() over (partition by src, b.dest order by b.arr, b.dep desc, b.origin, b.event_id) as r
  from reach join ev b on b.origin = place and b.dep >= ready),
aon as materialized (select src, dst from picked where r = 1),
hop as materialized (select src, dst, e.arr, e.dep, e.bit from aon join ev e on e.event_id = dst)
"""
STOPS_SQL = """
stops as (
  select l_orderkey as route, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) as pos,
    cast(l_suppkey % 100 as int) as station, (l_partkey * 37 + l_linenumber * 53) % 1440 as clock
  from lineitem)
"""
