"""Tables written by the sinks and read back by the readers, in the shared folder; the SQL states what went in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itinera.operators import routes as R
from itinera.plans.projection import EVENTS_SQL, events, transfers
from itinera.session import shared_dir, table
from itinera.sources import readers, sinks


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/io-{name}-{uuid.uuid4().hex}"


_FLIGHTS = "id bigint, flight_number string, departure_airport string, departure_delay_minutes int, date string"


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Flights written in two parts, the second appended, and read back by the schema."""
    path = _folder(spark, "csv")
    f = table(spark, d, "flights").select(*[c.split(" ")[0] for c in _FLIGHTS.split(", ")])
    sinks.write_csv(f.where("id % 2 = 0"), path)
    sinks.write_csv(f.where("id % 2 <> 0"), path, append=True)
    return readers.csv(spark, path, _FLIGHTS)


def airports_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Airports as the national file has them: semicolons, Central European bytes, decimal commas."""
    path = _folder(spark, "airports")
    comma = lambda c: F.regexp_replace(F.col(c).cast("decimal(12,6)").cast("string"), "[.]", ",")
    rows = table(spark, d, "airports").withColumns({"latitude_deg": comma("latitude_deg"), "longitude_deg": comma("longitude_deg"), "keywords": F.lit("\u0141\u00f3d\u017a \u4e2d")})
    sinks.write_csv(rows, path, sep=";", encoding="cp1250")
    back = readers.airports_csv(spark, path)
    return back.select("id", "ident", F.round("latitude_deg", 6).alias("latitude_deg"), F.round("longitude_deg", 6).alias("longitude_deg"), "elevation_ft", "iso_country", "keywords")


def cities_tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Cities as the positional file of a gazetteer."""
    path = _folder(spark, "cities")
    blank, text = F.lit(""), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    fields = [blank, text("name"), text("ascii_name"), text("alternate_names"), *[blank] * 4, text("country"), *[blank] * 5, text("population")]
    table(spark, d, "cities").select(F.concat_ws("\t", *fields).alias("value")).write.text(path)
    return readers.cities_tsv(spark, path)


def json_partitions_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Flights by date: the first load keeps its dates when a second comes with all of them."""
    path = _folder(spark, "json")
    f = table(spark, d, "flights").select("id", "flight_number", "date")
    sinks.write_json_partitions(f.where("date < '2026-04-01'"), path, ("date",))
    sinks.write_json_partitions(f.withColumn("flight_number", F.upper("flight_number")), path, ("date",))
    return spark.read.schema("id bigint, flight_number string, date string").json(path)


def route_lines_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Routes appended as lines by four jobs, and their segments counted again."""
    path = _folder(spark, "lines")
    r = table(spark, d, "master_elite_routes_full").select(F.col("total_countries").cast("int").alias("score"), F.from_json("route_sequence_json", readers.ROUTE_TYPE).alias("route"), (F.col("route_id") % 4).alias("job_idx"))
    for odd in (0, 1):
        sinks.append_route_lines(r.where(F.col("job_idx") % 2 == odd), path)
    return readers.route_lines(spark, path).groupBy("score").agg(F.count("*").alias("routes"), F.sum(F.size("route")).alias("segments"))


def elite_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The elite route table as it is written for pruning, with the metrics of the result beside it."""
    path = _folder(spark, "elite")
    r = table(spark, d, "master_elite_routes_full").select("route_id", "start_node", "total_countries")
    sinks.write_elite(r, f"{path}/elite")
    sinks.write_result(spark.read.parquet(f"{path}/elite"), f"{path}/result", 0.0, "total_countries", "start_node")
    return spark.read.parquet(f"{path}/result/metrics").drop("seconds")


def report_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the route report and rows of its JSON."""
    path = _folder(spark, "report")
    sinks.write_report(R.itinerary(R.segments(table(spark, d, "master_elite_routes_full"))), f"{path}/text", f"{path}/json")
    lines = spark.read.text(f"{path}/text").agg(F.count("*").alias("lines"))
    return lines.join(spark.read.schema("route_id bigint, pos int").json(f"{path}/json").agg(F.count("*").alias("rows"), F.countDistinct("route_id").alias("routes")))


def country_bits(spark: SparkSession, d: str) -> DataFrame:
    return sinks.country_bits(table(spark, d, "country_zones"), "country_name")


def checkpoint_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Routes in checkpoint documents of at most a thousand each, read back and counted by score."""
    path = _folder(spark, "checkpoint")
    r = table(spark, d, "master_elite_routes_full").select("total_countries", F.floor(F.col("route_id") / 1000).alias("part"), F.from_json("route_sequence_json", readers.ROUTE_TYPE).alias("route")).where("route is not null")
    lists = r.groupBy("part", "total_countries").agg(F.collect_list("route").alias("list"))
    docs = lists.select(F.col("total_countries").alias("global_max"), F.create_map(F.col("total_countries").cast("string"), F.col("list")).alias("routes"))
    docs.write.json(path)
    return readers.checkpoint_routes(spark, path, a_line=True).groupBy("score").agg(F.count("*").alias("routes"), F.sum(F.size("route")).alias("segments"))


def graph_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The tables of a stored graph: those that are there."""
    path = _folder(spark, "graph")
    events(spark, d).write.parquet(f"{path}/events")
    transfers(spark).write.parquet(f"{path}/transfers")
    tables = readers.graph_tables(spark, path)
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in sorted(tables.items())]
    return counts[0].unionByName(counts[1])


def load_once(spark: SparkSession, d: str) -> DataFrame:
    """Airports loaded without those that lack a code; a second load changes nothing."""
    path = _folder(spark, "load")
    a = table(spark, d, "airports").select("id", "ident", "iata_code")
    sinks.load_table(a, path, ["iata_code"])
    sinks.load_table(a.limit(0), path, ["iata_code"])
    return spark.read.parquet(path)


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Events in two numbered snapshots, the second replaced and marked as the last."""
    path = _folder(spark, "snapshot")
    ev = events(spark, d).select("event_id", "dep")
    for number, until in ((1, 1440), (2, 1440), (2, 2880)):
        sinks.write_snapshot(ev.where(F.col("dep") < until), path, number, done=until == 2880)
    if not sinks.exists(spark, f"{path}/_DONE"):
        raise RuntimeError("the flag of the last snapshot is missing")
    return spark.read.schema("event_id bigint, dep bigint, snapshot int").parquet(path).groupBy("snapshot").agg(F.count("*").alias("events"))


QUERIES = {f.__name__: f for f in (csv_round_trip, airports_csv_round_trip, cities_tsv_round_trip, json_partitions_round_trip, route_lines_round_trip, elite_round_trip, report_round_trip, country_bits, checkpoint_round_trip, graph_round_trip, load_once, snapshots)}
_ROUTES = """with parsed as (select route_id, total_countries, from_json(route_sequence_json, '[{"origin":"VARCHAR"}]') as r from master_elite_routes_full)"""
SQL = {
    "csv_round_trip": "select id, flight_number, departure_airport, departure_delay_minutes, date from flights",
    "airports_csv_round_trip": "select id, ident, round(cast(cast(latitude_deg as decimal(12,6)) as double), 6) as latitude_deg, round(cast(cast(longitude_deg as decimal(12,6)) as double), 6) as longitude_deg, elevation_ft, iso_country, '\u0141\u00f3d\u017a ?' as keywords from airports",
    "cities_tsv_round_trip": "select name, ascii_name, nullif(alternate_names, '') as alternate_names, country, coalesce(population, 0) as population from cities",
    "json_partitions_round_trip": "select id, case when date < '2026-04-01' then flight_number else upper(flight_number) end as flight_number, date from flights",
    "route_lines_round_trip": _ROUTES + " select cast(total_countries as int) as score, count(*) as routes, cast(sum(len(r)) as bigint) as segments from parsed where r is not null group by 1",
    "elite_round_trip": "select count(*) as paths, max(total_countries) as global_max, count(distinct start_node) as starts from master_elite_routes_full",
    "report_round_trip": _ROUTES + " select cast(sum(len(r)) as bigint) as lines, cast(sum(len(r)) as bigint) as rows, count(*) filter (len(r) > 0) as routes from parsed",
    "country_bits": "select country_name as country, cast(1 as bigint) << (row_number() over (order by country_name) - 1) as bit from (select distinct country_name from country_zones where country_name is not null)",
    "checkpoint_round_trip": _ROUTES + " select cast(total_countries as int) as score, count(*) as routes, cast(sum(len(r)) as bigint) as segments from parsed where r is not null group by 1",
    "graph_round_trip": "with " + EVENTS_SQL + "select 'events' as name, count(*) as rows from ev union all select 'transfers', 300",
    "load_once": "select id, ident, iata_code from airports where iata_code is not null",
    "snapshots": "with " + EVENTS_SQL + "select cast(i as int) as snapshot, count(*) as events from ev, range(1, 3) r(i) where dep < 1440 * i group by i",
}
