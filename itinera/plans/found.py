"""Queries p1, p3, p5 and p6: the core problems over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itinera.functions.text import alnum_key, not_blank
from itinera.operators.orphans import ForeignKey, find_orphans, orphan_report
from itinera.operators.shred import shred, stop_rows
from itinera.operators.spatial import near_pairs
from itinera.operators.timestamps import MOST_ZONES, estimate_zones, read_times, to_instant
from itinera.session import cut, small, table

LISTS = ["legs_with_countries", "legs_filtered"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    stops = stop_rows(table(spark, d, "train_routes"), "id", LISTS, ["station"], every_entry=False).where(not_blank(F.col("station")))
    return stops.select(F.col("id").alias("route_id"), F.col("source").alias("list_name"), F.col("stop_no").cast("bigint").alias("stop_no"), "station")


def p1_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the adjacency table per list, kind and depth."""
    nodes = shred(table(spark, d, "train_routes"), ["id"], LISTS)
    return nodes.groupBy(F.col("source").alias("list_name"), "kind", "depth").agg(F.count("*").alias("nodes"), F.count("scalar").alias("scalars"))


def p1_stops(spark: SparkSession, d: str) -> DataFrame:
    """All entries of the lists as the entity table, unusable ones too."""
    return stop_rows(table(spark, d, "train_routes"), "id", LISTS).withColumnsRenamed({"id": "route_id", "source": "list_name"}).drop("list_node")


#: The references between the project's tables.
FLIGHT_KEYS = [ForeignKey("flights", f, "airports", "iata_code") for f in ("departure_airport", "arrival_airport")]
ZONE_KEY = ForeignKey("airports", "iso_country", "country_zones", "iso_country")


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    tables = {t: table(spark, d, t) for t in ("flights", "airports", "country_zones")}
    return find_orphans(tables, {"flights": "id", "airports": "id"}, [*FLIGHT_KEYS, ZONE_KEY])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The flights of the cascade that are orphans themselves, not by an orphaned airport."""
    return _cascade(spark, d).where("table_name = 'flights' and kind = 'direct'").select("id", "field")


def p3_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans per table and field, over zones <- airports <- flights."""
    return _cascade(spark, d).groupBy("table_name", "field", "kind").agg(F.count("*").alias("orphans"), F.countDistinct("ref").alias("refs"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan flights per field, kind and date."""
    orphans = _cascade(spark, d).where("table_name = 'flights'")
    return orphan_report(orphans, table(spark, d, "flights"), "id", "date")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(table(spark, d, "airports"), "id", "latitude_deg", "longitude_deg", 5.0)


_PLACES = {"departure_scheduled": "departure_airport", "departure_estimated": "departure_airport", "arrival_scheduled": "arrival_airport"}


def _airport_groups(spark: SparkSession, d: str) -> DataFrame:
    """code, group (the country) of each iata_code; of several rows the one of least id."""
    airports = table(spark, d, "airports").where(not_blank(F.col("iata_code")))
    one = airports.groupBy(alnum_key(F.col("iata_code")).alias("code")).agg(F.min_by("iso_country", "id").alias("group"))
    # Joined by several plans: worked out once.
    return cut(one.where("code <> ''"))


def _flight_times(spark: SparkSession, d: str) -> DataFrame:
    """id, field, code, wall_ms, offset_min and delay of the stated times of flights."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text"), F.col(a).alias("place")) for f, a in _PLACES.items()])
    flat = table(spark, d, "flights").select("id", F.explode(cells).alias("c")).select("id", "c.field", "c.text", "c.place").where(not_blank(F.col("text")))
    return read_times(flat, "text").where("wall_ms is not null").select("id", "field", alnum_key(F.col("place")).alias("code"), "wall_ms", "offset_min")


def observations(spark: SparkSession, d: str, places: DataFrame) -> DataFrame:
    """Local times of flights beside a moment that their record states with an offset: group, local_ms, lo_ms, hi_ms.

    - Estimated minus scheduled departure is the stated delay in minutes, so a local one of the
      two is within a minute of the other less or plus that delay.
    - A departure is ingested after it was scheduled.
    - Sequence order: a flight departs before it arrives, which bounds a local departure from
      above by the arrival, and a local arrival from below by the departure.

    ``places``: code, group.  The clocks of legs_* don't serve: they run on through countries
    of other zones without a jump, so their order says nothing about zones.
    """
    flights = table(spark, d, "flights").select("departure_airport", "arrival_airport", "departure_scheduled", "departure_estimated", "arrival_scheduled", "departure_delay_minutes", "created_at")
    a = read_times(flights, "departure_scheduled").withColumnsRenamed({"wall_ms": "sched", "offset_min": "sched_o"})
    b = read_times(a, "arrival_scheduled").withColumnsRenamed({"wall_ms": "arr", "offset_min": "arr_o"})
    c = read_times(b, "departure_estimated")
    delay = F.col("departure_delay_minutes").cast("bigint") * 60_000
    sched_utc, est_utc, arr_utc = (F.col(w) - F.col(o) * 60_000 for w, o in (("sched", "sched_o"), ("wall_ms", "offset_min"), ("arr", "arr_o")))
    local_sched = F.col("sched").isNotNull() & F.col("sched_o").isNull()
    local_est = F.col("wall_ms").isNotNull() & F.col("offset_min").isNull()
    exact = F.when(local_sched, est_utc - delay).when(local_est, sched_utc + delay)
    leaves = F.struct(
        alnum_key(F.col("departure_airport")).alias("code"),
        F.when(local_sched, F.col("sched")).when(local_est, F.col("wall_ms")).alias("local_ms"),
        (exact - 60_000).alias("lo_ms"),
        F.least(exact + 60_000, F.when(local_sched, F.least(F.unix_millis("created_at"), arr_utc))).alias("hi_ms"),
    )
    local_arr = F.col("arr").isNotNull() & F.col("arr_o").isNull()
    lands = F.struct(alnum_key(F.col("arrival_airport")).alias("code"), F.when(local_arr, F.col("arr")).alias("local_ms"), sched_utc.alias("lo_ms"), F.lit(None).cast("bigint").alias("hi_ms"))
    seen = c.select(F.inline(F.array(leaves, lands))).where("local_ms is not null and coalesce(lo_ms, hi_ms) is not null")
    return seen.join(small(places), "code").select("group", "local_ms", "lo_ms", "hi_ms")


def zone_choices(spark: SparkSession, d: str, places: DataFrame) -> DataFrame:
    """group, zone, declared, estimated, n, violations, declared_violations, runner_up, source, differs: per country the zone that its times are read by.

    Where there is evidence the estimate supplies the zone; country_zones breaks its ties and
    supplies the zone of countries without evidence.
    """
    declared = table(spark, d, "country_zones").select(F.col("iso_country").alias("group"), F.col("tz_name").alias("zone"))
    listed = [r["zone"] for r in declared.select("zone").distinct().limit(MOST_ZONES + 1).collect()]
    estimated = estimate_zones(observations(spark, d, places), listed, declared).withColumnRenamed("zone", "estimated")
    both = declared.withColumnRenamed("zone", "declared").join(estimated, "group", "full")
    return both.withColumns({"zone": F.coalesce("estimated", "declared"), "source": F.when(F.col("estimated").isNotNull(), "evidence").otherwise("declared"), "differs": F.coalesce(F.col("estimated") != F.col("declared"), F.lit(False))})


def p6_zones(spark: SparkSession, d: str) -> DataFrame:
    """The zone of every country, whence it comes, its violations, and whether it differs from the declared one."""
    return zone_choices(spark, d, _airport_groups(spark, d)).select(F.col("group").alias("iso_country"), "zone", "source", "declared", "differs", "n", "violations", "declared_violations", "runner_up")


def instants(spark: SparkSession, d: str, places: DataFrame, chosen: DataFrame) -> DataFrame:
    """table_name, id, field, epoch_ms of all stated times, local ones by the zones ``chosen`` (group, zone)."""
    zones = small(cut(places.join(small(chosen), "group").select("code", "zone")))
    times = _flight_times(spark, d).join(zones, "code", "left")
    flights = times.select(F.lit("flights").alias("table_name"), "id", "field", to_instant(F.col("wall_ms"), F.col("offset_min"), F.col("zone")).alias("epoch_ms"))
    stations = cut(table(spark, d, "stations").select(F.col("name").alias("route_origin"), F.col("country").alias("group")).join(small(chosen), "group", "left"))
    routes = table(spark, d, "train_routes").select("id", "route_origin", "search_date", "departure_time").where(not_blank(F.col("departure_time")))
    trains = read_times(routes.join(small(stations), "route_origin"), "departure_time", "search_date").where("wall_ms is not null")
    trains = trains.select(F.lit("train_routes").alias("table_name"), "id", F.lit("departure_time").alias("field"), to_instant(F.col("wall_ms"), F.col("offset_min"), F.col("zone")).alias("epoch_ms"))
    return flights.unionByName(trains).where("epoch_ms is not null")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Only countries of country_zones have a zone at all; which one, the estimate says where it has evidence."""
    places = _airport_groups(spark, d)
    # A row per country, read by several joins: worked out once.
    chosen = cut(zone_choices(spark, d, places).where("declared is not null").select("group", "zone"))
    return instants(spark, d, places, chosen)


QUERIES = {f.__name__: f for f in (p1_found, p1_adjacency, p1_stops, p3_found, p3_cascade, p3_report, p5_found, p6_found, p6_zones)}
