"""Relational preparation: duplicates, upserts, scope, countries, stops, times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itinera.functions.text import squeeze
from itinera.functions.transit import name_score, normal_station, normal_tokens

#: Score from which a stop inside a route is always kept.
HIGH_SCORE = 16


def codeshare_groups(flights: DataFrame) -> DataFrame:
    """One row per physical flight: equal places, times and date; the least of the other columns and how many shared it."""
    keys = ["departure_airport", "arrival_airport", "departure_scheduled", "arrival_scheduled", "date"]
    rest = ["flight_number", "departure_estimated", "departure_delay_minutes", "status", "id"]
    return flights.where("status <> 'unknown'").groupBy(*keys).agg(*[F.min(c).alias(c) for c in rest], F.count("*").alias("shared"))


def upsert(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False, existing: DataFrame | None = None) -> DataFrame:
    """One row per key: the first (or last) by ``order``; with ``existing``, first-wins keeps its rows and drops their keys here.

    An aggregation of the whole row by its order, combined before the shuffle, so repeated keys cost no sort.
    """
    row, by = F.struct(*df.columns), F.struct(*order)
    picked = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg((F.max_by if last else F.min_by)(row, by).alias("_row")).select("_row.*")
    if existing is None:
        return picked
    if last:
        return picked.unionByName(existing.join(picked.select(*keys), list(keys), "left_anti"))
    return existing.unionByName(picked.join(existing.select(*keys), list(keys), "left_anti"))


def european_airports(airports: DataFrame) -> DataFrame:
    kinds = ["large_airport", "medium_airport", "small_airport"]
    return airports.where(F.col("type").isin(kinds) & (F.col("continent") == "EU") & (F.col("scheduled_service") == "yes") & F.col("iata_code").isNotNull())


def within_scope(flights: DataFrame, codes: DataFrame) -> DataFrame:
    """Flights whose both ends are among ``codes`` (code)."""
    a, b = codes.select(F.col("code").alias("departure_airport")), codes.select(F.col("code").alias("arrival_airport"))
    return flights.join(a, "departure_airport", "left_semi").join(b, "arrival_airport", "left_semi")


def most_populous(cities: DataFrame) -> DataFrame:
    """key, country of the most populous city per normal name (ties: the lesser name)."""
    best = F.max_by("country", F.struct("population", F.col("name").alias("n")))
    return cities.withColumn("population", F.coalesce("population", F.lit(0))).groupBy(normal_station(F.col("name")).alias("key")).agg(best.alias("country")).where("key <> ''")


def pattern_country(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """The country of the first pattern, in the given order, that the text holds; patterns are (substring, country), without regard to case."""
    low, out = F.lower(text), F.lit(None).cast("string")
    for part, country in reversed(patterns):
        out = F.when(F.contains(low, F.lit(part.lower())), country).otherwise(out)
    return out


def corrected_country(name: Column, country: Column, exact: dict[str, str], rules: Sequence[tuple[str, str]]) -> Column:
    """The country by an exact name, else by the first rule whose substring the name holds, else as found; only where one was found."""
    out = F.coalesce(pattern_country(name, rules), country)
    if exact:
        table = F.create_map(*[F.lit(x) for kv in exact.items() for x in kv])
        out = F.coalesce(F.try_element_at(table, name), out)
    return F.when(country.isNotNull(), out)


def detect_country(
    values: DataFrame, value: str, stations: DataFrame, cities: DataFrame, zones: DataFrame, patterns: Sequence[tuple[str, str]] = (), exact: dict[str, str] | None = None, rules: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """``values`` with country and strategy: a code or name in brackets, the station's, the city's, a pattern of the language, the city of the longest word.

    Each strategy but the patterns is one equi-join of a small dimension; the first that answers
    wins.  ``exact`` and ``rules`` then correct what was found.  Patterns and corrections are
    tables of the caller: they hold names of single places.
    """
    v = F.col(value)
    hint = F.upper(F.trim(F.regexp_extract(v, r"[\[(]([^\])]+)[\])]\s*$", 1)))
    bare = F.regexp_replace(v, r"\s*[\[(][^\])]*[\])]\s*$", "")
    tokens = normal_tokens(bare)
    longest = F.array_max(F.transform(tokens, lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))).t
    named = values.withColumns({"_hint": hint, "_key": normal_station(bare), "_word": F.regexp_replace(longest, r"[^a-z0-9]+", "")})
    codes = zones.select(F.upper("iso_country").alias("_hint"), F.col("iso_country").alias("by_hint"))
    codes = codes.union(zones.select(F.upper("country_name"), "iso_country"))
    station = stations.groupBy(normal_station(F.col("name")).alias("_key")).agg(F.min("country").alias("by_station")).where("_key <> ''")
    city = most_populous(cities)
    out = named.join(codes, "_hint", "left").join(station, "_key", "left").join(city.select(F.col("key").alias("_key"), F.col("country").alias("by_city")), "_key", "left")
    out = out.join(city.select(F.col("key").alias("_word"), F.col("country").alias("by_word")), "_word", "left").withColumn("by_pattern", pattern_country(v, patterns))
    by = ["by_hint", "by_station", "by_city", "by_pattern", "by_word"]
    strategy = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c[3:])) for c in by])
    found = corrected_country(bare, F.coalesce(*by), exact or {}, rules)
    return out.withColumns({"country": found, "strategy": strategy}).drop("_hint", "_key", "_word", *by)


#: Weights of a station's flags: main station, city, airport.
FLAG_WEIGHTS = {"is_main_station": 7, "is_city": 3, "is_airport": 3}


def station_flags(stations: DataFrame) -> DataFrame:
    """key and whether any station of that normal name is a main station, a city, an airport."""
    keyed = stations.where("name is not null").withColumn("key", normal_station(F.col("name"))).where("key <> ''")
    return keyed.groupBy("key").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in FLAG_WEIGHTS])


def stop_scores(stops: DataFrame, flags: DataFrame, name: str = "name") -> DataFrame:
    """key, example, n, routes, score of every station by normal name: flags, words of the name, and 3 or 2 for the busiest 5 or 10 percent (exact quantiles).

    ``stops``: route, pos, the name, and key, its normal form, if that is known already (else it
    is worked out for every stop).  The example is the name of the first stop, by route and place.
    """
    keyed = (stops if "key" in stops.columns else stops.withColumn("key", normal_station(F.col(name)))).where("key <> ''")
    freq = keyed.groupBy("key").agg(F.min_by(name, F.struct("route", "pos")).alias("example"), F.count("*").alias("n"), F.countDistinct("route").alias("routes"))
    q = freq.agg(F.percentile("n", F.lit(0.95)).alias("q95"), F.percentile("n", F.lit(0.90)).alias("q90"))
    kind = F.lit(0)
    for flag, weight in FLAG_WEIGHTS.items():
        kind = kind + F.when(F.col(flag), weight).otherwise(0)
    busy = F.when(F.col("n") >= F.col("q95"), 3).when(F.col("n") >= F.col("q90"), 2).otherwise(0)
    scored = freq.join(flags, "key", "left").join(F.broadcast(q))
    return scored.select("key", "example", "n", "routes", F.greatest(F.lit(0), kind + name_score(F.col("example")) + busy).alias("score"))


def important_stops(scored: DataFrame, high: int = HIGH_SCORE) -> DataFrame:
    """Of stops (route, pos, country, score): a route's first and last, each country's first, last and best, and any of a high score."""
    route = Window.partitionBy("route")
    land = Window.partitionBy("route", "country")
    first, last = F.min("pos").over(route), F.max("pos").over(route)
    best = F.max(F.struct("score", (-F.col("pos")).alias("p"))).over(land)
    keep = (F.col("pos") == first) | (F.col("pos") == last) | (F.col("pos") == F.min("pos").over(land)) | (F.col("pos") == F.max("pos").over(land)) | (F.col("pos") == -best.p) | (F.col("score") >= high)
    return scored.withColumn("_keep", keep).where("_keep").drop("_keep")


def legs_by_country(stops: DataFrame) -> DataFrame:
    """Stops regrouped: countries by first appearance, the destination's country last, the destination last; new_pos from 1."""
    route, land = Window.partitionBy("route"), Window.partitionBy("route", "country")
    end = F.max(F.struct("pos", "country")).over(route)
    flagged = stops.withColumns({"_first": F.min("pos").over(land), "_end": end.country, "_last": end.pos})
    order = Window.partitionBy("route").orderBy((F.col("country") == F.col("_end")).cast("int"), "_first", (F.col("pos") == F.col("_last")).cast("int"), "pos")
    return flagged.withColumn("new_pos", F.row_number().over(order)).drop("_first", "_end", "_last")


def keep_hubs(stops: DataFrame, hubs: DataFrame, countries: Sequence[int]) -> DataFrame:
    """In the named countries only stops that are hubs (station, hub), under the hub's name; elsewhere all stops as they are."""
    joined = stops.join(hubs, "station", "left")
    listed = F.col("country").isin(list(countries))
    return joined.where(~listed | F.col("hub").isNotNull()).withColumn("name", F.when(listed, F.col("hub")).otherwise(F.col("station").cast("string"))).drop("hub")


def route_clocks(stops: DataFrame) -> DataFrame:
    """route and its clocks in order, as one array per route."""
    return stops.groupBy("route").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "clock"))), lambda s: s.clock).alias("clocks"))


def absolute_minutes(stops: DataFrame) -> DataFrame:
    """``stops`` with minute, the clock as ``transit.rollover`` counts it on, beside the other columns."""
    w = Window.partitionBy("route").orderBy("pos")
    wraps = stops.withColumn("_wrap", F.when(F.col("clock") < F.lag("clock").over(w), F.lit(1440).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return wraps.withColumn("minute", F.col("clock") + F.sum("_wrap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_wrap")


def fill_times(arr: Column, dep: Column) -> tuple[Column, Column]:
    return F.coalesce(arr, dep), F.coalesce(dep, arr)


def corridor_ends(routes: DataFrame, text: str) -> DataFrame:
    """Corridors "A - x <-> y - B" as origin and destination, in both directions."""
    parts = F.filter(F.transform(F.split(F.col(text), r"\s*(?:↔|<->|–|—|-)\s*"), squeeze), lambda p: p != "")
    ends = routes.where(F.size(parts) >= 2).select(F.element_at(parts, 1).alias("origin"), F.element_at(parts, -1).alias("destination"))
    return ends.unionByName(ends.select(F.col("destination").alias("origin"), F.col("origin").alias("destination"))).distinct()


def forward_only(df: DataFrame, dep: Column, arr: Column) -> DataFrame:
    """Rows that depart before they arrive; rows without one of the times stay."""
    return df.where(dep.isNull() | arr.isNull() | (dep < arr))


def sortedness(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, rows, is_sorted: whether no value is less than the one before it; nulls are passed over."""
    w = Window.partitionBy(group).orderBy(order)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fits = df.withColumn("_ok", F.col(value).isNull() | before.isNull() | (before <= F.col(value)))
    return fits.groupBy(group).agg(F.count("*").alias("rows"), F.bool_and("_ok").alias("is_sorted"))


def compared_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows of two tables of one column with where they are: "both", "first" or "second"."""
    label = lambda df, name: df.withColumn("side", F.lit(name))
    return label(a.intersect(b), "both").unionByName(label(a.subtract(b), "first")).unionByName(label(b.subtract(a), "second"))
