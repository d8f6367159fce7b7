"""Queries of the preparation operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itinera.functions import transit as fn
from itinera.functions.text import squeeze
from itinera.operators import prep
from itinera.operators.shred import paired_stops
from itinera.plans.found_sql import _STOPS
from itinera.plans.projection import STOPS_SQL, stops
from itinera.session import cut, small, table
from itinera.sources.readers import flatten_flights


def flight_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Raw flight documents, made from ``events``, flattened with their delays."""
    iso = "yyyy-MM-dd't'HH:mm:ss.SSS"
    k = F.get_json_object("props", "$.k").cast("int")
    late = F.col("ts") + F.make_dt_interval(mins=k)
    raw = table(spark, d, "events").select(
        "event_id",
        F.struct(F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.lit("it"), F.col("event_id").cast("string"))).alias("iataNumber"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("number")).alias("flight"),
        F.struct(F.concat(F.lit("a"), (F.col("user_id") % 100).cast("string")).alias("iataCode"), F.date_format("ts", iso).alias("scheduledTime"), F.when(F.col("event_id") % 3 != 0, F.date_format(late, iso)).alias("estimatedTime")).alias("departure"),
        F.when(F.col("event_id") % 11 != 0, F.struct(F.concat(F.lit("b"), k.cast("string")).alias("iataCode"), F.date_format(late, iso).alias("scheduledTime"))).alias("arrival"),
        F.col("event_type").alias("status"),
    )
    return flatten_flights(raw, "event_id").select("event_id", "flight_number", "departure_airport", "arrival_airport", "departure_delay_minutes", "status")


def codeshare_dedup(spark: SparkSession, d: str) -> DataFrame:
    return prep.codeshare_groups(table(spark, d, "flights"))


_KEY = ["flight_number", "departure_airport", "departure_scheduled"]


def upsert_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return prep.upsert(table(spark, d, "flights").select("id", *_KEY, "status"), _KEY, ["id"])


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return prep.upsert(table(spark, d, "flights").select("id", *_KEY, "status"), _KEY, ["id"], last=True)


def airport_scope(spark: SparkSession, d: str) -> DataFrame:
    return prep.european_airports(table(spark, d, "airports")).select("id", "ident", "iata_code", "iso_country")


def scope_semi_join(spark: SparkSession, d: str) -> DataFrame:
    codes = prep.european_airports(table(spark, d, "airports")).select(F.col("iata_code").alias("code")).distinct()
    return prep.within_scope(table(spark, d, "flights"), small(codes)).select("id", "departure_airport", "arrival_airport")


def used_airports(spark: SparkSession, d: str) -> DataFrame:
    """Airports that a flight names."""
    f = table(spark, d, "flights")
    used = f.select(F.col("departure_airport").alias("iata_code")).union(f.select("arrival_airport")).distinct()
    return table(spark, d, "airports").where("iata_code is not null").join(used, "iata_code", "left_semi").select("id", "iata_code", "name")


def country_lookup_default(spark: SparkSession, d: str) -> DataFrame:
    """Country names and UTC offsets of coded airports: by override, group of countries, or default."""
    a = table(spark, d, "airports").where("iata_code is not null and trim(iata_code) <> ''")
    zones = small(table(spark, d, "country_zones").select("iso_country", "country_name"))
    override = F.when(F.col("id") % 17 == 0, 0)
    return a.join(zones, "iso_country", "left").select("id", fn.known_or_null(F.col("country_name")).alias("country_name"), fn.utc_offset(F.col("iso_country"), override).alias("offset"))


def station_normalize(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "stations")
    return s.select("name", fn.normal_station(F.col("name")).alias("key"), F.array_join(fn.normal_tokens(F.col("name")), " ").alias("tokens"), fn.name_score(F.col("name")).alias("score"), fn.station_code(F.col("name")).alias("code"))


def country_detect_cascade(spark: SparkSession, d: str) -> DataFrame:
    typed = table(spark, d, "train_routes").select("id", "route_origin")
    found = prep.detect_country(typed, "route_origin", table(spark, d, "stations"), table(spark, d, "cities"), table(spark, d, "country_zones"))
    return found.select("id", "country", "strategy")


def _named_stops(spark: SparkSession, d: str) -> DataFrame:
    """route, pos, station, country, name and key: the projection's stations bear the first hundred names of the list, in order; each is normalised once."""
    names = table(spark, d, "stations").select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("station")).where("station < 100")
    keyed = cut(names.withColumn("key", fn.normal_station(F.col("name"))))
    return stops(spark, d).join(small(keyed), "station").select("route", "pos", "station", (F.col("station") % 25).alias("country"), "name", "key")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return prep.stop_scores(_named_stops(spark, d), prep.station_flags(table(spark, d, "stations")))


def station_flags(spark: SparkSession, d: str) -> DataFrame:
    return prep.station_flags(table(spark, d, "stations"))


def station_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


def important_stops(spark: SparkSession, d: str) -> DataFrame:
    """Stops kept by place and by their station's score, from the production threshold on."""
    named = _named_stops(spark, d)
    scores = small(cut(prep.stop_scores(named, prep.station_flags(table(spark, d, "stations"))).select("key", "score")))
    return prep.important_stops(named.join(scores, "key").select("route", "pos", "station", "country", "score"))


def stop_reduction(spark: SparkSession, d: str) -> DataFrame:
    """Stops before and after the filter, and the share that went."""
    before = stops(spark, d).agg(F.count("*").alias("before"))
    after = important_stops(spark, d).agg(F.count("*").alias("after"))
    return before.join(after).select("before", "after", (1 - F.col("after") / F.col("before")).alias("reduction"))


def legs_sorted_filled(spark: SparkSession, d: str) -> DataFrame:
    """Legs in the order of time, with missing times filled: a time before the route's first departure is of the next day."""
    s = stops(spark, d)
    w = Window.partitionBy("route").orderBy("pos")
    arr = F.when(F.col("pos") % 3 != 0, F.col("clock"))
    dep = F.when(F.col("pos") % 4 != 0, (F.col("clock") + 2) % 1440)
    a, b = prep.fill_times(arr, dep)
    first = F.first("clock").over(w)
    placed = s.withColumns({"arr": a, "dep": b, "first_clock": first})
    key = F.col("dep") + F.when(F.col("dep") < F.col("first_clock"), 1440).otherwise(0)
    order = Window.partitionBy("route").orderBy(key.asc_nulls_last(), "pos")
    return placed.select("route", "pos", "station", "arr", "dep", F.row_number().over(order).alias("new_pos"))


def legs_by_country(spark: SparkSession, d: str) -> DataFrame:
    s = stops(spark, d).select("route", "pos", "station", (F.col("station") % 25).alias("country"))
    return prep.legs_by_country(s)


def midnight_rollover(spark: SparkSession, d: str) -> DataFrame:
    """Absolute minutes of every stop, folded inside the route's array."""
    folded = prep.route_clocks(stops(spark, d)).select("route", F.posexplode(fn.rollover(F.col("clocks"))).alias("p", "minute"))
    return folded.select("route", (F.col("p") + 1).alias("pos"), "minute")


def utc_shift(spark: SparkSession, d: str) -> DataFrame:
    """Stops in UTC minutes by their country's offset, as clock and day; only routes whose times go forward."""
    offset = F.when(F.col("station") % 5 == 0, 0).when(F.col("station") % 5 == 1, 120).when(F.col("station") % 5 == 2, 180).otherwise(60)
    s = midnight_rollover(spark, d).join(stops(spark, d), ["route", "pos"]).withColumn("utc", F.col("minute") - offset)
    bad = s.groupBy("route").agg(F.min("utc").alias("a"), F.max("utc").alias("b")).where("a >= b").select("route")
    kept = s.join(bad, "route", "left_anti")
    return kept.select("route", "pos", "utc", fn.clock_of(F.col("utc")).alias("clock"), F.floor(F.col("utc") / 1440).cast("bigint").alias("day"))


def clock_text(spark: SparkSession, d: str) -> DataFrame:
    """Departure texts that are HH:MM, as minutes and back."""
    t = table(spark, d, "train_routes").select("id", fn.minutes_of(F.col("departure_time")).alias("minute")).where("minute is not null")
    return t.select("id", "minute", fn.clock_of(F.col("minute")).alias("clock"), fn.day_clock_of(F.col("minute") + 1440).alias("day_clock"))


def feed_compare(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers against a feed of them with prefixed ids: rows of either side without partner or with another name."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("stop_id"), F.col("s_name").alias("name"))
    feed = table(spark, d, "supplier").where("s_suppkey % 9 <> 4").select(F.concat(F.lit("feed:"), F.col("s_suppkey").cast("string")).alias("raw"), F.when(F.col("s_suppkey") % 10 == 3, F.upper("s_name")).otherwise(F.col("s_name")).alias("feed_name"))
    feed = feed.select(F.regexp_replace("raw", "^[^:]*:", "").alias("stop_id"), "feed_name")
    both = s.join(feed, "stop_id", "full")
    return both.where("feed_name is null or name is null or feed_name <> name").select("stop_id", "name", "feed_name")


def corridor_parse(spark: SparkSession, d: str) -> DataFrame:
    """Both directions of every corridor that was scraped, from its text "origin ↔ destination"."""
    t = table(spark, d, "train_routes").select(F.concat("route_origin", F.lit(" ↔ "), "route_destination").alias("corridor"))
    return prep.corridor_ends(t.distinct(), "corridor")


def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of the files of a scrape."""
    t = table(spark, d, "train_routes")
    return t.select("id", fn.file_name(F.col("route_origin"), F.col("route_destination"), F.col("search_date")).alias("file"))


def forward_flights(spark: SparkSession, d: str) -> DataFrame:
    """Flights of ISO times that depart before they arrive on the clock, or lack one of the times."""
    f = table(spark, d, "flights")
    when = lambda c: F.try_to_timestamp(F.upper(F.substring(squeeze(F.col(c)), 1, 19)), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return prep.forward_only(f, when("departure_scheduled"), when("arrival_scheduled")).select("id", "departure_scheduled", "arrival_scheduled")


def paired_legs(spark: SparkSession, d: str) -> DataFrame:
    """Stops of the legs that are whole pairs of pairs, per list and place."""
    lists = ["legs_with_countries", "legs_filtered"]
    return paired_stops(table(spark, d, "train_routes"), "id", lists).groupBy(F.col("source").alias("list_name"), "stop_no").agg(F.count("*").alias("stops"))


def stops_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Routes by whether their clocks never go back."""
    return prep.sortedness(stops(spark, d), "route", "pos", "clock").groupBy("is_sorted").agg(F.count("*").alias("routes"), F.sum("rows").alias("stops"))


def code_sets(spark: SparkSession, d: str) -> DataFrame:
    """Codes that flights and airports share or have alone."""
    f = table(spark, d, "flights")
    used = f.select(F.col("departure_airport").alias("code")).union(f.select("arrival_airport"))
    return prep.compared_sets(used, table(spark, d, "airports").where("iata_code is not null").select(F.col("iata_code").alias("code")))


#: Patterns and corrections of the example: (substring, country), and exact names.
_PATTERNS = [("burg", "DE"), ("vik", "SE"), ("ova", "CZ")]
_EXACT, _RULES = {"Togasburg": "AT"}, [("holm flughafen", "DK")]


def country_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Countries of typed origins with language patterns and corrections."""
    typed = table(spark, d, "train_routes").select("id", "route_origin")
    found = prep.detect_country(typed, "route_origin", table(spark, d, "stations"), table(spark, d, "cities"), table(spark, d, "country_zones"), _PATTERNS, _EXACT, _RULES)
    return found.select("id", "country", "strategy")


def country_labels(spark: SparkSession, d: str) -> DataFrame:
    """Names of countries with another label for some."""
    return table(spark, d, "country_zones").select("iso_country", fn.known_name(F.col("iso_country"), F.col("country_name"), {"GB": "England"}).alias("label"))


def delay_bands(spark: SparkSession, d: str) -> DataFrame:
    """Flights per date and band of delay."""
    f = table(spark, d, "flights").where("departure_delay_minutes is not null")
    return f.groupBy("date", (F.floor(F.col("departure_delay_minutes") / 15) * 15).cast("int").alias("band")).agg(F.count("*").alias("flights"))


def coordinate_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Airport names that stand at several places: rows and distinct places."""
    a = table(spark, d, "airports").where("name is not null and latitude_deg is not null and longitude_deg is not null")
    return a.groupBy("name").agg(F.count("*").alias("rows"), F.countDistinct("latitude_deg", "longitude_deg").alias("places")).where("places > 1")


def hub_stops(spark: SparkSession, d: str) -> DataFrame:
    """Stops kept by a list of hubs in some countries, under the hubs' canonical names; other countries' stops all stay."""
    s = stops(spark, d).select("route", "pos", "station", (F.col("station") % 25).alias("country"))
    hubs = spark.range(0, 100, 7).select(F.col("id").cast("int").alias("station"), F.concat(F.lit("Hub "), F.col("id").cast("string")).alias("hub"))
    return prep.keep_hubs(s, hubs, [3, 11]).select("route", "pos", "name")


def latest_departure(spark: SparkSession, d: str) -> DataFrame:
    """Per corridor the train that leaves last, by its text, and how many scrapes repeat a train."""
    t = table(spark, d, "train_routes").where("departure_time is not null")
    one = t.groupBy("route_origin", "route_destination", "search_date", "departure_time", "arrival_time").agg(F.count("*").alias("copies"), F.min("id").alias("id"))
    return one.groupBy("route_origin", "route_destination").agg(F.max(F.struct("departure_time", "id")).alias("m"), F.sum(F.col("copies") - 1).alias("repeats")).select("route_origin", "route_destination", F.col("m.departure_time").alias("last"), F.col("m.id").alias("id"), "repeats")


QUERIES = {
    f.__name__: f
    for f in (
        flight_flatten, codeshare_dedup, upsert_first_wins, upsert_last_wins, airport_scope, scope_semi_join, used_airports, country_lookup_default, station_normalize, country_detect_cascade,
        station_flags, station_scores, important_stops, file_names, forward_flights, paired_legs, stops_sorted, code_sets, country_patterns, country_labels, stop_reduction, legs_sorted_filled, legs_by_country, midnight_rollover, utc_shift, clock_text, feed_compare, corridor_parse, delay_bands, coordinate_conflicts, hub_stops, latest_departure,
    )
}

_ROLL = (
    "with "
    + STOPS_SQL
    + """, wraps as (select *, case when clock < lag(clock) over (partition by route order by pos) then 1440 else 0 end as wrap from stops),
roll as (select route, pos, station, cast(clock + sum(wrap) over (partition by route order by pos) as bigint) as minute from wraps)
"""
)
_GENERIC = "'" + "','".join(fn.GENERIC_TOKENS) + "'"


def _norm(c: str) -> str:
    words = f"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[()\\[\\],.-]+', ' ', 'g'), '\\s+'), lambda w: w <> '')"
    return f"(case when len(list_filter({words}, lambda w: w not in ({_GENERIC}))) > 0 then list_filter({words}, lambda w: w not in ({_GENERIC})) else {words} end)"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _key(c: str) -> str:
    return f"regexp_replace(array_to_string({_norm(c)}, ''), '[^a-z0-9]+', '', 'g')"


_EU = "type in ('large_airport', 'medium_airport', 'small_airport') and continent = 'EU' and scheduled_service = 'yes' and iata_code is not null"
_BARE = "regexp_replace(route_origin, '\\s*[\\[(][^\\])]*[\\])]\\s*$', '')"
_SUM = " + ".join([f"case when contains(lower(name), '{w}') then 3 else 0 end" for w in fn.IMPORTANT_WORDS] + [f"case when contains(lower(name), '{w}') then -2 else 0 end" for w in fn.MINOR_WORDS])
_FLAGS = f"""flags as (select {_key("name")} as key, bool_or(is_main_station) as is_main_station, bool_or(is_city) as is_city, bool_or(is_airport) as is_airport from stations group by 1 having {_key("name")} <> '')"""
_NAMED = (
    "with "
    + STOPS_SQL
    + f""", names as (select name, {_key("name")} as key, {_SUM} as words, row_number() over (order by name) - 1 as station from stations),
named as (select route, pos, stops.station, stops.station % 25 as country, name, key, words from stops join names on names.station = stops.station),
freq as (select key, arg_min(name, (route, pos)) as example, arg_min(words, (route, pos)) as words, count(*) as n, count(distinct route) as routes from named group by key),
q as (select quantile_cont(n, 0.95) as q95, quantile_cont(n, 0.90) as q90 from freq), {_FLAGS},
scores as (select key, example, n, routes, cast(greatest(0, words + case when is_main_station then 7 else 0 end + case when is_city then 3 else 0 end + case when is_airport then 3 else 0 end
  + case when n >= q95 then 3 when n >= q90 then 2 else 0 end) as int) as score from freq left join flags using (key), q)
"""
)
_IMPORTANT = (
    _NAMED
    + """, s as (select route, pos, station, country, score from named join scores using (key)),
m as (select *, min(pos) over (partition by route) as a, max(pos) over (partition by route) as b, min(pos) over (partition by route, country) as ca, max(pos) over (partition by route, country) as cb,
  row_number() over (partition by route, country order by score desc, pos) as r from s),
kept as (select route, pos, station, country, score from m where pos in (a, b, ca, cb) or r = 1 or score >= 16)
"""
)
_DETECTED = f"""
with v as (select id, upper(trim(regexp_extract(route_origin, '[\\[(]([^\\])]+)[\\])]\\s*$', 1))) as hint, {_BARE} as bare, lower(route_origin) as low, {_key(_BARE)} as key,
    regexp_replace(list_reverse_sort(list_transform({_norm(_BARE)}, lambda t: {{'n': length(t), 't': t}}))[1].t, '[^a-z0-9]+', '', 'g') as word from train_routes),
codes as (select upper(iso_country) as hint, iso_country as c from country_zones union select upper(country_name), iso_country from country_zones),
st as (select {_key("name")} as key, min(country) as c from stations group by 1 having {_key("name")} <> ''),
ci as (select key, country as c from (select {_key("name")} as key, country, row_number() over (partition by {_key("name")} order by coalesce(population, 0) desc, name desc) as r from cities) where r = 1 and key <> '')
"""
_JOINED = " from v left join codes on codes.hint = v.hint left join st on st.key = v.key left join ci on ci.key = v.key left join ci cw on cw.key = v.word"
SQL = {
    "flight_flatten": """
with r as (select event_id, ts, cast(json_extract_string(props, '$.k') as int) as k, user_id, event_type from events where event_id % 11 <> 0)
select event_id, upper(case when event_id % 7 = 0 then 'n' || event_id else 'it' || event_id end) as flight_number, upper('a' || user_id % 100) as departure_airport, upper('b' || k) as arrival_airport,
  case when event_id % 3 <> 0 then k end as departure_delay_minutes, event_type as status from r""",
    "codeshare_dedup": """select departure_airport, arrival_airport, departure_scheduled, arrival_scheduled, date, min(flight_number) as flight_number, min(departure_estimated) as departure_estimated,
  min(departure_delay_minutes) as departure_delay_minutes, min(status) as status, min(id) as id, count(*) as shared from flights where status <> 'unknown' group by all""",
    "upsert_first_wins": "select id, flight_number, departure_airport, departure_scheduled, status from flights qualify row_number() over (partition by flight_number, departure_airport, departure_scheduled order by id) = 1",
    "upsert_last_wins": "select id, flight_number, departure_airport, departure_scheduled, status from flights qualify row_number() over (partition by flight_number, departure_airport, departure_scheduled order by id desc) = 1",
    "airport_scope": f"select id, ident, iata_code, iso_country from airports where {_EU}",
    "scope_semi_join": f"with c as (select iata_code from airports where {_EU}) select id, departure_airport, arrival_airport from flights where departure_airport in (from c) and arrival_airport in (from c)",
    "used_airports": "select id, iata_code, name from airports where iata_code in (select departure_airport from flights union select arrival_airport from flights)",
    "country_lookup_default": """select id, country_name, cast(case when id % 17 = 0 then 0 when iso_country in ('GB', 'IE', 'PT', 'IS') then 0
  when iso_country in ('FI', 'EE', 'LV', 'LT', 'GR', 'RO', 'BG', 'UA', 'CY', 'MD') then 120 when iso_country in ('TR', 'BY', 'RU') then 180 else 60 end as int) as "offset"
  from airports left join country_zones using (iso_country) where iata_code is not null and trim(iata_code) <> ''""",
    "station_normalize": f"""select name, {_key("name")} as key, array_to_string({_norm("name")}, ' ') as tokens, cast({_SUM} as int) as score,
  case when regexp_matches(split_part(trim(name), ' ', 1), '^[A-Za-z0-9]{{3}}$') then split_part(trim(name), ' ', 1)
    when regexp_extract(name, '\\b[A-Z0-9]{{3,4}}\\b') <> '' then regexp_extract(name, '\\b[A-Z0-9]{{3,4}}\\b') else trim(name) end as code from stations""",
    "country_detect_cascade": _DETECTED
    + "select id, coalesce(codes.c, st.c, ci.c, cw.c) as country, case when codes.c is not null then 'hint' when st.c is not null then 'station' when ci.c is not null then 'city' when cw.c is not null then 'word' end as strategy"
    + _JOINED,
    "country_patterns": _DETECTED
    + """, found as (select id, bare, case when contains(low, 'burg') then 'DE' when contains(low, 'vik') then 'SE' when contains(low, 'ova') then 'CZ' end as p, codes.c as a, st.c as b, ci.c as c, cw.c as e"""
    + _JOINED
    + """), named as (select *, coalesce(a, b, c, p, e) as f from found)
select id, case when f is not null then case when bare = 'Togasburg' then 'AT' when contains(lower(bare), 'holm flughafen') then 'DK' else f end end as country,
  case when a is not null then 'hint' when b is not null then 'station' when c is not null then 'city' when p is not null then 'pattern' when e is not null then 'word' end as strategy from named""",
    "country_labels": "select iso_country, case iso_country when 'GB' then 'England' else country_name end as label from country_zones",
    "station_flags": "with " + _FLAGS + " select * from flags",
    "station_scores": _NAMED + "select key, example, n, routes, score from scores",
    "file_names": """select id, regexp_replace(replace(route_origin, ' ', '_'), '[,()]', '', 'g') || '_' || regexp_replace(replace(route_destination, ' ', '_'), '[,()]', '', 'g') || '_' || replace(search_date, '.', '_') || '.csv' as file from train_routes""",
    "forward_flights": f"""with t as (select id, departure_scheduled, arrival_scheduled, try_strptime(upper(substr({_strip("departure_scheduled")}, 1, 19)), '%Y-%m-%dT%H:%M:%S') as a, try_strptime(upper(substr({_strip("arrival_scheduled")}, 1, 19)), '%Y-%m-%dT%H:%M:%S') as b from flights)
select id, departure_scheduled, arrival_scheduled from t where a is null or b is null or a < b""",
    "stops_sorted": "with " + STOPS_SQL + ", b as (select route, clock >= coalesce(lag(clock) over (partition by route order by pos), clock) as ok from stops), g as (select route, count(*) as n, bool_and(ok) as is_sorted from b group by route) select is_sorted, count(*) as routes, cast(sum(n) as bigint) as stops from g group by 1",
    "code_sets": """with f as (select departure_airport as code from flights union select arrival_airport from flights), a as (select distinct iata_code as code from airports where iata_code is not null)
select code, 'both' as side from (from f intersect from a) union all select code, 'first' from (from f except from a) union all select code, 'second' from (from a except from f)""",
    "paired_legs": _STOPS
    + "select list_name, cast(stop_no as int) as stop_no, count(*) as stops from s where json_type(s) = 'ARRAY' and json_array_length(s) = 2 and json_type(s, '$[0]') = 'ARRAY' and json_array_length(s, '$[0]') = 2 and json_type(s, '$[1]') = 'ARRAY' and json_array_length(s, '$[1]') = 2 group by all",
    "important_stops": _IMPORTANT + "select * from kept",
    "stop_reduction": _IMPORTANT + "select (select count(*) from stops) as before, (select count(*) from kept) as after, 1 - (select count(*) from kept) / (select count(*) from stops) as reduction",
    "legs_sorted_filled": "with "
    + STOPS_SQL
    + """, t as (select route, pos, station, case when pos % 3 <> 0 then clock end as a, case when pos % 4 <> 0 then (clock + 2) % 1440 end as b, first(clock) over (partition by route order by pos) as f from stops),
u as (select route, pos, station, coalesce(a, b) as arr, coalesce(b, a) as dep, f from t)
select route, pos, station, arr, dep, row_number() over (partition by route order by dep + case when dep < f then 1440 else 0 end nulls last, pos) as new_pos from u""",
    "legs_by_country": "with "
    + STOPS_SQL
    + """, s as (select route, pos, station, station % 25 as country from stops),
f as (select *, min(pos) over (partition by route, country) as fp, max(pos) over (partition by route) as lp from s),
e as (select f.*, l.country as ec from f join s l on l.route = f.route and l.pos = f.lp)
select route, pos, station, country, row_number() over (partition by route order by (country = ec)::int, fp, (pos = lp)::int, pos) as new_pos from e""",
    "midnight_rollover": _ROLL + "select route, pos, minute from roll",
    "utc_shift": _ROLL
    + """, s as (select route, pos, minute - case station % 5 when 0 then 0 when 1 then 120 when 2 then 180 else 60 end as utc from roll),
g as (select route from s group by route having min(utc) < max(utc))
select route, pos, cast(utc as bigint) as utc, printf('%02d:%02d', ((utc % 1440 + 1440) % 1440) // 60, ((utc % 1440 + 1440) % 1440) % 60) as clock, cast(floor(utc / 1440) as bigint) as day from s where route in (from g)""",
    "clock_text": """with t as (select id, trim(departure_time) as t from train_routes where regexp_matches(departure_time, '^\\s*([01]?[0-9]|2[0-3]):[0-5][0-9]\\s*$')),
m as (select id, cast(split_part(t, ':', 1) as bigint) * 60 + cast(split_part(t, ':', 2) as bigint) as minute from t)
select id, minute, printf('%02d:%02d', minute // 60, minute % 60) as clock, 'Day 2, ' || printf('%02d:%02d', minute // 60, minute % 60) as day_clock from m""",
    "feed_compare": """with s as (select cast(s_suppkey as varchar) as stop_id, s_name as name from supplier),
f as (select cast(s_suppkey as varchar) as stop_id, case when s_suppkey % 10 = 3 then upper(s_name) else s_name end as feed_name from supplier where s_suppkey % 9 <> 4)
select coalesce(s.stop_id, f.stop_id) as stop_id, name, feed_name from s full join f on s.stop_id = f.stop_id where feed_name is null or name is null or feed_name <> name""",
    "corridor_parse": """with p as (select list_filter(list_transform(regexp_split_to_array(route_origin || ' ↔ ' || route_destination, '\\s*(?:↔|<->|–|—|-)\\s*'), lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: x <> '') as p from train_routes),
e as (select p[1] as origin, p[-1] as destination from p where len(p) >= 2) select origin, destination from e union select destination, origin from e""",
    "coordinate_conflicts": "select name, count(*) as rows, count(distinct (latitude_deg, longitude_deg)) as places from airports where name is not null and latitude_deg is not null and longitude_deg is not null group by name having count(distinct (latitude_deg, longitude_deg)) > 1",
    "hub_stops": "with " + STOPS_SQL + "select route, pos, case when station % 25 in (3, 11) then 'Hub ' || station else cast(station as varchar) end as name from stops where station % 25 not in (3, 11) or station % 7 = 0",
    "latest_departure": """with one as (select route_origin, route_destination, departure_time, min(id) as id, count(*) as copies from train_routes where departure_time is not null group by route_origin, route_destination, search_date, departure_time, arrival_time)
select route_origin, route_destination, departure_time as last, id, cast(sum(copies - 1) over (partition by route_origin, route_destination) as bigint) as repeats from one
qualify row_number() over (partition by route_origin, route_destination order by departure_time desc, id desc) = 1""",
    "delay_bands": "select date, cast(floor(departure_delay_minutes / 15) * 15 as int) as band, count(*) as flights from flights where departure_delay_minutes is not null group by all",
}
