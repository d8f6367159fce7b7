"""Queries over found routes (master_elite_routes_full), each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itinera.functions import transit as fn
from itinera.operators import routes as R
from itinera.session import table


def _routes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "master_elite_routes_full")


def _segs(spark: SparkSession, d: str) -> DataFrame:
    return R.segments(_routes(spark, d))


def route_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segs(spark, d)


def transfer_scores(spark: SparkSession, d: str) -> DataFrame:
    return R.route_transfers(_routes(spark, d))


def route_rqi(spark: SparkSession, d: str) -> DataFrame:
    return R.route_quality(R.route_transfers(_routes(spark, d)))


def route_records(spark: SparkSession, d: str) -> DataFrame:
    return R.route_records(_routes(spark, d))


def route_dedup_nodes(spark: SparkSession, d: str) -> DataFrame:
    return R.distinct_routes(_routes(spark, d), R.node_path(fn.route_of(F.col("route_sequence_json"))))


def route_dedup_times(spark: SparkSession, d: str) -> DataFrame:
    return R.distinct_routes(_routes(spark, d), R.timed_path(fn.route_of(F.col("route_sequence_json"))))


def station_frequency(spark: SparkSession, d: str) -> DataFrame:
    return R.cumulative(R.station_usage(_segs(spark, d)), ["name"])


def edge_frequency(spark: SparkSession, d: str) -> DataFrame:
    return R.cumulative(R.edge_usage(_segs(spark, d)), ["origin", "dest"])


def coverage_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """How many stations make up 50, 80 and 95 percent of all uses."""
    return R.coverage(station_frequency(spark, d), [0.5, 0.8, 0.95])


def long_tail(spark: SparkSession, d: str) -> DataFrame:
    """Stations with few uses, and the first rank below each bound."""
    ranked = station_frequency(spark, d)
    bounds = [5, 20, 100]
    one = ranked.agg(*[F.min(F.when(F.col("uses") < b, F.col("rank"))).alias(f"r{b}") for b in bounds], *[F.count_if(F.col("uses") < b).alias(f"n{b}") for b in bounds])
    return one.select(F.inline(F.array(*[F.struct(F.lit(b).alias("below"), F.col(f"r{b}").alias("first_rank"), F.col(f"n{b}").alias("stations")) for b in bounds])))


def routes_by_country_start(spark: SparkSession, d: str) -> DataFrame:
    """Routes by countries and start, with the sums over starts (a null start) from the same rollup."""
    r = R.route_records(_routes(spark, d))
    return r.where("start is not null").rollup("countries", "start").agg(F.count("*").alias("routes")).where("countries is not null")


def explorer_page(spark: SparkSession, d: str) -> DataFrame:
    r = _routes(spark, d).where(R.page_filter(contains=["(germany)", "(france)"]))
    order = [F.desc("total_countries"), F.asc("total_legs"), F.asc("route_id")]
    return R.page(r, order, 20, 20).select("rank", "route_id", "start_node", "end_node", "total_countries", "total_legs")


def ranking_page(spark: SparkSession, d: str) -> DataFrame:
    r = _routes(spark, d).where(R.page_filter(hide_negative=True))
    return R.page(r, [F.desc_nulls_last("rqi_score"), F.desc("total_countries"), F.asc("route_id")], 10, 10).select("rank", "route_id", "rqi_score", "total_countries")


def filtered_routes(spark: SparkSession, d: str) -> DataFrame:
    """The dashboard's conjunction: countries, start minute and a contained name."""
    return _routes(spark, d).where(R.page_filter(countries=14, contains=["hbf"])).select("route_id", "start_node", F.pmod(F.get_json_object("route_sequence_json", "$[0].dep_time").try_cast("bigint"), F.lit(1440)).alias("minute"))


def route_metadata(spark: SparkSession, d: str) -> DataFrame:
    r = _routes(spark, d)
    return r.agg(F.count("*").alias("routes"), F.max("total_countries").alias("most_countries"), F.countDistinct("start_node").alias("starts"), F.min("duration_mins").alias("shortest"))


def start_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _routes(spark, d).where("start_node is not null").select("start_node").distinct()


def elite_keep(spark: SparkSession, d: str) -> DataFrame:
    """The keep rule over routes: at least 14 countries, or the most there are."""
    r = _routes(spark, d).select("route_id", "total_countries")
    most = r.agg(F.max("total_countries").alias("most"))
    return r.join(F.broadcast(most)).where((F.col("total_countries") >= 14) | ((F.col("most") < 14) & (F.col("total_countries") == F.col("most")))).drop("most")


def itinerary_display(spark: SparkSession, d: str) -> DataFrame:
    return R.itinerary(_segs(spark, d))


def _schedule(spark: SparkSession, d: str) -> DataFrame:
    """Local clocks of every other segment by its stations and minutes of the day; the rest stay approximate."""
    seg = _segs(spark, d).where("dep_time is not null and arr_time is not null")
    keyed = seg.select(fn.station_name(F.col("origin")).alias("origin"), fn.station_name(F.col("dest")).alias("dest"), F.pmod("dep_time", F.lit(1440)).alias("dep_min"), F.pmod("arr_time", F.lit(1440)).alias("arr_min"))
    timed = keyed.where("dep_min % 2 = 0 and origin is not null and dest is not null").distinct()
    return timed.select("*", fn.clock_of(F.col("dep_min") + 60).alias("local_dep"), fn.clock_of(F.col("arr_min") + 60).alias("local_arr"))


def itinerary_local(spark: SparkSession, d: str) -> DataFrame:
    """Itineraries with the local clocks of the schedule where it has them."""
    return R.itinerary(_segs(spark, d), _schedule(spark, d)).select("route_id", "pos", "departs", "arrives")


def transfer_scores_known(spark: SparkSession, d: str) -> DataFrame:
    """Changes scored by a table of transfer minutes, with the default for pairs it lacks."""
    pairs = R.route_transfers(_routes(spark, d)).where("from_name <> to_name").select("from_name", "to_name").distinct()
    minutes = pairs.where(F.length("from_name") % 2 == 0).select("from_name", "to_name", (F.length("to_name") + 5).cast("bigint").alias("minutes"))
    return R.route_transfers(_routes(spark, d), minutes).select("route_id", "pos", "margin", F.round("score", 6).alias("score"))


def resolved_steps(spark: SparkSession, d: str) -> DataFrame:
    """Each segment as a scheduled edge, a transfer or unknown, counted by kind."""
    seg = _segs(spark, d)
    known = seg.where("dep_time % 3 = 0").select("origin", "dest", "dep_time", "arr_time", F.when(F.col("dep_time") % 2 == 0, "train").otherwise("flight").alias("kind"))
    walks = seg.where("dep_time % 3 = 1").select("origin", "dest", (F.col("arr_time") - F.col("dep_time")).alias("minutes")).distinct()
    return R.resolved_steps(seg, known, walks).groupBy("transport").agg(F.count("*").alias("steps"), F.sum("minutes").alias("minutes"))


def collapsed_paths(spark: SparkSession, d: str) -> DataFrame:
    """The stations of a route in order, each once while it repeats."""
    r = fn.route_of(F.col("route_sequence_json"))
    stations = F.flatten(F.transform(r, lambda s: F.array(fn.station_name(s.origin), fn.station_name(s.dest))))
    return _routes(spark, d).select("route_id", F.array_join(fn.collapsed(stations), " -> ").alias("path")).where("path is not null")


def schedule_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Routes with alternatives from all routes' own segments."""
    r = _routes(spark, d)
    return R.slide(r, R.segments(r).select("origin", "dest", "dep_time", "arr_time"))


def path_steps(spark: SparkSession, d: str) -> DataFrame:
    """Changes between neighbouring segments that break the chain or go back in time, per kind."""
    t = R.route_transfers(_routes(spark, d))
    return t.agg(F.count("*").alias("changes"), F.count_if(F.col("from_name") != F.col("to_name")).alias("broken"), F.count_if(F.col("buffer") < 0).alias("back_in_time"), F.sum("buffer").alias("layover"))


QUERIES = {
    f.__name__: f
    for f in (
        route_segments, transfer_scores, route_rqi, route_records, route_dedup_nodes, route_dedup_times, station_frequency, edge_frequency, coverage_cutoff, long_tail,
        routes_by_country_start, explorer_page, ranking_page, filtered_routes, route_metadata, start_nodes, elite_keep, itinerary_display, itinerary_local, transfer_scores_known, resolved_steps, collapsed_paths, schedule_sliding, path_steps,
    )
}

_PARSED = """with parsed as (
  select route_id, from_json(route_sequence_json, '[{"origin":"VARCHAR","dest":"VARCHAR","dep_time":"BIGINT","arr_time":"BIGINT"}]') as r from master_elite_routes_full),
segs as (select route_id, generate_subscripts(r, 1) as pos, unnest(r) as s from parsed),
seg as (select route_id, pos, s.origin as origin, s.dest as dest, s.dep_time as dep_time, s.arr_time as arr_time,
  trim(regexp_replace(s.origin, '\\s*\\([^()]*\\)\\s*$', '')) as o, trim(regexp_replace(s.dest, '\\s*\\([^()]*\\)\\s*$', '')) as t from segs)
"""


def _mode(c: str) -> str:
    code = f"case when regexp_matches(split_part({c}, ' ', 1), '^[A-Za-z0-9]{{3}}$') then split_part({c}, ' ', 1) when regexp_extract({c}, '\\b[A-Z0-9]{{3,4}}\\b') <> '' then regexp_extract({c}, '\\b[A-Z0-9]{{3,4}}\\b') else {c} end"
    return f"case when regexp_matches({code}, '^[A-Z]{{3}}$') then 'A' else 'R' end"


_TRANSFERS = (
    _PARSED
    + f"""
, pairs as (select route_id, pos, t as f, lead(o) over w as g, lead(dep_time) over w - arr_time as buffer from seg window w as (partition by route_id order by pos)),
moded as (select *, {_mode("f")} as fm, {_mode("g")} as gm from pairs where g is not null and buffer is not null),
marg as (select *, cast(buffer - case when f = g then 0 else 60 end
  - case when fm = 'R' and gm = 'R' then case when f = g then 0 else 5 end when fm = 'R' then 25 else 20 end as bigint) as margin from moded),
tr as (select route_id, pos, f as from_name, g as to_name, buffer, margin, case when margin >= 0 then 100 * (1 - exp(-0.05 * margin)) else margin * 1000.0 end as score from marg)
"""
)
_USAGE = _PARSED + ", uses as (select name, count(*) as uses from (select o as name from seg union all select t from seg) where name is not null group by name)"
_RANKED = """
, ranked as (select *, row_number() over w as rank, sum(uses) over (order by uses desc, {0} rows unbounded preceding) as running, sum(uses) over (order by uses desc, {0} rows unbounded preceding) / sum(uses) over () as share
  from uses window w as (order by uses desc, {0}))
"""
_REC = (
    _PARSED
    + """
, rec as (select route_id, any_value(r[1].origin) as start, any_value(r[-1].dest) as "end", cast(count(*) as int) as legs, count(distinct nullif(regexp_extract(dest, '\\(([^()]*)\\)\\s*$', 1), '')) as countries,
  any_value(r[-1].arr_time) - any_value(r[1].dep_time) as duration from seg join parsed using (route_id) group by route_id)
"""
)
SQL = {
    "route_segments": _PARSED + "select route_id, pos, origin, dest, dep_time, arr_time from seg",
    "transfer_scores": _TRANSFERS + "select * from tr",
    "route_rqi": _TRANSFERS
    + """, w as (select *, row_number() over (partition by route_id order by score, pos) as r from tr)
select route_id, 0.7 * min(score) + 0.3 * avg(score) as rqi, max(case when r = 1 then from_name || '->' || to_name || ' (' || case when margin >= 0 then '+' else '' end || margin || 'm margin)' end) as bottleneck from w group by route_id""",
    "route_records": _REC + "select * from rec",
    "route_dedup_nodes": _PARSED
    + """, p as (select route_id, concat_ws(' -> ', any_value(r[1].origin), string_agg(dest, ' -> ' order by pos)) as path from seg join parsed using (route_id) group by route_id)
select md5(path) as route_hash, min(route_id) as first, count(*) as copies from p group by path""",
    "route_dedup_times": _PARSED
    + """, p as (select route_id, string_agg(concat_ws('_', origin, dep_time, dest, arr_time), '|' order by pos) as path from seg group by route_id)
select md5(path) as route_hash, min(route_id) as first, count(*) as copies from p group by path""",
    "station_frequency": _USAGE + _RANKED.format("name") + "select name, uses, rank, cast(running as bigint) as running, share from ranked",
    "edge_frequency": _PARSED + ", uses as (select o as origin, t as dest, count(*) as uses from seg where o is not null and t is not null group by all)" + _RANKED.format("origin, dest") + "select origin, dest, uses, rank, cast(running as bigint) as running, share from ranked",
    "coverage_cutoff": _USAGE + _RANKED.format("name") + "select target, (select min(rank) from ranked where share >= target) as needed from (select unnest([0.5::double, 0.8::double, 0.95::double]) as target)",
    "long_tail": _USAGE + _RANKED.format("name") + "select below, (select min(rank) from ranked where uses < below) as first_rank, (select count(*) from ranked where uses < below) as stations from (select unnest([5, 20, 100]) as below)",
    "routes_by_country_start": _REC + "select countries, start, count(*) as routes from rec where start is not null group by rollup (countries, start) having countries is not null",
    "explorer_page": """with r as (select *, row_number() over (order by total_countries desc, total_legs, route_id) as rank from master_elite_routes_full
  where contains(lower(route_sequence_json), '(germany)') and contains(lower(route_sequence_json), '(france)'))
select rank, route_id, start_node, end_node, total_countries, total_legs from r where rank between 21 and 40""",
    "ranking_page": """with r as (select *, row_number() over (order by rqi_score desc, total_countries desc, route_id) as rank from master_elite_routes_full where rqi_score >= 0 and not isnan(rqi_score))
select rank, route_id, rqi_score, total_countries from r where rank between 11 and 20""",
    "filtered_routes": "select route_id, start_node, cast(json_extract_string(route_sequence_json, '$[0].dep_time') as bigint) % 1440 as minute from master_elite_routes_full where total_countries = 14 and contains(lower(route_sequence_json), 'hbf')",
    "route_metadata": "select count(*) as routes, max(total_countries) as most_countries, count(distinct start_node) as starts, min(duration_mins) as shortest from master_elite_routes_full",
    "start_nodes": "select distinct start_node from master_elite_routes_full where start_node is not null",
    "elite_keep": "select route_id, total_countries from master_elite_routes_full where total_countries >= least(14, (select max(total_countries) from master_elite_routes_full))",
    "itinerary_display": _PARSED
    + f"""select route_id, pos, o as origin, t as dest, case when {_mode("o")} = 'A' and {_mode("t")} = 'A' then 'flight' else 'train' end as mode,
  '~ ' || printf('%02d:%02d', (dep_time % 1440) // 60, dep_time % 60) as departs, '~ ' || printf('%02d:%02d', (arr_time % 1440) // 60, arr_time % 60) as arrives,
  arr_time - first(arr_time) over w as elapsed, cast(len(list_distinct(list(nullif(regexp_extract(dest, '\\(([^()]*)\\)\\s*$', 1), '')) over w)) as int) as countries,
  o <> lag(t) over (partition by route_id order by pos) as changes_station
from seg window w as (partition by route_id order by pos rows unbounded preceding)""",
    "path_steps": _TRANSFERS + "select count(*) as changes, count(*) filter (from_name <> to_name) as broken, count(*) filter (buffer < 0) as back_in_time, cast(sum(buffer) as bigint) as layover from tr",
    "itinerary_local": _PARSED
    + """, sched as (select distinct o, t, ((dep_time % 1440) + 1440) % 1440 as d, ((arr_time % 1440) + 1440) % 1440 as a from seg where dep_time is not null and arr_time is not null and o is not null and t is not null and ((dep_time % 1440) + 1440) % 1440 % 2 = 0)
select route_id, pos, case when s.d is not null then printf('%02d:%02d', (s.d + 60) % 1440 // 60, (s.d + 60) % 1440 % 60) when dep_time is not null then '~ ' || printf('%02d:%02d', ((dep_time % 1440) + 1440) % 1440 // 60, ((dep_time % 1440) + 1440) % 1440 % 60) end as departs,
  case when s.a is not null then printf('%02d:%02d', (s.a + 60) % 1440 // 60, (s.a + 60) % 1440 % 60) when arr_time is not null then '~ ' || printf('%02d:%02d', ((arr_time % 1440) + 1440) % 1440 // 60, ((arr_time % 1440) + 1440) % 1440 % 60) end as arrives
from seg left join sched s on s.o = seg.o and s.t = seg.t and s.d = ((dep_time % 1440) + 1440) % 1440 and s.a = ((arr_time % 1440) + 1440) % 1440""",
    "transfer_scores_known": _TRANSFERS
    + """, known as (select distinct from_name, to_name, length(to_name) + 5 as m from tr where from_name <> to_name and length(from_name) % 2 = 0),
again as (select route_id, pos, margin + case when tr.from_name <> tr.to_name and m is not null then 60 - m else 0 end as margin from tr left join known using (from_name, to_name))
select route_id, pos, cast(margin as bigint) as margin, round(case when margin >= 0 then 100 * (1 - exp(-0.05 * margin)) else margin * 1000.0 end, 6) as score from again""",
    "resolved_steps": _PARSED
    + """, edge as (select origin, dest, dep_time, arr_time, min(case when dep_time % 2 = 0 then 'train' else 'flight' end) as kind from seg where dep_time % 3 = 0 group by all),
walk as (select distinct origin, dest, arr_time - dep_time as minutes from seg where dep_time % 3 = 1)
select coalesce(kind, case when w.origin is not null then 'transfer' end, 'unknown') as transport, count(*) as steps, cast(sum(s.arr_time - s.dep_time) as bigint) as minutes
from seg s left join edge e on e.origin = s.origin and e.dest = s.dest and e.dep_time = s.dep_time and e.arr_time = s.arr_time left join walk w on w.origin = s.origin and w.dest = s.dest and w.minutes = s.arr_time - s.dep_time group by 1""",
    "collapsed_paths": _PARSED
    + """, st as (select route_id, pos * 2 as k, o as n from seg union all select route_id, pos * 2 + 1, t from seg), known as (select * from st where n is not null),
c as (select *, lag(n) over (partition by route_id order by k) as before from known)
select p.route_id, coalesce(string_agg(n, ' -> ' order by k) filter (before is null or n <> before), '') as path from parsed p left join c using (route_id) where r is not null group by p.route_id""",
}
