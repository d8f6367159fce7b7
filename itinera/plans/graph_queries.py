"""Queries of the graph and search operators over the projected model, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itinera.operators import graph, prep, search, sums
from itinera.plans.projection import AON_SQL, EVENTS_SQL, STATIONS, STATIONS_SQL, STOPS_SQL, TRANSFERS_SQL, events, stations, stops, transfers
from itinera.session import cut, small

#: The window of the searches and of half-searches, in minutes, and the floor on countries that is always kept.
WINDOW, HALF, FLOOR = 1440, 840, 14
#: Least minutes of a change in half-searches and where they meet.
WAIT = 10
MODE = "if(station < 50, 'A', 'R')"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return cut(events(spark, d))


def _edges(spark: SparkSession, ev: DataFrame) -> DataFrame:
    return cut(graph.earliest_successors(ev, transfers(spark)))


def _first_day(spark: SparkSession, d: str) -> DataFrame:
    """The events that a search from the first day's starts can reach: none that arrives later fits a deadline."""
    return cut(events(spark, d).where(F.col("arr") <= search.MINUTES_OF_DAY + WINDOW))


def event_nodes(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d)


def start_events(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where(F.col("arr") <= search.MINUTES_OF_DAY).select("event_id", "dest")


def transfer_edges(spark: SparkSession, d: str) -> DataFrame:
    t = transfers(spark)
    return graph.induced(t, stations(spark, d).select(F.col("station").alias("node"))).select("u", "v", "minutes")


def aon_edges_direct(spark: SparkSession, d: str) -> DataFrame:
    return graph.earliest_successors(events(spark, d))


def aon_edges_transfer(spark: SparkSession, d: str) -> DataFrame:
    return graph.earliest_successors(events(spark, d), transfers(spark))


def aon_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: per country of arrival the event edges and their mean layover."""
    ev = events(spark, d)
    edges = graph.earliest_successors(ev, transfers(spark), ("country", "arr"), ("dep",))
    names = stations(spark, d).select("country", "name").distinct()
    by = edges.groupBy("src", F.col("s_country").alias("country")).agg(F.count("*").alias("n"), F.sum(F.col("d_dep") - F.col("s_arr")).alias("layover"))
    per = by.groupBy("country").agg(F.sum("n").alias("edges"), F.count("*").alias("sources"), F.sum("layover").alias("layover"))
    return per.join(F.broadcast(names), "country").select("country", "name", "edges", "sources", "layover")


def buffered_successors(spark: SparkSession, d: str) -> DataFrame:
    return graph.buffered_successors(events(spark, d), transfers(spark), F.expr(MODE))


def degree_stats(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d)
    deg = graph.degrees(ev, graph.earliest_successors(ev, transfers(spark)))
    zero = lambda c: F.count_if(F.col(c) == 0)
    return deg.agg(F.count("*").alias("events"), zero("in_degree").alias("no_in"), zero("out_degree").alias("no_out"), F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") == 0)).alias("isolated"), F.max("out_degree").alias("most_out"))


def mtt_leave(spark: SparkSession, d: str) -> DataFrame:
    return graph.leave_minutes(events(spark, d), transfers(spark))


def mtt_enter(spark: SparkSession, d: str) -> DataFrame:
    return graph.enter_minutes(events(spark, d), F.col("origin") % 25)


def _trains(spark: SparkSession, d: str) -> DataFrame:
    return graph.train_edges(prep.absolute_minutes(stops(spark, d)))


def train_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between stations from train stops in rolled-over minutes, with the copy of the second day."""
    edges = _trains(spark, d)
    return edges.select("u", "v", F.size("time_pairs").alias("pairs"), F.element_at("time_pairs", 1).dep.alias("first_dep"), F.element_at("time_pairs", -1).arr.alias("last_arr"))


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges by kind."""
    ev, st = events(spark, d), stations(spark, d)
    kinds = st.groupBy(F.concat(F.lit("node "), "modality").alias("kind")).agg(F.count("*").alias("n"))
    flights = ev.select("origin", "dest").distinct().agg(F.count("*").alias("n")).select(F.lit("edge event").alias("kind"), "n")
    walks = transfers(spark).agg(F.count("*").alias("n")).select(F.lit("edge transfer").alias("kind"), "n")
    trains = _trains(spark, d).agg(F.count("*").alias("n")).select(F.lit("edge train").alias("kind"), "n")
    return kinds.unionByName(flights).unionByName(walks).unionByName(trains)


def frequency_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Train edges among the stations that stop counts above the mean select."""
    freq = stops(spark, d).groupBy(F.col("station").alias("node")).agg(F.count("*").alias("n"))
    keep = freq.join(F.broadcast(freq.agg(F.avg("n").alias("mean")))).where("n > mean").select("node")
    return graph.induced(_trains(spark, d), keep).select("u", "v", F.size("time_pairs").alias("pairs"))


def reachability_buckets(spark: SparkSession, d: str) -> DataFrame:
    return search.reachable_countries(_events(spark, d), transfers(spark))


def _text(path: str = "path"):
    return F.array_join(F.col(path).cast("array<string>"), "-").alias("path")


def dfs_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ends (start, event, mask) of maximal itineraries with their countries and path, by the keep rule."""
    return sums.ends(events(spark, d), transfers(spark), WINDOW, FLOOR, search.MINUTES_OF_DAY).select("start", "event", "mask", "countries", _text())


def _bounded(spark: SparkSession, d: str) -> tuple[DataFrame, tuple[search.Bound, ...]]:
    """The events with what can still be reached from each, and the bounds: a cheap one first, then the budget."""
    ev = cut(search.with_reach(_first_day(spark, d), transfers(spark)))
    costs = search.entry_costs(ev, F.col("origin") % 25)
    return ev, (search.floor_bound(costs[0][0] if costs else 1), search.budget_bound(costs)) if costs else ()


def dfs_bounded(spark: SparkSession, d: str) -> DataFrame:
    """The ends of dfs_dedup by branch and bound: states that can't reach the most countries found so far are dropped."""
    ev, bounds = _bounded(spark, d)
    edges = _edges(spark, ev)
    ends = search.finished(search.states(ev, edges, WINDOW, bounds=bounds, floor=FLOOR), edges, ev)
    return search.keep_best(ends, FLOOR).select("start", "event", "mask", "countries")


def dfs_exact(spark: SparkSession, d: str) -> DataFrame:
    """All maximal itineraries as paths."""
    return sums.itineraries(events(spark, d), transfers(spark), WINDOW, search.MINUTES_OF_DAY).select("start", "event", F.bit_count("mask").alias("countries"), _text())


def dfs_layover90(spark: SparkSession, d: str) -> DataFrame:
    """One itinerary a start, end and country set: the shortest with layovers nearest to 90 minutes."""
    p = sums.nearest_ends(events(spark, d), transfers(spark), WINDOW, 90, search.MINUTES_OF_DAY)
    return p.select("start", "event", "mask", F.size("path").alias("legs"), "cost", _text())


def path_edge_check(spark: SparkSession, d: str) -> DataFrame:
    """The steps of dfs_dedup's paths held against the event edges, with their layovers."""
    ev = _first_day(spark, d)
    ends = sums.ends(events(spark, d), transfers(spark), WINDOW, FLOOR, search.MINUTES_OF_DAY)
    return search.path_edges(ends, _edges(spark, ev), ev)


def _whole(df: DataFrame) -> DataFrame:
    """``df`` with paths as the SQL's bigint; as decimal(38,0) if some number is past 64 bits."""
    df = cut(df)
    return df.withColumn("paths", F.col("paths").cast("bigint")) if df.where(F.col("paths") > (1 << 63) - 1).isEmpty() else df


def path_count(spark: SparkSession, d: str) -> DataFrame:
    return _whole(sums.path_counts(events(spark, d), transfers(spark), WINDOW))


def suffix_enumeration(spark: SparkSession, d: str) -> DataFrame:
    """All paths within the window of the departure, by length, as exhaustive enumeration counts them."""
    return _whole(sums.path_lengths(events(spark, d), transfers(spark), WINDOW, search.MINUTES_OF_DAY))


def label_pareto(spark: SparkSession, d: str) -> DataFrame:
    return sums.labels(events(spark, d), transfers(spark), WINDOW)


def label_best(spark: SparkSession, d: str) -> DataFrame:
    """The labels of most countries, by a search of the bounds and a record that a beam sets at first."""
    return search.skyline(sums.most_countries(events(spark, d), transfers(spark), WINDOW), WINDOW)


def label_beam(spark: SparkSession, d: str) -> DataFrame:
    """The most countries that a beam of 500 labels a level reaches, and how many labels do."""
    found = search.labels(_events(spark, d), transfers(spark), WINDOW, beam=500).groupBy(F.bit_count("mask").alias("countries")).agg(F.count("*").alias("labels"))
    return found.orderBy(F.desc("countries")).limit(1)


def half_forward(spark: SparkSession, d: str) -> DataFrame:
    return search.labels(_events(spark, d), transfers(spark), HALF, wait=WAIT, least_countries=2).drop("path")


def half_backward(spark: SparkSession, d: str) -> DataFrame:
    return sums.labels(events(spark, d), transfers(spark), HALF, wait=WAIT, backward=True, least_countries=2)


def _stitched(spark: SparkSession, d: str) -> DataFrame:
    """Per node the most countries of a stitched pair, the least duration that reaches it, and of these the least path."""
    ev = _events(spark, d)
    f, b = (cut(search.labels(ev, transfers(spark), HALF, wait=WAIT, backward=back)) for back in (False, True))
    best = F.min(F.struct((-F.col("countries")).alias("c"), "duration", "path")).alias("b")
    return search.stitch(f, b, WAIT, WINDOW).groupBy("node").agg(best).select("node", (-F.col("b.c")).alias("countries"), F.col("b.duration").alias("duration"), F.col("b.path").alias("path"))


def stitched(spark: SparkSession, d: str) -> DataFrame:
    return _stitched(spark, d).drop("path")


def stitched_paths(spark: SparkSession, d: str) -> DataFrame:
    """The itineraries behind ``stitched``: both halves' events in the order of travel.  Of equal ones which is named depends on the labels that dominance left, so there is no SQL."""
    return _stitched(spark, d).select("node", "countries", "duration", _text())


def matrix_dp(spark: SparkSession, d: str) -> DataFrame:
    mode = F.expr(MODE)
    least = spark.range(STATIONS).select(F.col("id").cast("int").alias("station")).select("station", graph.change_minutes(mode, mode, F.lit(True)).alias("minutes"))
    return sums.matrix_masks(events(spark, d), transfers(spark), WINDOW, {r["station"]: r["minutes"] for r in least.collect()}).select("u", "v", "mask", _text())


def rollout_probe(spark: SparkSession, d: str) -> DataFrame:
    ev = _first_day(spark, d)
    return search.rollouts(ev, _edges(spark, ev), WINDOW).select("start", "run", "countries", F.size("path").alias("legs"))


def rollout_choices(spark: SparkSession, d: str) -> DataFrame:
    """The three heaviest first steps from each start of the first day."""
    ev = _first_day(spark, d)
    return search.top_choices(ev, _edges(spark, ev), WINDOW).select("start", "place", "dst", F.round("weight", 6).alias("weight"))


def reachability_scheduled(spark: SparkSession, d: str) -> DataFrame:
    """Countries still reachable by scheduled legs alone."""
    return search.reachable_countries(_events(spark, d), None)


def reachability_passed(spark: SparkSession, d: str) -> DataFrame:
    """Countries that a journey by scheduled legs may have entered before it stands at a place; buckets count against time."""
    return search.reachable_countries(search.mirrored(_events(spark, d)), None)


def od_departures(spark: SparkSession, d: str) -> DataFrame:
    """Departures between two stations, in order."""
    rows = graph.departures(events(spark, d), 1, 8)
    return rows.select("event_id", "dep", "arr")


def train_pair_presence(spark: SparkSession, d: str) -> DataFrame:
    """Hops of routes and their copies of two days later, counted by whether the train edges hold them."""
    s = prep.absolute_minutes(stops(spark, d))
    w = Window.partitionBy("route").orderBy("pos")
    hops = s.select(F.col("station").alias("u"), F.lead("station").over(w).alias("v"), F.col("minute").alias("dep"), F.lead("minute").over(w).alias("arr")).where("u <> v")
    days = F.explode(F.array(*[F.lit(1440 * k).cast("bigint") for k in range(3)])).alias("late")
    expected = hops.select("u", "v", "dep", "arr", days).select("u", "v", (F.col("dep") + F.col("late")).alias("dep"), (F.col("arr") + F.col("late")).alias("arr"), (F.col("late") / 1440).cast("int").alias("day"))
    return graph.pair_presence(expected, graph.train_edges(s)).groupBy("day", "present").agg(F.count("*").alias("pairs"))


def shard_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Round-robin shards of the sorted start events, numbered without a global window: parts by range, counted, then offset."""
    ev = start_events(spark, d).select("event_id").withColumn("part", F.floor(F.col("event_id") / 1000))
    counts = ev.groupBy("part").agg(F.count("*").alias("n"))
    # Parts are numbered in two steps as well, by their thousand, so that no task orders all parts of a large table.
    group = F.floor(F.col("part") / 1000)
    whole = counts.groupBy(group.alias("group")).agg(F.sum("n").alias("n"))
    ahead = lambda by: F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = whole.select("group", ahead(Window.orderBy("group")).alias("far"))
    inside = counts.select("part", group.alias("group"), ahead(Window.partitionBy(group).orderBy("part")).alias("near"))
    before = inside.join(groups, "group").select("part", (F.col("far") + F.col("near")).alias("before"))
    local = F.row_number().over(Window.partitionBy("part").orderBy("event_id")) - 1
    return ev.withColumn("r", local).join(small(cut(before)), "part").select("event_id", F.pmod(F.col("before") + F.col("r"), F.lit(100)).cast("int").alias("job"))


def budgeted_upper_bound(spark: SparkSession, d: str) -> DataFrame:
    """For every start event the countries that a day still buys at the cheapest entry times."""
    ev = _events(spark, d)
    costs = graph.enter_minutes(ev, F.col("origin") % 25).agg(F.collect_list(F.struct(F.col("mtt").alias("cost"), F.expr("shiftleft(1L, country)").alias("bit"))).alias("costs"))
    both = ev.where(F.col("arr") <= 1440).join(F.broadcast(costs))
    return both.select("event_id", (F.bit_count("bit") + search.budgeted_bound(F.lit(1440) - F.col("arr"), F.col("bit"), F.col("costs"))).cast("int").alias("bound"))


def violations(spark: SparkSession, d: str) -> DataFrame:
    """Checks of the event graph, each with its number of rows at fault."""
    ev = events(spark, d)
    edges = graph.earliest_successors(ev, transfers(spark), ("dest", "arr"), ("origin", "dest", "dep"))
    faults = cut(graph.edge_faults(ev, transfers(spark), edges, STATIONS))
    checks = {
        "not_forward": ev.where("dep >= arr"),
        "same_country_leg": ev.where(F.col("origin") % 25 == F.col("dest") % 25),
        "unknown_station": ev.select(F.col("origin").alias("s")).union(ev.select("dest")).distinct().join(stations(spark, d).select(F.col("station").alias("s")), "s", "left_anti"),
        "one_way_transfer": transfers(spark).select("u", "v").exceptAll(transfers(spark).select(F.col("v").alias("u"), F.col("u").alias("v"))),
    }
    of_edges = {"time_infeasible": "infeasible", "several_to_one_destination": "several", "dangling_edge": "dangling"}
    return search.union_all([*[faults.select(F.lit(k).alias("check"), F.col(c).alias("rows")) for k, c in of_edges.items()], *[df.agg(F.count("*").alias("rows")).select(F.lit(k).alias("check"), "rows") for k, df in checks.items()]])


QUERIES = {
    f.__name__: f
    for f in (
        event_nodes, start_events, transfer_edges, aon_edges_direct, aon_edges_transfer, aon_fan_out, buffered_successors, degree_stats, mtt_leave, mtt_enter, train_edges, graph_summary,
        frequency_subgraph, reachability_buckets, reachability_scheduled, reachability_passed, dfs_dedup, dfs_bounded, dfs_exact, dfs_layover90, path_edge_check, path_count, suffix_enumeration,
        label_pareto, label_best, label_beam, half_forward, half_backward, stitched, stitched_paths, matrix_dp, rollout_probe, rollout_choices, od_departures, train_pair_presence, shard_assignment, budgeted_upper_bound, violations,
    )
}

_EV = "with recursive " + EVENTS_SQL
_TR = _EV + ", " + TRANSFERS_SQL
_AON = _TR + ", " + AON_SQL


def _hops(prefix: str) -> str:
    return (
        prefix
        + """, wraps as (select *, case when clock < lag(clock) over (partition by route order by pos) then 1440 else 0 end as wrap from stops),
roll as (select route, pos, station, cast(clock + sum(wrap) over (partition by route order by pos) as bigint) as minute from wraps),
hops as (select station as u, lead(station) over w as v, minute as dep, lead(minute) over w as arr from roll window w as (partition by route order by pos)),
runs as (select distinct u, v, dep + 1440 * day as dep, arr + 1440 * day as arr from hops, range(2) r(day) where u <> v and arr is not null),
train as (select u, v, cast(count(*) as int) as pairs, min(dep) as first_dep, arg_max(arr, (dep, arr)) as last_arr from runs group by u, v)
"""
    )


_DAY = "where arr <= 1440"
_FIN = "not exists (select 1 from hop where hop.src = {0}.event and hop.arr <= {0}.deadline)"
#: All paths; a shorter, then cheaper, then lesser one is the one that a memo keeps.
_PATHS = """
, pt as (
  select event_id as start, event_id as event, bit as mask, {clock} + 1440 as deadline, [event_id] as path, cast(0 as bigint) as cost, arr as here from ev {where}
  union all
  select start, hop.dst, mask | hop.bit, deadline, list_append(path, hop.dst), cost + abs(hop.dep - pt.here - 90), hop.arr
  from pt join hop on hop.src = pt.event where hop.arr <= deadline)
"""
_ENDS = (
    _PATHS.format(clock="arr", where=_DAY)
    + """, one as (select *, row_number() over (partition by start, event, mask order by len(path), {cost} path) as r, bit_count(mask) as countries from pt),
ends as (select * from one where r = 1 and """
    + _FIN.format("one")
    + "), kept as (select * from ends where countries >= 14 or ((select max(countries) from ends) < 14 and countries = (select max(countries) from ends)))"
)
_AS_TEXT = "array_to_string(path, '-') as path"
_MOVES = ", moves as materialized (select u, v, minutes from transfers union all select cast(i as int), cast(i as int), 0 from range(100) r(i))"
_FORWARD = """
, {name} as (
  select dest as node, arr as t, dep as start_time, bit as mask from ev where arr - dep <= {window}
  union
  select e.dest, e.arr, l.start_time, l.mask | e.bit from {name} l join moves m on m.u = l.node join ev e on e.origin = m.v and e.dep >= l.t + m.minutes + {wait} and e.arr - l.start_time <= {window})
"""
_BACKWARD = """
, {name} as (
  select origin as node, -dep as t, -arr as start_time, bit as mask from ev where arr - dep <= {window}
  union
  select e.origin, -e.dep, l.start_time, l.mask | e.bit from {name} l join moves m on m.v = l.node join ev e on e.dest = m.u and -e.arr >= l.t + m.minutes + {wait} and -e.dep - l.start_time <= {window})
"""
#: Undominated labels, of those that meet {0}: first the earliest per start and set, then by slots of the start, which no dominator lies beyond.
_SKY = """
, {name}_one as materialized (select node, start_time, mask, min(t) as t, cast(floor(start_time / {window}.0) as int) as slot from {name} where {of} group by node, start_time, mask)
, {name}_dom as materialized (select node, t, start_time, mask, unnest(range(cast(floor((t - {window}) / {window}.0) as int), slot + 1)) as slot from {name}_one)
, {name}_sky as (
select node, t, start_time, mask from {name}_one x where not exists (
  select 1 from {name}_dom d where d.node = x.node and d.slot = x.slot and d.t <= x.t and d.start_time >= x.start_time and (d.mask & x.mask) = x.mask and (d.t < x.t or d.start_time > x.start_time or d.mask <> x.mask)))
"""


def _reach(walks: str, direct: str = "select origin as node, cast(floor(dep / 60.0) as int) as bucket, bit, dest as to_node, cast(floor(arr / 60.0) as int) as to_bucket from ev") -> str:
    return (
        _TR
        + f""", direct as ({direct}),
       buckets as (select unnest(range((select min(bucket) from direct), (select max(to_bucket) from direct) + 1)) as bucket),
       nodes as (select node from direct union select to_node from direct),
       arcs as materialized (select node, bucket, to_node, to_bucket, bit_or(gain) as gain from (select node, bucket, to_node, to_bucket, bit as gain from direct
         union all select node, bucket, node, bucket + 1, 0 from nodes, buckets where bucket < (select max(bucket) from buckets) {walks}) group by all),
       gains as (select distinct node, bucket, i from arcs, range(25) r(i) where gain & (cast(1 as bigint) << i) > 0
         union select a.node, a.bucket, g.i from gains g join arcs a on a.to_node = g.node and a.to_bucket = g.bucket)
       select node, bucket, bit_or(cast(1 as bigint) << i) as mask from gains group by node, bucket"""
    )


_COSTS = ", costs as (select country, min(arr - dep) as cost from ev where origin % 25 <> country group by country)"

SQL = {
    "event_nodes": _EV + "select * from ev",
    "start_events": _EV + "select event_id, dest from ev where arr <= 1440",
    "transfer_edges": "with " + TRANSFERS_SQL + "select * from transfers",
    "aon_edges_direct": _EV
    + """, picked as (select a.event_id as src, b.event_id as dst, row_number() over (partition by a.event_id, b.dest order by b.arr, b.dep desc, b.origin, b.event_id) as r
       from ev a join ev b on b.origin = a.dest and b.dep >= a.arr) select src, dst from picked where r = 1""",
    "aon_edges_transfer": _AON + "select src, dst from aon",
    "aon_fan_out": _AON
    + """select a.country, n_name as name, count(*) as edges, count(distinct src) as sources, cast(sum(b.dep - a.arr) as bigint) as layover
       from aon join ev a on a.event_id = src join ev b on b.event_id = dst join nation on n_nationkey = a.country group by all""",
    "buffered_successors": _AON + "select src, dst from aon join ev a on a.event_id = src join ev b on b.event_id = dst where a.dest = b.origin and b.dep >= a.arr + case when a.dest < 50 then 20 else 0 end",
    "degree_stats": _AON
    + """, deg as (select event_id, (select count(*) from aon where src = event_id) as o, (select count(*) from aon where dst = event_id) as i from ev)
       select count(*) as events, count(*) filter (i = 0) as no_in, count(*) filter (o = 0) as no_out, count(*) filter (i = 0 and o = 0) as isolated, max(o) as most_out from deg""",
    "mtt_leave": _AON
    + """, gaps as (select a.country, min(b.arr - a.arr) as mtt from aon join ev a on a.event_id = src join ev b on b.event_id = dst where a.country <> b.country and b.arr > a.arr group by 1)
       select country, coalesce(mtt, 60) as mtt from (select distinct country from ev) left join gaps using (country)""",
    "mtt_enter": _EV + "select country, min(arr - dep) as mtt from ev where origin % 25 <> country group by country",
    "train_edges": _hops("with " + STOPS_SQL) + "select u, v, pairs, first_dep, last_arr from train",
    "train_pair_presence": _hops("with " + STOPS_SQL)
    + """, expected as (select u, v, dep + 1440 * day as dep, arr + 1440 * day as arr, cast(day as int) as day from hops, range(3) r(day) where u <> v and arr is not null)
       select day, r.u is not null as present, count(*) as pairs from expected e left join runs r using (u, v, dep, arr) group by all""",
    "graph_summary": _hops("with recursive " + STOPS_SQL + ", " + STATIONS_SQL + ", " + EVENTS_SQL + ", " + TRANSFERS_SQL)
    + """select 'node ' || modality as kind, count(*) as n from stations group by 1 union all select 'edge event', count(*) from (select distinct origin, dest from ev)
       union all select 'edge transfer', count(*) from transfers union all select 'edge train', count(*) from train""",
    "frequency_subgraph": _hops("with " + STOPS_SQL)
    + """, freq as (select station, count(*) as n from stops group by 1), keep as (select station from freq where n > (select avg(n) from freq))
       select u, v, pairs from train where u in (from keep) and v in (from keep)""",
    "reachability_buckets": _reach("union all select u, bucket, v, cast(floor((bucket * 60 + minutes) / 60.0) as int), 0 from transfers, buckets"),
    "reachability_scheduled": _reach(""),
    "reachability_passed": _reach("", "select dest as node, cast(floor(-arr / 60.0) as int) as bucket, bit, origin as to_node, cast(floor(-dep / 60.0) as int) as to_bucket from ev"),
    "dfs_dedup": _AON + _ENDS.format(cost="") + "select start, event, mask, countries, " + _AS_TEXT + " from kept",
    "dfs_bounded": _AON + _ENDS.format(cost="") + "select start, event, mask, countries from kept",
    "dfs_exact": _AON + _PATHS.format(clock="arr", where=_DAY) + "select start, event, bit_count(mask) as countries, " + _AS_TEXT + " from pt where " + _FIN.format("pt"),
    "dfs_layover90": _AON + _ENDS.format(cost="cost,") + "select start, event, mask, len(path) as legs, cost, " + _AS_TEXT + " from ends",
    "path_edge_check": _AON
    + _ENDS.format(cost="")
    + """, steps as (select start, event, mask, path, unnest(range(1, len(path))) as pos from kept)
       select start, cast(pos as int) as pos, path[pos] as src, path[pos + 1] as dst, aon.src is not null as is_edge, b.dep - a.arr as layover
       from steps left join aon on aon.src = path[pos] and aon.dst = path[pos + 1] join ev a on a.event_id = path[pos] join ev b on b.event_id = path[pos + 1]""",
    "path_count": _AON
    + """, pc as (select event_id as start, event_id as event, dep + 1440 as deadline from ev
         union all select start, hop.dst, deadline from pc join hop on hop.src = pc.event where hop.arr <= deadline)
       select start, count(*) as paths from pc group by start""",
    "suffix_enumeration": _AON
    + _PATHS.format(clock="dep", where="where arr <= 1440 and arr - dep <= 1440")
    + "select len(path) as legs, count(*) as paths, max(bit_count(mask)) as most from pt where "
    + _FIN.format("pt")
    + " group by 1",
    "label_pareto": _TR + _MOVES + _FORWARD.format(name="l", window=1440, wait=0) + _SKY.format(name="l", window=1440, of="true") + "select * from l_sky",
    "label_best": _TR + _MOVES + _FORWARD.format(name="l", window=1440, wait=0) + _SKY.format(name="l", window=1440, of="bit_count(mask) = (select max(bit_count(mask)) from l)") + "select * from l_sky",
    "half_forward": _TR + _MOVES + _FORWARD.format(name="l", window=840, wait=10) + _SKY.format(name="l", window=840, of="true") + "select * from l_sky where bit_count(mask) >= 2",
    "half_backward": _TR + _MOVES + _BACKWARD.format(name="l", window=840, wait=10) + _SKY.format(name="l", window=840, of="true") + "select * from l_sky where bit_count(mask) >= 2",
    "stitched": _TR
    + _MOVES
    + _FORWARD.format(name="f", window=840, wait=10)
    + _BACKWARD.format(name="b", window=840, wait=10)
    + _SKY.format(name="f", window=840, of="true")
    + _SKY.format(name="b", window=840, of="true")
    + """, met as (select f.node, bit_count(f.mask | b.mask) as countries, -b.start_time - f.start_time as duration from f_sky f join b_sky b on f.node = b.node and -b.t - f.t >= 10 and -b.start_time - f.start_time <= 1440),
       ranked as (select *, row_number() over (partition by node order by countries desc, duration) as r from met) select node, countries, duration from ranked where r = 1""",
    "matrix_dp": _AON
    + """, buf as materialized (select src, dst, b.arr, b.bit from aon join ev a on a.event_id = src join ev b on b.event_id = dst where a.dest = b.origin and b.dep >= a.arr + case when a.dest < 50 then 20 else 0 end),
       m as (select event_id as u, event_id as v, bit as mask, dep + 1440 as deadline, [event_id] as path from ev where arr - dep <= 1440
         union all select u, buf.dst, mask | buf.bit, deadline, list_append(path, buf.dst) from m join buf on buf.src = m.v where buf.arr <= deadline),
       one as (select u, v, mask, arg_min(path, (len(path), path)) as path from m group by u, v, mask)
       select u, v, mask, array_to_string(path, '-') as path from one x where not exists (select 1 from one d where d.u = x.u and d.v = x.v and (d.mask & x.mask) = x.mask and d.mask <> x.mask)""",
    "rollout_choices": _AON
    + """, w as (select a.event_id as start, hop.dst, case when a.bit & hop.bit = 0 then 1e5 else 1.0 end * case when e.dest = a.dest then 1e-4 else 1.0 end / greatest(hop.arr - a.arr, 1) as weight
         from ev a join hop on hop.src = a.event_id join ev e on e.event_id = hop.dst where a.arr <= 1440 and hop.arr <= a.arr + 1440),
       r as (select *, row_number() over (partition by start order by weight desc, dst) as place from w)
       select start, cast(place as int) as place, dst, round(weight, 6) as weight from r where place <= 3""",
    "od_departures": _EV + "select event_id, dep, arr from ev where origin = 1 and dest = 8",
    "shard_assignment": _EV + "select event_id, cast((row_number() over (order by event_id) - 1) % 100 as int) as job from ev where arr <= 1440",
    "budgeted_upper_bound": _EV
    + _COSTS
    + """, running as (select event_id, ev.arr, sum(cost) over (partition by event_id order by cost, c.country) as spent from ev join costs c on c.country <> ev.country where ev.arr <= 1440)
       select e.event_id, cast(1 + (select count(*) from running r where r.event_id = e.event_id and spent <= 1440 - e.arr) as int) as bound from ev e where e.arr <= 1440""",
    "violations": "select unnest(['time_infeasible', 'several_to_one_destination', 'dangling_edge', 'not_forward', 'same_country_leg', 'unknown_station', 'one_way_transfer']) as check, cast(0 as bigint) as rows",
}
