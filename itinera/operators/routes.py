"""Found routes: segments, quality, duplicates, usage, pages."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itinera.functions.transit import clock_of, holds_all, label_country, modality, route_of, station_code, station_name, transfer_margin, transfer_score, transport_type
from itinera.operators.graph import CHANGE_MINUTES
from itinera.session import small

#: Minutes of a transfer between different stations that no table lists.
UNKNOWN_TRANSFER = 60
#: Routes that sliding turns into Python objects at once.
ROUTES = 256


def segments(routes: DataFrame, key: str = "route_id", text: str = "route_sequence_json") -> DataFrame:
    """key, pos (from 1), origin, dest, dep_time, arr_time of every segment."""
    parsed = routes.select(key, F.posexplode(route_of(F.col(text))).alias("pos", "s"))
    return parsed.select(key, (F.col("pos") + 1).alias("pos"), "s.*")


def route_transfers(routes: DataFrame, minutes: DataFrame | None = None, key: str = "route_id", text: str = "route_sequence_json") -> DataFrame:
    """key, pos, from_name, to_name, buffer, margin, score of every change between segments; changes without times are left out.

    Neighbours are paired inside the route's array, so pairing shuffles nothing.
    ``minutes``: from_name, to_name, minutes of known transfers.
    """
    parsed = routes.select(key, route_of(F.col(text)).alias("r"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.struct(i.alias("pos"), F.element_at("r", i).alias("a"), F.element_at("r", i + 1).alias("b")))
    flat = parsed.where(F.size("r") > 1).select(key, F.inline(pairs))
    flat = flat.select(key, "pos", station_name(F.col("a.dest")).alias("from_name"), station_name(F.col("b.origin")).alias("to_name"), (F.col("b.dep_time") - F.col("a.arr_time")).alias("buffer"))
    same = F.col("from_name") == F.col("to_name")
    known = F.lit(None).cast("bigint")
    if minutes is not None:
        flat = flat.join(small(minutes.select("from_name", "to_name", F.col("minutes").alias("_m"))), ["from_name", "to_name"], "left")
        known = F.col("_m")
    transit = F.when(same, 0).otherwise(F.coalesce(known, F.lit(UNKNOWN_TRANSFER)))
    margin = transfer_margin(F.col("buffer"), transit, modality(station_code(F.col("from_name"))), modality(station_code(F.col("to_name"))), same)
    return flat.where("buffer is not null").withColumn("margin", margin.cast("bigint")).withColumn("score", transfer_score(F.col("margin"))).select(key, "pos", "from_name", "to_name", "buffer", "margin", "score")


def route_quality(transfers: DataFrame, key: str = "route_id") -> DataFrame:
    """key, rqi (0.7 least + 0.3 mean score) and the bottleneck's text, of its first worst change."""
    worst = F.min(F.struct("score", "pos", F.concat("from_name", F.lit("->"), "to_name", F.format_string(" (%+dm margin)", F.col("margin"))).alias("text")))
    scored = transfers.groupBy(key).agg(F.avg("score").alias("mean"), worst.alias("w"))
    return scored.select(key, (0.7 * F.col("w.score") + 0.3 * F.col("mean")).alias("rqi"), F.col("w.text").alias("bottleneck"))


def node_path(route: Column) -> Column:
    return F.concat_ws(" -> ", F.concat(F.array(F.element_at(route, 1).origin), F.transform(route, lambda s: s.dest)))


def timed_path(route: Column) -> Column:
    return F.array_join(F.transform(route, lambda s: F.concat_ws("_", s.origin, s.dep_time.cast("string"), s.dest, s.arr_time.cast("string"))), "|")


def distinct_routes(routes: DataFrame, path: Column, key: str = "route_id") -> DataFrame:
    """route_hash, first (least key) and copies of equal paths."""
    return routes.select(key, F.md5(path).alias("route_hash")).groupBy("route_hash").agg(F.min(key).alias("first"), F.count("*").alias("copies"))


def route_records(routes: DataFrame, key: str = "route_id", text: str = "route_sequence_json") -> DataFrame:
    """key, start, end, legs, countries (of destinations), duration (last arrival less first departure)."""
    r = route_of(F.col(text))
    parsed = routes.select(key, r.alias("r")).where(F.size("r") > 0)
    first, last = F.element_at("r", 1), F.element_at("r", -1)
    lands = F.array_distinct(F.filter(F.transform("r", lambda s: label_country(s.dest)), lambda c: c.isNotNull()))
    return parsed.select(key, first.origin.alias("start"), last.dest.alias("end"), F.size("r").alias("legs"), F.size(lands).alias("countries"), (last.arr_time - first.dep_time).alias("duration"))


def station_usage(segs: DataFrame) -> DataFrame:
    """name, uses: each segment counts its origin and destination; missing names don't count."""
    both = segs.select(F.explode(F.array(station_name(F.col("origin")), station_name(F.col("dest")))).alias("name"))
    return both.where("name is not null").groupBy("name").agg(F.count("*").alias("uses"))


def edge_usage(segs: DataFrame) -> DataFrame:
    return segs.where("origin is not null and dest is not null").groupBy(station_name(F.col("origin")).alias("origin"), station_name(F.col("dest")).alias("dest")).agg(F.count("*").alias("uses"))


def cumulative(counts: DataFrame, names: Sequence[str], uses: str = "uses", parts: int = 64) -> DataFrame:
    """rank, running total and share, by falling use, then by name.

    The running total over all rows needs an order of all rows.  It is worked out over the
    distinct use counts (few) and over ranges of names among equals, whose bounds come from a
    sample; rows take their place from their count's total, their range's start and their rank
    in the range.  So neither one count that most rows have nor the table is ordered by one task.
    """
    # Cut points from a sample of the first name by its hash; any cut points give the same ranks.
    first = F.col(names[0])
    drawn = counts.select(first.alias("_n")).where("_n is not null").distinct().orderBy(F.xxhash64("_n"), "_n").limit(16 * parts)
    cuts = sorted(r["_n"] for r in drawn.collect())[::16]
    range_no = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= first)) if cuts else F.lit(0)
    placed = counts.withColumn("_range", F.coalesce(range_no, F.lit(0)))
    sizes = placed.groupBy(uses, "_range").agg(F.count("*").alias("_n"))
    starts = sizes.select(uses, "_range", F.coalesce(F.sum("_n").over(Window.partitionBy(uses).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    levels = sizes.groupBy(uses).agg(F.sum("_n").alias("_n"))
    falling = Window.orderBy(F.desc(uses)).rowsBetween(Window.unboundedPreceding, -1)
    before = levels.select(uses, F.coalesce(F.sum("_n").over(falling), F.lit(0)).alias("_rank"), F.coalesce(F.sum(F.col("_n") * F.col(uses)).over(falling), F.lit(0)).alias("_sum"), F.sum(F.col("_n") * F.col(uses)).over(Window.partitionBy()).alias("_all"))
    among = F.row_number().over(Window.partitionBy(uses, "_range").orderBy(*names))
    ranked = placed.withColumn("_a", among).join(starts, [uses, "_range"]).withColumn("_a", F.col("_a") + F.col("_start")).join(before, uses)
    running = F.col("_sum") + F.col("_a") * F.col(uses)
    return ranked.select(*names, uses, (F.col("_rank") + F.col("_a")).alias("rank"), running.alias("running"), (running / F.col("_all")).alias("share"))


def coverage(ranked: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share, needed: the fewest ranks whose running share reaches each share."""
    return ranked.agg(*[F.min(F.when(F.col("share") >= s, F.col("rank"))).alias(f"s{i}") for i, s in enumerate(shares)]).select(
        F.inline(F.array(*[F.struct(F.lit(float(s)).alias("target"), F.col(f"s{i}").alias("needed")) for i, s in enumerate(shares)]))
    )


def page_filter(countries: int | None = None, start: str | None = None, minute: int | None = None, contains: Sequence[str] = (), hide_negative: bool = False) -> Column:
    """The conjunction of the page's filters; no filter is true."""
    out = F.lit(True)
    if countries is not None:
        out &= F.col("total_countries") == countries
    if start is not None:
        out &= F.col("start_node") == start
    if minute is not None:
        out &= F.pmod(F.get_json_object("route_sequence_json", "$[0].dep_time").try_cast("bigint"), F.lit(1440)) == minute
    if contains:
        out &= holds_all(F.col("route_sequence_json"), contains)
    if hide_negative:
        out &= F.col("rqi_score").isNotNull() & ~F.isnan("rqi_score") & (F.col("rqi_score") >= 0)
    return out


def page(routes: DataFrame, order: Sequence[Column], offset: int, size: int) -> DataFrame:
    """One page with its rank; a page is the feature, so the sort is a top-k of offset + size rows."""
    top = routes.orderBy(*order).limit(offset + size)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") > offset)


def itinerary(segs: DataFrame, schedule: DataFrame | None = None, key: str = "route_id") -> DataFrame:
    """Display rows: mode, local or approximate clock, elapsed minutes, countries so far, whether the station repeats the last."""
    w = Window.partitionBy(key).orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    o, t = station_name(F.col("origin")), station_name(F.col("dest"))
    rows = segs.select(
        key, "pos", o.alias("origin"), t.alias("dest"), transport_type(station_code(o), station_code(t)).alias("mode"), "dep_time", "arr_time",
        (F.col("arr_time") - F.first("arr_time").over(upto)).alias("elapsed"), F.size(F.array_distinct(F.collect_list(label_country(F.col("dest"))).over(upto))).alias("countries"),
        (o != F.lag(t).over(w)).alias("changes_station"),
    )
    dep, arr = F.concat(F.lit("~ "), clock_of(F.col("dep_time"))), F.concat(F.lit("~ "), clock_of(F.col("arr_time")))
    if schedule is not None:
        rows = rows.withColumns({"dep_min": F.pmod("dep_time", F.lit(1440)), "arr_min": F.pmod("arr_time", F.lit(1440))}).join(small(schedule), ["origin", "dest", "dep_min", "arr_min"], "left")
        dep, arr = F.coalesce("local_dep", dep), F.coalesce("local_arr", arr)
    return rows.select(key, "pos", "origin", "dest", "mode", dep.alias("departs"), arr.alias("arrives"), "elapsed", "countries", "changes_station")


def resolved_steps(segs: DataFrame, scheduled: DataFrame, transfers: DataFrame, key: str = "route_id") -> DataFrame:
    """key, pos, transport, minutes of every segment: the kind of the scheduled edge that has its times, else "transfer" if a walk takes as long, else "unknown".

    ``scheduled``: origin, dest, dep_time, arr_time, kind.  ``transfers``: origin, dest, minutes.  Of several edges the least kind counts.
    """
    edge = scheduled.groupBy("origin", "dest", "dep_time", "arr_time").agg(F.min("kind").alias("kind"))
    walk = transfers.select("origin", "dest", F.col("minutes").cast("bigint").alias("minutes"), F.lit(True).alias("_walk")).distinct()
    steps = segs.select(key, "pos", "origin", "dest", "dep_time", "arr_time", (F.col("arr_time") - F.col("dep_time")).alias("minutes"))
    found = steps.join(edge, ["origin", "dest", "dep_time", "arr_time"], "left").join(walk, ["origin", "dest", "minutes"], "left")
    return found.select(key, "pos", F.coalesce("kind", F.when(F.col("_walk"), "transfer"), F.lit("unknown")).alias("transport"), "minutes")


def slide(routes: DataFrame, alternatives: DataFrame, key: str = "route_id", text: str = "route_sequence_json") -> DataFrame:
    """Schedule sliding: inner rail segments move to another departure of their edge where that raises the route's quality.

    ``alternatives``: origin, dest, dep_time, arr_time.  Candidates come from an equi-join on the
    edge and a range: they arrive by the next departure, which has not moved when they are tried, and
    leave no earlier than any arrival before, which moves can't undercut but by ``back``, the most that
    an alternative arrives before it leaves.  The sequential choice runs per route, a few routes at a time.
    Keys are unique: a route's neighbours are looked up inside its row, not by a shuffle.
    Output: key, rqi_before, rqi_after, moved.
    """
    parsed = routes.select(key, route_of(F.col(text)).alias("_s")).where(F.size("_s") > 0)
    back = alternatives.agg(F.greatest(F.coalesce(F.max(F.col("dep_time") - F.col("arr_time")), F.lit(0)), F.lit(0)).alias("back"))
    alt = alternatives.select("origin", "dest", F.col("dep_time").alias("a_dep"), F.col("arr_time").alias("a_arr")).repartition("origin", "dest").distinct()
    each = parsed.select(key, "_s", F.posexplode("_s").alias("pos", "_x")).where(F.col("pos") > 0)
    lo, hi = F.array_min(F.transform(F.slice("_s", 1, F.col("pos")), lambda x: x["arr_time"])), F.get("_s", F.col("pos") + 1)["dep_time"]
    inner = each.select(key, "pos", "_x.origin", "_x.dest", F.col("_x.dep_time").alias("dep"), F.col("_x.arr_time").alias("arr"), lo.alias("lo"), hi.alias("hi"))
    tried = inner.where("lo is not null and hi is not null").join(F.broadcast(back)).withColumn("lo", F.col("lo") - F.col("pos") * F.col("back")).drop("back")
    # A train that leaves and arrives as the route's own changes nothing.
    other = tried.join(alt, ["origin", "dest"]).where("a_dep >= lo and a_arr <= hi and (a_dep <> dep or a_arr <> arr)")
    options = other.groupBy(key).agg(F.collect_list(F.struct("pos", "a_dep", "a_arr")).alias("options"))

    def seg(x: Column, i: Column) -> Column:
        ends = station_name(x["dest"]).eqNullSafe(station_name(F.get("_s", i + 1)["origin"]))
        from_mode, to_mode = modality(station_code(station_name(x["dest"]))), modality(station_code(station_name(x["origin"])))
        return F.struct(x["dep_time"].alias("dep_time"), x["arr_time"].alias("arr_time"), ends.alias("same"), to_mode.alias("o_mode"), from_mode.alias("d_mode"))

    whole = parsed.select(key, F.transform("_s", seg).alias("segs")).join(options, key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROUTES):
                part = b.slice(i, ROUTES)
                before, after, moved = zip(*[_slid(*x) for x in zip(part["segs"].to_pylist(), part["options"].to_pylist())])
                yield pa.RecordBatch.from_arrays([part[key].cast(pa.int64()), pa.array(before, pa.float64()), pa.array(after, pa.float64()), pa.array(moved, pa.int32())], [key, "rqi_before", "rqi_after", "moved"])

    return whole.mapInArrow(run, f"`{key}` bigint, rqi_before double, rqi_after double, moved int")


def _slid(segs: list[dict], options: list[dict] | None) -> tuple[float | None, float | None, int]:
    """(quality before, after, segments moved) of one route; a move changes the two changes beside it."""
    times = [(s["dep_time"], s["arr_time"]) for s in segs]
    trains: dict[int, list[tuple[int, int]]] = {}
    for o in options or ():
        trains.setdefault(o["pos"], []).append((o["a_dep"], o["a_arr"]))

    def score(i: int, arrived, leaves) -> float:
        a, b = segs[i], segs[i + 1]
        same = a["same"]
        least = 0 if same and a["d_mode"] == b["o_mode"] == "R" else CHANGE_MINUTES[a["d_mode"], b["o_mode"]]
        m = leaves - arrived - (0 if same else UNKNOWN_TRANSFER) - least
        return 100 * (1 - math.exp(-0.05 * m)) if m >= 0 else 1000.0 * m

    def quality(scores: list[float]) -> float:
        return 0.7 * min(scores) + 0.3 * sum(scores) / len(scores)

    if len(segs) < 2 or any(t is None for pair in times for t in pair):
        return None, None, 0
    scores = [score(i, times[i][1], times[i + 1][0]) for i in range(len(segs) - 1)]
    before = best = quality(scores)
    moved = 0
    for i in range(1, len(segs) - 1):
        if segs[i]["o_mode"] == segs[i]["d_mode"] == "A":
            continue
        kept = times[i]
        for dep, arr in sorted(trains.get(i, ())):
            if dep < times[i - 1][1] or arr > times[i + 1][0]:
                continue
            trial = [*scores[: i - 1], score(i - 1, times[i - 1][1], dep), score(i, arr, times[i + 1][0]), *scores[i + 1 :]]
            if (q := quality(trial)) > best:
                best, times[i], scores = q, (dep, arr), trial
        moved += times[i] != kept
    return before, best, moved
