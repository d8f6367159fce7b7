"""Searches for itineraries that visit many countries, as supersteps of joins.

State: (start, event, mask, ...).  One superstep joins the frontier with the edges, keeps
what arrives within the deadline and may still reach the record, adds the country's bit and
drops states that this or an earlier level found.  Events arrive after they depart, so time
grows with every level; the loops run until the frontier is empty, however many levels that
takes.  Every state, label and mask carries its path as an array of event ids.

The record (incumbent) is one number per level, known to the driver.  Bounds are admissible: a
country costs at least its cheapest entering leg, and only countries that can still be
reached from the place and hour count.  Lineage is cut by reliable checkpoints, so lost
executors cost a recomputation of one level at most.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itinera.session import cut, small

MINUTES_OF_DAY = 1440
#: Upper bound on the countries of a journey: (mask, minutes left, mask of countries still reachable or None) -> number.
Bound = Callable[[Column, Column, Column | None], Column]


def with_legs(edges: DataFrame, events: DataFrame) -> DataFrame:
    """src, dst and of the destination event: arr, dep, country, bit, dest (and reach); the table that every superstep joins."""
    own = {"arr": "n_arr", "dep": "n_dep", "bit": "n_bit", "country": "n_country", "dest": "n_dest", "reach": "n_reach"}
    legs = events.select(F.col("event_id").alias("dst"), *[F.col(c).alias(n) for c, n in own.items() if c in events.columns])
    return edges.join(legs, "dst")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class _Log:
    """Tables of the levels so far; written as one every so often, so that plans stay short."""

    def __init__(self) -> None:
        self.parts: list[DataFrame] = []

    def add(self, df: DataFrame) -> None:
        self.parts.append(df)
        if len(self.parts) > 16:
            self.parts = [cut(union_all(self.parts))]

    def all(self) -> DataFrame:
        return union_all(self.parts)


def entry_costs(events: DataFrame, station_country: Column) -> list[tuple[int, int]]:
    """(least minutes of a leg that enters it, bit) of each country; a mask has at most 63."""
    rows = events.where(station_country != F.col("country")).groupBy("bit").agg(F.min(F.col("arr") - F.col("dep")).alias("m")).collect()
    return sorted((int(r["m"]), int(r["bit"])) for r in rows)


def budget_bound(costs: list[tuple[int, int]]) -> Bound:
    """Countries seen plus those that the minutes left buy, cheapest first, of the reachable ones not seen."""
    table = F.array(*[F.struct(F.lit(c).cast("bigint").alias("cost"), F.lit(b).cast("bigint").alias("bit")) for c, b in costs])

    def bound(mask: Column, left: Column, reach: Column | None) -> Column:
        closed = mask if reach is None else mask.bitwiseOR(F.bitwise_not(reach))
        return F.bit_count(mask) + budgeted_bound(left, closed, table)

    return bound


def floor_bound(least: int) -> Bound:
    """Countries seen plus one for every ``least`` minutes left."""
    return lambda mask, left, reach: F.bit_count(mask) + F.floor(left / F.lit(max(1, least)))


def with_reach(events: DataFrame, transfers: DataFrame | None) -> DataFrame:
    """``events`` with reach: the countries that can still be entered after arriving by each, whatever the deadline."""
    ahead = reachable_countries(events, transfers).select(F.col("node").alias("dest"), F.col("bucket").alias("_b"), F.col("mask").alias("reach"))
    placed = events.withColumn("_b", F.floor(F.col("arr") / 60).cast("int")).join(ahead, ["dest", "_b"], "left").drop("_b")
    return placed.withColumn("reach", F.coalesce("reach", F.lit(0).cast("bigint")))


def _most(df: DataFrame) -> int:
    return df.agg(F.max(F.bit_count("mask")).alias("n")).first()["n"] or 0


def states(
    events: DataFrame, edges: DataFrame, window: int, clock: str = "arr", bounds: tuple[Bound, ...] = (), floor: int | None = None, prefer_layover: int | None = None, first_until: int = MINUTES_OF_DAY
) -> DataFrame:
    """Distinct (start, event, mask) reachable within ``window`` minutes of the start's ``clock``: with level, deadline, cost, path.

    A state is expanded once, at the level that first finds it.  Of several ways to it at that
    level the one of least cost (the distances of layovers from ``prefer_layover``, if given),
    then of least path is kept.  ``bounds``: a state that some bound keeps below the record,
    the most countries of any state so far but ``floor`` at most, is dropped; ties survive.
    Starts are the events that arrive by ``first_until``.
    """
    hop = with_legs(edges, events)
    if prefer_layover is not None:
        hop = hop.join(events.select(F.col("event_id").alias("src"), F.col("arr").alias("s_arr")), "src").withColumn("step_cost", F.abs(F.col("n_dep") - F.col("s_arr") - prefer_layover).cast("bigint")).drop("s_arr")
    else:
        hop = hop.withColumn("step_cost", F.lit(0).cast("bigint"))
    hop = cut(hop)
    reach = F.col("n_reach") if "n_reach" in hop.columns else None
    key = ["start", "event", "mask"]
    frontier = cut(
        events.where(F.col("arr") <= first_until).select(
            F.col("event_id").alias("start"), F.col("event_id").alias("event"), F.col("bit").alias("mask"), (F.col(clock) + window).alias("deadline"), F.lit(0).alias("level"),
            F.lit(0).cast("bigint").alias("cost"), F.array("event_id").alias("path"),
        )
    )
    log, record = _Log(), _most(frontier) if bounds else 0
    for level in count(1):
        log.add(frontier)
        step = frontier.join(hop, frontier["event"] == hop["src"]).where("n_arr <= deadline").withColumn("mask", F.col("mask").bitwiseOR(F.col("n_bit")))
        for b in bounds:
            step = step.where(b(F.col("mask"), F.col("deadline") - F.col("n_arr"), reach) >= (record if floor is None else min(record, floor)))
        step = step.select("start", F.col("dst").alias("event"), "mask", "deadline", (F.col("cost") + F.col("step_cost")).alias("cost"), F.concat("path", F.array("dst")).alias("path"))
        best = step.groupBy(*key).agg(F.min(F.struct("cost", "path")).alias("b"), F.max("deadline").alias("deadline"))
        fresh = best.join(log.all().select(*key), key, "left_anti")
        frontier = cut(fresh.select(*key, "deadline", F.lit(level).alias("level"), F.col("b.cost").alias("cost"), F.col("b.path").alias("path")))
        if frontier.isEmpty():
            return log.all()
        if bounds:
            record = max(record, _most(frontier))


def finished(found: DataFrame, edges: DataFrame, events: DataFrame) -> DataFrame:
    """The states with no successor within the deadline: ends of maximal itineraries."""
    hop = with_legs(edges, events).select("src", "n_arr")
    return found.join(hop, (found["event"] == hop["src"]) & (hop["n_arr"] <= found["deadline"]), "left_anti")


def keep_best(ends: DataFrame, floor: int) -> DataFrame:
    """Ends with at least ``floor`` countries, or with the most there are if none has."""
    scored = ends.withColumn("countries", F.bit_count("mask"))
    most = scored.agg(F.max("countries").alias("most"))
    return scored.join(F.broadcast(most)).where((F.col("countries") >= floor) | ((F.col("most") < floor) & (F.col("countries") == F.col("most")))).drop("most")


def itineraries(events: DataFrame, edges: DataFrame, window: int, clock: str = "arr", first_until: int = MINUTES_OF_DAY) -> DataFrame:
    """start, event, mask, path (event ids) of all maximal itineraries, however many ways lead to one end."""
    hop = cut(with_legs(edges, events))
    frontier = cut(
        events.where(F.col("arr") <= first_until).select(
            F.col("event_id").alias("start"), F.col("event_id").alias("event"), F.col("bit").alias("mask"), (F.col(clock) + window).alias("deadline"), F.array("event_id").alias("path")
        )
    )
    ends = []
    while True:
        joined = frontier.join(hop, (frontier["event"] == hop["src"]) & (hop["n_arr"] <= frontier["deadline"]), "left")
        ends.append(joined.where("dst is null").select("start", "event", "mask", "path"))
        step = joined.where("dst is not null").select("start", F.col("dst").alias("event"), F.col("mask").bitwiseOR(F.col("n_bit")).alias("mask"), "deadline", F.concat("path", F.array("dst")).alias("path"))
        frontier = cut(step)
        if frontier.isEmpty():
            break
    return union_all(ends)


def path_edges(paths: DataFrame, edges: DataFrame, events: DataFrame, key: str = "start", path: str = "path") -> DataFrame:
    """key, pos, src, dst, is_edge, layover of every step of event paths: whether it is an edge, and the minutes between its events."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.struct(i.alias("pos"), F.element_at(path, i).alias("src"), F.element_at(path, i + 1).alias("dst")))
    steps = paths.where(F.size(path) > 1).select(key, F.inline(pairs))
    known = edges.select("src", "dst", F.lit(True).alias("is_edge"))
    a, b = events.select(F.col("event_id").alias("src"), F.col("arr")), events.select(F.col("event_id").alias("dst"), F.col("dep"))
    return steps.join(known, ["src", "dst"], "left").join(a, "src").join(b, "dst").select(key, "pos", "src", "dst", F.coalesce("is_edge", F.lit(False)).alias("is_edge"), (F.col("dep") - F.col("arr")).alias("layover"))


def _slot(c: Column, span: int) -> Column:
    return F.floor(c / span)


def undominated(labels: DataFrame, others: DataFrame, span: int | None = None, equal: bool = False) -> DataFrame:
    """The labels (node, t, start_time, mask) that none of ``others`` at the node dominates: no later, started no earlier, and a superset.

    ``equal``: an equal label dominates as well.  ``span``: no label has t more than this past
    start_time; then the join is also by slots of start_time, each dominator standing in all
    slots that hold labels which it could dominate.
    """
    d = others.select(F.col("node").alias("d_node"), F.col("t").alias("d_t"), F.col("start_time").alias("d_start"), F.col("mask").alias("d_mask"))
    better = (F.col("node") == F.col("d_node")) & (F.col("d_t") <= F.col("t")) & (F.col("d_start") >= F.col("start_time")) & (F.col("d_mask").bitwiseAND(F.col("mask")) == F.col("mask"))
    if not equal:
        better &= (F.col("d_t") < F.col("t")) | (F.col("d_start") > F.col("start_time")) | (F.col("d_mask") != F.col("mask"))
    if span is None:
        return labels.join(d, better, "left_anti")
    d = d.withColumn("d_slot", F.explode(F.sequence(_slot(F.col("d_t") - span, span), _slot(F.col("d_start"), span))))
    return labels.withColumn("slot", _slot(F.col("start_time"), span)).join(d, better & (F.col("slot") == F.col("d_slot")), "left_anti").drop("slot")


def skyline(labels: DataFrame, span: int | None = None) -> DataFrame:
    """Labels that no other of the node dominates; equal labels count once, with the shortest, then least path if they carry paths.

    Labels are first reduced to the least t per (node, start, mask), before the shuffle.
    """
    carried = [F.size("path").alias("n"), F.col("path")] if "path" in labels.columns else []
    one = labels.groupBy("node", "start_time", "mask").agg(F.min(F.struct("t", *carried)).alias("b"))
    one = one.select("node", F.col("b.t").alias("t"), "start_time", "mask", *[F.col("b.path").alias("path") for _ in carried[1:]])
    return undominated(one, one, span)


def maximal_masks(sets: DataFrame, by: list[str]) -> DataFrame:
    """Masks that are no proper subset of another of their group."""
    one = sets.select(*by, "mask").distinct()
    d = one.select(*[F.col(c).alias(f"d_{c}") for c in by], F.col("mask").alias("d_mask"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"d_{c}") for c in by])
    return one.join(d, same & (F.col("d_mask").bitwiseAND(F.col("mask")) == F.col("mask")) & (F.col("d_mask") != F.col("mask")), "left_anti")


def labels(
    events: DataFrame, transfers: DataFrame | None, window: int, wait: int = 0, backward: bool = False, least_countries: int = 0,
    bounds: tuple[Bound, ...] = (), record: int = 0, reach: DataFrame | None = None, beam: int | None = None,
) -> DataFrame:
    """Label-setting search over stations: node, t, start_time, mask, path of undominated labels within ``window`` minutes.

    Forward labels board any event at its departure; backward ones leave a final event against
    time (times are negated, so one skyline serves both; paths stay in the order of travel).
    A level's labels are dropped if one of theirs or of an earlier level dominates them.
    ``least_countries``: the fewest of a label that is returned.

    ``bounds``: labels that a bound keeps below the most countries found so far, ``record``
    at first, are dropped; ties survive, so all labels of most countries are found.
    ``reach``: node, bucket, mask of ``reachable_countries``, for forward bounds.
    ``beam``: the feature of keeping that many labels of a level, most countries, then earliest, first.
    """
    if backward:
        legs = events.select("event_id", F.col("dest").alias("o"), F.col("origin").alias("d"), (-F.col("arr")).alias("dep"), (-F.col("dep")).alias("arr"), "bit")
        moves = None if transfers is None else transfers.select(F.col("v").alias("u"), F.col("u").alias("v"), "minutes")
    else:
        legs = events.select("event_id", F.col("origin").alias("o"), F.col("dest").alias("d"), "dep", "arr", "bit")
        moves = transfers
    legs = cut(legs)
    if reach is not None:
        reach = small(cut(reach.select(F.col("node"), F.col("bucket").alias("_b"), F.col("mask").alias("_reach"))))

    def promising(df: DataFrame) -> DataFrame:
        if not bounds:
            return df
        ahead = None
        if reach is not None:
            df = df.withColumn("_b", F.floor(F.col("t") / 60).cast("int")).join(reach, ["node", "_b"], "left")
            ahead = F.coalesce("_reach", F.lit(0).cast("bigint"))
        for b in bounds:
            df = df.where(b(F.col("mask"), F.lit(window) - (F.col("t") - F.col("start_time")), ahead) >= record)
        return df.select("node", "t", "start_time", "mask", "path")

    step = legs.where(F.col("arr") - F.col("dep") <= window).select(F.col("d").alias("node"), F.col("arr").alias("t"), F.col("dep").alias("start_time"), F.col("bit").alias("mask"), F.array("event_id").alias("path"))
    log = _Log()
    while True:
        fresh = skyline(promising(step), window)
        if log.parts:
            fresh = undominated(fresh, log.all(), window, equal=True)
        if beam is not None:
            fresh = fresh.orderBy(F.desc(F.bit_count("mask")), "t", F.desc("start_time"), "node", "mask").limit(beam)
        frontier = cut(fresh)
        if frontier.isEmpty():
            break
        log.add(frontier)
        if bounds:
            record = max(record, _most(frontier))
        at = frontier
        if moves is not None:
            walked = at.join(moves, at["node"] == moves["u"]).select(F.col("v").alias("node"), (F.col("t") + F.col("minutes")).alias("t"), "start_time", "mask", "path")
            at = at.unionByName(walked)
        step = at.join(legs, (at["node"] == legs["o"]) & (legs["dep"] >= at["t"] + wait) & (legs["arr"] - at["start_time"] <= window))
        longer = F.concat(F.array("event_id"), F.col("path")) if backward else F.concat(F.col("path"), F.array("event_id"))
        step = step.select(F.col("d").alias("node"), F.col("arr").alias("t"), "start_time", F.col("mask").bitwiseOR(F.col("bit")).alias("mask"), longer.alias("path"))
    if not log.parts:
        return step.limit(0)
    found = skyline(log.all(), window)
    return found.where(F.bit_count("mask") >= (max(record, least_countries) if bounds else least_countries))


def stitch(forward: DataFrame, backward: DataFrame, wait: int, window: int) -> DataFrame:
    """Pairs of half-searches that meet at a node: node, countries, duration, start_time, end_time, path.

    A pair that fits starts at most ``window`` before it ends, so the join is by slots of the start too.
    """
    carried = "path" in forward.columns and "path" in backward.columns
    f = forward.select("node", F.col("t").alias("f_t"), F.col("start_time").alias("f_start"), F.col("mask").alias("f_mask"), *[F.col("path").alias("f_path")] * carried)
    b = backward.select("node", (-F.col("t")).alias("b_t"), (-F.col("start_time")).alias("b_end"), F.col("mask").alias("b_mask"), *[F.col("path").alias("b_path")] * carried)
    f = f.withColumn("slot", _slot(F.col("f_start"), window))
    b = b.withColumn("slot", F.explode(F.sequence(_slot(F.col("b_end") - window, window), _slot(F.col("b_end"), window))))
    met = f.join(b, ["node", "slot"]).where((F.col("b_t") - F.col("f_t") >= wait) & (F.col("b_end") - F.col("f_start") <= window))
    return met.select(
        "node", F.bit_count(F.col("f_mask").bitwiseOR(F.col("b_mask"))).alias("countries"), (F.col("b_end") - F.col("f_start")).alias("duration"), F.col("f_start").alias("start_time"),
        F.col("b_end").alias("end_time"), *[F.concat("f_path", "b_path").alias("path")] * carried,
    )


def reachable_countries(events: DataFrame, transfers: DataFrame | None, bucket_minutes: int = 60, waits: bool = True) -> DataFrame:
    """node, bucket, mask: countries that can still be entered from a node in a time bucket, as a backward fixpoint.

    A round takes one leg or walk; waits go back over a whole run of buckets by a running or,
    so the rounds follow the legs of a journey, not its hours.  They end when nothing is gained.
    """
    b = lambda c: F.floor(c / bucket_minutes).cast("int")
    direct = events.select(F.col("origin").alias("node"), b(F.col("dep")).alias("bucket"), "bit", F.col("dest").alias("to"), b(F.col("arr")).alias("to_bucket"))
    # All buckets from the first departure to the last arrival, hours without an event too: one row, exploded beside each place.
    span = F.broadcast(direct.agg(F.min("bucket").alias("lo"), F.max("to_bucket").alias("hi")).where("lo is not null"))
    every = F.explode(F.sequence("lo", "hi")).alias("bucket")
    arcs = direct.select("node", "bucket", "to", "to_bucket", F.col("bit").alias("gain"))
    nodes = direct.select("node").union(direct.select("to")).distinct()
    if waits:
        rest = nodes.join(span).select("node", "hi", every).where("bucket < hi").select("node", "bucket", F.col("node").alias("to"), (F.col("bucket") + 1).alias("to_bucket"), F.lit(0).cast("bigint").alias("gain"))
        arcs = arcs.unionByName(rest)
    if transfers is not None:
        walk = transfers.join(span).select("u", "v", "minutes", every).select(F.col("u").alias("node"), "bucket", F.col("v").alias("to"), b(F.col("bucket") * bucket_minutes + F.col("minutes")).alias("to_bucket"), F.lit(0).cast("bigint").alias("gain"))
        arcs = arcs.unionByName(walk)
    arcs = cut(arcs.groupBy("node", "bucket", "to", "to_bucket").agg(F.bit_or("gain").alias("gain")))
    run = Window.partitionBy("node").orderBy("bucket")
    back = Window.partitionBy("node", "run", "alone").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    served = small(cut(nodes.withColumn("served", F.lit(True))))

    def waited(df: DataFrame) -> DataFrame:
        if not waits:
            return df
        df = df.join(served, "node", "left").withColumns({"run": F.col("bucket") - F.row_number().over(run), "alone": F.when(F.col("served").isNull(), F.col("bucket"))})
        return df.select("node", "bucket", F.bit_or("mask").over(back).alias("mask"))

    now = cut(waited(arcs.groupBy("node", "bucket").agg(F.bit_or("gain").alias("mask"))))
    while True:
        ahead = now.select(F.col("node").alias("to"), F.col("bucket").alias("to_bucket"), F.col("mask").alias("ahead"))
        step = arcs.join(ahead, ["to", "to_bucket"], "left").groupBy("node", "bucket").agg(F.bit_or(F.col("gain").bitwiseOR(F.coalesce("ahead", F.lit(0).cast("bigint")))).alias("mask"))
        after = cut(waited(step))
        moved = after.join(now.withColumnRenamed("mask", "old"), ["node", "bucket"]).where("mask <> old")
        now = after
        if moved.isEmpty():
            break
    return now.where("mask <> 0")


def mirrored(events: DataFrame) -> DataFrame:
    """``events`` against time: what can be reached in them is what a journey may have passed before."""
    return events.select("event_id", F.col("dest").alias("origin"), F.col("origin").alias("dest"), (-F.col("arr")).alias("dep"), (-F.col("dep")).alias("arr"), "country", "bit")


def matrix_masks(events: DataFrame, edges: DataFrame, window: int) -> DataFrame:
    """u, v, mask, path: maximal country sets of the paths from event u to event v within ``window`` of u's departure.

    A set found at an earlier level is not expanded again; its path is the shortest, then the least.
    """
    hop = cut(with_legs(edges, events))
    start = events.where(F.col("arr") - F.col("dep") <= window).select(F.col("event_id").alias("u"), F.col("event_id").alias("v"), F.col("bit").alias("mask"), (F.col("dep") + window).alias("deadline"), F.array("event_id").alias("path"))
    frontier, log, key = cut(start), _Log(), ["u", "v", "mask"]
    while not frontier.isEmpty():
        log.add(frontier)
        step = frontier.join(hop, frontier["v"] == hop["src"]).where("n_arr <= deadline")
        step = step.select("u", F.col("dst").alias("v"), F.col("mask").bitwiseOR(F.col("n_bit")).alias("mask"), "deadline", F.concat("path", F.array("dst")).alias("path"))
        best = step.groupBy(*key).agg(F.min("path").alias("path"), F.max("deadline").alias("deadline"))
        frontier = cut(best.join(log.all().select(*key), key, "left_anti"))
    found = log.all() if log.parts else frontier
    return maximal_masks(found, ["u", "v"]).join(found.select(*key, "path"), key)


def budgeted_bound(remaining: Column, visited: Column, costs: Column) -> Column:
    """Countries that a budget still buys, cheapest first: costs is an array of struct(cost, bit), visited a mask."""
    fresh = F.array_sort(F.filter(costs, lambda c: visited.bitwiseAND(c.bit) == 0))
    start = F.struct(F.lit(0).cast("bigint").alias("spent"), F.lit(0).alias("n"))
    add = lambda acc, c: F.when(acc.spent + c.cost <= remaining, F.struct((acc.spent + c.cost).alias("spent"), (acc.n + 1).alias("n"))).otherwise(F.struct((acc.spent + c.cost).alias("spent"), acc.n.alias("n")))
    return F.aggregate(fresh, start, add, lambda acc: acc.n)


#: Weights of a rollout's step: into a country not seen, into another than the present one, within it; and the factor for a station seen.
ROLLOUT_WEIGHTS, TABU = (1e5, 1e3, 1.0), 1e-4


def _choices(now: DataFrame, hop: DataFrame) -> DataFrame:
    """The steps that each run can take, with their weights; runs that can take none keep a row without dst."""
    j = now.join(hop, (now["event"] == hop["src"]) & (hop["n_arr"] <= now["deadline"]), "left")
    tier = F.when(F.col("mask").bitwiseAND(F.col("n_bit")) == 0, ROLLOUT_WEIGHTS[0]).when(F.col("n_country") != F.col("country"), ROLLOUT_WEIGHTS[1]).otherwise(ROLLOUT_WEIGHTS[2])
    tabu = F.when(F.array_contains("stations", F.col("n_dest")), TABU).otherwise(1.0)
    return j.withColumn("weight", tier * tabu / F.col("takes"))


def _rollout_hops(events: DataFrame, edges: DataFrame) -> DataFrame:
    hop = with_legs(edges, events).join(events.select(F.col("event_id").alias("src"), F.col("arr").alias("s_arr")), "src")
    return cut(hop.withColumn("takes", F.greatest(F.col("n_arr") - F.col("s_arr"), F.lit(1))))


def _rollout_starts(events: DataFrame, window: int, clock: str, first_until: int) -> DataFrame:
    return events.where(F.col("arr") <= first_until).select(
        F.col("event_id").alias("start"), F.col("event_id").alias("event"), "country", F.col("bit").alias("mask"), (F.col(clock) + window).alias("deadline"), F.array("event_id").alias("path"), F.array("dest").alias("stations")
    )


def rollouts(events: DataFrame, edges: DataFrame, window: int, per_start: int = 4, seed: int = 7, clock: str = "arr", first_until: int = MINUTES_OF_DAY) -> DataFrame:
    """Greedy random walks: start, run, countries, path.

    A step's weight is that of its kind (``ROLLOUT_WEIGHTS``) over the minutes it takes, and by
    ``TABU`` less into a station seen before.  Each destination is offered by its earliest arrival, as
    edges are.  The draw is an exponential race on a hash of (start, run, event, level, seed),
    so runs repeat exactly.
    """
    hop = _rollout_hops(events, edges)
    now = cut(_rollout_starts(events, window, clock, first_until).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(per_start - 1)))))
    done = []
    for level in count():
        j = _choices(now, hop)
        done.append(j.where("dst is null").select("start", "run", F.bit_count("mask").alias("countries"), "path"))
        u = (F.pmod(F.xxhash64("start", "run", "dst", F.lit(level), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        step = F.struct(
            F.col("dst").alias("event"), F.col("n_country").alias("country"), F.col("mask").bitwiseOR(F.col("n_bit")).alias("mask"), "deadline", F.concat("path", F.array("dst")).alias("path"),
            F.concat("stations", F.array("n_dest")).alias("stations"),
        )
        pick = F.min_by(step, F.struct(-F.log(u) / F.col("weight"), "dst")).alias("p")
        now = cut(j.where("dst is not null").groupBy("start", "run").agg(pick).select("start", "run", "p.*"))
        if now.isEmpty():
            break
    return union_all(done)


def top_choices(events: DataFrame, edges: DataFrame, window: int, n: int = 3, clock: str = "arr", first_until: int = MINUTES_OF_DAY) -> DataFrame:
    """start, place, dst, weight: the ``n`` heaviest first steps of a rollout from each start."""
    choices = _choices(_rollout_starts(events, window, clock, first_until), _rollout_hops(events, edges)).where("dst is not null")
    w = Window.partitionBy("start").orderBy(F.desc("weight"), "dst")
    return choices.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("start", "place", "dst", "weight")
