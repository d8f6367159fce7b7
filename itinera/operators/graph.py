"""Spatial graph to event graph: joins that respect time, pruned to earliest arrivals.

Events are rows (event_id, origin, dest, dep, arr, country, bit); an edge leads from an
event to one that departs from where it ends, at once or over a transfer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itinera.session import cut, small

#: Least minutes between modes at a change, by the modes arrived and left with.
CHANGE_MINUTES = {("A", "A"): 20, ("A", "R"): 20, ("R", "A"): 25, ("R", "R"): 5}
#: Of the as-of join: minutes of a slot, rows from which slots are answered, homes that stations joined by walks are split into, numbers held at once.
SLOT, ROWS, SPLITS, CELLS = 1440, 1 << 16, 2, 1 << 18
WALK, ASK, OFFER = range(3)
_NEVER = (1 << 63) - 1


def _homes(transfers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """place, label: stations that walks join get the same label; v, homes: those of ``v`` and the stations from which a walk leads there."""
    both = transfers.select(F.col("u").alias("place"), F.col("v").alias("other")).union(transfers.select("v", "u"))
    label = cut(both.groupBy("place").agg(F.least("place", F.min("other")).cast("bigint").alias("label")))
    walked = transfers.select(F.col("u").alias("place"), "v").unionByName(label.select("place", F.col("place").alias("v")))
    return label, cut(walked.join(small(label), "place").select("v", _home("label", "place").alias("home")).groupBy("v").agg(F.sort_array(F.collect_set("home")).alias("homes")))


def _home(label: str, place: str) -> Column:
    return F.col(label).cast("bigint") * SPLITS + F.pmod(F.col(place), F.lit(SPLITS))


def earliest_successors(events: DataFrame, transfers: DataFrame | None = None, src: tuple[str, ...] = (), dst: tuple[str, ...] = ()) -> DataFrame:
    """src, dst: of the events that an event can reach, for every destination the one that arrives first.

    Ties go to the later departure, then the lesser origin and id.  ``src``, ``dst``: further
    columns of either event, returned as s_... and d_..., so that no join has to fetch them.  An
    as-of join: events meet as asks (by where they arrive) and as offers (by where they leave) in
    the home of stations that walks join, and are answered there from late to early, a slot
    of time after the other.  What is shuffled are events, not edges, and what a task
    holds is a slot and the best offer so far of each pair of stations.  Walks take no negative time.
    """
    kinds = dict(events.dtypes)
    held = list(dict.fromkeys(["event_id", "origin", "dest", "dep", "arr", *src, *dst]))

    def row(kind: int, home: Column, slot: Column, values: dict[str, Column]) -> Column:
        return F.struct(home.cast("bigint").alias("home"), F.lit(kind).alias("kind"), slot.cast("bigint").alias("slot"), *[values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in held])

    of = lambda *names: {c: F.col(c) for c in names}
    ask = lambda home: F.when(F.expr("event_id is not null and dest is not null and arr is not null"), row(ASK, home, F.floor(F.col("arr") / SLOT), of("event_id", "dest", "arr", *src)))
    offer = lambda home: F.when(F.expr("origin is not null and dest is not null and dep is not null and arr is not null"), row(OFFER, home, F.floor(F.col("dep") / SLOT), of(*held[:5], *dst)))
    if transfers is None:
        pairs, walks = events.select(F.array(ask(_home("dest", "dest")), offer(_home("origin", "origin"))).alias("r")), None
    else:
        least = cut(transfers.where("u is not null and v is not null").groupBy("u", "v").agg(F.min("minutes").cast("bigint").alias("minutes")))
        label, homes = _homes(least)
        placed = events.join(small(label.withColumnRenamed("place", "dest")), "dest", "left").withColumn("_label", F.coalesce("label", F.col("dest").cast("bigint")))
        placed = placed.join(small(homes.withColumnRenamed("v", "origin")), "origin", "left").withColumn("_homes", F.coalesce("homes", F.array(_home("origin", "origin"))))
        pairs = placed.select(F.concat(F.array(ask(_home("_label", "dest"))), F.transform("_homes", offer)).alias("r"))
        walks = least.join(small(label.withColumnRenamed("place", "u")), "u").select(row(WALK, _home("label", "u"), F.lit(None), {"origin": F.col("v"), "dest": F.col("u"), "dep": F.col("minutes")}).alias("r")).select("r.*")
    both = pairs.select(F.explode("r").alias("r")).where("r is not null").select("r.*")
    both = both if walks is None else both.unionByName(walks)
    spark = events.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = both.repartition(parts, "home").sortWithinPartitions("home", F.desc_nulls_first("slot"))
    out = [("src", "event_id"), *[(f"s_{c}", c) for c in src]], [("dst", "event_id"), *[(f"d_{c}", c) for c in dst]]
    schema = ", ".join(f"{name} {kinds[c]}" for name, c in [out[0][0], out[1][0], *out[0][1:], *out[1][1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, slots in _slots(batches):
            answers = _Home(home)
            for low, table in slots:
                for asked, offered in answers.of(table, low):
                    a = pa.table([asked[c] for _, c in out[0]], [n for n, _ in out[0]])
                    b = pa.table([offered[c] for _, c in out[1]], [n for n, _ in out[1]])
                    yield pa.RecordBatch.from_arrays([*_flat(a)[:1], *_flat(b)[:1], *_flat(a)[1:], *_flat(b)[1:]], names=[n for n, _ in [out[0][0], out[1][0], *out[0][1:], *out[1][1:]]])

    return sorted_.mapInArrow(run, schema)


def _flat(t: pa.Table) -> list[pa.Array]:
    return [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in t.columns]


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, pa.Table]]]]:
    """Each home with its tables from late to early: whole slots, as many as make ``ROWS`` rows, and from when they hold all offers."""

    def pieces() -> Iterator[tuple[int, int | None, pa.RecordBatch]]:
        for b in batches:
            if not b.num_rows:
                continue
            home, slot = b["home"].to_numpy(zero_copy_only=False), b["slot"].fill_null(_NEVER).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((home[1:] != home[:-1]) | (slot[1:] != slot[:-1])) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                yield int(home[i]), int(slot[i]), b.slice(i, j - i)

    def tables(of: Iterator[tuple[int, int, pa.RecordBatch]]) -> Iterator[tuple[int, pa.Table]]:
        some, last = [], None
        for _, slot, b in of:
            if slot != last and last not in (None, _NEVER) and sum(x.num_rows for x in some) >= ROWS:
                yield last * SLOT, pa.Table.from_batches(some)
                some = []
            some.append(b)
            last = slot
        yield last * SLOT, pa.Table.from_batches(some)

    for home, of in groupby(pieces(), key=lambda x: x[0]):
        yield home, tables(of)


class _Home:
    """The as-of join of one home: walks, and of what was seen so far the best offer per pair of stations and those that walks put before the slot."""

    def __init__(self, home: int) -> None:
        self.side = home % SPLITS
        self.walks: dict[int, list[tuple[int, int]]] = {}
        self.kept: pa.Table | None = None
        self.best: dict[int, np.ndarray] = {}  # by station: rows of kept, one a destination
        self.later: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by station: rows of kept and the time by which to leave the station

    def of(self, table: pa.Table, low: int) -> Iterator[tuple[pa.Table, pa.Table]]:
        """Asks and the offers that answer them, row by row.  ``low``: no offer of a later table departs at or after it."""
        kind = table["kind"].to_numpy()
        w = table.filter(pa.array(kind == WALK))
        for u, v, m in zip(w["dest"].to_pylist(), w["origin"].to_pylist(), w["dep"].to_pylist()):
            self.walks.setdefault(u, []).append((v, m))
        asks, new = table.filter(pa.array(kind == ASK)), table.filter(pa.array(kind == OFFER))
        held = 0 if self.kept is None else self.kept.num_rows
        legs = new if not held else pa.concat_tables([self.kept, new])
        num = {c: legs[c].to_numpy() for c in ("event_id", "origin", "dest", "dep", "arr")}
        order = np.lexsort((num["event_id"], num["origin"], -num["dep"], num["arr"]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by_origin = _groups(num["origin"][held:], held)
        by_dest = _groups(asks["dest"].to_numpy(), 0)
        ready = asks["arr"].to_numpy()
        none = np.empty(0, np.int64)
        for a in sorted({*self.walks, *by_dest, *(v for v in by_origin if v % SPLITS == self.side), *self.best, *self.later}):
            first = self.best.get(a, none)
            rows, times = ([x] for x in self.later[a]) if a in self.later else ([], [])
            for v, m in [(a, 0), *self.walks.get(a, [])]:
                if (r := by_origin.get(v)) is not None:
                    rows.append(r)
                    times.append(num["dep"][r] - m)
            row, t = (np.concatenate(rows), np.concatenate(times)) if rows else (none, none)
            self.later[a] = row[t < low], t[t < low]
            row, t = row[t >= low], t[t >= low]
            late = np.argsort(-t, kind="stable")
            row, t = row[late], t[late]
            places, at = np.unique(num["dest"][np.concatenate([first, row])], return_inverse=True)
            state = np.full(len(places), _NEVER, np.int64)
            state[at[: len(first)]] = rank[first]
            at = at[len(first) :]
            asked = by_dest.get(a, none)
            ahead = np.searchsorted(-t, -ready[asked], side="right")  # so many offers leave after an ask
            asked = asked[o := np.argsort(ahead, kind="stable")]
            ahead = ahead[o]
            wide = max(16, CELLS // max(1, len(places)))
            for i in range(0, len(row) + 1, wide):
                j = min(i + wide, len(row) + 1)  # the states after i to j - 1 offers
                grid = np.full((j - i, len(places)), _NEVER, np.int64)
                if i:
                    grid[np.arange(j - i), at[i - 1 : j - 1]] = rank[row[i - 1 : j - 1]]
                else:
                    grid[np.arange(1, j), at[: j - 1]] = rank[row[: j - 1]]
                np.minimum(grid[0], state, out=grid[0])
                np.minimum.accumulate(grid, axis=0, out=grid)
                state = grid[-1].copy()
                lo, hi = np.searchsorted(ahead, [i, j])
                for k in range(lo, hi, wide):
                    n = min(k + wide, hi)
                    found = grid[ahead[k:n] - i]
                    there = found != _NEVER
                    if (answers := there.sum(axis=1)).any():
                        yield asks.take(np.repeat(asked[k:n], answers)), legs.take(order[found[there]])
            self.best[a] = order[state[state != _NEVER]]
        keep = np.unique(np.concatenate([none, *self.best.values(), *(r for r, _ in self.later.values())]))
        self.kept = legs.take(keep).combine_chunks()
        self.best = {a: np.searchsorted(keep, r) for a, r in self.best.items()}
        self.later = {a: (np.searchsorted(keep, r), t) for a, (r, t) in self.later.items() if len(r)}


def _groups(values: np.ndarray, start: int) -> dict[int, np.ndarray]:
    """The positions of each value, counted from ``start``."""
    order = np.argsort(values, kind="stable")
    found, first = np.unique(values[order], return_index=True)
    return {int(v): p + start for v, p in zip(found, np.split(order, first[1:]))}


def change_minutes(from_mode: Column, to_mode: Column, same_station: Column) -> Column:
    """Least minutes of a change; none between trains of one station."""
    out = F.lit(0)
    for (a, b), m in CHANGE_MINUTES.items():
        out = F.when((from_mode == a) & (to_mode == b), m).otherwise(out)
    return F.when((from_mode == "R") & (to_mode == "R") & same_station, 0).otherwise(out)


def buffered_successors(events: DataFrame, transfers: DataFrame | None, modality: Column) -> DataFrame:
    """The edges that stay at a station and leave its least minutes for the change; ``modality`` is an expression of ``station``."""
    both = earliest_successors(events, transfers, ("dest", "arr"), ("origin", "dep")).where("s_dest = d_origin").withColumn("station", F.col("s_dest")).withColumn("m", modality)
    return both.where(F.col("d_dep") >= F.col("s_arr") + change_minutes(F.col("m"), F.col("m"), F.lit(True))).select("src", "dst")


def degrees(events: DataFrame, edges: DataFrame) -> DataFrame:
    """event_id, out_degree, in_degree of every event; the edges are read once, for both ends."""
    end = lambda c, out: F.struct(F.col(c).alias("event_id"), F.lit(out).cast("bigint").alias("out"), F.lit(1 - out).cast("bigint").alias("into"), F.lit(False).alias("known"))
    ends = edges.select(F.inline(F.array(end("src", 1), end("dst", 0))))
    none = events.select("event_id", F.lit(0).cast("bigint").alias("out"), F.lit(0).cast("bigint").alias("into"), F.lit(True).alias("known"))
    counted = ends.unionByName(none).groupBy("event_id").agg(F.sum("out").alias("out_degree"), F.sum("into").alias("in_degree"), F.max("known").alias("known"))
    return counted.where("known").drop("known")


def leave_minutes(events: DataFrame, transfers: DataFrame | None = None, default: int = 60) -> DataFrame:
    """country, mtt: least minutes from arriving in a country to arriving in another by the next event; ``default`` without any."""
    edges = earliest_successors(events, transfers, ("country", "arr"), ("country", "arr"))
    gaps = edges.where("s_country <> d_country and d_arr > s_arr").groupBy(F.col("s_country").alias("country")).agg(F.min(F.col("d_arr") - F.col("s_arr")).alias("mtt"))
    return events.select("country").distinct().join(gaps, "country", "left").select("country", F.coalesce("mtt", F.lit(default)).cast("bigint").alias("mtt"))


def edge_faults(events: DataFrame, transfers: DataFrame, edges: DataFrame, stations: int) -> DataFrame:
    """infeasible, dangling, several of edges (src, dst and s_dest, s_arr, d_origin, d_dest, d_dep): numbers of edges that leave too early or
    over no walk, of edges to no event, and of pairs of an event and a destination with more than one edge.

    The edges are summed up by event, the destinations of each as bits of a set, so that no edge is
    shuffled; those of the events that have more edges than destinations are counted one by one.
    ``stations``: destinations are numbers below it.
    """
    walk = small(cut(transfers.select(F.col("u").alias("s_dest"), F.col("v").alias("d_origin"), "minutes")))
    need = F.when(F.col("s_dest") == F.col("d_origin"), 0).otherwise(F.col("minutes"))
    bad = (F.col("d_dep") < F.col("s_arr") + need) | need.isNull()
    words = [f"w{i}" for i in range(-(-stations // 63))]
    bit = lambda i: F.when(F.floor(F.col("d_dest") / 63) == i, F.expr("shiftleft(1L, cast(d_dest % 63 as int))")).otherwise(F.lit(0).cast("bigint"))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def row(c: str, n: Column, bad: Column, into: Column, known: Column, bits: list[Column]) -> Column:
        return F.struct(F.col(c).alias("id"), n.alias("n"), bad.alias("bad"), into.alias("into"), known.alias("known"), *[b.alias(w) for b, w in zip(bits, words)])

    none = [zero] * len(words)
    ends = edges.join(walk, ["s_dest", "d_origin"], "left").select(F.inline(F.array(
        row("src", one, bad.cast("bigint"), zero, zero, [bit(i) for i in range(len(words))]), row("dst", zero, zero, one, zero, none),
    )))
    all_ = ends.unionByName(events.select(F.inline(F.array(row("event_id", zero, zero, zero, one, none)))))
    by = cut(all_.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "into")], F.max("known").alias("known"), *[F.bit_or(w).alias(w) for w in words]))
    different = reduce(lambda a, b: a + b, [F.bit_count(w) for w in words])
    suspects = cut(by.where(F.col("n") > different).select(F.col("id").alias("src")))
    totals = by.agg(F.coalesce(F.sum("bad"), zero).alias("infeasible"), F.coalesce(F.sum(F.when(F.col("known") == 0, F.col("into"))), zero).alias("dangling"))
    if suspects.isEmpty():
        return totals.withColumn("several", zero)
    several = edges.join(small(suspects), "src", "left_semi").groupBy("src", "d_dest").count().where("count > 1").agg(F.count("*").alias("several"))
    return totals.join(F.broadcast(several))


def enter_minutes(events: DataFrame, station_country: Column, transfers: DataFrame | None = None) -> DataFrame:
    """country, mtt: least minutes of a leg that enters a country; ``station_country`` is an expression of ``origin``.

    ``transfers``: u_country, v_country, minutes of walks, which enter countries as well.
    """
    legs = events.where(station_country != F.col("country")).select("country", (F.col("arr") - F.col("dep")).alias("m"))
    if transfers is not None:
        legs = legs.unionByName(transfers.where("u_country <> v_country").select(F.col("v_country").alias("country"), F.col("minutes").cast("bigint").alias("m")))
    return legs.groupBy("country").agg(F.min("m").cast("bigint").alias("mtt"))


def departures(events: DataFrame, origin: int, dest: int) -> DataFrame:
    """The events between two stations in the order of their departures."""
    return events.where((F.col("origin") == origin) & (F.col("dest") == dest)).orderBy("dep", "arr", "event_id")


def pair_presence(expected: DataFrame, edges: DataFrame) -> DataFrame:
    """``expected`` (u, v, dep, arr) with present: whether the edge's ``time_pairs`` hold the pair."""
    held = edges.select("u", "v", F.inline("time_pairs")).select("u", "v", "dep", "arr", F.lit(True).alias("_held"))
    return expected.join(held, ["u", "v", "dep", "arr"], "left").withColumn("present", F.coalesce("_held", F.lit(False))).drop("_held")


def train_edges(stops: DataFrame, days: int = 2) -> DataFrame:
    """u, v, time_pairs: scheduled edges between consecutive stops (absolute minutes), each with its sorted departures and arrivals.

    Every pair of different stations with both times counts, also one left and reached in the
    same minute.  Trains run daily: each pair is repeated a day later for every further one of ``days``.
    """
    w = Window.partitionBy("route").orderBy("pos")
    hops = stops.select(F.col("station").alias("u"), F.lead("station").over(w).alias("v"), F.col("minute").alias("dep"), F.lead("minute").over(w).alias("arr"))
    runs = hops.where("u <> v and dep is not null and arr is not null").withColumn("later", F.explode(F.array(*[F.lit(1440 * i).cast("bigint") for i in range(days)])))
    return runs.groupBy("u", "v").agg(F.sort_array(F.collect_set(F.struct((F.col("dep") + F.col("later")).alias("dep"), (F.col("arr") + F.col("later")).alias("arr")))).alias("time_pairs"))


def induced(edges: DataFrame, keep: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Edges with both ends among ``keep`` (node)."""
    return edges.join(keep.select(F.col("node").alias(u)), u, "left_semi").join(keep.select(F.col("node").alias(v)), v, "left_semi")
