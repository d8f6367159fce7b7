"""Core operators on small fixtures: edge cases, golden values and properties."""

import gzip
import json
import math
import random
import sqlite3
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from itinera.functions import transit as fn
from itinera.operators import graph, prep, routes, search, shred, spatial, sums
from itinera.operators.orphans import ForeignKey, find_orphans
from itinera.operators.timestamps import estimate_zones, histories, read_times, to_instant
from itinera.sources import readers, sinks
from itinera.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Shredding


def test_adjacency_keeps_parent_child_links(spark):
    doc = {"a": [1, {"b": None}, []], "c/d": "x", "e": True}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps(json.dumps(doc))), (3, "{"), (4, None), (5, ""), (6, "[1] 2")], "id int, t string").withColumn("node", F.lit("clash"))
    rows = shred.shred(df, ["id"], ["t"]).collect()
    assert {r["id"] for r in rows} == {1, 2} and sum(r["id"] == 1 for r in rows) == sum(r["id"] == 2 for r in rows) == 8
    by = {r["node"]: r for r in rows if r["id"] == 1}

    def path(r):
        return "" if r["parent"] is None else f"{path(by[r['parent']])}/{r['label'] or '#'}"

    assert {(path(r), r["ordinal"], r["depth"], r["kind"], r["scalar"]) for r in by.values()} == {
        ("", 1, 0, "object", None), ("/a", 1, 1, "array", None), ("/a/#", 1, 2, "number", "1"), ("/a/#", 2, 2, "object", None), ("/a/#/b", 1, 3, "null", None), ("/a/#", 3, 2, "array", None),
        ("/c/d", 2, 1, "string", "x"), ("/e", 3, 1, "boolean", "true"),
    }


def test_entities_of_nested_members(spark):
    docs = [{"legs": [{"stops": [{"n": "a", "t": {"x": 1}}, {"n": None}]}, {"stops": [{"m": "b", "n": "c"}, 5]}]}, {"legs": {"stops": []}}, {}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "k int, j string")
    got = shred.entity_table(df, ["k"], ["j"], [("legs", None, "stops", None)], {"n": [("n",), ("m",)], "x": [("t", "x"), ("t", "y")]})
    assert sorted((r["k"], r["parent"], r["entity"], r["n"], r["x"]) for r in got.collect()) == [(0, 3, 1, "a", "1"), (0, 3, 2, None, None), (0, 11, 1, "c", None), (0, 11, 2, None, None)]
    assert shred.entity_table(df, ["k"], ["j"], [("legs", None, "stops", None)], {"n": [("n",)]}, every_entity=False).count() == 2


def test_stops_of_uneven_lists(spark):
    stop_list = [[["A", "DE"], [None, "1"]], None, [], {"name": "B", "arr": "2"}, [{"station": "C", "country": "FR"}, {"dep": "3"}], [["", "IT"]], [[None, "X"]], "junk", 7, ["D", ["4", "5"]]]
    texts = [json.dumps(stop_list), json.dumps({"x": 1, "legs": stop_list}), json.dumps(json.dumps(stop_list)), json.dumps({"legs": "no"}), "[[", json.dumps([])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, l string").withColumn("node", F.lit(1)).withColumn("entity", F.lit("x"))
    got = {(r["id"], r["stop_no"]): (r["station"], r["country"], r["arr"], r["dep"]) for r in shred.stop_rows(df, "id", ["l"]).collect()}
    for i in range(3):
        assert [got[i, n] for n in range(1, 11)] == [("A", "DE", None, "1"), (None,) * 4, (None,) * 4, ("B", None, "2", None), ("C", "FR", None, "3"), ("", "IT", None, None), (None, "X", None, None), (None,) * 4, (None,) * 4, ("D", None, "4", "5")]
    assert len(got) == 30
    assert shred.stop_rows(df.limit(0), "id", ["l"]).count() == 0


def test_deep_and_long_texts(spark):
    deep, digits = "[" * 20_000 + "]" * 20_000, "7" * 6000
    rows = [(1, deep), (2, json.dumps(["s" * 200_000])), (3, '["\\ud800"]'), (4, f'{{"a": {digits}}}'), (5, "[" * 20_000 + "]" * 19_999), (6, deep + "x"), (7, json.dumps(deep))]
    df = spark.createDataFrame(rows, "id int, l string")
    nodes = shred.shred(df, ["id"], ["l"])
    counts = {r["id"]: (r["n"], r["deepest"]) for r in nodes.groupBy("id").agg(F.count("*").alias("n"), F.max("depth").alias("deepest")).collect()}
    assert counts == {1: (20_000, 19_999), 2: (2, 1), 3: (2, 1), 4: (2, 1), 7: (20_000, 19_999)}
    assert nodes.where("id = 4 and depth = 1").first()["scalar"] == digits


def test_deep_reader_agrees_with_the_fast_one():
    rng = random.Random(1)

    def some(depth=0):
        r = rng.random()
        if depth > 4 or r < 0.3:
            return rng.choice([1, -2.5, 'x"y\\', None, True, "", 1e20, "ü"])
        return [some(depth + 1) for _ in range(rng.randrange(4))] if r < 0.65 else {rng.choice("abcd"): some(depth + 1) for _ in range(rng.randrange(4))}

    def plain(v):
        return json.loads(v) if isinstance(v, shred.Digits) else [plain(x) for x in v] if isinstance(v, list) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v

    def tried(f, text):
        try:
            return True, plain(f(text))
        except ValueError:
            return False, None

    for _ in range(3000):
        t = json.dumps(some(), indent=rng.choice([None, 1]))
        if rng.random() < 0.5:
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["", ",", "]", "}", '"', "1", "x", " ", "[", ":"]) + t[k + 1 :]
        assert tried(json.loads, t) == tried(shred.read_deep, t), t


# Orphans


def test_direct_and_inherited_orphans(spark):
    zones = spark.createDataFrame([("DE",)], "iso string")
    ports = spark.createDataFrame([(1, "AAA", "DE"), (2, "bbb ", "XX"), (3, "CCC", "XX"), (4, "CCC", "DE"), (5, None, None)], "id int, code string, iso string")
    trips = spark.createDataFrame([(10, "a.a.a", "BBB"), (11, "CCC", "ZZZ"), (12, None, " "), (13, "--", "AAA"), (14, "BBB", "AAA")], "id int, a string, b string").withColumn("code", F.lit("clash"))
    legs = spark.createDataFrame([(100, "10"), (101, "12"), (102, "999")], "id int, trip string")
    keys = [ForeignKey("ports", "iso", "zones", "iso"), ForeignKey("trips", "a", "ports", "code"), ForeignKey("trips", "b", "ports", "code"), ForeignKey("legs", "trip", "trips", "id")]
    tables = {"zones": zones, "ports": ports, "trips": trips, "legs": legs}
    got = {(r["table_name"], r["id"], r["field"], r["kind"], r["round"]) for r in find_orphans(tables, {t: "id" for t in tables}, keys).collect()}
    assert got == {
        ("ports", 2, "iso", "direct", 0), ("ports", 3, "iso", "direct", 0), ("trips", 11, "b", "direct", 0), ("trips", 13, "a", "direct", 0), ("legs", 102, "trip", "direct", 0),
        ("trips", 10, "b", "inherited", 1), ("trips", 14, "a", "inherited", 1), ("legs", 100, "trip", "inherited", 2),
    }
    empty = {**tables, "ports": ports.limit(0)}
    assert find_orphans(empty, {t: "id" for t in tables}, keys[1:3]).count() == 8
    assert find_orphans({**tables, "trips": trips.limit(0)}, {t: "id" for t in tables}, keys[1:3]).count() == 0


def test_a_chain_of_orphans_runs_to_its_end(spark):
    """Every row refers to the one before it in its own table; the first refers to nothing that exists."""
    rows = [(i, f"k{i}", f"k{i - 1}") for i in range(1, 71)] + [(500, "r", "r"), (501, "s", "r")]
    df = spark.createDataFrame(rows, "id int, code string, before string")
    got = {r["id"]: (r["kind"], r["round"]) for r in find_orphans({"t": df}, {"t": "id"}, [ForeignKey("t", "before", "t", "code")]).collect()}
    assert got == {i: ("direct", 0) if i == 1 else ("inherited", i - 1) for i in range(1, 71)}


def test_a_parent_of_several_rows_dies_with_the_last(spark):
    a = spark.createDataFrame([(1, "A", "none"), (2, "B", "A"), (3, "C", "B"), (4, "C", "none"), (5, "D", "C"), (6, "D", "E"), (7, "E", None)], "id int, code string, above string")
    leaf = spark.createDataFrame([(1, "C"), (2, "D"), (3, "E")], "id int, ref string")
    keys = [ForeignKey("a", "above", "a", "code"), ForeignKey("leaf", "ref", "a", "code")]
    got = {(r["table_name"], r["id"], r["kind"], r["round"]) for r in find_orphans({"a": a, "leaf": leaf}, {"a": "id", "leaf": "id"}, keys).collect()}
    assert got == {("a", 1, "direct", 0), ("a", 4, "direct", 0), ("a", 2, "inherited", 1), ("a", 3, "inherited", 2), ("a", 5, "inherited", 3), ("leaf", 1, "inherited", 3)}


# Points


def pairs(spark, pts, km, **how):
    df = spark.createDataFrame([(i, a, o) for i, (a, o) in enumerate(pts)], "id bigint, la double, lo double").withColumn("lat", F.lit("clash")).withColumn("leaf", F.lit(0))
    return sorted(tuple(r) for r in spatial.near_pairs(df, "id", "la", "lo", km, **how).collect())


def brute(pts, km):
    ok = lambda p: None not in p and not any(math.isnan(x) for x in p) and abs(p[0]) <= 90 and abs(p[1]) <= 180 and p != (0.0, 0.0)

    def d(p, q):
        a, b = np.radians(p), np.radians(q)
        h = math.sin((b[0] - a[0]) / 2) ** 2 + math.cos(a[0]) * math.cos(b[0]) * math.sin((b[1] - a[1]) / 2) ** 2
        return 2 * spatial.EARTH_KM * math.asin(min(1, math.sqrt(h)))

    return sorted((i, j) for j in range(len(pts)) for i in range(j) if ok(pts[i]) and ok(pts[j]) and d(pts[i], pts[j]) <= km)


@pytest.mark.parametrize("km", [5.0, 300.0])
def test_pairs_across_poles_and_the_date_line(spark, km):
    rng = random.Random(3)
    pts = [(90.0, 10.0), (89.99, -170.0), (-90.0, 0.0), (-89.98, 90.0), (10.0, 180.0), (10.0, -180.0), (10.01, 179.99), (0.0, 0.0), (0.0, 0.01), (None, 1.0), (float("nan"), 1.0), (91.0, 0.0), (5.0, 181.0)]
    pts += [(rng.gauss(50, 0.3), rng.gauss(9, 0.3)) for _ in range(150)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)]
    assert pairs(spark, pts, km, leaf_rows=20, sample_rows=200) == brute(pts, km)


def test_coincident_points_are_split_into_blocks(spark):
    pts = [(50.0, 9.0)] * 60 + [(50.0, 9.02)] * 10 + [(51.0, 9.0)]
    assert pairs(spark, pts, 5.0, leaf_rows=5, block_rows=20) == brute(pts, 5.0)
    assert pairs(spark, [], 5.0) == [] and pairs(spark, [(1.0, 1.0)], 5.0) == []


def test_quadtree_leaves_tile_the_globe():
    rng = np.random.default_rng(0)
    lat, lon = rng.uniform(-90, 90, 5000), rng.uniform(-180, 180, 5000)
    tree = spatial.Quadtree(spatial.morton(lat, lon), 50, 1.0)
    s, n, w, e = tree.boxes()
    assert abs(((n - s) * (e - w)).sum() - 360 * 180) < 1e-6
    home = tree.home(lat, lon)
    assert ((s[home] <= lat) & (lat <= n[home]) & (w[home] <= lon) & (lon <= e[home])).all()


def test_leaves_follow_the_counts(spark):
    """A few sampled points can't shape the dense part; counts split it to the least width."""
    rng = np.random.default_rng(2)
    lat, lon = np.concatenate([rng.uniform(-80, 80, 500), rng.normal(48, 0.5, 4000)]), np.concatenate([rng.uniform(-180, 180, 500), rng.normal(9, 0.5, 4000)])
    df = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(zip(lat, lon))], "id bigint, lat double, lon double")
    tree, counted = spatial._shaped(df, 4500, 0.5, 1000, 100)
    held = np.bincount(tree.home(lat, lon), minlength=len(tree.starts))
    assert ((held <= 200) | (tree.levels == tree.deepest)).all() and len(tree.starts) < 600
    assert all(n >= held[leaf] for leaf, n in counted.items()) and set(np.flatnonzero(held > 200)) <= set(counted)
    s, n, w, e = tree.boxes()
    assert abs(((n - s) * (e - w)).sum() - 360 * 180) < 1e-6
    rough = spatial.Quadtree(spatial.morton(lat[::900], lon[::900]), 4, 2.0)
    assert len(rough.starts) < 10 < len(tree.starts)


# Times


@pytest.mark.parametrize(
    ("text", "date", "zone", "iso"),
    [
        ("2026-01-22t01:30:00.000", None, "Europe/Berlin", "2026-01-22T00:30:00"), ("20260122T013000", None, "Europe/London", "2026-01-22T01:30:00"), ("22.01.2026 01:30", None, "Europe/Athens", "2026-01-21T23:30:00"),
        ("01/02/2026 00:05", None, "UTC", "2026-02-01T00:05:00"), ("Mar 3, 2026 12:05 AM", None, "UTC", "2026-03-03T00:05:00"), ("2026-03-03 12:05 PM", None, "UTC", "2026-03-03T12:05:00"), ("2026-07-01 10:00:00 CEST", None, None, "2026-07-01T08:00:00"),
        ("2026-07-01T10:00:00+02:00[Europe/Berlin]", None, None, "2026-07-01T08:00:00"), ("2026-07-01 10:00:00.123456 -0330", None, None, "2026-07-01T13:30:00.123"), ("1774220400", None, None, "2026-03-22T23:00:00"), ("1774220400999", None, None, "2026-03-22T23:00:00.999"),
        ("2026-03-29T02:30:00", None, "Europe/Berlin", "2026-03-29T01:30:00"), ("2026-10-25T02:30:00", None, "Europe/Berlin", "2026-10-25T00:30:00"), ("0905", "29.03.2026", "Europe/Paris", "2026-03-29T07:05:00"), ("9h05", "2026-03-29", "UTC", "2026-03-29T09:05:00"), ("9:05 PM", "2026-03-29", "UTC", "2026-03-29T21:05:00"),
        ("29 Feb 2024 10:00", None, "UTC", "2024-02-29T10:00:00"), (" 2026-01-01 00:00\t", None, "UTC", "2026-01-01T00:00:00"), ("0905", None, "UTC", None), ("2026-02-30 10:00", None, "UTC", None), ("2026-13-05 08:00", None, "UTC", None), ("0000-00-00t00:00:00.000", None, "UTC", None), ("2026-01-01", None, "UTC", None),
        ("10:45", None, "UTC", None), ("2026-01-01 24:00", None, "UTC", None), ("2026-01-01 13:00 PM", None, "UTC", None), ("2026-01-01 10:00 XYZ", None, "UTC", None), ("n/a", None, "UTC", None), ("", None, "UTC", None), (None, None, "UTC", None), ("ca. 9", "2026-01-01", "UTC", None), ("2026-01-01 10:00", None, None, None), ("x" * 50_000, None, "UTC", None),
    ],
)
def test_instants(spark, text, date, zone, iso):
    from datetime import datetime, timezone

    df = spark.createDataFrame([(text, date, zone, 1)], "t string, d string, z string, wall int")
    r = read_times(df, "t", "d" if date else None).select(to_instant(F.col("wall_ms"), F.col("offset_min"), F.col("z")).alias("x")).first()["x"]
    assert r == (None if iso is None else round(datetime.fromisoformat(iso).replace(tzinfo=timezone.utc).timestamp() * 1000))


def test_times_beside_clashing_columns(spark):
    df = spark.createDataFrame([("2026-01-01 10:00 CET", None, 5, "x"), (None, "2026-01-01", 6, "y")], "t string, d string, wall_ms int, _rt_f string").withColumn("offset_min", F.lit("z"))
    rows = read_times(df, "t", "d").orderBy(F.col("t").asc_nulls_last()).select("wall_ms", "offset_min").collect()
    assert [tuple(r) for r in rows] == [(1767261600000, 60), (None, None)]
    assert read_times(df.limit(0), "t").count() == 0


def test_zone_estimate_takes_the_fewest_violations(spark):
    from datetime import datetime
    from zoneinfo import ZoneInfo

    rows = []
    for group, zone in (("a", "Europe/Berlin"), ("b", "Europe/Istanbul")):
        for m in range(1, 13):
            local = datetime(2026, m, 10, 12)
            utc = int(local.replace(tzinfo=ZoneInfo(zone)).timestamp() * 1000)
            rows.append((group, int((local - datetime(1970, 1, 1)).total_seconds() * 1000), utc - 60_000, utc + 60_000))
    rows.append(("a", rows[0][1], 0, 1))
    df = spark.createDataFrame(rows, "group string, local_ms bigint, lo_ms bigint, hi_ms bigint")
    tried = ["Europe/Berlin", "Europe/Paris", "Europe/Istanbul", "UTC"]
    read = lambda x: {r["group"]: (r["zone"], r["violations"], r["declared_violations"]) for r in x.collect()}
    assert read(estimate_zones(df, tried)) == {"a": ("Europe/Berlin", 1, None), "b": ("Europe/Istanbul", 0, None)}
    # The declared zone breaks ties; it doesn't outweigh evidence.
    declared = spark.createDataFrame([("a", "Europe/Paris"), ("b", "Europe/Berlin"), ("c", "UTC")], "group string, zone string")
    assert read(estimate_zones(df, tried, declared)) == {"a": ("Europe/Paris", 1, 1), "b": ("Europe/Istanbul", 0, 12)}
    assert estimate_zones(df.limit(0), ["UTC"]).count() == 0 and estimate_zones(df, []).count() == 0


def test_histories_of_any_years(spark):
    """Lisbon kept Central European Time in the nineties; the years between take no part."""
    from datetime import datetime

    hours = lambda *years: spark.createDataFrame([((datetime(y, m, 1) - datetime(1970, 1, 1)).days * 24,) for y in years for m in (1, 7)], "hour bigint")
    same = lambda *years: histories(hours(*years), ["Europe/Lisbon", "Europe/Berlin", "Europe/London"])
    assert same(1995)["Europe/Lisbon"] == "Europe/Berlin" and same(2020)["Europe/London"] == "Europe/Lisbon"
    assert len(set(same(1995, 2090).values())) == 3


# Scalars: golden values


@pytest.mark.parametrize(
    ("label", "code", "name", "country"),
    [("CDG (France)", "CDG", "CDG", "France"), ("München Hbf (Germany)", "Hbf", "München Hbf", "Germany"), ("Flughafen BER (Germany)", "BER", "Flughafen BER", "Germany"), ("Frankfurt (Main) Hbf (Germany)", None, "Frankfurt (Main) Hbf", "Germany"), ("Bad Schandau (Germany)", "Bad", "Bad Schandau", "Germany")],
)
def test_labels(spark, label, code, name, country):
    assert one(spark, fn.station_name(F.lit(label))) == name and one(spark, fn.label_country(F.lit(label))) == country
    if code and code != "Hbf":
        assert one(spark, fn.station_code(F.lit(name))) == code


@pytest.mark.parametrize(("margin", "score"), [(30, 77.687), (0, 0), (-5, -5000), (5, 22.120), (10, 39.347)])
def test_transfer_scores(spark, margin, score):
    assert abs(one(spark, fn.transfer_score(F.lit(margin))) - score) < 1e-3


@pytest.mark.parametrize(("clocks", "want"), [([1400, 10, 20], [1400, 1450, 1460]), ([5, 5], [5, 5]), ([1400, 10, 5], [1400, 1450, 2885]), ([], [])])
def test_rollover(spark, clocks, want):
    df = spark.createDataFrame([(clocks,)], "c array<bigint>")
    assert df.select(fn.rollover(F.col("c")).alias("x")).first()["x"] == want


def test_clock_of_negative_minutes(spark):
    assert one(spark, fn.clock_of(F.lit(-30))) == "23:30" and one(spark, fn.day_clock_of(F.lit(1500))) == "Day 2, 01:00"
    assert one(spark, fn.minutes_of(F.lit("07:05"))) == 425 and one(spark, fn.minutes_of(F.lit("25:00"))) is None
    assert one(spark, fn.decimal_comma(F.lit("48,5"))) == 48.5 and one(spark, fn.decimal_comma(F.lit("x"))) is None


# Graph and search


def events(spark, rows):
    return spark.createDataFrame([(i, o, d, a, b, d % 25, 1 << (d % 25)) for i, (o, d, a, b) in enumerate(rows, 1)], "event_id bigint, origin int, dest int, dep bigint, arr bigint, country int, bit bigint")


def test_earliest_arrival_golden(spark):
    ev = events(spark, [(1, 2, 0, 60), (2, 3, 60, 120), (2, 3, 70, 110), (2, 4, 50, 100), (5, 3, 90, 100)])
    edges = lambda m: {(r["src"], r["dst"]) for r in graph.earliest_successors(ev, spark.createDataFrame([(2, 5, m), (2, 5, 99)], "u int, v int, minutes int")).collect() if r["src"] == 1}
    assert edges(30) == {(1, 5)} and edges(31) == {(1, 3)}
    assert {(r["src"], r["dst"]) for r in graph.earliest_successors(ev).collect()} == {(1, 3)}


def test_earliest_arrivals_against_a_nested_loop(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(200):
        o, t = rng.randrange(8), rng.randrange(600)
        rows.append((o, (o + rng.randrange(1, 8)) % 8, t, t + rng.randrange(1, 90)))
    tr = [(u, v, rng.randrange(1, 60)) for u in range(8) for v in range(8) if u != v and rng.random() < 0.3]
    want = {}
    for i, (_, d, _, arr) in enumerate(rows, 1):
        ready = {d: arr} | {v: arr + m for u, v, m in tr if u == d}
        for j, (o, t, dep, a) in enumerate(rows, 1):
            if o in ready and dep >= ready[o]:
                want[i, t] = min(want.get((i, t), (1e9,)), (a, -dep, o, j))
    got = {(r["src"], r["dst"]) for r in graph.earliest_successors(events(spark, rows), spark.createDataFrame(tr, "u int, v int, minutes int")).collect()}
    assert got == {(i, w[3]) for (i, _), w in want.items()}


def test_edges_are_answered_slot_by_slot(monkeypatch):
    """Tables of a slot each and grids of a few cells, against a nested loop; walks lead back over midnight."""
    for name, value in (("ROWS", 1), ("SPLITS", 1), ("CELLS", 1)):
        monkeypatch.setattr(graph, name, value)
    rng = random.Random(8)
    rows = []
    for i in range(1, 401):
        dep = rng.randrange(6 * 1440)
        rows.append((i, *rng.sample(range(7), 2), dep, dep + rng.randrange(1, 300)))
    walks = {(u, v): rng.randrange(300) for u in range(4) for v in range(4) if u != v}
    sent = [{"home": 0, "kind": graph.WALK, "slot": None, "event_id": None, "origin": v, "dest": u, "dep": m, "arr": None} for (u, v), m in walks.items()]
    for i, o, d, dep, arr in rows:
        sent.append({"home": 0, "kind": graph.ASK, "slot": arr // 1440, "event_id": i, "origin": None, "dest": d, "dep": None, "arr": arr})
        sent.append({"home": 0, "kind": graph.OFFER, "slot": dep // 1440, "event_id": i, "origin": o, "dest": d, "dep": dep, "arr": arr})
    sent.sort(key=lambda r: (r["slot"] is not None, -(r["slot"] or 0)))
    batches = [pa.RecordBatch.from_pylist(sent[i : i + 150], schema=pa.schema([(c, pa.int64()) for c in sent[0]])) for i in range(0, len(sent), 150)]
    got, tables = [], 0
    for home, slots in graph._slots(iter(batches)):
        answers = graph._Home(home)
        for low, table in slots:
            tables += 1
            for a, b in answers.of(table, low):
                got += zip(a["event_id"].to_pylist(), b["event_id"].to_pylist())
    want = {}
    for i, _, d, _, arr in rows:
        for j, o, t, dep, a in rows:
            m = 0 if o == d else walks.get((d, o))
            if m is not None and dep >= arr + m:
                want[i, t] = min(want.get((i, t), (1e9,)), (a, -dep, o, j))
    assert tables > 5 and sorted(got) == sorted((i, w[3]) for (i, _), w in want.items())


def _after(df, what):
    """The plan's operators above ``what``, which stand before it in the text."""
    text = df._jdf.queryExecution().executedPlan().toString()
    assert what in text
    return text[: text.index(what)]


def test_edges_are_found_without_shuffling_them(spark):
    ev = events(spark, [(1, 2, 0, 60), (2, 3, 60, 120), (5, 3, 90, 100)])
    tr = spark.createDataFrame([(2, 5, 20), (5, 2, 20)], "u int, v int, minutes int")
    assert "Exchange" not in _after(graph.earliest_successors(ev, tr, ("country",), ("dep",)), "MapInArrow")
    got = graph.earliest_successors(ev, tr, ("country",), ("dep",)).collect()
    assert [tuple(r) for r in got] == [(1, 3, 2, 90)] and got[0].asDict().keys() == {"src", "dst", "s_country", "d_dep"}


def test_queries_sum_up_edges_where_they_are_found(spark):
    from itinera.plans import graph_queries as q

    d = "/root/testdata/sf0.001"
    above = {f.__name__: _after(f(spark, d), "MapInArrow") for f in (q.aon_fan_out, q.mtt_leave, q.buffered_successors, q.degree_stats)}
    joins = {name: text.count("Join") for name, text in above.items()}
    assert joins == {"aon_fan_out": 1, "mtt_leave": 1, "buffered_successors": 0, "degree_stats": 0}, above
    assert "Exchange" not in above["buffered_successors"]


def test_edge_faults_are_counted(spark):
    ev = events(spark, [(1, 2, 0, 60), (2, 3, 60, 120), (2, 3, 70, 110), (5, 3, 80, 100)])
    tr = spark.createDataFrame([(2, 5, 20)], "u int, v int, minutes int")
    rows = [(1, 2, 2, 60, 2, 3, 60), (1, 3, 2, 60, 2, 3, 59), (1, 4, 2, 60, 5, 3, 79), (2, 9, 3, 120, 5, 70, 130), (2, 1, 3, 120, 3, 64, 130)]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint, s_dest int, s_arr bigint, d_origin int, d_dest int, d_dep bigint")
    assert graph.edge_faults(ev, tr, edges, 100).first().asDict() == {"infeasible": 3, "dangling": 1, "several": 1}
    assert graph.edge_faults(ev, tr, edges.where("src = 2"), 100).first().asDict() == {"infeasible": 1, "dangling": 1, "several": 0}
    assert graph.edge_faults(ev, tr, edges.limit(0), 100).first().asDict() == {"infeasible": 0, "dangling": 0, "several": 0}


def test_train_edges_keep_hops_over_midnight_and_the_second_day(spark):
    trips = {1: [(1, 1400), (2, 10), (3, 10), (3, 20), (1, 5)], 2: [(1, 600), (2, 700)], 3: [(1, 1400), (2, 10)]}
    df = spark.createDataFrame([(r, i, s, c) for r, t in trips.items() for i, (s, c) in enumerate(t, 1)], "route int, pos int, station int, clock bigint")
    got = {(r["u"], r["v"]): [tuple(p) for p in r["time_pairs"]] for r in graph.train_edges(prep.absolute_minutes(df)).collect()}
    assert got == {(1, 2): [(600, 700), (1400, 1450), (2040, 2140), (2840, 2890)], (2, 3): [(1450, 1450), (2890, 2890)], (3, 1): [(1460, 2885), (2900, 4325)]}


def test_train_queries_hold_every_hop(spark):
    from itinera.plans import graph_queries as q
    from itinera.plans.projection import stops

    d, trips, pairs = "/root/testdata/sf0.001", {}, {}
    for r in stops(spark, d).orderBy("route", "pos").collect():
        trips.setdefault(r["route"], []).append((r["station"], r["clock"]))
    for t in trips.values():
        minutes = []
        for _, c in t:
            day = minutes[-1] // 1440 * 1440 if minutes else 0
            minutes.append(c + day + (1440 if minutes and c + day < minutes[-1] else 0))
        for (u, _), (v, _), a, b in zip(t, t[1:], minutes, minutes[1:]):
            if u != v:
                pairs.setdefault((u, v), set()).update({(a, b), (a + 1440, b + 1440)})
    assert {(r["u"], r["v"]): (r["pairs"], r["first_dep"], r["last_arr"]) for r in q.train_edges(spark, d).collect()} == {k: (len(p), min(p)[0], max(p)[1]) for k, p in pairs.items()}
    assert {r["kind"]: r["n"] for r in q.graph_summary(spark, d).collect()}["edge train"] == len(pairs)
    kept = q.frequency_subgraph(spark, d).collect()
    assert kept and all(r["pairs"] == len(pairs[r["u"], r["v"]]) for r in kept)


def test_skyline_golden_and_property(spark):
    schema = "node int, t int, start_time int, mask bigint"
    kept = {tuple(r) for r in search.skyline(spark.createDataFrame([(1, 10, 0, 3), (1, 12, 0, 1), (1, 12, 0, 7), (1, 10, 0, 3), (2, 10, 0, 1), (2, 12, 9, 1)], schema)).collect()}
    assert kept == {(1, 10, 0, 3), (1, 12, 0, 7), (2, 10, 0, 1), (2, 12, 9, 1)}
    rng = random.Random(6)
    rows = {(rng.randrange(3), rng.randrange(20), rng.randrange(5), rng.randrange(1, 32)) for _ in range(150)}
    dom = lambda d, x: d != x and d[0] == x[0] and d[1] <= x[1] and d[2] >= x[2] and d[3] & x[3] == x[3]
    assert {tuple(r) for r in search.skyline(spark.createDataFrame(sorted(rows), schema)).collect()} == {x for x in rows if not any(dom(d, x) for d in rows)}


def test_search_agrees_with_depth_first(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(14):
        o, t = rng.randrange(5), rng.randrange(200)
        rows.append((o, (o + rng.randrange(1, 5)) % 5, t, t + rng.randrange(5, 60)))
    ev = events(spark, rows)
    edges = graph.earliest_successors(ev)
    succ = {}
    for r in edges.collect():
        succ.setdefault(r["src"], []).append(r["dst"])
    want = set()

    def walk(start, path, mask):
        nxt = [j for j in succ.get(path[-1], []) if rows[j - 1][3] <= rows[start - 1][3] + 150]
        if not nxt:
            want.add((start, path[-1], mask, tuple(path)))
        for j in nxt:
            walk(start, [*path, j], mask | 1 << rows[j - 1][1])

    for i in range(1, 15):
        walk(i, [i], 1 << rows[i - 1][1])
    got = search.itineraries(ev, edges, 150).collect()
    assert {(r["start"], r["event"], r["mask"], tuple(r["path"])) for r in got} == want
    ends = search.finished(search.states(ev, edges, 150), edges, ev).collect()
    assert {(r["start"], r["event"], r["mask"]) for r in ends} == {w[:3] for w in want}


def random_events(rng, n, places, until, longest):
    rows = []
    for _ in range(n):
        o, t = rng.randrange(places), rng.randrange(until)
        rows.append((o, (o + rng.randrange(1, places)) % places, t, t + rng.randrange(5, longest)))
    return rows


def replayed(rows, path, walks, wait=0):
    """(first departure, last arrival, mask) of a path of events; fails if it can't be travelled."""
    mask, before = 0, None
    for i in path:
        o, d, dep, arr = rows[i - 1]
        if before:
            least = [0] if before[1] == o else [m for u, v, m in walks if (u, v) == (before[1], o)]
            assert least and dep >= before[3] + min(least) + wait
        mask, before = mask | 1 << (d % 25), rows[i - 1]
    return rows[path[0] - 1][2], rows[path[-1] - 1][3], mask


def test_bounded_searches_lose_nothing(spark):
    rng = random.Random(12)
    rows = random_events(rng, 130, 9, 1400, 90)
    walks = [(1, 3, 20), (3, 1, 20), (4, 7, 35)]
    ev, tr = events(spark, rows), spark.createDataFrame(walks, "u int, v int, minutes int")
    edges = graph.earliest_successors(ev, tr)
    near = search.with_reach(ev, tr)
    costs = search.entry_costs(ev, F.col("origin") % 25)
    bounds = (search.floor_bound(costs[0][0]), search.budget_bound(costs))
    for window, floor in ((500, 14), (500, 3), (900, 6)):
        ends = lambda **how: {(r["start"], r["event"], r["mask"]): tuple(r["path"]) for r in search.keep_best(search.finished(search.states(near, edges, window, **how), edges, ev), floor).collect()}  # noqa: B023, E731
        whole, bounded = ends(), ends(bounds=bounds, floor=floor)
        assert whole and whole.keys() == bounded.keys()
        assert all(replayed(rows, p, walks)[2] == k[2] and (p[0], p[-1]) == k[:2] for p_k in (whole, bounded) for k, p in p_k.items())
        assert all(k[2].bit_count() >= floor for k in whole) or len({k[2].bit_count() for k in whole}) == 1
    plain = search.labels(ev, tr, 500).collect()
    assert all(replayed(rows, r["path"], walks) == (r["start_time"], r["t"], r["mask"]) for r in plain)
    most = max(r["mask"].bit_count() for r in plain)
    key = lambda rs: {(r["node"], r["t"], r["start_time"], r["mask"]) for r in rs}
    for record, reach in ((0, None), (most - 1, search.reachable_countries(ev, tr)), (most, search.reachable_countries(ev, tr))):
        assert key(search.labels(ev, tr, 500, bounds=bounds, record=record, reach=reach).collect()) == {k for k in key(plain) if k[3].bit_count() == most}
    assert key(search.labels(ev, tr, 500, least_countries=3).collect()) == {k for k in key(plain) if k[3].bit_count() >= 3}
    assert key(search.labels(ev, tr, 500, beam=10_000).collect()) == key(plain)
    assert max(r["mask"].bit_count() for r in search.labels(ev, tr, 500, beam=20).collect()) <= most
    runs = search.rollouts(ev, edges, 500, clock="dep", first_until=10**6).collect()
    assert max(r["countries"] for r in runs) <= most and all(replayed(rows, r["path"], walks)[2].bit_count() == r["countries"] for r in runs)


def test_stitched_and_matrix_paths_can_be_travelled(spark):
    rng = random.Random(13)
    rows = random_events(rng, 110, 8, 900, 90)
    walks = [(1, 3, 20), (3, 1, 20)]
    ev, tr = events(spark, rows), spark.createDataFrame(walks, "u int, v int, minutes int")
    f, b = (search.labels(ev, tr, 250, wait=5, backward=back) for back in (False, True))
    met = search.stitch(f, b, 5, 450).collect()
    assert met
    for r in met:
        start, end, mask = replayed(rows, r["path"], walks, wait=5)
        assert (start, end, end - start, mask.bit_count()) == (r["start_time"], r["end_time"], r["duration"], r["countries"])
    edges = graph.earliest_successors(ev, tr)
    for r in search.matrix_masks(ev, edges, 400).collect():
        assert (r["path"][0], r["path"][-1]) == (r["u"], r["v"]) and replayed(rows, r["path"], walks)[2] == r["mask"]
    steps = search.path_edges(spark.createDataFrame([(1, [1, 2]), (2, [3])], "start int, path array<bigint>"), spark.createDataFrame([(1, 2)], "src bigint, dst bigint"), ev).collect()
    assert [(r["start"], r["pos"], r["is_edge"], r["layover"]) for r in steps] == [(1, 1, True, rows[1][2] - rows[0][3])]


def test_states_are_expanded_once(spark):
    """Two ways of different length lead to one state; only the first is kept and expanded."""
    ev = events(spark, [(0, 1, 0, 10), (1, 2, 10, 20), (2, 3, 20, 30), (1, 3, 10, 25), (3, 2, 30, 40), (2, 4, 50, 60)])
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (3, 5), (4, 5), (5, 6), (2, 6)], "src bigint, dst bigint")
    found = [r for r in search.states(ev, edges, 100, first_until=10).collect() if r["event"] in (5, 6)]
    assert len({(r["start"], r["event"], r["mask"]) for r in found}) == len(found)
    assert {(r["event"], r["level"], tuple(r["path"])) for r in found} == {(5, 2, (1, 4, 5)), (6, 2, (1, 2, 6)), (6, 3, (1, 4, 5, 6))}


def test_rollouts_shun_seen_stations(spark):
    ev = events(spark, [(0, 1, 0, 10), (1, 0, 20, 30), (1, 26, 20, 30), (1, 2, 20, 30)])
    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "src bigint, dst bigint")
    top = {r["dst"]: r["weight"] for r in search.top_choices(ev, edges, 100, first_until=10).collect()}
    assert top == {2: 1e5 / 20, 3: 1 / 20, 4: 1e5 / 20}
    again = events(spark, [(0, 1, 0, 10), (1, 2, 20, 30), (2, 1, 40, 50), (2, 3, 40, 50)])
    runs = search.rollouts(again, spark.createDataFrame([(1, 2), (2, 3), (2, 4)], "src bigint, dst bigint"), 100, per_start=50, first_until=10)
    assert {tuple(r["path"]) for r in runs.collect()} == {(1, 2, 4)}


def test_entering_costs_over_transfers(spark):
    ev = events(spark, [(0, 1, 0, 50), (2, 1, 0, 40), (1, 2, 0, 90)])
    tr = spark.createDataFrame([(0, 1, 30), (1, 1, 5), (2, 3, 12)], "u_country int, v_country int, minutes int")
    assert {tuple(r) for r in graph.enter_minutes(ev, F.col("origin") % 25, tr).collect()} == {(1, 30), (2, 90), (3, 12)}
    pairs = spark.createDataFrame([(1, 2, [(5, 9)])], "u int, v int, time_pairs array<struct<dep:int,arr:int>>")
    want = spark.createDataFrame([(1, 2, 5, 9), (1, 2, 5, 8), (2, 1, 5, 9)], "u int, v int, dep int, arr int")
    assert sorted(r["present"] for r in graph.pair_presence(want, pairs).collect()) == [False, False, True]


def test_events_of_all_days_meet(spark, tmp_path):
    from datetime import datetime

    from itinera.plans import graph_queries as q
    from itinera.plans import projection

    rows = [(1, 1, datetime(2024, 1, 1, 10), '{"k": 1}'), (2, 8, datetime(2024, 1, 3, 9, 30), '{"k": 1}'), (3, 9, datetime(2024, 1, 30, 23, 59), '{"k": 2}')]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = [tuple(r) for r in projection.events(spark, str(tmp_path)).orderBy("event_id").select("event_id", "origin", "dest", "dep", "arr").collect()]
    assert got == [(1, 1, 8, 600, 631), (2, 8, 9, 2 * 1440 + 570, 2 * 1440 + 602), (3, 9, 17, 29 * 1440 + 1439, 29 * 1440 + 1472)]
    assert {(r["src"], r["dst"]) for r in q.aon_edges_direct(spark, str(tmp_path)).collect()} == {(1, 2), (2, 3)}


@pytest.mark.parametrize("waits", [True, False])
def test_reachable_countries_over_many_days(spark, waits):
    rng = random.Random(4)
    rows = [(0, 1, 5, 65), (1, 2, 9000, 9100)] + [(o := rng.randrange(6), (o + rng.randrange(1, 6)) % 6, t := rng.randrange(9000), t + rng.randrange(5, 200)) for _ in range(120)]
    walks = [(0, 7, 30), (7, 0, 30), (2, 8, 70), (8, 2, 70), (7, 8, 61)]
    times = {*range(min(r[2] for r in rows) // 60, max(r[3] for r in rows) // 60 + 1)}
    arcs = {(o, a // 60, d, b // 60, 1 << d) for o, d, a, b in rows}
    arcs |= {(u, t, v, (t * 60 + m) // 60, 0) for u, v, m in walks for t in times}
    arcs |= {(n, t, n, t + 1, 0) for r in rows for n in r[:2] for t in times if t < max(times)} if waits else set()
    want, moved = {}, True
    while moved:
        moved = False
        for n, t, to, at, gain in sorted(arcs, key=lambda a: -a[1]):
            mask = want.get((n, t), 0) | gain | want.get((to, at), 0)
            moved |= mask != want.get((n, t), 0)
            want[n, t] = mask
    got = search.reachable_countries(events(spark, rows), spark.createDataFrame(walks, "u int, v int, minutes int"), waits=waits).collect()
    assert {(r["node"], r["bucket"]): r["mask"] for r in got} == {k: m for k, m in want.items() if m}


def test_labels_and_stitching_by_slots(spark):
    rng = random.Random(9)
    schema = "node int, t bigint, start_time bigint, mask bigint"
    rows = sorted({(rng.randrange(3), s + rng.randrange(1, 41), s, rng.randrange(1, 16)) for s in (rng.randrange(-300, 300) for _ in range(400))})
    df = spark.createDataFrame(rows, schema)
    dom = lambda d, x: d != x and d[0] == x[0] and d[1] <= x[1] and d[2] >= x[2] and d[3] & x[3] == x[3]
    assert {tuple(r) for r in search.skyline(df, span=40).collect()} == {x for x in rows if not any(dom(d, x) for d in rows)}
    back = [(n, -b, -e, m) for n, e, b, m in rows]
    met = sorted((f[0], (f[3] | b[3]).bit_count(), -b[2] - f[2], f[2], -b[2]) for f in rows for b in back if f[0] == b[0] and -b[1] - f[1] >= 5 and -b[2] - f[2] <= 70)
    assert met and sorted(tuple(r) for r in search.stitch(df, spark.createDataFrame(back, schema), 5, 70).collect()) == met


def test_searches_run_until_nothing_is_left(spark):
    ev = events(spark, [(i % 2, (i + 1) % 2, 10 * i, 10 * i + 10) for i in range(40)])
    edges = graph.earliest_successors(ev).where("src = dst - 1")
    runs = search.rollouts(ev, edges, 1000, per_start=1).collect()
    assert {r["start"]: len(r["path"]) for r in runs} == {i: 41 - i for i in range(1, 41)}


def paths_of(spark, rows, walks, window, first_until=None):
    """Start, path and whether nothing can follow it, of all paths in the window after the start's departure, along the edges."""
    ev, tr = events(spark, rows), spark.createDataFrame(walks, "u int, v int, minutes int")
    succ = {}
    for r in graph.earliest_successors(ev, tr).collect():
        succ.setdefault(r["src"], []).append(r["dst"])
    out = []

    def walk(path):
        nxt = [j for j in succ.get(path[-1], []) if rows[j - 1][3] <= rows[path[0] - 1][2] + window]
        out.append((path[0], path, not nxt))
        for j in nxt:
            walk([*path, j])

    for i, r in enumerate(rows, 1):
        if first_until is None or r[3] <= first_until:
            walk([i])
    return out


@pytest.mark.parametrize("cells", [sums.CELLS, 1])
def test_paths_are_counted_by_deadline(spark, monkeypatch, cells):
    monkeypatch.setattr(sums, "SPAN", 50)
    monkeypatch.setattr(sums, "CELLS", cells)
    rows = [*random_events(random.Random(21), 120, 7, 700, 90), (0, 1, 30, 400), (2, 3, 10, 20), (2, 3, 10, 20)]
    walks = [(1, 3, 20), (3, 1, 25), (4, 6, 0)]
    want = {}
    for start, _, _ in paths_of(spark, rows, walks, 200):
        want[start] = want.get(start, 0) + 1
    got = sums.path_counts(events(spark, rows), spark.createDataFrame(walks, "u int, v int, minutes int"), 200)
    assert {r["start"]: int(r["paths"]) for r in got.collect()} == want and max(want.values()) > 20


@pytest.mark.parametrize("tight", [False, True])
def test_lengths_of_paths_and_their_most_countries(spark, monkeypatch, tight):
    """Against a list of all paths; ``tight``: one deadline and few lengths at a time, states expanded one by one."""
    monkeypatch.setattr(sums, "SHORT_SPAN", 40)
    for name, value in (("CELLS", 1), ("LAYERS", 2), ("CHUNK", 1)) if tight else ():
        monkeypatch.setattr(sums, name, value)
    rows = [*random_events(random.Random(31), 110, 7, 700, 60), (0, 1, 30, 400), (2, 3, 10, 20), (2, 3, 10, 20)]
    rows = [(o % 5 + 25 * (o > 4), d % 5 + 25 * (d > 4), a, b) for o, d, a, b in rows]
    rows += [(60 + i % 2, 61 - i % 2, 30 * i, 30 * i + 25) for i in range(20)]
    walks = [(1, 3, 20), (3, 1, 25), (4, 26, 0)]
    want = {}
    for _, path, ended in paths_of(spark, rows, walks, 300, first_until=350):
        if ended and rows[path[0] - 1][3] - rows[path[0] - 1][2] <= 300:
            n, most = want.get(len(path), (0, 0))
            want[len(path)] = n + 1, max(most, len({rows[i - 1][1] % 25 for i in path}))
    got = sums.path_lengths(events(spark, rows), spark.createDataFrame(walks, "u int, v int, minutes int"), 300, 350)
    assert {r["legs"]: (int(r["paths"]), r["most"]) for r in got.collect()} == want
    assert len(want) > 5 and want[10][1] == 2 < want[5][1]


@pytest.mark.parametrize("tight", [False, True])
def test_labels_of_most_countries_against_all_labels(spark, monkeypatch, tight):
    for name, value in (("SPAN", 90), ("DEADLINES", 7), ("STATES", 3), ("BEAM", 1)) if tight else ():
        monkeypatch.setattr(sums, name, value)
    rows = [*random_events(random.Random(41), 150, 9, 900, 90), (0, 1, 30, 700), (2, 3, 10, 20), (2, 3, 10, 20)]
    walks = [(1, 3, 20), (3, 1, 25), (4, 6, 0)]
    ev, tr = events(spark, rows), spark.createDataFrame(walks, "u int, v int, minutes int")
    key = lambda df: sorted((r["node"], r["t"], r["start_time"], r["mask"]) for r in df.collect())
    for window in (200, 420):
        every = key(search.labels(ev, tr, window))
        most = max(k[3].bit_count() for k in every)
        assert key(search.skyline(sums.most_countries(ev, tr, window), window)) == [k for k in every if k[3].bit_count() == most]
    assert sums.most_countries(ev.limit(0), tr, 200).count() == 0


@pytest.mark.parametrize("tight", [False, True])
def test_ends_against_all_states(spark, monkeypatch, tight):
    """With legs alike, arrivals that tie, starts that share what follows, and in pieces."""
    for name, value in (("ENDS_SPAN", 70), ("STATES", 3), ("CANDIDATES", 5), ("ENDS_STATES", 1), ("BATCH", 2), ("BEAM", 1)) if tight else ():
        monkeypatch.setattr(sums, name, value)
    rows = random_events(random.Random(43), 140, 9, 1400, 90)
    rows += [*rows[:60], *[(o, d, a - 7, b) for o, d, a, b in rows[60:90]], *[((d + 1) % 9, d, a, b) for _, d, a, b in rows[90:120]]]
    walks = [(1, 3, 20), (3, 1, 25), (4, 6, 0)]
    # The bits of the last round leave no room for a start and a leg beside a mask.
    for window, floor, wide in ((300, 3, 1),) if tight else ((500, 14, 1), (300, 3, 7)):
        ev = events(spark, rows).withColumn("bit", F.expr(f"shiftleft(1L, cast(country * {wide} as int))"))
        tr = spark.createDataFrame(walks, "u int, v int, minutes int")
        edges = graph.earliest_successors(ev, tr)
        key = lambda df: sorted((r["start"], r["event"], r["mask"], r["countries"], tuple(r["path"])) for r in df.select("start", "event", "mask", "countries", "path").collect())
        every = key(search.keep_best(search.finished(search.states(ev, edges, window, first_until=400), edges, ev), floor))
        assert every and key(sums.ends(ev, tr, window, floor, 400)) == every
    assert sums.ends(ev.limit(0), tr, 500, 14, 400).count() == 0


@pytest.mark.parametrize("tight", [False, True])
def test_ends_of_the_nearest_layovers_are_streamed(spark, monkeypatch, tight):
    """As by joins of whole levels, in pieces, with one table written: the legs."""
    for name, value in (("ENDS_SPAN", 70), ("STATES", 3), ("CANDIDATES", 5), ("BATCH", 2)) if tight else ():
        monkeypatch.setattr(sums, name, value)
    rows = random_events(random.Random(53), 140, 9, 900, 90)
    rows += [*rows[:30], *[(o, d, a - 7, b) for o, d, a, b in rows[30:50]]]
    tr = spark.createDataFrame([(1, 3, 20), (3, 1, 25), (4, 6, 0)], "u int, v int, minutes int")
    ev = events(spark, rows).withColumn("bit", F.expr(f"shiftleft(1L, cast(country * {1 if tight else 7} as int))"))
    edges = graph.earliest_successors(ev, tr)
    key = lambda df: sorted((r["start"], r["event"], r["mask"], r["cost"], tuple(r["path"])) for r in df.collect())
    want = key(search.finished(search.states(ev, edges, 350, prefer_layover=30, first_until=250), edges, ev))
    written, cut = [], sums.cut
    monkeypatch.setattr(sums, "cut", lambda df: written.append(df) or cut(df))
    assert key(sums.nearest_ends(ev, tr, 350, 30, 250)) == want and len(want) > 200 and len(written) == 1


@pytest.mark.parametrize("tight", [False, True])
def test_matrix_masks_are_streamed(spark, monkeypatch, tight):
    """As by joins of whole levels over the edges with time to change, in pieces, with one table written: the legs."""
    for name, value in (("SHORT_SPAN", 70), ("STATES", 3), ("PAIRS", 3), ("BATCH", 2)) if tight else ():
        monkeypatch.setattr(sums, name, value)
    rows = random_events(random.Random(57), 130, 7, 700, 60)
    rows += [*rows[:20], *[(o, d, a - 7, b) for o, d, a, b in rows[20:40]]]
    ev, tr = events(spark, rows), spark.createDataFrame([(1, 3, 20), (3, 1, 25), (4, 6, 0)], "u int, v int, minutes int")
    edges = graph.buffered_successors(ev, tr, F.expr("if(station < 4, 'A', 'R')"))
    key = lambda df: sorted((r["u"], r["v"], r["mask"], tuple(r["path"])) for r in df.collect())
    want = key(search.matrix_masks(ev, edges, 350))
    written, cut = [], sums.cut
    monkeypatch.setattr(sums, "cut", lambda df: written.append(df) or cut(df))
    assert key(sums.matrix_masks(ev, tr, 350, dict.fromkeys(range(4), 20))) == want and max(len(k[3]) for k in want) > 4 and len(written) == 1


@pytest.mark.parametrize("walked", [sums.WALKED, 3])
def test_itineraries_are_streamed(spark, monkeypatch, walked):
    """As by joins of whole levels, some paths at a time, with one table written: the legs."""
    monkeypatch.setattr(sums, "WALKED", walked)
    monkeypatch.setattr(sums, "ENDS_SPAN", 70)
    rows = random_events(random.Random(51), 110, 8, 900, 90)
    rows += [*rows[:30], *[(o, d, a - 7, b) for o, d, a, b in rows[30:50]]]
    ev, tr = events(spark, rows), spark.createDataFrame([(1, 3, 20), (3, 1, 25), (4, 6, 0)], "u int, v int, minutes int")
    key = lambda df: sorted((r["start"], r["event"], r["mask"], tuple(r["path"])) for r in df.collect())
    want = key(search.itineraries(ev, graph.earliest_successors(ev, tr), 300, first_until=400))
    written, cut = [], sums.cut
    monkeypatch.setattr(sums, "cut", lambda df: written.append(df) or cut(df))
    assert key(sums.itineraries(ev, tr, 300, 400)) == want and len(want) > 200 and len(written) == 1


def test_path_edges_follow_only_ends_of_the_floor(spark, monkeypatch):
    """The steps checked are those of dfs_dedup's paths, and no search writes all states for them."""
    from itinera.plans import graph_queries as q

    monkeypatch.setattr(search, "states", lambda *_, **__: pytest.fail("all states were searched"))
    d = "/root/testdata/sf0.001"
    want = sorted((r["start"], k, int(a), int(b), True) for r in q.dfs_dedup(spark, d).collect() for p in [r["path"].split("-")] for k, (a, b) in enumerate(zip(p, p[1:]), 1))
    got = sorted((r["start"], r["pos"], r["src"], r["dst"], r["is_edge"]) for r in q.path_edge_check(spark, d).collect())
    assert got == want and want


@pytest.mark.parametrize("tight", [False, True])
def test_labels_of_spans_against_all_labels(spark, monkeypatch, tight):
    """Over several spans, a few starts and pairs at a time, with masks of more than 31 bits."""
    for name, value in (("LABEL_SPAN", 90), ("STARTS", 7), ("LABELS", 10), ("PAIRS", 3), ("ROWS", 4), ("STATES", 3)) if tight else ():
        monkeypatch.setattr(sums, name, value)
    rows = [*random_events(random.Random(47), 150, 9, 900, 90), (0, 1, 30, 700), (2, 3, 10, 20), (2, 3, 10, 20)]
    tr = spark.createDataFrame([(1, 3, 20), (3, 1, 25), (4, 6, 0)], "u int, v int, minutes int")
    key = lambda df: sorted((r["node"], r["t"], r["start_time"], r["mask"]) for r in df.collect())
    for window, wait, backward, least, wide in ((420, 0, False, 0, 1), (250, 10, True, 2, 7)):
        ev = events(spark, rows).withColumn("bit", F.expr(f"shiftleft(1L, cast(country * {wide} as int))"))
        every = key(search.labels(ev, tr, window, wait=wait, backward=backward, least_countries=least).drop("path"))
        assert len(every) > 100 and key(sums.labels(ev, tr, window, wait, backward, least)) == every
    assert sums.labels(ev.limit(0), tr, 200).count() == 0


def test_labels_leave_nothing_on_disk(spark, monkeypatch):
    """Labels need no table of a level: the tasks stream them."""
    monkeypatch.setattr(sums, "cut", lambda df: pytest.fail("a table was written"))
    ev = events(spark, random_events(random.Random(48), 40, 5, 300, 60))
    assert sums.labels(ev, None, 200).count() > 40


def test_lengths_of_more_paths_than_could_be_listed(spark):
    rows = [(0, 1, 0, 1)]
    for level in range(40):
        rows += [(u, v, 2 * level + 2, 2 * level + 3) for u in range(1, 5) for v in range(1, 5)]
    got = sums.path_lengths(events(spark, rows), None, 1440, 1).collect()
    assert [(r["legs"], int(r["paths"]), r["most"]) for r in got] == [(41, 4**40, 4)]


def test_paths_past_64_bits_and_without_times_are_counted(spark):
    """Layers of ten legs each way double the paths: more than could be listed, or kept in 64 bits."""
    rows = [(0, 1, 0, 1)]
    for level in range(60):
        rows += [(u, v, 2 * level + 2, 2 * level + 3) for u in (1, 2, 3, 4) for v in (1, 2, 3, 4)]
    ev = events(spark, rows).unionByName(spark.createDataFrame([(9999, 1, 2, None, None, 2, 4)], "event_id bigint, origin int, dest int, dep bigint, arr bigint, country int, bit bigint"))
    got = {r["start"]: int(r["paths"]) for r in sums.path_counts(ev, None, 1440).collect()}
    by = [0] * 61
    for level in range(59, -1, -1):
        by[level] = 4 * (1 + by[level + 1])
    assert got[1] == 1 + by[0] > 1 << 100 and got[len(rows)] == 1 and got[9999] == 1 and len(got) == len(rows) + 1


@pytest.mark.parametrize("levels", [20, 33, 60])
def test_path_queries_return_counts_of_any_size(spark, monkeypatch, levels):
    """A bigint as the SQL's where that holds the counts, else a decimal of one, two and more limbs."""
    from itinera.plans import graph_queries as q

    rows = [(0, 1, 0, 1)]
    for level in range(levels):
        rows += [(u, v, 2 * level + 2, 2 * level + 3) for u in (1, 2, 3, 4) for v in (1, 2, 3, 4)]
    monkeypatch.setattr(q, "events", lambda *_: events(spark, rows))
    monkeypatch.setattr(q, "transfers", lambda *_: None)
    monkeypatch.setattr(search, "MINUTES_OF_DAY", 1)
    counted, lengths = q.path_count(spark, ""), q.suffix_enumeration(spark, "")
    kind = "bigint" if levels < 31 else "decimal(38,0)"
    assert dict(counted.dtypes)["paths"] == dict(lengths.dtypes)["paths"] == kind
    assert int(counted.where("start = 1").first()["paths"]) == (4 ** (levels + 1) - 1) // 3
    assert [(r["legs"], int(r["paths"]), r["most"]) for r in lengths.collect()] == [(levels + 1, 4**levels, 4)]


def test_important_stops_golden(spark):
    rows = [(1, i, c, s) for i, (c, s) in enumerate([("FR", 3), ("FR", 9), ("FR", 16), ("FR", 1), ("CH", 2), ("DE", 20), ("DE", 5)])]
    kept = prep.important_stops(spark.createDataFrame(rows, "route int, pos int, country string, score int")).collect()
    assert sorted(r["pos"] for r in kept) == [0, 2, 3, 4, 5, 6]


def test_sliding_improves_routes(spark):
    segs = [{"origin": "A x", "dest": "B x", "dep_time": 0, "arr_time": 10}, {"origin": "B x", "dest": "C x", "dep_time": 10, "arr_time": 50}, {"origin": "C x", "dest": "D x", "dep_time": 100, "arr_time": 120}]
    df = spark.createDataFrame([(1, json.dumps(segs)), (2, json.dumps(segs[:1])), (3, None)], "route_id bigint, route_sequence_json string")
    alt = spark.createDataFrame([("B x", "C x", 30, 70), ("B x", "C x", 90, 130)], "origin string, dest string, dep_time bigint, arr_time bigint")
    got = {r["route_id"]: r for r in routes.slide(df, alt).collect()}
    assert got[1]["moved"] == 1 and got[1]["rqi_after"] > got[1]["rqi_before"] and got[2]["rqi_before"] is None and 3 not in got


def test_sliding_follows_a_move_of_more_than_a_day(spark):
    segs = [("A x", "B x", 0, 10), ("B x", "C x", 2000, 3000), ("C x", "D x", 3005, 3010), ("D x", "E x", 3012, 3020)]
    df = spark.createDataFrame([(1, json.dumps([dict(zip(("origin", "dest", "dep_time", "arr_time"), s)) for s in segs]))], "route_id bigint, route_sequence_json string")
    alt = spark.createDataFrame([("B x", "C x", 60, 100), ("C x", "D x", 150, 2000)], "origin string, dest string, dep_time bigint, arr_time bigint")
    assert routes.slide(df, alt).first()["moved"] == 2


def test_sliding_agrees_with_trying_each_train(spark):
    """All routes of the smallest table, one train after the other, by plain loops."""
    from itinera.plans import route_queries

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/master_elite_routes_full.parquet").select("route_id", "route_sequence_json").collect()
    segs = {r["route_id"]: json.loads(r["route_sequence_json"]) for r in rows if r["route_sequence_json"]}
    trains = {}
    for s in segs.values():
        for x in s:
            if None not in (x.get("dep_time"), x.get("arr_time"), x.get("origin"), x.get("dest")):
                trains.setdefault((x["origin"], x["dest"]), set()).add((x["dep_time"], x["arr_time"]))
    bare = lambda t: t[: t.rindex("(")].strip() if t.rstrip().endswith(")") and "(" in t else t.strip()

    def mode(label):
        words = bare(label).split(" ")
        first = words[0] if len(words[0]) == 3 and words[0].isalnum() and words[0].isascii() else None
        import re

        m = re.search(r"\b[A-Z0-9]{3,4}\b", bare(label))
        code = first or (m[0] if m else bare(label))
        return "A" if re.fullmatch("[A-Z]{3}", code) else "R"

    least = {("A", "A"): 20, ("A", "R"): 20, ("R", "A"): 25, ("R", "R"): 5}

    def quality(s, times):
        scores = []
        for i in range(len(s) - 1):
            same = bare(s[i]["dest"]) == bare(s[i + 1]["origin"])
            a, b = mode(s[i]["dest"]), mode(s[i + 1]["origin"])
            m = times[i + 1][0] - times[i][1] - (0 if same else 60) - (0 if same and a == b == "R" else least[a, b])
            scores.append(100 * (1 - math.exp(-0.05 * m)) if m >= 0 else 1000.0 * m)
        return 0.7 * min(scores) + 0.3 * sum(scores) / len(scores)

    want = {}
    for k, s in segs.items():
        if not s:
            continue
        times = [(x["dep_time"], x["arr_time"]) for x in s]
        if len(s) < 2 or any(None in t for t in times):
            want[k] = (None, None)
            continue
        before = best = quality(s, times)
        for i in range(1, len(s) - 1):
            if mode(s[i]["origin"]) == mode(s[i]["dest"]) == "A":
                continue
            for o in sorted(trains[s[i]["origin"], s[i]["dest"]]):
                if o[0] >= times[i - 1][1] and o[1] <= times[i + 1][0] and (q := quality(s, [*times[:i], o, *times[i + 1 :]])) > best + 1e-9:
                    best, times[i] = q, o
        want[k] = (before, best)
    got = {r["route_id"]: (r["rqi_before"], r["rqi_after"]) for r in route_queries.schedule_sliding(spark, d).collect()}
    assert got.keys() == want.keys()
    near = lambda x, y: x is y is None or abs(x - y) < 1e-6 * max(1, abs(x))
    assert all(near(got[k][0], want[k][0]) and near(got[k][1], want[k][1]) for k in want)


# Sources, sinks, streams


def test_sources(spark, tmp_path):
    (tmp_path / "air.csv").write_bytes("id;ident;type;name;latitude_deg;longitude_deg;elevation_ft;continent;iso_country;iso_region;municipality;scheduled_service;icao_code;iata_code;gps_code;local_code;home_link;wikipedia_link;keywords\n1;X;small_airport;Łódź;51,5;19,4;x;EU;PL;PL-1;Łódź;yes;;LCJ;;;;;\n".encode("cp1250"))
    r = readers.airports_csv(spark, str(tmp_path / "air.csv")).first()
    assert (r["name"], r["latitude_deg"], r["elevation_ft"]) == ("Łódź", 51.5, None)
    assert readers.probed_encoding(spark, str(tmp_path / "air.csv")) == "UTF-8"
    (tmp_path / "cities.txt").write_text("\t".join(["1", "Köln", "Koln", "Cologne,Keulen", *[""] * 4, "DE", *[""] * 5, "x7"]) + "\nshort\n")
    assert tuple(readers.cities_tsv(spark, str(tmp_path / "cities.txt")).first()) == ("Köln", "Koln", "Cologne,Keulen", "DE", 0)
    (tmp_path / "f/2026-01-22").mkdir(parents=True)
    doc = [{"flight": {"number": "12"}, "departure": {"iataCode": "aaa", "scheduledTime": "2026-01-22t01:30:00.000", "estimatedTime": "2026-01-22t01:20:30.000"}, "arrival": {"iataCode": "bbb"}, "status": "x"}, {"departure": {"iataCode": "aaa"}}, {"flight": {"iataNumber": "q1"}, "departure": {"iataCode": "c", "scheduledTime": "bad"}, "arrival": {"iataCode": "d"}}]
    (tmp_path / "f/2026-01-22/aaa.json").write_text(json.dumps(doc))
    (tmp_path / "f/2026-01-22/bad.json").write_text("{oops")
    got = {tuple(r) for r in readers.flatten_flights(readers.flight_documents(spark, str(tmp_path / "f")), "date", "airport").select("date", "airport", "flight_number", "departure_delay_minutes").collect()}
    assert got == {("2026-01-22", "aaa", "12", -9), ("2026-01-22", "aaa", "Q1", None)}
    (tmp_path / "c.json").write_text(json.dumps({"global_max": 14, "routes": {"14": [[{"origin": "A", "dest": "B", "dep_time": 1, "arr_time": 2}]] * 2}}))
    assert [r["score"] for r in readers.checkpoint_routes(spark, str(tmp_path / "c.json")).collect()] == [14, 14]
    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as f:
        f.write('{"score": 3, "route": [{"origin": "A", "dest": "B", "dep_time": 1, "arr_time": 2}]}\n\n')
    assert readers.route_lines(spark, str(tmp_path / "r.jsonl.gz")).count() == 1
    (tmp_path / "latin.csv").write_bytes("Köln;x\n".encode("cp1250"))
    assert readers.probed_encoding(spark, str(tmp_path / "latin.csv")) == "cp1250"
    lines = [json.dumps({"score": i, "route": [{"origin": "A", "dest": "B", "dep_time": i % 3, "arr_time": 9}]}) for i in range(40)]
    (tmp_path / "many.jsonl").write_text("\n".join(lines[:20]) + "\n\n" + "\n".join(lines[20:]))
    assert [r["score"] for r in readers.route_lines(spark, str(tmp_path / "many.jsonl")).orderBy("file", "block", "line").collect()] == list(range(40))
    spark.range(3).write.parquet(str(tmp_path / "graph/events"))
    assert {k: v.count() for k, v in readers.graph_tables(spark, f"file://{tmp_path}/graph").items()} == {"events": 3}
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("stops.txt", "stop_name,stop_id,stop_lat,stop_lon\nS,007,1.5,x\n")
        z.writestr("trips.txt", "trip_id\n1\n")
        z.writestr("stop_times.txt", "trip_id,stop_id,stop_sequence,arrival_time,departure_time\n1,007,1,25:00:00,\n")
    feed = readers.gtfs(spark, str(tmp_path / "g.zip"), str(tmp_path / "gtfs"))
    assert tuple(feed["stops"].first()) == ("007", "S", 1.5, None) and feed["stop_times"].first()["arrival_time"] == "25:00:00"
    with sqlite3.connect(tmp_path / "t.db") as c:
        c.execute("create table t (a integer, b text, d real)")
        c.executemany("insert into t values (?, ?, ?)", [(i, f"x{i}", i / 2) for i in range(100)] + [(None, None, None)])
    df = readers.sqlite(spark, str(tmp_path / "t.db"), "t", 4)
    assert df.count() == 101 and df.agg(F.sum("d")).first()[0] == 2475.0 and df.rdd.getNumPartitions() == 4


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, o int")
    new = spark.createDataFrame([(2, "x", 5), (2, "y", 6), (3, "z", 7)], "k int, v string, o int")
    sinks.insert_or_ignore(new, old, ["k"], ["o"], str(tmp_path / "i"))
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "i")).collect()} == {(1, "a"), (2, "b"), (3, "z")}
    sinks.insert_or_replace(new, old, ["k"], ["o"], str(tmp_path / "r"))
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {(1, "a"), (2, "y"), (3, "z")}
    sinks.load_table(new, str(tmp_path / "l"), ["v"])
    sinks.load_table(old, str(tmp_path / "l"), ["v"])
    assert spark.read.parquet(str(tmp_path / "l")).count() == 3
    sinks.write_csv(old, str(tmp_path / "c"))
    sinks.write_csv(new, str(tmp_path / "c"), append=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 5
    scored = spark.createDataFrame([(13, "r"), (12, "q")], "score int, route string")
    sinks.write_checkpoint(scored, str(tmp_path / "k"))
    assert [r["score"] for r in spark.read.json(str(tmp_path / "k")).collect()] == [13]
    assert [tuple(r) for r in sinks.country_bits(spark.createDataFrame([("B",), ("A",), (None,)], "c string"), "c").collect()] == [("A", 1), ("B", 2)]


def test_json_partitions_are_written_once_each(spark, tmp_path):
    path = str(tmp_path / "p")
    day = lambda rows: spark.createDataFrame(rows, "date string, airport string, v int")
    read = lambda: list(tuple(r) for r in spark.read.schema("v int, date string, airport string").json(path).select("date", "airport", "v").collect())
    sinks.write_json_partitions(day([("2026-01-01", "A B/C", 1), ("2026-01-01", "D", 2)]), path)
    sinks.write_json_partitions(day([("2026-01-01", "A B/C", 9), ("2026-01-02", "D", 3), ("2026-01-01", None, 4)]), path)
    assert set(read()) == {("2026-01-01", "A B/C", 1), ("2026-01-01", "D", 2), ("2026-01-02", "D", 3), ("2026-01-01", None, 4)}
    sinks.write_json_partitions(day([("2026-01-01", None, 8)]), path)
    sinks.write_json_partitions(day([("2026-01-02", "D", 7)]), path, replace=True)
    assert {(r[0], r[1], r[2]) for r in read()} == {("2026-01-01", "A B/C", 1), ("2026-01-01", "D", 2), ("2026-01-02", "D", 7), ("2026-01-01", None, 4)}


def test_results_and_snapshots(spark, tmp_path):
    sinks.write_result(spark.createDataFrame([(1, 14), (1, 12), (2, 13)], "start int, countries int"), str(tmp_path / "r"), 1.5)
    assert tuple(spark.read.parquet(str(tmp_path / "r/metrics")).first()) == (3, 14, 2, 1.5)
    for n in (1, 1, 2):
        sinks.write_snapshot(spark.range(n), str(tmp_path / "s"), n, done=n == 2)
    assert spark.read.parquet(str(tmp_path / "s/snapshot=*")).count() == 3 and sinks.exists(spark, str(tmp_path / "s/_DONE"))


def test_incumbents_only_rise(spark, tmp_path):
    (tmp_path / "in").mkdir()
    route = [{"origin": "A", "dest": "B", "dep_time": 1, "arr_time": 2}]
    path, held = str(tmp_path / "best"), []
    for n, scores in enumerate([(3, 5), (4, 2), (5,), (7, 6)]):
        (tmp_path / f"in/{n}.jsonl").write_text("\n".join(json.dumps({"score": s, "route": route}) for s in scores))
        stream = live.observed(live.route_stream(spark, str(tmp_path / "in")))
        q = live.incumbent_stream(stream, path, str(tmp_path / "cp"))
        q.awaitTermination()
        held.append(sorted(r["score"] for r in live.incumbents(spark, path, stream.schema).collect()))
        assert [p["best"] for p in live.progress(q) if p["rows"]] == [max(scores)]
    assert held == [[5], [5], [5], [5, 7]]


def test_watching_ends_with_the_flags(spark, tmp_path):
    (tmp_path / "in").mkdir()
    route = [{"origin": "A", "dest": "B", "dep_time": 1, "arr_time": 2}]
    started = []

    def start():
        n = len(started)
        (tmp_path / f"in/{n}.jsonl").write_text(json.dumps({"score": n, "route": route}))
        if n == 1:
            (tmp_path / "_DONE").touch()
        started.append(n)
        return live.incumbent_stream(live.route_stream(spark, str(tmp_path / "in")), str(tmp_path / "best"), str(tmp_path / "cp"))

    assert live.watch(start, [str(tmp_path / "_DONE")], spark, 0.01) == 3 == len(started)


def test_live_routes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    route = [{"origin": "A", "dest": "B", "dep_time": 1, "arr_time": 2}]
    (tmp_path / "in/a.jsonl").write_text("\n".join(json.dumps({"score": s, "route": route}) for s in (3, 5, 5)))
    live.incumbent_stream(live.route_stream(spark, str(tmp_path / "in")), str(tmp_path / "best"), str(tmp_path / "cp")).awaitTermination()
    assert [r["score"] for r in spark.read.parquet(str(tmp_path / "best/part=*")).collect()] == [5]
    q = live.distinct_live(live.route_stream(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "d")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).count() == 1
