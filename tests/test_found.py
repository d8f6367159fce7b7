"""The core problems against brute force over whole small tables."""

import json
import math
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from pyspark.sql import functions as F

from itinera.plans import found

D = "/root/testdata/sf0.01"


def load(name, d=D):
    return pd.read_parquet(f"{d}/{name}.parquet")


def brute_stops(text):
    try:
        v = json.loads(text)
        v = json.loads(v) if isinstance(v, str) else v
    except (ValueError, TypeError):
        return []
    if isinstance(v, dict):
        v = v.get("legs")
    out = []
    for n, s in enumerate(v if isinstance(v, list) else [], 1):
        head = s[0] if isinstance(s, list) and s else s
        name = head.get("station") or head.get("name") if isinstance(head, dict) else head[0] if isinstance(head, list) and head else None
        if isinstance(name, str) and name.strip():
            out.append((n, name))
    return out


def test_p1_against_brute_force(spark):
    want = {(r["id"], c, n, s) for _, r in load("train_routes").iterrows() for c in found.LISTS for n, s in brute_stops(r[c])}
    got = [tuple(r) for r in found.p1_found(spark, D).select("route_id", "list_name", "stop_no", "station").collect()]
    assert len(got) == len(set(got)) and set(got) == want


ZONES = {"Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 1, "BST": 1, "IST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "TRT": 3, "MSK": 3}


def brute_time(text, date=None):
    """(wall clock, hours of offset or None), by another road than the operator's: strip parts off the ends."""
    t = text.strip().strip(" ")
    if re.fullmatch(r"\d{10}|\d{13}", t):
        return datetime(1970, 1, 1) + timedelta(milliseconds=int(t) * (1000 if len(t) == 10 else 1)), 0
    t = re.sub(r"\[.*\]$", "", t)
    offset = None
    if m := re.search(r"\s*([+-])(\d\d):?(\d\d)$", t):
        if re.search(r"\d[:.]?\d\d\S*\s*[+-]\d\d:?\d\d$", t) and not re.fullmatch(r"\d{4}-\d\d-\d\d", t):
            offset = (1 if m[1] == "+" else -1) * (int(m[2]) + int(m[3]) / 60)
            t = t[: m.start()]
    if offset is None and (m := re.search(r"\s*([A-Za-z]+)$", t)) and m[1].upper() in ZONES:
        offset = ZONES[m[1].upper()]
        t = t[: m.start()]
    half = None
    if m := re.search(r"\s*([AP])M$", t, re.I):
        half, t = m[1].upper(), t[: m.start()]
    m = re.search(r"(\d{1,2})[:.h]?(\d\d)(?:[:.]?(\d\d)(?:\.(\d+))?)?$", t)
    if not m:
        return None
    for cut in (re.search(r"(?<!\d)(\d{1,2})[:.h](\d\d)(?:[:.](\d\d)(?:\.(\d+))?)?$", t), re.search(r"(?:^|[Tt\s])(\d\d)(\d\d)(?:(\d\d)(?:\.(\d+))?)?$", t)):
        if cut:
            head = re.sub(r"[\s,]*[Tt]?[\s,]*$", "", t[: cut.start()] + (t[cut.start()] if not t[cut.start()].isdigit() else "")).strip()
            day = None
            if head:
                for f in ("%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y%m%d", "%d.%m.%Y", "%d/%m/%Y", "%d-%m-%Y", "%b %d, %Y"):
                    try:
                        day = datetime.strptime(head, f)
                    except ValueError:
                        continue
                    break
                if day is None:
                    continue
            elif date:
                day = datetime.strptime(date, "%Y-%m-%d" if date[4] == "-" else "%d.%m.%Y")
            else:
                return None
            h, mi, s, ms = int(cut[1]), int(cut[2]), int(cut[3] or 0), int(((cut[4] or "") + "000")[:3])
            if half:
                if not 1 <= h <= 12:
                    return None
                h = h % 12 + (12 if half == "P" else 0)
            if h > 23 or mi > 59 or s > 59:
                return None
            return day + timedelta(hours=h, minutes=mi, seconds=s, milliseconds=ms), offset
    return None


def epoch(local, zone):
    """First of two, forward over a gap (by the offset before it)."""
    z = ZoneInfo(zone)
    return round(local.replace(tzinfo=z, fold=0).astimezone(timezone.utc).timestamp() * 1000)


def brute_p6(d):
    zones = dict(load("country_zones", d)[["iso_country", "tz_name"]].itertuples(index=False))
    key = lambda s: "".join(c for c in s or "" if c.isalnum()).upper()
    places = {}
    for r in load("airports", d).sort_values("id").itertuples():
        if isinstance(r.iata_code, str) and key(r.iata_code):
            places.setdefault(key(r.iata_code), zones.get(r.iso_country))
    out = set()

    def add(table, i, field, text, zone, date=None):
        if isinstance(text, str) and (p := brute_time(text, date)):
            if p[1] is not None:
                out.add((table, i, field, round((p[0] - datetime(1970, 1, 1)) / timedelta(milliseconds=1) - p[1] * 3_600_000)))
            elif zone:
                out.add((table, i, field, epoch(p[0], zone)))

    for r in load("flights", d).itertuples():
        for f, a in (("departure_scheduled", r.departure_airport), ("departure_estimated", r.departure_airport), ("arrival_scheduled", r.arrival_airport)):
            add("flights", r.id, f, getattr(r, f), places.get(key(a)))
    homes = {r.name: zones.get(r.country) for r in load("stations", d).itertuples(index=False)}
    for r in load("train_routes", d).itertuples():
        if r.route_origin in homes:
            add("train_routes", r.id, "departure_time", r.departure_time, homes[r.route_origin], r.search_date)
    return out


def test_p6_against_brute_force(spark):
    got = [tuple(r) for r in found.p6_found(spark, D).select("table_name", "id", "field", "epoch_ms").collect()]
    want = brute_p6(D)
    assert len(got) == len(set(got))
    assert set(got) == want


def test_p6_estimates_meet_the_declared_zones(spark):
    for r in found.p6_zones(spark, D).collect():
        if r["n"]:
            assert r["zone"] == r["declared"] and r["source"] == "evidence" and r["violations"] * 50 <= r["n"], r


def test_p6_rows_follow_the_estimate(spark, monkeypatch):
    """Another estimate gives other instants: the rows come through it."""
    d = "/root/testdata/sf0.001"
    before = {tuple(r) for r in found.p6_found(spark, d).collect()}
    real = found.estimate_zones
    monkeypatch.setattr(found, "estimate_zones", lambda *a: real(*a).withColumn("zone", F.lit("Asia/Tokyo")))
    after = {tuple(r) for r in found.p6_found(spark, d).collect()}
    assert len(after) == len(before) and len(after - before) > len(before) / 2


def test_p5_against_all_pairs(spark):
    a = load("airports", "/root/testdata/sf0.001")
    a = a[a.latitude_deg.between(-90, 90) & a.longitude_deg.between(-180, 180) & ~((a.latitude_deg == 0) & (a.longitude_deg == 0))]
    rows = list(a[["id", "latitude_deg", "longitude_deg"]].itertuples(index=False))

    def km(p, q):
        f1, f2, dl = math.radians(p[1]), math.radians(q[1]), math.radians(q[2] - p[2])
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin((f2 - f1) / 2) ** 2 + math.cos(f1) * math.cos(f2) * math.sin(dl / 2) ** 2)))

    want = {(int(min(p[0], q[0])), int(max(p[0], q[0]))) for i, p in enumerate(rows) for q in rows[:i] if km(p, q) <= 5}
    assert {tuple(r) for r in found.p5_found(spark, "/root/testdata/sf0.001").collect()} == want


@pytest.mark.parametrize("name", ["p3_found", "p3_cascade", "p3_report"])
def test_p3_runs_on_the_smallest_tables(spark, name):
    assert found.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
