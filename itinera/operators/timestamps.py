"""Mixed timestamp texts and time zones into one UTC instant.

``read_times`` takes a text apart with built-in expressions: one regular expression per
family of styles rewrites it to fixed fields.  ``estimate_zones`` finds the zone of
sources that state local times only: each candidate's offset history converts the local
times, a violation is an instant outside the window that its evidence allows (ingestion
time, or the order of times in one record), and the history with the fewest wins.
``to_instant`` converts.  Everything is independent of the session's time zone.

Defined results: null, blank and texts without a real date and time of day have no
instant; digits finer than milliseconds are cut off; day comes before month where the
year comes last; a local time that occurs twice means the first, one that is skipped
moves on by the hour skipped; times that state an offset need no zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itinera.functions.text import squeeze
from itinera.session import cut

#: Minutes east of Greenwich of the zone letters used in Europe.
ZONE_LETTERS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120,
    "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "OEZ": 120, "OESZ": 180, "TRT": 180, "FET": 180, "MSK": 180, "SAMT": 240,
    "AZOT": -60, "AZOST": 0,
}
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

_CLOCK = r"(\d{1,2})(?:\s*[:.hH]\s*|(?<=\d\d)(?=\d\d))(\d{2})(?:[:.]?(\d{2})(?:[.,](\d+))?)?\s*([AaPp]\.?[Mm]\.?)?"
_ZONE = r"\s*(?:([Zz]|[A-Za-z]{2,5})|(?:(?:UTC|GMT)\s*)?([+-])(\d{2}):?(\d{2})?)?\s*(?:\[[A-Za-z0-9_+/-]+\])?"
_GAP = r"(?:\s*[Tt]\s*|\s*,\s*|\s+)"
#: Family -> (pattern, fields in the order year month day hour minute second fraction half letters sign oh om).
_FAMILIES = {
    "year_first": (rf"^(\d{{4}})([-/.]?)(\d{{2}})\2(\d{{2}}){_GAP}{_CLOCK}{_ZONE}$", "$1|$3|$4|$5|$6|$7|$8|$9|$10|$11|$12|$13"),
    "year_last": (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}){_GAP}{_CLOCK}{_ZONE}$", "$4|$3|$1|$5|$6|$7|$8|$9|$10|$11|$12|$13"),
    "month_day": (rf"^([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s*(\d{{4}}){_GAP}{_CLOCK}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10|$11|$12"),
    "day_month": (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})\.?[\s-]+([A-Za-z]{{3,9}})\.?,?[\s-]+(\d{{4}}){_GAP}{_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10|$11|$12"),
}
_TIME_ONLY = (rf"^{_CLOCK}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9")


def _int(c: Column) -> Column:
    return c.try_cast("int")


def read_times(df: DataFrame, text: str, date_text: str | None = None) -> DataFrame:
    """``df`` with wall_ms (the wall clock as if it were UTC) and offset_min (null: not stated).

    Both are null where the text states no real date and time.  Epoch numbers of 10 and 13
    digits have offset 0.  With the column ``date_text`` a time of day alone, or four digits,
    is placed on that date.  The steps are columns of their own so that each regular
    expression runs once a row; scratch columns start with ``_rt_`` and are dropped, and columns
    of ``df`` by these names are replaced, unless they hold the texts.
    """
    df = df.drop(*[c for c in df.columns if (c in ("wall_ms", "offset_min") or c.startswith("_rt_")) and c not in (text, date_text)])
    s = F.col("_rt_text")
    fields = F.lit(None).cast("string")
    if date_text is not None:
        day = F.regexp_replace(squeeze(F.col(date_text)), r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$", "$3-$2-$1")
        day = F.when(day.rlike(r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$"), F.regexp_replace(day, r"[-/.]", "|"))
        fields = F.when(s.rlike(_TIME_ONLY[0]), F.concat(day, F.lit("|"), F.regexp_replace(s, *_TIME_ONLY)))
    first, *others = _FAMILIES.values()
    for pattern, out in reversed(others):
        fields = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, out)).otherwise(fields)
    # Most texts are of the first family: one expression both tests and rewrites them, as a rewritten text is never the text.
    tried = F.col("_rt_first")
    fields = F.when(tried != s, tried).otherwise(fields)
    f = F.col("_rt_f")
    month = F.coalesce(_int(f[1]), _int(F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.substring(f[1], 1, 3)))))
    hour, half = _int(f[3]), F.lower(F.substring(f[7], 1, 1))
    hour24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    letters = F.upper(f[8])
    zones = F.create_map(*[F.lit(x) for kv in ZONE_LETTERS.items() for x in kv])
    numeric = (_int(f[10]) * 60 + F.coalesce(_int(f[11]), F.lit(0))) * F.when(f[9] == "-", -1).otherwise(1)
    parts = {
        "y": _int(f[0]), "mo": month, "d": _int(f[2]), "h": hour24, "mi": _int(f[4]), "s": F.when(f[5] == "", 0).otherwise(_int(f[5])),
        "ms": _int(F.rpad(F.substring(f[6], 1, 3), 3, "0")), "o": F.when(letters != "", F.try_element_at(zones, letters)).when(f[9] != "", numeric), "stated": (letters != "") | (f[9] != ""),
    }
    y, mo, d, h, mi, sec, ms, o, stated = (F.col(f"_rt_{k}") for k in parts)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    days = F.when(mo == 2, F.when(leap, 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)
    real = (y >= 1) & mo.between(1, 12) & (d >= 1) & (d <= days) & h.between(0, 23) & mi.between(0, 59) & sec.between(0, 59)
    ok = F.coalesce(real & (~stated | (F.abs(o) <= 1080)), F.lit(False))
    day = F.unix_date(F.make_date(F.when(F.col("_rt_ok"), y), F.when(F.col("_rt_ok"), mo), F.when(F.col("_rt_ok"), d))).cast("bigint")
    wall = ((day * 24 + h) * 60 + mi) * 60_000 + sec * 1000 + ms
    number = F.when(s.rlike(r"^\d{10}$"), s.try_cast("bigint") * 1000).when(s.rlike(r"^\d{13}$"), s.try_cast("bigint"))
    out = df.withColumn("_rt_text", squeeze(F.col(text)))
    if text in ("wall_ms", "offset_min"):
        out = out.drop(text)
    out = _step(out, {"_rt_first": F.regexp_replace(s, *first)})
    out = _step(out, {"_rt_f": F.split(fields, r"\|", -1), "_rt_n": number})
    out = _step(out, {f"_rt_{k}": v for k, v in parts.items()})
    out = _step(out, {"_rt_ok": ok})
    out = _step(out, {"wall_ms": F.coalesce("_rt_n", F.when(F.col("_rt_ok"), wall)), "offset_min": F.when(F.col("_rt_n").isNotNull(), 0).otherwise(F.when(F.col("_rt_ok"), o))})
    return out.drop("_rt_text", "_rt_first", "_rt_f", "_rt_n", "_rt_ok", *[f"_rt_{k}" for k in parts])


def _step(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with the columns, worked out once: filters on them aren't rewritten into their definitions.

    The optimiser pushes a filter through projections by repeating their expressions, here
    hundreds of times over; it doesn't through a generator, and inlining an array of one
    struct is one that makes no rows.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def local_to_utc(ms: Column, zone: Column) -> Column:
    """UTC milliseconds of a local wall clock: the first of two, forward over a gap; null without a zone."""
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(ms), zone))


def to_instant(wall_ms: Column, offset_min: Column, zone: Column) -> Column:
    """UTC milliseconds; times without a stated offset are local to ``zone`` (null without one)."""
    return F.when(offset_min.isNotNull(), wall_ms - offset_min.cast("bigint") * 60_000).otherwise(local_to_utc(wall_ms, zone))


#: Minutes beyond which no zone lies; bounds on an offset are clipped to one more.
_FAR = 1081
#: Most candidate zones; each is one expression of the aggregation that tries them.
MOST_ZONES = 1000


def _offset(hour: Column, zone: str) -> Column:
    """Minutes east of Greenwich of a zone at a local hour."""
    local = hour * 3_600_000
    return (local - local_to_utc(local, F.lit(zone))) / 60_000


def histories(hours: DataFrame, zones: list[str]) -> dict[str, str]:
    """zone -> the first of the zones (in sorted order) that have its offsets at all of the local hours (column hour).

    Offsets are compared by a digest over the hours, whichever years these lie in, so the driver gets one row.
    """
    tried = sorted(set(zones))
    if len(tried) > MOST_ZONES:
        raise ValueError(f"more than {MOST_ZONES} candidate zones")
    digest = hours.select("hour").distinct().agg(*[F.struct(F.bit_xor(F.xxhash64("hour", _offset(F.col("hour"), z))), F.sum(_offset(F.col("hour"), z))).alias(z) for z in tried]).first()
    first: dict[tuple, str] = {}
    return {z: first.setdefault(tuple(digest[z]), z) for z in tried}


def estimate_zones(observed: DataFrame, zones: list[str], declared: DataFrame | None = None) -> DataFrame:
    """For each group the zone of fewest violations: group, zone, n, violations, runner_up, declared_violations.

    ``observed``: group, local_ms, lo_ms, hi_ms - a local wall clock and the UTC window that
    its evidence leaves (either bound may be null).  An observation says that the offset in
    its local hour lies between two whole minutes; equal statements are counted before the
    shuffle, so the histories are tried on a table of groups, hours and bounds, not of
    observations.  Candidates with equal offsets at all observed hours are one history.
    Among histories of equally few violations the one of the group's ``declared`` zone
    (group, zone) wins and is named by it, else the one whose zone sorts first.
    runner_up: the fewest violations of any other history.  Groups without observations have
    no row.  Offsets are taken to change on the hour of the local clock.
    """
    spark = observed.sparkSession
    most = F.coalesce(F.least(F.floor((F.col("local_ms") - F.col("lo_ms")) / 60_000), F.lit(_FAR)), F.lit(_FAR))
    least = F.coalesce(F.greatest(F.ceil((F.col("local_ms") - F.col("hi_ms")) / 60_000), F.lit(-_FAR)), F.lit(-_FAR))
    bounds = observed.select("group", F.floor(F.col("local_ms") / 3_600_000).alias("hour"), F.greatest(most, F.lit(-_FAR)).alias("most"), F.least(least, F.lit(_FAR)).alias("least"))
    stated = cut(bounds.groupBy("group", "hour", "most", "least").agg(F.count("*").alias("n")))
    schema = "group string, zone string, n bigint, violations bigint, runner_up bigint, declared_violations bigint"
    if not zones or stated.isEmpty():
        return spark.createDataFrame([], schema)
    history = histories(stated, zones)
    tried = sorted(set(history.values()))
    tests = []
    for z in tried:
        offset = _offset(F.col("hour"), z)
        bad = (offset > F.col("most")) | (offset < F.col("least"))
        tests.append(F.sum(F.when(bad, F.col("n")).otherwise(0)).alias(z))
    counted = stated.groupBy("group").agg(F.sum("n").alias("n"), *tests)
    if declared is None:
        named = counted.withColumn("own", F.lit(None).cast("string"))
    else:
        # A row per group either way; groups without a declared zone keep their row.
        named = counted.join(declared.groupBy("group").agg(F.min("zone").alias("own")), "group", "left")
    of = F.create_map(*[F.lit(x) for kv in history.items() for x in kv])
    own = F.try_element_at(of, F.col("own"))
    # Struct order decides: fewest violations, then the declared history, then the name.
    scored = F.array_sort(F.array(*[F.struct(F.col(f"`{z}`").alias("violations"), F.when(own == z, 0).otherwise(1).alias("other"), F.lit(z).alias("zone")) for z in tried]))
    best = named.select("group", "n", "own", scored.alias("s"))
    first = F.col("s")[0]
    return best.select(
        "group", F.when(first.other == 0, F.col("own")).otherwise(first.zone).alias("zone"), "n", first.violations.alias("violations"), F.try_element_at("s", F.lit(2)).violations.alias("runner_up"),
        F.try_element_at(F.filter("s", lambda x: x.other == 0), F.lit(1)).violations.alias("declared_violations"),
    )
