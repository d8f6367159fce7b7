"""Scalar functions of the transit domain; every one is a built-in expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from itinera.operators.graph import change_minutes

# Words that name no place of their own, and words that raise or lower a stop's weight.
GENERIC_TOKENS = [
    "aeroport", "aéroport", "airport", "bahnhof", "bf", "cfl", "eurostar", "gare", "hb", "hbf", "hl", "international", "intl", "rer", "sbb", "sncf", "station", "stn", "ter", "tgv",
]
IMPORTANT_WORDS = ["central", "centraal", "centrale", "centre-ville", "city", "hauptbahnhof", "international", "intl", "main station", "stazione centrale", "termini"]
MINOR_WORDS = ["eglise", "église", "halt", "halte", "haltestelle", "mairie", "stop", "village"]
#: Minutes east of UTC in summer by group of countries; others have 60.
OFFSET_GROUPS = {0: ["GB", "IE", "IS", "PT"], 120: ["BG", "CY", "EE", "FI", "GR", "LT", "LV", "MD", "RO", "UA"], 180: ["BY", "RU", "TR"]}

ROUTE_TYPE = "array<struct<origin:string,dest:string,dep_time:bigint,arr_time:bigint>>"


def station_name(label: Column) -> Column:
    """The label without a trailing country in parentheses."""
    return F.trim(F.regexp_replace(label, r"\s*\([^()]*\)\s*$", ""))


def label_country(label: Column) -> Column:
    """The last parenthesised group of the label, or null."""
    return F.nullif(F.regexp_extract(label, r"\(([^()]*)\)\s*$", 1), F.lit(""))


def station_code(name: Column) -> Column:
    """First word if it has three letters or digits, else the first run of 3 or 4 capitals or digits, else the name."""
    first = F.split_part(F.trim(name), F.lit(" "), F.lit(1))
    run = F.regexp_extract(name, r"\b[A-Z0-9]{3,4}\b", 0)
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", "").when(first.rlike(r"^[A-Za-z0-9]{3}$"), first).when(run != "", run).otherwise(F.trim(name))


def modality(code: Column) -> Column:
    """A for an airport's three capitals, else R."""
    return F.when(code.rlike(r"^[A-Z]{3}$"), "A").otherwise("R")


def transport_type(from_code: Column, to_code: Column) -> Column:
    return F.when((modality(from_code) == "A") & (modality(to_code) == "A"), "flight").otherwise("train")


def normal_tokens(name: Column) -> Column:
    """Lower-case words without punctuation and generic words, unless there are no others."""
    words = F.filter(F.split(F.regexp_replace(F.lower(name), r"[()\[\],.-]+", " "), r"\s+"), lambda w: w != "")
    own = F.filter(words, lambda w: ~w.isin(GENERIC_TOKENS))
    return F.when(F.size(own) > 0, own).otherwise(words)


def normal_station(name: Column) -> Column:
    return F.regexp_replace(F.array_join(normal_tokens(name), ""), r"[^a-z0-9]+", "")


def name_score(name: Column) -> Column:
    """+3 for each important word that the name holds, -2 for each minor one."""
    low = F.lower(name)
    out = F.lit(0)
    for words, gain in ((IMPORTANT_WORDS, 3), (MINOR_WORDS, -2)):
        for w in words:
            out = out + F.when(F.contains(low, F.lit(w)), gain).otherwise(0)
    return out


def utc_offset(country: Column, override: Column | None = None) -> Column:
    """Minutes by override, else group of countries, else 60."""
    out = F.lit(60)
    for minutes, codes in OFFSET_GROUPS.items():
        out = F.when(country.isin(codes), minutes).otherwise(out)
    return out if override is None else F.coalesce(override, out)


def known_or_null(c: Column) -> Column:
    """Null for the spellings of a missing name."""
    t = F.trim(c)
    return F.when(F.lower(t).isin("", "unknown", "nan", "none", "null"), None).otherwise(t)


def minutes_of(text: Column) -> Column:
    """Minute of the day of HH:MM, null if it is no such text."""
    ok = text.rlike(r"^\s*([01]?\d|2[0-3]):[0-5]\d\s*$")
    t = F.trim(text)
    return F.when(ok, F.split_part(t, F.lit(":"), F.lit(1)).try_cast("bigint") * 60 + F.split_part(t, F.lit(":"), F.lit(2)).try_cast("bigint"))


def clock_of(minutes: Column) -> Column:
    """HH:MM of a minute on any day, also before day one."""
    m = F.pmod(minutes, F.lit(1440))
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))


def day_clock_of(minutes: Column) -> Column:
    return F.concat(F.lit("Day "), (F.floor(minutes / 1440) + 1).cast("string"), F.lit(", "), clock_of(minutes))


def decimal_comma(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), ",", ".").try_cast("double")


def transfer_margin(buffer: Column, transit: Column, from_mode: Column, to_mode: Column, same: Column) -> Column:
    return buffer - transit - change_minutes(from_mode, to_mode, same)


def transfer_score(margin: Column) -> Column:
    """100 (1 - e^(-0.05 m)), or 1000 m if the margin is negative."""
    return F.when(margin >= 0, 100 * (1 - F.exp(-0.05 * margin))).otherwise(margin * 1000.0)


def route_of(text: Column) -> Column:
    """Segments of a route text; null if it is no list."""
    return F.from_json(text, ROUTE_TYPE)


def rollover(clocks: Column) -> Column:
    """Absolute minutes of a list of clock minutes: a day is added whenever the clock goes back."""
    start = F.struct(F.lit(0).cast("bigint").alias("base"), F.lit(None).cast("bigint").alias("prev"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        base = acc.base + F.when(x < acc.prev, F.lit(1440).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        return F.struct(base.alias("base"), x.alias("prev"), F.concat(acc.out, F.array(base + x)).alias("out"))

    return F.aggregate(clocks, start, step, lambda acc: acc.out)


def holds_all(text: Column, terms: Sequence[str]) -> Column:
    """All terms occur in the text, without regard to case."""
    return F.forall(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower(text), t)) if terms else F.lit(True)


def known_name(iso: Column, names: Column, relabelled: dict[str, str] | None = None) -> Column:
    """A country's name, by another label for some codes."""
    out = names
    for code, label in (relabelled or {}).items():
        out = F.when(iso == code, label).otherwise(out)
    return out


def file_name(origin: Column, dest: Column, date: Column) -> Column:
    """origin_dest_date.csv: blanks become underscores, commas and brackets go, dots of the date become underscores."""
    clean = lambda c: F.regexp_replace(F.replace(c, F.lit(" "), F.lit("_")), "[,()]", "")
    return F.concat(F.concat_ws("_", clean(origin), clean(dest), F.replace(date, F.lit("."), F.lit("_"))), F.lit(".csv"))


def collapsed(items: Column) -> Column:
    """An array without entries that repeat the one before; nulls are left out."""
    there = F.filter(items, lambda x: x.isNotNull())
    return F.filter(there, lambda x, i: (i == 0) | (F.try_element_at(there, i.cast("int")) != x))
