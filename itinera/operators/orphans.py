"""References to records that do not exist, with the cascade to what depends on them.

``find_orphans`` takes tables and a foreign-key graph.  Direct orphans are rows whose
reference is stated but names no parent; rows that refer to an orphaned record are
inherited orphans, found by semi-joins down the graph until no round adds a record.

Both sides of a comparison go through the same key expression, so references may be
compared in a normal form.  Defined results: a null or blank reference is no reference;
a reference without any letter or digit names nothing and is an orphan; an empty parent
table orphans every stated reference; repeated parent keys count once; a row at fault
in several fields has one row for each; columns of the tables play no part beyond those
named, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itinera.functions.text import alnum_key, not_blank
from itinera.session import cut, small


@dataclass(frozen=True)
class ForeignKey:
    """``child.field`` names ``parent.key``."""

    child: str
    field: str
    parent: str
    key: str


def _keys(df: DataFrame, fk: ForeignKey, form: Callable[[Column], Column]) -> DataFrame:
    key = F.col(fk.key).cast("string")
    return df.where(not_blank(key)).select(form(key).alias("ref")).where("ref <> ''").distinct()


def find_orphans(
    tables: dict[str, DataFrame], ids: dict[str, str], keys: Sequence[ForeignKey], form: Callable[[Column], Column] = alnum_key
) -> DataFrame:
    """table_name, id, field, ref, kind ("direct" or "inherited"), round (0 for direct).

    The references of one child to one parent key are unpivoted and anti-joined in one
    pass.  Parents are broadcast only if counted small; else the join shuffles and
    adaptive execution splits hot references.  A parent that exists twice is orphaned
    only if all its rows are.

    The fixpoint runs over the tables that are both parent and child, in a narrow form
    (ids and references) that is written once: a round joins the rows orphaned in the last
    one with it and touches nothing else.  It ends when a round orphans no row, after as many
    rounds as the longest chain has links.  Tables that nothing refers to, mostly the large
    ones, take no part: they meet the parents that died, of any round, in one join at the end.
    """
    groups = _grouped(keys)
    passing = {fk.parent for fk in keys} & {fk.child for fk in keys}
    parents = {}
    for (_, parent, key), group in groups.items():
        if (parent, key) not in parents:
            parents[parent, key] = small(cut(_keys(tables[parent], group[0], form)))

    def refs_of(child: str, group: list[ForeignKey]) -> DataFrame:
        return _unpivoted(tables[child], ids[child], child, [fk.field for fk in group], form)

    refs = {k: cut(refs_of(k[0], group)) if k[0] in passing else refs_of(k[0], group) for k, group in groups.items()}
    out = ["table_name", "id", "field", "ref"]
    found = [refs[k].join(parents[k[1:]], "ref", "left_anti").select(*out, F.lit("direct").alias("kind"), F.lit(0).alias("round")) for k in groups]
    if not passing:
        return _union(found)
    # Of the parents that can be orphaned: the references that name a row, and how many rows bear each.
    named = {k: cut(_named(tables[k[0]], ids[k[0]], k[1], form)) for k in parents if k[0] in passing}
    bearers = {k: cut(rows.groupBy("ref").agg(F.count("*").alias("rows"))) for k, rows in named.items()}
    frontier = cut(_union([df for k, df in zip(groups, found, strict=True) if k[0] in passing]).select("table_name", "id").distinct())
    seen, lost = frontier, {}
    dead: list[DataFrame] = []
    for n in count(1):  # ends: no row is in two frontiers
        if frontier.isEmpty():
            break
        steps = []
        for k, rows in named.items():
            fresh = frontier.where(F.col("table_name") == k[0]).select("id")
            went = rows.join(small(fresh), "id", "left_semi").groupBy("ref").agg(F.count("*").alias("n"))
            # References whose rows went in several rounds die with the last of them.
            if k in lost:
                before = lost[k].groupBy("ref").agg(F.sum("n").alias("before"))
                went = went.join(before, "ref", "left")
            else:
                went = went.withColumn("before", F.lit(None).cast("bigint"))
            went = cut(went.join(bearers[k], "ref"))
            lost[k] = _grown(lost.get(k), went.select("ref", "n"), n)
            died = went.where(F.col("n") + F.coalesce("before", F.lit(0)) == F.col("rows")).select("ref", F.lit(n).alias("round"))
            dead.append(died.select(F.lit(k[0]).alias("_parent"), F.lit(k[1]).alias("_key"), "ref", "round"))
            steps += [refs[g].join(small(died), "ref").select(*out, F.lit("inherited").alias("kind"), "round") for g in groups if g[1:] == k and g[0] in passing]
        if not steps:
            break
        step = cut(_union(steps))
        found.append(step)
        frontier = cut(step.select("table_name", "id").distinct().join(seen, ["table_name", "id"], "left_anti"))
        seen = _grown(seen, frontier, n)
    if dead:
        died = cut(_union(dead))
        for g in groups:
            if g[0] not in passing and g[1] in passing:
                own = died.where((F.col("_parent") == g[1]) & (F.col("_key") == g[2])).select("ref", "round")
                found.append(refs[g].join(small(own), "ref").select(*out, F.lit("inherited").alias("kind"), "round"))
    return _union(found)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _grown(before: DataFrame | None, more: DataFrame, rounds: int) -> DataFrame:
    """A log of rounds; written as one table every so often, so its plan stays short."""
    if before is None:
        return more
    both = before.unionByName(more)
    return cut(both) if rounds % 16 == 0 else both


def _named(df: DataFrame, row_id: str, key: str, form: Callable[[Column], Column]) -> DataFrame:
    """id, ref of the rows of a parent that bear a key."""
    raw = F.col(key).cast("string")
    return df.where(not_blank(raw)).select(F.col(row_id).cast("bigint").alias("id"), form(raw).alias("ref")).where("ref <> ''")


def _grouped(keys: Sequence[ForeignKey]) -> dict[tuple[str, str, str], list[ForeignKey]]:
    out: dict[tuple[str, str, str], list[ForeignKey]] = {}
    for fk in keys:
        out.setdefault((fk.child, fk.parent, fk.key), []).append(fk)
    return out


def _unpivoted(df: DataFrame, row_id: str, child: str, fields: Sequence[str], form: Callable[[Column], Column]) -> DataFrame:
    """One row per stated reference of the child's fields, from one scan."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("raw")) for f in fields])
    flat = df.select(F.col(row_id).cast("bigint").alias("id"), F.explode(pairs).alias("_p")).select("id", "_p.field", "_p.raw")
    return flat.where(not_blank(F.col("raw"))).select(F.lit(child).alias("table_name"), "id", "field", form(F.col("raw")).alias("ref"))


def orphan_report(orphans: DataFrame, child: DataFrame, row_id: str, period: str) -> DataFrame:
    """Orphan references of one child table per field, kind and period."""
    when = child.select(F.col(row_id).cast("bigint").alias("id"), F.col(period).alias("period"))
    return orphans.join(when, "id").groupBy("table_name", "field", "kind", "period").agg(F.count("*").alias("orphans"))
