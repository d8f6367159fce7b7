"""Sources mixed to target shares: certain whole copies, then Pareto order sampling.

Every source gets a budget of size (tokens): its target share of the total.  A source
whose budget holds all its documents k times hands out k whole copies of each, which is
certain; what is left of the budget is drawn.  The draw is Pareto order sampling: every
document has an inclusion probability proportional to its weight, and documents are taken
in the order of the odds of a uniform number divided by the inclusion odds, until the
budget's size is reached.  The uniform number is a hash of the id and the seed, so the
sample is the same on every run.

A document of inclusion probability 1 ranks first.  The cut is found without sorting a
source: sizes are summed by source and fine buckets of the rank (combined before the
shuffle), and only the bucket that holds the cut is ranked row by row.

The total defaults to the largest for which every source with documents can meet its share
without exceeding its cap on repeats.  Targets are set against each other among the sources
that have documents, so a target without documents leaves the others' ratios unchanged.

Defined results: source names are compared without case and surrounding white space; a
document without source, or of a source without target, isn't chosen; null or zero sizes
are never drawn and take part only in whole copies; targets that are null, not positive or
allow no use choose nothing; a repeated target counts once (largest share); ties of rank
are ordered by id; empty tables choose nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itinera.functions.text import squeeze
from itinera.session import cut

#: Buckets of the logarithm of the rank per source.
BUCKETS = 4096
#: Most targets that are held on the driver.
MOST_SOURCES = 10_000


def source_key(c: Column) -> Column:
    return F.lower(squeeze(c))


def uniform(row_id: Column, seed: int) -> Column:
    """A number inside (0, 1) that depends on the id and the seed alone."""
    return (F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def budgets(totals: dict[str, float], targets: dict[str, tuple[float, int]], total: float | None) -> dict[str, tuple[float, int, float]]:
    """source -> (budget, whole copies, rest of the budget).

    totals: source -> size of its documents; targets: source -> (share, most repeats).
    """
    live = {s: (share, most) for s, (share, most) in targets.items() if share and share > 0 and most > 0 and totals.get(s, 0) > 0}
    whole = sum(share for share, _ in live.values())
    if not live:
        return {}
    reach = min(totals[s] * most * whole / share for s, (share, most) in live.items())
    aim = reach if total is None else min(total, reach)
    out = {}
    for s, (share, most) in live.items():
        budget = aim * share / whole
        copies = min(most, int(budget / totals[s] + 1e-9))
        out[s] = (budget, copies, max(0.0, budget - copies * totals[s]) if copies < most else 0.0)
    return out


def mix(
    documents: DataFrame, row_id: str, source: str, size: str, targets: DataFrame, total: float | None = None, seed: int = 17, power: float = 0.5
) -> DataFrame:
    """id, source (its key), size, repeats (1 and up) of the chosen documents.

    ``targets``: source, target_share, max_repeats.  The weight of a document is its size to
    the ``power``: 0 draws all alike, 1 in proportion to size.
    """
    spark = documents.sparkSession
    docs = cut(
        documents.select(F.col(row_id).alias("id"), source_key(F.col(source)).alias("source"), F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("bigint"), F.lit(0).cast("bigint")).alias("size")).where("source is not null and id is not null")
    )
    wanted = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share is not null and max_repeats is not null")
    wanted = wanted.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most")).limit(MOST_SOURCES + 1).collect()
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} targets")
    target = {r["source"]: (r["share"], r["most"]) for r in wanted}
    if not target:
        return docs.limit(0).withColumn("repeats", F.lit(0))
    named = docs.join(F.broadcast(spark.createDataFrame([(t,) for t in sorted(target)], "source string")), "source")
    weight = F.pow(F.col("size").cast("double"), F.lit(power))
    # Sizes by source and sixteenth of a power of two: all the driver needs for budgets and inclusion probabilities.
    step = F.floor(F.log2(F.col("size").cast("double")) * 16)
    histogram: dict[str, list] = {}
    for r in named.where("size > 0").groupBy("source", step.alias("b")).agg(F.sum("size").alias("s"), F.sum(weight * F.col("size")).alias("ws"), F.min(weight).alias("w")).collect():
        histogram.setdefault(r["source"], []).append(r)
    plan = budgets({s: float(sum(r["s"] for r in rows)) for s, rows in histogram.items()}, target, total)
    if not plan:
        return docs.limit(0).withColumn("repeats", F.lit(0))
    # Inclusion probability: scale x weight, capped at 1; the scale makes the expected size the rest of the budget.
    scale = {s: _scale(histogram[s], rest) if rest > 0 else 0.0 for s, (_, _, rest) in plan.items()}
    known = spark.createDataFrame([(s, c, rest, scale[s]) for s, (_, c, rest) in plan.items()], "source string, copies int, rest double, scale double")
    able = named.join(F.broadcast(known), "source").withColumn("p", F.least(weight * F.col("scale"), F.lit(1.0)))
    u = uniform(F.col("id"), seed)
    odds = F.log(u / (1 - u)) - F.log(F.col("p") / (1 - F.col("p")))
    order = F.when(F.col("p") >= 1, F.lit(-1e9) + u).when(F.col("p") > 0, odds)
    drawn = able.withColumn("rank_key", order)
    # A fine bucket of the rank, by the logistic function so that the buckets' edges are fixed; certain documents have as many below.
    place = F.when(F.col("rank_key") <= -1e8, F.floor((F.col("rank_key") + 1e9) * BUCKETS) - BUCKETS).otherwise(F.least(F.floor(F.lit(float(BUCKETS)) / (1 + F.exp(-F.col("rank_key") / 2))), F.lit(BUCKETS - 1))).cast("int")
    drawn = drawn.withColumn("bucket", F.when(F.col("rank_key").isNotNull() & (F.col("rest") > 0), place))
    cuts = drawn.where("bucket is not null").groupBy("source", "bucket").agg(F.sum("size").alias("s"), F.first("rest").alias("rest"))
    running = F.sum("s").over(Window.partitionBy("source").orderBy("bucket"))
    edge = cuts.withColumn("upto", running).where("upto >= rest").groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("s")).alias("before"))).alias("e"))
    edge = edge.select("source", F.col("e.bucket").alias("edge"), F.col("e.before").alias("before"))
    edges = spark.createDataFrame([tuple(r) for r in edge.collect()], "source string, edge int, before bigint")
    placed = drawn.join(F.broadcast(edges), "source", "left")
    sure = placed.where("edge is null or bucket is null or bucket <> edge").withColumn("extra", F.coalesce((F.col("bucket") < F.coalesce("edge", F.lit(BUCKETS))).cast("int"), F.lit(0)))
    # Within the edge: take a document while more than half of it is still within the budget.
    within = Window.partitionBy("source").orderBy("rank_key", "id").rowsBetween(Window.unboundedPreceding, 0)
    split = placed.where("bucket = edge").withColumn("at", F.col("before") + F.sum("size").over(within)).withColumn("extra", (F.col("at") - F.col("size") / 2 <= F.col("rest")).cast("int")).drop("at")
    return sure.unionByName(split).select("id", "source", "size", (F.col("copies") + F.col("extra")).alias("repeats")).where("repeats > 0")


def _scale(rows: list, rest: float) -> float:
    """The factor for which the sum of min(1, factor x weight) x size is ``rest``, by bisection.

    ``rows`` is a source's histogram of log2(size) in 1/16 steps: at most about a thousand rows.
    """
    lo, hi = 0.0, max(1.0 / max(min(r["w"] for r in rows), 1e-12), 1e-12) * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        held = sum(min(float(r["s"]), mid * r["ws"]) for r in rows)
        lo, hi = (mid, hi) if held < rest else (lo, mid)
    return hi


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: documents, uses, most repeats, size used, target and actual share."""
    used = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("repeats").alias("uses"), F.max("repeats").alias("most"), F.sum(F.col("size") * F.col("repeats")).alias("size"))
    whole = used.agg(F.sum("size").alias("whole"))
    wanted = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    joined = wanted.join(used, "source", "left").join(F.broadcast(whole))
    size = F.coalesce("size", F.lit(0))
    return joined.select("source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "uses", "most")], size.alias("size"), F.when(F.col("whole") > 0, size / F.col("whole")).otherwise(0.0).alias("actual_share"))
