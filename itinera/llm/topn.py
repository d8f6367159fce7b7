"""Top N items within every group: two-stage salted ranking.

Stage one hashes each group into subgroups by the item's identifier and keeps the N best
of each, so that a group of any size is ranked by as many tasks as there are subgroups
(and the rank limit already applies before the shuffle).  Stage two ranks the survivors,
at most N x subgroups a group.

Order: higher score first, then smaller identifier; -0.0 equals 0.0.
Defined results: rows whose score is null, NaN or one of ``not_scores`` and rows whose
group is null or blank are no candidates; infinite scores count; rows that are equal in
all columns each count and take places of their own; fewer than N candidates give fewer
places; an empty table gives none; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itinera.functions.text import not_blank
from itinera.session import salt


def top_n(df: DataFrame, group: str, score: str, item: str, n: int, not_scores: Sequence[float] = (), salts: int = 32) -> DataFrame:
    """``group``, place (1..n), ``item``, ``score`` of the n best items of every group."""
    value = F.col(score).cast("double")
    scored = df.select(F.col(group).alias("_g"), F.col(item).alias("_i"), (value + F.lit(0.0)).alias("_s"))
    valid = not_blank(F.col("_g").cast("string")) & F.col("_s").isNotNull() & ~F.isnan("_s")
    for x in not_scores:
        valid &= F.col("_s") != F.lit(float(x))
    order = [F.desc("_s"), F.asc_nulls_last("_i")]
    first = Window.partitionBy("_g", "_salt").orderBy(*order)
    kept = scored.where(valid).withColumn("_salt", salt(F.col("_i"), salts)).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n)
    final = Window.partitionBy("_g").orderBy(*order)
    placed = kept.drop("_salt", "_r").withColumn("place", F.row_number().over(final)).where(F.col("place") <= n)
    return placed.select(F.col("_g").alias(group), "place", F.col("_i").alias(item), F.col("_s").alias(score))
