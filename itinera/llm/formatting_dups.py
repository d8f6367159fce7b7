"""Duplicates hidden by formatting: dictionary-encoded columns, grouped integer tuples.

Every field gets a dictionary: its distinct values, each brought to canonical form once,
and an integer for each canonical form.  Records are rewritten as sorted tuples of
field-value integers, and equal tuples are grouped; the tuples' counts are combined before
the shuffle, so copies of one record are never gathered in one task.

Integers are given without a global sort and the same way on every run: canonical forms
are spread over hash buckets and numbered within their bucket.

Defined results: null is a value of its own, equal to null and to nothing else; values
without letters and digits have the canonical form "" and are equal to each other; very
long values count whole; every row is in exactly one group; ids are taken as unique (rows
that repeat an id are copies of their group like others); an empty table has no groups;
columns that aren't named play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itinera.session import BROADCAST_ROWS, cut, small

#: Buckets in which canonical forms are numbered, and the bits for the number within one.
BUCKETS, BITS = 4096, 38


def dictionaries(df: DataFrame, forms: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """field (its number), raw, code: the distinct non-null values of every field and the integer of their canonical form.

    One scan serves all fields: values are unpivoted and made distinct before the shuffle.
    """
    cells = F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).cast("string").alias("raw")) for k, c in enumerate(forms)])
    raw = df.select(F.inline(cells)).where("raw is not null").distinct()
    form = F.lit(None).cast("string")
    for k, f in enumerate(forms.values()):
        form = F.when(F.col("field") == k, f(F.col("raw"))).otherwise(form)
    bucket = F.pmod(F.xxhash64("form"), F.lit(BUCKETS))
    dense = F.dense_rank().over(Window.partitionBy("field", "bucket").orderBy("form"))
    return raw.withColumn("form", form).withColumn("bucket", bucket).select("field", "raw", (F.shiftleft("bucket", BITS) + dense).alias("code"))


def encode(df: DataFrame, row_id: str, forms: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """id and tuple: the record as the sorted array of its field-value integers (null has 0).

    The field's number is the last part of each integer, so equal codes of two fields differ.
    The dictionaries are written to the shared folder once; small ones (by count and bytes)
    are broadcast, others are joined by a shuffle.
    """
    words = cut(dictionaries(df, forms))
    out = df.select(F.col(row_id).alias("id"), *[F.col(c).cast("string").alias(f"f{k}") for k, c in enumerate(forms)])
    for k in range(len(forms)):
        own = words.where(F.col("field") == k).select(F.col("raw").alias(f"f{k}"), F.col("code").alias(f"c{k}"))
        out = out.join(small(own, BROADCAST_ROWS), f"f{k}", "left").drop(f"f{k}")
    n = len(forms)
    return out.select("id", F.array_sort(F.array(*[F.coalesce(F.col(f"c{k}"), F.lit(0)) * n + k for k in range(n)])).alias("tuple"))


def duplicate_groups(encoded: DataFrame) -> DataFrame:
    """tuple, first_id (the smallest) and copies of every distinct record."""
    return encoded.groupBy("tuple").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))


def duplicate_rows(encoded: DataFrame) -> DataFrame:
    """id_a, id_b: for every further row of a record its id with the record's smallest.

    The encoded rows are written to the shared folder once and read twice.  Only groups of
    several rows are joined back, by a shuffle in which hot tuples are split by adaptive execution.
    """
    kept = cut(encoded)
    many = duplicate_groups(kept).where("copies > 1").select("tuple", "first_id")
    return kept.join(many, "tuple").where("id <> first_id").select(F.col("first_id").alias("id_a"), F.col("id").alias("id_b"))
