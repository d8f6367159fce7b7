"""Items into fixed-capacity containers: dominance reduction, then best fit, on the histogram of sizes.

Items of equal size are interchangeable, so the packing is worked out over how many items
there are of each size, at most ``capacity`` numbers however many items there are:

1. Martello-Toth dominance reduction: from the largest size down, a set of at most three
   sizes that provably dominates every other set with that size is fixed, as often at once
   as its counts allow; each fixed set shrinks the instance.
2. The remainder goes best fit, largest first, over classes of containers of equal room.

The result is a short table of slots (size, ranks from, first container, how many), whose
length depends on the sizes there are and not on how many items have them.  The items are
then ranked within their size in two salted stages, so a size that a third of all items
share is ranked by many tasks, and find their slot by bisection over (size, rank).

An item larger than the capacity is split into full pieces and a rest; no other is.
Defined results: items of size 0 fit anywhere and are spread over the containers by hash
(container 0 if there are none); null sizes count as 0; ties are ranked by id; repeated
ids are items of their own whose places may be exchanged; an empty table has no containers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itinera.session import cut, salt

Slot = tuple[int, int, int, int]


class _Ledger:
    """Counts of sizes still to place, and the slots given so far."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.copy()
        self.rank = np.zeros(len(counts), np.int64)
        self.slots: list[Slot] = []
        self.containers = 0

    def place(self, size: int, container: int, n: int) -> None:
        """n items of the size, one to each of n containers."""
        self.slots.append((size, int(self.rank[size]), container, n))
        self.rank[size] += n
        self.left[size] -= n

    def fix(self, sizes: list[int], n: int) -> None:
        for s in sizes:
            self.place(s, self.containers, n)
        self.containers += n


def _largest(left: np.ndarray, most: int) -> int:
    """The largest size up to ``most`` that is left, or 0."""
    if most <= 0:
        return 0
    there = np.flatnonzero(left[1 : most + 1])
    return int(there[-1]) + 1 if len(there) else 0


def _pair(left: np.ndarray, room: int) -> tuple[int, int]:
    """Of two items that fill ``room`` best the sizes, larger first; among equals the least lopsided; (0, 0) if none fit."""
    there = np.flatnonzero(left[1 : room + 1]) + 1
    best = (0, 0)
    i, j = 0, len(there) - 1
    while i <= j:
        a, b = int(there[j]), int(there[i])
        if a + b > room or (i == j and left[a] < 2):
            j -= 1
            continue
        if a + b >= sum(best):
            best = (a, b)
        i += 1
    return best


def reduce_dominated(ledger: _Ledger, capacity: int) -> None:
    """Fixes sets that dominate every other set with their largest item, until a pass fixes none.

    Set A dominates B if B's items can be parted among A's items without any part being
    larger than its item; then some best packing holds A.  Checked for sets of up to three:
    - no second item fits: the item alone;
    - the best second item fills the container, or no third fits: that pair;
    - no fourth fits, with (a, b) the best pair beside the item: the pair (item, s) if its
      second s >= a + b; the triple if s <= a and no pair that fits has a lesser item above b.
    """
    left = ledger.left
    moved = True
    while moved:
        moved = False
        for w in range(capacity, 0, -1):
            while left[w]:
                left[w] -= 1
                small = np.flatnonzero(left[1:])[:3] + 1
                least = [int(x) for x in small for _ in range(min(3, int(left[x])))][:3]
                room = capacity - w
                s = _largest(left, room)
                left[w] += 1
                if not s:
                    ledger.fix([w], int(left[w]) if not least or least[0] > room else 1)
                    moved = True
                    continue
                often = int(left[w] // 2) if s == w else int(min(left[w], left[s]))
                if s == room or sum(least[:2]) > room or len(least) < 2:
                    ledger.fix([w, s], often)
                    moved = True
                    continue
                if len(least) == 3 and sum(least) <= room:
                    break
                left[w] -= 1
                a, b = _pair(left, room)
                highest = _lesser(left, room)
                left[w] += 1
                if not a:
                    break
                if s >= a + b:
                    ledger.fix([w, s], often)
                elif s <= a and highest <= b:
                    ledger.fix([w, a, b], _same_again(left, [w, a, b]))
                else:
                    break
                moved = True


def _same_again(left: np.ndarray, sizes: list[int]) -> int:
    """How often a set can be fixed before any of its sizes has fewer than three items left; 1 at least.

    The conditions above see counts up to three only, so until then they'd be met again.
    """
    return max(1, min((int(left[s]) - 3) // sizes.count(s) for s in sizes))


def _lesser(left: np.ndarray, room: int) -> int:
    """The largest size that can be the lesser item of a pair within ``room``."""
    there = np.flatnonzero(left[1 : room + 1]) + 1
    for y in there[there <= room // 2][::-1]:
        y = int(y)
        if left[y] > 1 and 2 * y <= room or len(x := there[(there > y) & (there <= room - y)]):
            return y
    return 0


def best_fit(ledger: _Ledger, capacity: int) -> None:
    """The sizes left, largest first, each to the containers of least sufficient room."""
    open_: dict[int, list[tuple[int, int]]] = {}
    for w in range(capacity, 0, -1):
        n = int(ledger.left[w])
        if not n:
            continue
        for room in sorted(r for r in open_ if r >= w):
            # Containers of this room take items of the size until it is used up.
            level = room
            while n and level >= w and open_.get(level):
                classes = open_[level]
                start, many = classes.pop()
                if not classes:
                    del open_[level]
                take = min(n, many)
                ledger.place(w, start, take)
                n -= take
                if take < many:
                    open_.setdefault(level, []).append((start + take, many - take))
                open_.setdefault(level - w, []).append((start, take))
        while n:
            each = capacity // w
            many = max(1, n // each)
            held = min(each, n)
            for _ in range(held):
                ledger.place(w, ledger.containers, many)
            n -= held * many
            open_.setdefault(capacity - held * w, []).append((ledger.containers, many))
            ledger.containers += many
        open_.pop(0, None)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Slot], int, int]:
    """Slots, containers, and how many of these the reduction fixed, for counts of sizes 1..capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    ledger = _Ledger(left)
    reduce_dominated(ledger, capacity)
    fixed = ledger.containers
    best_fit(ledger, capacity)
    return ledger.slots, ledger.containers, fixed


def pieces(sizes: DataFrame, row_id: str, size: str, capacity: int) -> DataFrame:
    """id, piece (from 0), size: the item itself, or full pieces and a rest of one beyond the capacity."""
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("bigint"), F.lit(0).cast("bigint"))
    count = F.greatest(F.ceil(n / capacity), F.lit(1)).cast("int")
    flat = sizes.select(F.col(row_id).alias("id"), n.alias("_n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    return flat.select("id", "piece", F.least(F.col("_n") - F.col("piece").cast("bigint") * capacity, F.lit(capacity).cast("bigint")).cast("int").alias("size"))


def ranked(items: DataFrame, salts: int) -> DataFrame:
    """``items`` with rank, from 0 within each size: counts of salted parts first, then ranks within a part."""
    parted = items.withColumn("part", salt(F.struct("id", "piece"), salts))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parted.groupBy("size", "part").agg(F.count("*").alias("n")).select("size", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("size", "part").orderBy("id", "piece")) - 1
    return parted.withColumn("_r", within).join(offsets, ["size", "part"]).select("id", "piece", "size", (F.col("_r") + F.col("offset")).alias("rank"))


def _container_of(spark: SparkSession, slots: list[Slot]):
    """A function of (size, rank): the container, by bisection in the slots, 32 bytes each on every worker."""
    table = np.array(sorted(slots), np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("bigint")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        t = shared.value
        s, r = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        # Slots of a size follow each other without gaps: the last that starts at or before the rank.
        sizes, first = np.unique(t[:, 0], return_index=True)
        k = np.searchsorted(sizes, s)
        low, high = first[k], np.append(first, len(t))[k + 1]
        while (high - low > 1).any():
            mid = (low + high) // 2
            right = t[mid, 1] <= r
            low, high = np.where(right, mid, low), np.where(right, high, mid)
        return pd.Series(t[low, 2] + r - t[low, 1])

    return container


def pack(sizes: DataFrame, row_id: str, size: str, capacity: int, salts: int = 64) -> DataFrame:
    """id, piece, size, container of every item or piece.

    The driver holds the histogram (at most ``capacity`` rows) and the slots, whose number
    depends on the sizes there are and not on the items.
    """
    spark = sizes.sparkSession
    items = cut(pieces(sizes, row_id, size, capacity))
    counts = {r["size"]: r["n"] for r in items.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}
    slots, containers, _ = plan(counts, capacity)
    empty = items.where("size = 0").select("id", "piece", "size", _spread(F.col("id"), containers).alias("container"))
    if not slots:
        return empty
    placed = ranked(items.where("size > 0"), salts)
    return placed.select("id", "piece", "size", _container_of(spark, slots)("size", "rank").alias("container")).unionByName(empty)


def _spread(row_id: Column, containers: int) -> Column:
    return F.pmod(F.xxhash64(row_id), F.lit(max(1, containers))).cast("bigint")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """containers, used, unused_share, and the fewest containers that any packing needs for the total."""
    each = packed.groupBy("container").agg(F.sum("size").alias("used"))
    total = F.sum("used")
    return each.agg(
        F.count("*").alias("containers"), total.alias("used"), F.max("used").alias("fullest"), (1 - total / (F.count("*") * capacity)).alias("unused_share"), F.ceil(total / capacity).alias("lower_bound")
    )
