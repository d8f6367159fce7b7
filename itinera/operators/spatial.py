"""Points near other points: quadtree partitions, R-tree probes, each pair once.

1. A sample (by hash of the id, so it is the same on every run) shapes a quadtree over
   longitude and latitude; its leaves are ranges of the Morton order.  Counts over all
   points then split further every leaf that is still too full, until each holds few enough
   or is as narrow as the search radius makes sensible.
2. Every point goes to its home leaf and, as a replica, to each further leaf that the
   box around it (the search radius, across the date line and the poles) touches.  As no leaf
   is narrower than four times the radius, replicas per point are bounded by geometry.
3. Leaves of that least width that hold too many points for one task are split into blocks
   of probes times blocks of candidates, from counts over all points.
4. Each (leaf, block pair) is probed through a bulk-loaded (sort-tile-recursive) R-tree
   over points of the unit sphere, then the exact great-circle distance decides.
5. Duplicates are dropped by reference point: a pair counts only in the home leaf of
   its point of smaller id, where the other is present by step 2.

Defined results: null, NaN, out-of-range coordinates and the placeholder (0, 0) are left
out, so are null ids; points that coincide are pairs; ids are taken to be unique (a
repeated id never pairs with itself); an empty table has no pairs; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itinera.session import small

EARTH_KM = 6371.0088
#: Levels of the quadtree; a Morton code has two bits a level.
DEPTH = 20
_FAN = 16


def valid_points(df: DataFrame, id_col: str, lat: str, lon: str) -> DataFrame:
    """id, lat, lon of the rows that place a point on the globe."""
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    ok = F.col(id_col).isNotNull() & la.between(-90, 90) & lo.between(-180, 180) & ~F.isnan(la) & ~F.isnan(lo) & ~((la == 0) & (lo == 0))
    return df.where(ok).select(F.col(id_col).cast("bigint").alias("id"), la.alias("lat"), lo.alias("lon"))


def morton(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Place in the Z-order of the 2^DEPTH x 2^DEPTH grid."""
    n = 1 << DEPTH
    x = np.clip(((lon + 180.0) / 360.0 * n).astype(np.int64), 0, n - 1)
    y = np.clip(((lat + 90.0) / 180.0 * n).astype(np.int64), 0, n - 1)

    def spread(v: np.ndarray) -> np.ndarray:
        v = (v | (v << 16)) & 0x0000FFFF0000FFFF
        v = (v | (v << 8)) & 0x00FF00FF00FF00FF
        v = (v | (v << 4)) & 0x0F0F0F0F0F0F0F0F
        v = (v | (v << 2)) & 0x3333333333333333
        return (v | (v << 1)) & 0x5555555555555555

    return (spread(y) << 1) | spread(x)


class Quadtree:
    """Leaves as the sorted starts of Morton ranges, with the level of each."""

    def __init__(self, codes: np.ndarray, most: int, least_km: float) -> None:
        """Cells split while they hold more than ``most`` of ``codes`` and stay wider than ``least_km``."""
        codes = np.sort(codes)
        #: The level of the narrowest leaves.
        self.deepest = deepest = max(0, min(DEPTH, int(math.log2(20015.0 / max(least_km, 1e-9)))))
        starts, levels, todo = [], [], [(0, 0)]
        while todo:
            start, level = todo.pop()
            size = 1 << (2 * (DEPTH - level))
            held = np.searchsorted(codes, start + size) - np.searchsorted(codes, start)
            if held > most and level < deepest:
                todo += [(start + k * (size >> 2), level + 1) for k in (3, 2, 1, 0)]
            else:
                starts.append(start)
                levels.append(level)
        self.starts, self.levels = np.array(starts, np.int64), np.array(levels, np.int64)

    def split(self, leaf: int, counts: dict[int, int], most: int, down: int) -> list[tuple[int, int]]:
        """The cells that replace a leaf: parts of it, ``down`` levels lower at most, that hold ``most`` where they can; ``counts`` by the start of the lowest cells."""
        start, level = int(self.starts[leaf]), int(self.levels[leaf])
        cells, todo = [], [(start, level)]
        keys = np.array(sorted(counts), np.int64)
        held = np.concatenate(([0], np.cumsum([counts[k] for k in keys.tolist()])))
        while todo:
            at, deep = todo.pop()
            size = 1 << (2 * (DEPTH - deep))
            n = held[np.searchsorted(keys, at + size)] - held[np.searchsorted(keys, at)]
            if n > most and deep < level + down:
                todo += [(at + k * (size >> 2), deep + 1) for k in (3, 2, 1, 0)]
            else:
                cells.append((at, deep))
        return cells

    def replaced(self, parts: dict[int, list[tuple[int, int]]]) -> Quadtree:
        """The tree with some leaves replaced by the cells that tile them."""
        tree = Quadtree.__new__(Quadtree)
        cells = [c for i in range(len(self.starts)) for c in parts.get(i, [(int(self.starts[i]), int(self.levels[i]))])]
        tree.starts, tree.levels, tree.deepest = np.array([c[0] for c in cells], np.int64), np.array([c[1] for c in cells], np.int64), self.deepest
        return tree

    def home(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, morton(lat, lon), side="right") - 1

    def boxes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """South, north, west, east of each leaf."""

        def gather(v: np.ndarray) -> np.ndarray:
            v = v & 0x5555555555555555
            v = (v | (v >> 1)) & 0x3333333333333333
            v = (v | (v >> 2)) & 0x0F0F0F0F0F0F0F0F
            v = (v | (v >> 4)) & 0x00FF00FF00FF00FF
            v = (v | (v >> 8)) & 0x0000FFFF0000FFFF
            return (v | (v >> 16)) & 0x00000000FFFFFFFF

        n, wide = float(1 << DEPTH), (1 << (DEPTH - self.levels)).astype(float)
        x, y = gather(self.starts).astype(float), gather(self.starts >> 1).astype(float)
        return y / n * 180 - 90, (y + wide) / n * 180 - 90, x / n * 360 - 180, (x + wide) / n * 360 - 180

    def touched(self, lat: np.ndarray, lon: np.ndarray, km: float) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) for every leaf that the box around a point meets, found by descending the tree.

        The box is generous by a hair, wraps at the date line and spans all longitudes near a pole.
        """
        reach = math.degrees(km / EARTH_KM) * (1 + 1e-9) + 1e-9
        south, north = lat - reach, lat + reach
        near = np.maximum(np.abs(south), np.abs(north)) >= 90
        cosine = np.cos(np.radians(np.where(near, 0, lat)))
        ratio = np.sin(math.radians(reach)) / np.maximum(cosine, 1e-12)
        span = np.where(near | (ratio >= 1), 180.0, np.degrees(np.arcsin(np.minimum(ratio, 1.0))) * (1 + 1e-9) + 1e-9)
        west, east = lon - span, lon + span
        points, leaves = [], []
        # Level by level: (point, cell start) pairs whose cell meets the point's box.
        p, c = np.arange(len(lat)), np.zeros(len(lat), np.int64)
        for level in range(DEPTH + 1):
            leaf = np.searchsorted(self.starts, c, side="right") - 1
            done = (self.starts[leaf] == c) & (self.levels[leaf] == level)
            points.append(p[done])
            leaves.append(leaf[done])
            p, c = p[~done], c[~done]
            if not len(p):
                break
            quarter = 1 << (2 * (DEPTH - level - 1))
            p, c = np.repeat(p, 4), (c[:, None] + np.arange(4) * quarter).ravel()
            s, n, w, e = self._cell(c, level + 1)
            meets = (south[p] <= n) & (north[p] >= s)
            across = np.zeros(len(p), bool)
            for turn in (-360.0, 0.0, 360.0):
                across |= (west[p] + turn <= e) & (east[p] + turn >= w)
            p, c = p[meets & across], c[meets & across]
        return np.concatenate(points), np.concatenate(leaves)

    def _cell(self, starts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        part = Quadtree.__new__(Quadtree)
        part.starts, part.levels = starts, np.full(len(starts), level, np.int64)
        return part.boxes()


def _sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], axis=1)


class RTree:
    """Bulk-loaded by sort-tile-recursive packing over unit-sphere points; batch probes."""

    def __init__(self, xyz: np.ndarray) -> None:
        n = len(xyz)
        tiles = max(1, math.ceil((n / _FAN) ** (1 / 3)))
        order = np.argsort(xyz[:, 0], kind="stable")
        slab = np.empty(n, np.int64)
        slab[order] = np.arange(n) * tiles // max(n, 1)
        order = np.lexsort((xyz[:, 1], slab))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        run = rank * tiles * tiles // max(n, 1)
        self.order = np.lexsort((xyz[:, 2], run))
        pts = xyz[self.order]
        lo, hi = pts, pts
        self.levels = []
        while True:
            self.levels.append((lo, hi))
            if len(lo) <= 1:
                break
            cuts = np.arange(0, len(lo), _FAN)
            lo, hi = np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts)

    def within(self, xyz: np.ndarray, chord: float) -> tuple[np.ndarray, np.ndarray]:
        """(probe, point) pairs whose boxes meet; a superset of those within the chord."""
        q, node = np.arange(len(xyz)), np.zeros(len(xyz), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            lo, hi = self.levels[depth]
            ok = np.ones(len(q), bool)
            for d in range(3):
                ok &= (xyz[q, d] - chord <= hi[node, d]) & (xyz[q, d] + chord >= lo[node, d])
            q, node = q[ok], node[ok]
            if depth:
                below = len(self.levels[depth - 1][0])
                child = (node[:, None] * _FAN + np.arange(_FAN)).ravel()
                q = np.repeat(q, _FAN)
                q, node = q[child < below], child[child < below]
        return q, self.order[node]


def _pairs(group: pd.DataFrame, km: float) -> Iterator[pd.DataFrame]:
    """Pairs of one (leaf, block pair): its probes against its candidates, by chunks."""
    probes = group[group["probe"]]
    others = group[~group["probe"]]
    if not len(probes) or not len(others):
        return
    oid, olat, olon = (others[c].to_numpy() for c in ("id", "lat", "lon"))
    tree = RTree(_sphere(olat, olon))
    chord = 2 * math.sin(min(km / EARTH_KM, math.pi) / 2) * (1 + 1e-9) + 1e-12
    pid, plat, plon = (probes[c].to_numpy() for c in ("id", "lat", "lon"))
    step = 256
    for at in range(0, len(pid), step):
        i, la, lo = pid[at : at + step], plat[at : at + step], plon[at : at + step]
        q, o = tree.within(_sphere(la, lo), chord)
        keep = i[q] < oid[o]
        q, o = q[keep], o[keep]
        p1, p2 = np.radians(la[q]), np.radians(olat[o])
        h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(olon[o] - lo[q]) / 2) ** 2
        near = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0))) <= km
        if near.any():
            yield pd.DataFrame({"id_a": i[q[near]], "id_b": oid[o[near]]})


#: Levels by which an over-full leaf is split from one count.
_DOWN = 3


def _shaped(points: DataFrame, total: int, km: float, sample_rows: int, leaf_rows: int) -> tuple[Quadtree, dict[int, int]]:
    """A quadtree by a sample of 16 points a leaf aimed at, refined by counts of all points; and the points, replicas counted, of leaves with more than aimed at.

    A round counts the points of over-full leaves by the cells three levels below, so a tree
    is found after as many rounds as its depth beyond the sample's has threes; mostly in none or one.
    """
    aim = min(sample_rows, max(1000, 16 * total // leaf_rows))
    share = min(1.0, aim / total)
    drawn = points.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("lat", "lon")
    # The hash draws about aim rows; equal ids are drawn together, so the driver's bound is stated as well.
    sample = drawn.limit(2 * aim).toPandas()
    tree = Quadtree(morton(sample["lat"].to_numpy(), sample["lon"].to_numpy()), max(4, int(leaf_rows * len(sample) / total)), 4 * km)
    while True:
        counts = _spread(points, tree, km).groupBy("leaf").agg(F.count("*").alias("n"), F.count_if(F.col("replica") == 0).alias("home")).where(F.col("n") > 2 * leaf_rows).collect()
        full = [r["leaf"] for r in counts if r["home"] > 2 * leaf_rows and tree.levels[r["leaf"]] < tree.deepest]
        if not full:
            return tree, {r["leaf"]: r["n"] for r in counts}
        cells = points.select(F.explode(_cell_below(tree, full)("lat", "lon")).alias("c")).groupBy("c.leaf", "c.cell").agg(F.count("*").alias("n"))
        by: dict[int, dict[int, int]] = {}
        for r in cells.collect():
            by.setdefault(r["leaf"], {})[r["cell"]] = r["n"]
        tree = tree.replaced({leaf: tree.split(leaf, by[leaf], leaf_rows, min(_DOWN, tree.deepest - int(tree.levels[leaf]))) for leaf in full})


def _spread(points: DataFrame, tree: Quadtree, km: float) -> DataFrame:
    """id, lat, lon, replica (0 at home), leaf: a row for every leaf that a point's box touches."""

    @F.pandas_udf("array<int>")
    def leaves(la: pd.Series, lo: pd.Series) -> pd.Series:
        a, o = la.to_numpy(), lo.to_numpy()
        home = tree.home(a, o)
        p, leaf = tree.touched(a, o, km)
        other = leaf != home[p]
        p, leaf = p[other], leaf[other]
        order = np.argsort(p, kind="stable")
        cuts = np.searchsorted(p[order], np.arange(1, len(a)))
        return pd.Series([np.concatenate(([h], x)).astype(np.int32) for h, x in zip(home, np.split(leaf[order], cuts), strict=True)])

    return points.select("id", "lat", "lon", F.posexplode(leaves("lat", "lon")).alias("replica", "leaf"))


def _cell_below(tree: Quadtree, full: list[int]):
    """(leaf, start of the cell some levels below) of the points of the leaves ``full``; an empty list for others."""
    chosen = np.zeros(len(tree.starts), bool)
    chosen[full] = True

    @F.pandas_udf("array<struct<leaf:int,cell:bigint>>")
    def cell(la: pd.Series, lo: pd.Series) -> pd.Series:
        a, o = la.to_numpy(), lo.to_numpy()
        leaf = tree.home(a, o)
        bits = 2 * (DEPTH - np.minimum(tree.levels[leaf] + _DOWN, tree.deepest))
        at = (morton(a, o) >> bits) << bits
        return pd.Series([[{"leaf": int(x), "cell": int(c)}] if y else [] for x, c, y in zip(leaf, at, chosen[leaf], strict=True)])

    return cell


def near_pairs(
    df: DataFrame, id_col: str, lat: str, lon: str, km: float, sample_rows: int = 1_000_000, leaf_rows: int = 4_000, block_rows: int = 20_000
) -> DataFrame:
    """id_a < id_b of all points at most ``km`` apart.

    ``leaf_rows`` is the aim for points per leaf; ``sample_rows`` bounds the sample that first
    shapes the tree.  The driver and the workers hold the tree, 16 bytes a leaf.  Leaves of the
    least width with more than ``block_rows`` points (at least twice ``leaf_rows``) are split
    into block pairs, exactly.
    """
    block_rows = max(block_rows, 2 * leaf_rows)
    spark = df.sparkSession
    points = valid_points(df, id_col, lat, lon)
    total = points.count()
    if not total:
        return spark.createDataFrame([], "id_a bigint, id_b bigint")
    tree, held = _shaped(points, total, km, sample_rows, leaf_rows)
    spread = _spread(points, tree, km)
    # Leaves too full for one task: at most one a block of rows.
    full = spark.createDataFrame([(leaf, -(-n // block_rows)) for leaf, n in held.items() if n > block_rows], "leaf int, blocks int")
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    mine = F.pmod(F.xxhash64("id", F.lit(11)), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    # A home point probes in its block's row of block pairs and is a candidate, as replicas are, in its block's column.
    as_probe = F.when(F.col("replica") == 0, F.transform(every, lambda j: F.struct(F.lit(True).alias("probe"), mine.alias("i"), j.alias("j"))))
    as_other = F.transform(every, lambda i: F.struct(F.lit(False).alias("probe"), i.alias("i"), mine.alias("j")))
    roles = F.concat(F.coalesce(as_probe, F.filter(as_other, lambda _: F.lit(False))), as_other)
    parted = spread.join(small(full), "leaf", "left")
    tasks = parted.select("id", "lat", "lon", "leaf", F.explode(roles).alias("r")).select("leaf", "r.i", "r.j", "r.probe", "id", "lat", "lon")
    return tasks.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j").mapInPandas(lambda it: _each_group(it, km), "id_a bigint, id_b bigint")


def _each_group(batches: Iterator[pd.DataFrame], km: float) -> Iterator[pd.DataFrame]:
    """Groups of a partition sorted by leaf and block pair, each complete, one held at a time."""
    held: list[pd.DataFrame] = []
    key = None
    for batch in batches:
        if not len(batch):
            continue
        change = (batch[["leaf", "i", "j"]].diff().fillna(0) != 0).any(axis=1).to_numpy()
        for part in np.split(np.arange(len(batch)), np.flatnonzero(change)):
            if not len(part):
                continue
            rows = batch.iloc[part]
            k = tuple(rows.iloc[0][["leaf", "i", "j"]])
            if k != key and held:
                yield from _pairs(pd.concat(held, ignore_index=True), km)
                held = []
            key = k
            held.append(rows)
    if held:
        yield from _pairs(pd.concat(held, ignore_index=True), km)
