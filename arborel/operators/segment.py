"""Crown segmentation and terrain: region growing on the canopy raster, top-down growing on points, and a triangulated ground.

These are sequential by nature, so one task has one tile with its halo; only a tile's own points and crowns are returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Crowns:
    """Region growing: cells over th_tree, over th_seed times the seed's and th_crown times the crown's mean height, at most 1.05 times the seed's, less than
    max_cells away in either direction."""

    th_tree: float = 100
    th_seed: float = 0.45
    th_crown: float = 0.8
    max_cells: int = 20


@dataclass(frozen=True)
class TopDown:
    """Growing trees from the highest free point: spacing thresholds below and above height_switch, radius of the local maximum test, least height and
    search radius; metres."""

    dt1: float = 1.5
    dt2: float = 2.0
    radius: float = 4.0
    height_switch: float = 15.0
    hmin: float = 2.0
    search: float = 5.0


# --- canopy raster -----------------------------------------------------------------------------------


def grow_array(z: np.ndarray, seeds: np.ndarray, crowns: Crowns) -> np.ndarray:
    """Crown labels of a raster (NaN: no cell) from seeds (0: none): rounds in which every crown tries the free cells beside it, until nothing changes. A cell that
    several crowns want goes to the first of its left, lower, right and upper neighbours' crowns that may have it."""
    label = seeds.copy()
    rows, cols = z.shape
    at = {int(label[r, c]): (r, c) for r, c in zip(*np.nonzero(label), strict=True)}
    total = {k: float(z[p]) for k, p in at.items()}
    count = dict.fromkeys(at, 1)
    edge = list(at.values())
    while edge:
        wanted: dict[tuple[int, int], int] = {}
        mean = {k: total[k] / count[k] for k in total}
        for r, c in sorted(edge):
            k = int(label[r, c])
            sr, sc = at[k]
            for dr, dc in ((0, -1), (-1, 0), (0, 1), (1, 0)):
                rr, cc = r + dr, c + dc
                if not (0 <= rr < rows and 0 <= cc < cols) or label[rr, cc] or (rr, cc) in wanted:
                    continue
                v = z[rr, cc]
                if v > crowns.th_tree and v > crowns.th_seed * z[sr, sc] and v > crowns.th_crown * mean[k] and v <= 1.05 * z[sr, sc] and abs(rr - sr) < crowns.max_cells and abs(cc - sc) < crowns.max_cells:
                    wanted[rr, cc] = k
        # A cell refused now may be taken later, as the mean falls: the whole rim stays in play while anything grows.
        for (r, c), k in wanted.items():
            label[r, c] = k
            total[k] += float(z[r, c])
            count[k] += 1
        edge = [*edge, *wanted] if wanted else []
        if wanted:
            edge = [(r, c) for r, c in edge if any(0 <= r + dr < rows and 0 <= c + dc < cols and not label[r + dr, c + dc] for dr, dc in ((0, -1), (-1, 0), (0, 1), (1, 0)))]
    return label


def grow_crowns(raster: DataFrame, seeds: DataFrame, crowns: Crowns = Crowns(), tile: int = 100) -> DataFrame:
    """raster (col, row, z) and seeds (treeID, col, row): col, row, label. Tiles of that many cells have a halo of two crowns' reach; a crown belongs to its
    seed's tile, and a cell that crowns of several tiles claim goes to the smallest label."""
    halo = 2 * crowns.max_cells
    reach = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    one = seeds.groupBy("col", "row").agg(F.min("treeID").alias("treeID"))
    cells = raster.where("z is not null").join(one, ["col", "row"], "left")
    dealt = cells.withColumn("tx", F.explode(reach("col"))).withColumn("ty", F.explode(reach("row"))).select("tx", "ty", "col", "row", F.col("z").cast("double"), F.coalesce("treeID", F.lit(0)).cast("long").alias("seed"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tx, ty = (int(k) for k in key)
        c0, r0 = int(part["col"].min()), int(part["row"].min())
        shape = (int(part["row"].max()) - r0 + 1, int(part["col"].max()) - c0 + 1)
        z, seed = np.full(shape, np.nan), np.zeros(shape, np.int64)
        z[part["row"] - r0, part["col"] - c0] = part["z"]
        seed[part["row"] - r0, part["col"] - c0] = part["seed"]
        own = {int(seed[r, c]) for r, c in zip(*np.nonzero(seed), strict=True) if (c + c0) // tile == tx and (r + r0) // tile == ty}
        label = grow_array(z, seed, crowns)
        r, c = np.nonzero(np.isin(label, list(own)))
        return pd.DataFrame({"col": c + c0, "row": r + r0, "label": label[r, c]})

    grown = dealt.groupBy("tx", "ty").applyInPandas(run, "col long, row long, label long")
    return grown.groupBy("col", "row").agg(F.min("label").alias("label"))


def grow_step(raster: DataFrame, labels: DataFrame, seeds: DataFrame, th_tree: int = 100, th_seed: int = 45, th_crown: int = 80, max_cells: int = 20) -> DataFrame:
    """One synchronous round of growing as joins, in whole numbers (shares in percent): labels and the cells that join, each to the smallest crown that may have it."""
    stats = labels.join(raster, ["col", "row"]).groupBy("label").agg(F.sum("z").alias("total"), F.count("*").alias("n"))
    seed = seeds.join(raster, ["col", "row"]).select(F.col("treeID").alias("label"), F.col("col").alias("sc"), F.col("row").alias("sr"), F.col("z").alias("sz"))
    sides = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    rim = labels.select("label", F.explode(sides).alias("o"), "col", "row").select("label", (F.col("col") + F.col("o.i")).alias("col"), (F.col("row") + F.col("o.j")).alias("row")).distinct()
    free = rim.join(labels.select("col", "row"), ["col", "row"], "left_anti").join(raster, ["col", "row"])
    z = F.col("z")
    fits = (z > th_tree) & (100 * z > th_seed * F.col("sz")) & (100 * z * F.col("n") > th_crown * F.col("total")) & (100 * z <= 105 * F.col("sz"))
    near = (F.abs(F.col("col") - F.col("sc")) < max_cells) & (F.abs(F.col("row") - F.col("sr")) < max_cells)
    new = free.join(stats, "label").join(seed, "label").where(fits & near).groupBy("col", "row").agg(F.min("label").alias("label"))
    return labels.select("col", "row", "label").unionByName(new)


# --- points, top down --------------------------------------------------------------------------------


def top_down_array(points: np.ndarray, rule: TopDown) -> np.ndarray:
    """Tree numbers from 1 (0: none) of points in metres, sorted by height from the top. The highest free point starts a tree; the other free points in reach are
    taken from the top down: a point joins if it is nearer to the tree than to the points that were refused, under the spacing rule for its height."""
    out = np.zeros(len(points), int)
    order = np.argsort(-points[:, 2], kind="stable")
    order = order[points[order, 2] >= rule.hmin]
    free, tree = order.tolist(), 0
    xy, z = points[:, :2], points[:, 2]
    while free:
        tree += 1
        seed = free[0]
        near = np.array(free)
        near = near[((xy[near] - xy[seed]) ** 2).sum(axis=1) <= rule.search**2]
        member, other = np.empty((len(near), 2)), np.empty((len(near) + 1, 2))
        member[0], n, m = xy[seed], 1, 1
        other[0] = xy[seed] + 100.0  # a far point, so that there always is one
        out[seed] = tree
        for i in near[1:]:
            d_in = np.sqrt(((member[:n] - xy[i]) ** 2).sum(axis=1).min())
            d_out = np.sqrt(((other[:m] - xy[i]) ** 2).sum(axis=1).min())
            limit = rule.dt2 if z[i] > rule.height_switch else rule.dt1
            around = near[((xy[near] - xy[i]) ** 2).sum(axis=1) <= rule.radius**2]
            peak = z[around].max() <= z[i]
            if (d_in > limit) if peak and d_in > limit else (d_in > d_out):
                other[m], m = xy[i], m + 1
            else:
                member[n], n, out[i] = xy[i], n + 1, tree
        free = [i for i in free if not out[i]]
    return out


def top_down_trees(tiled: DataFrame, rule: TopDown = TopDown()) -> DataFrame:
    """tiled (tile_x, tile_y, is_buffer, point_id, xi, yi, zi): point_id, tile and the tree's number in its tile, for the tile's own points."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("point_id", ignore_index=True)
        tree = top_down_array(tile[["xi", "yi", "zi"]].to_numpy() / 100.0, rule)
        keep = (tree > 0) & ~tile["is_buffer"].to_numpy()
        return tile[["tile_x", "tile_y", "point_id"]].assign(treeID=tree)[keep]

    columns = ["tile_x", "tile_y", "is_buffer", "point_id", "xi", "yi", "zi"]
    return tiled.select(columns).groupBy("tile_x", "tile_y").applyInPandas(run, "tile_x long, tile_y long, point_id long, treeID long")


# --- triangulated ground -----------------------------------------------------------------------------


def triangulate(xy: np.ndarray) -> np.ndarray:
    """Delaunay triangles (rows of three places in xy) by inserting points one at a time; places repeated in xy count once."""
    _, first = np.unique(xy, axis=0, return_index=True)
    if len(first) < 3:
        return np.zeros((0, 3), int)
    centre = xy.mean(axis=0)
    span = max(float(np.abs(xy - centre).max()), 1.0)
    p = np.concatenate([xy - centre, span * np.array([[-60.0, -50.0], [60.0, -50.0], [0.0, 70.0]])])
    n = len(xy)
    tri = np.array([[n, n + 1, n + 2]])
    circle = _circles(p, tri)
    for i in np.sort(first):
        bad = ((circle[:, :2] - p[i]) ** 2).sum(axis=1) < circle[:, 2] * (1 + 1e-12)
        edges = np.concatenate([tri[bad][:, [0, 1]], tri[bad][:, [1, 2]], tri[bad][:, [2, 0]]])
        key = np.sort(edges, axis=1)
        _, inverse, times = np.unique(key, axis=0, return_inverse=True, return_counts=True)
        rim = edges[times[inverse.reshape(-1)] == 1]
        new = np.column_stack([rim, np.full(len(rim), i)])
        area = (p[new[:, 1], 0] - p[new[:, 0], 0]) * (p[new[:, 2], 1] - p[new[:, 0], 1]) - (p[new[:, 2], 0] - p[new[:, 0], 0]) * (p[new[:, 1], 1] - p[new[:, 0], 1])
        new = new[np.abs(area) > 1e-12]
        tri, circle = np.concatenate([tri[~bad], new]), np.concatenate([circle[~bad], _circles(p, new)])
    return tri[(tri < n).all(axis=1)]


def _circles(p: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Centre and squared radius of each triangle's circumcircle."""
    a, b, c = (p[tri[:, i]] for i in range(3))
    d = 2 * (a[:, 0] * (b[:, 1] - c[:, 1]) + b[:, 0] * (c[:, 1] - a[:, 1]) + c[:, 0] * (a[:, 1] - b[:, 1]))
    sa, sb, sc = ((v**2).sum(axis=1) for v in (a, b, c))
    x = (sa * (b[:, 1] - c[:, 1]) + sb * (c[:, 1] - a[:, 1]) + sc * (a[:, 1] - b[:, 1])) / d
    y = (sa * (c[:, 0] - b[:, 0]) + sb * (a[:, 0] - c[:, 0]) + sc * (b[:, 0] - a[:, 0])) / d
    return np.column_stack([x, y, (a[:, 0] - x) ** 2 + (a[:, 1] - y) ** 2])


def interpolate(ground: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Heights of the triangulated ground (x, y, z) at places (x, y); outside its hull, the nearest ground point's. No ground: NaN."""
    if not len(ground):
        return np.full(len(at), np.nan)
    out = np.full(len(at), np.nan)
    for a, b, c in ground[triangulate(ground[:, :2])]:
        low, high = np.minimum(np.minimum(a, b), c), np.maximum(np.maximum(a, b), c)
        box = np.flatnonzero(np.isnan(out) & (at >= low[:2] - 1e-9).all(axis=1) & (at <= high[:2] + 1e-9).all(axis=1))
        if len(box):
            d = (b[1] - c[1]) * (a[0] - c[0]) + (c[0] - b[0]) * (a[1] - c[1])
            u = ((b[1] - c[1]) * (at[box, 0] - c[0]) + (c[0] - b[0]) * (at[box, 1] - c[1])) / d
            v = ((c[1] - a[1]) * (at[box, 0] - c[0]) + (a[0] - c[0]) * (at[box, 1] - c[1])) / d
            own = (u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9)
            out[box[own]] = (u * a[2] + v * b[2] + (1 - u - v) * c[2])[own]
    for i in np.flatnonzero(np.isnan(out)):
        out[i] = ground[((ground[:, :2] - at[i]) ** 2).sum(axis=1).argmin(), 2]
    return out


def normalize_height(tiled: DataFrame) -> DataFrame:
    """tiled with is_ground: point_id and height above the tile's triangulated ground (centimetres; null without ground), for the tile's own points."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("point_id", ignore_index=True)
        xyz = tile[["xi", "yi", "zi"]].to_numpy().astype(float)
        own = ~tile["is_buffer"].to_numpy()
        floor = interpolate(xyz[tile["is_ground"].to_numpy(bool)], xyz[own, :2])
        return pd.DataFrame({"point_id": tile["point_id"][own], "height": xyz[own, 2] - floor})

    columns = ["tile_x", "tile_y", "is_buffer", "point_id", "xi", "yi", "zi", "is_ground"]
    return tiled.select(columns).groupBy("tile_x", "tile_y").applyInPandas(run, "point_id long, height double")


def terrain_raster(tiled: DataFrame, size: int, tile: int) -> DataFrame:
    """The triangulated ground at the centres of each tile's own cells: col, row, z (centimetres). A tile without ground has no cells."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tx, ty = (int(k) for k in key)
        ground = part.sort_values("point_id")[["xi", "yi", "zi"]].to_numpy().astype(float)
        n = tile // size
        col, row = (a.reshape(-1) for a in np.meshgrid(np.arange(tx * n, tx * n + n), np.arange(ty * n, ty * n + n)))
        z = interpolate(ground, np.column_stack([col * size + size / 2, row * size + size / 2]))
        return pd.DataFrame({"col": col, "row": row, "z": z})

    return tiled.where("is_ground").select("tile_x", "tile_y", "point_id", "xi", "yi", "zi").groupBy("tile_x", "tile_y").applyInPandas(run, "col long, row long, z double")
