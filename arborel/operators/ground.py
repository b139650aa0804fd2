"""Ground classification: threshold, robust plane, cloth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .preprocess import bottom_fraction


@dataclass(frozen=True)
class Plane:
    """A seeded robust plane over the lowest fraction: hypotheses of three points, the best by inliers, refitted."""

    threshold: float = 40.0
    fraction: float = 0.3
    hypotheses: int = 50
    seed: int = 1


@dataclass(frozen=True)
class Cloth:
    """A cloth of that resolution (metres) falls on the inverted cloud; points within threshold of it are ground."""

    threshold: float = 0.25
    resolution: float = 0.25
    rigidness: int = 2
    step: float = 0.65
    iterations: int = 500


def threshold_split(points: DataFrame, height: int = 100) -> DataFrame:
    """is_ground: z at most height. NaN and null belong to neither class (null)."""
    return points.withColumn("is_ground", F.col("zi") <= height)


def plane_fit(points: DataFrame, weight: Column | None = None) -> DataFrame:
    """Least squares z = a x + b y + c, as one row (a, b, c): sums about the mean in one aggregate after one for the means."""
    mean = points.agg(*[F.avg(c).alias(f"m{c[0]}") for c in ("xi", "yi", "zi")])
    d = points.crossJoin(F.broadcast(mean)).select(*[(F.col(c) - F.col(f"m{c[0]}")).alias(c[0]) for c in ("xi", "yi", "zi")])
    s = d.agg(*[F.sum(F.col(p) * F.col(q)).alias(p + q) for p, q in ("xx", "xy", "yy", "xz", "yz")])
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    a = F.try_divide(F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy"), det)
    b = F.try_divide(F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy"), det)
    fit = s.select(a.alias("a"), b.alias("b")).crossJoin(mean)
    return fit.select("a", "b", (F.col("mz") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).alias("c"))


def hypotheses(candidates: DataFrame, plane: Plane) -> DataFrame:
    """h, a, b, c: planes through three candidates, chosen by their rank and the seed; flat triples fall out. Few rows."""
    n = candidates.count()
    if n < 3:
        return candidates.limit(0).select(F.lit(0).alias("h"), *[F.lit(0.0).alias(c) for c in "abc"])
    draws = [(h, i, ((h + plane.seed) * step + i) % n + 1) for h in range(plane.hypotheses) for i, step in enumerate((7919, 104729, 1299709))]
    wanted = candidates.sparkSession.createDataFrame(draws, "h int, i int, rank long")
    ranked = candidates.select("xi", "yi", "zi", "rank").join(F.broadcast(wanted), "rank")
    tri = ranked.groupBy("h").agg(*[F.max(F.when(F.col("i") == i, F.col(c))).cast("double").alias(f"{c[0]}{i}") for i in range(3) for c in ("xi", "yi", "zi")])
    u = {f"{c}{i}": F.col(f"{c}{i}") - F.col(f"{c}0") for c in "xyz" for i in (1, 2)}
    det = u["x1"] * u["y2"] - u["x2"] * u["y1"]
    a, b = (u["z1"] * u["y2"] - u["z2"] * u["y1"]) / det, (u["x1"] * u["z2"] - u["x2"] * u["z1"]) / det
    planes = tri.where(det != 0).select("h", a.alias("a"), b.alias("b"), "x0", "y0", "z0")
    return planes.select("h", "a", "b", (F.col("z0") - F.col("a") * F.col("x0") - F.col("b") * F.col("y0")).alias("c"))


def residual() -> Column:
    return F.round(F.abs(F.col("zi") - (F.col("a") * F.col("xi") + F.col("b") * F.col("yi") + F.col("c"))), 6)


def ransac_ground(points: DataFrame, plane: Plane = Plane()) -> DataFrame:
    """points with is_ground: vertical distance below the threshold from the plane that most of the lowest points agree with.

    The hypotheses are a few rows and are broadcast; all their inliers are counted in one pass over the candidates.
    """
    from pyspark.sql import Window

    low = bottom_fraction(points.select("point_id", "xi", "yi", "zi"), plane.fraction)
    low = low.withColumn("rank", F.row_number().over(Window.orderBy("zi", "point_id"))).cache()
    tried = hypotheses(low, plane)
    votes = low.crossJoin(F.broadcast(tried)).groupBy("h").agg(F.count_if(residual() < plane.threshold).alias("votes"))
    best = tried.join(votes, "h").orderBy(F.desc("votes"), "h").limit(1)
    inliers = low.crossJoin(F.broadcast(best)).where(residual() < plane.threshold)
    fit = plane_fit(inliers.select("xi", "yi", "zi"))
    return points.crossJoin(F.broadcast(fit)).withColumn("is_ground", residual() < plane.threshold).drop("a", "b", "c")


def cloth_ground(x: np.ndarray, y: np.ndarray, z: np.ndarray, cloth: Cloth) -> np.ndarray:
    """Which points are ground, by a cloth that falls on the cloud turned upside down (metres)."""
    if not len(x):
        return np.zeros(0, bool)
    up = -z
    col = np.floor((x - x.min()) / cloth.resolution).astype(int) + 1
    row = np.floor((y - y.min()) / cloth.resolution).astype(int) + 1
    shape = (row.max() + 2, col.max() + 2)
    floor = np.full(shape, -np.inf)
    np.maximum.at(floor, (row, col), up)
    while np.isneginf(floor).any():  # cells without points take their neighbours' mean
        known = np.isfinite(floor)
        filled, count = np.zeros(shape), np.zeros(shape)
        for axis, shift in ((0, 1), (0, -1), (1, 1), (1, -1)):
            near = np.roll(np.where(known, floor, 0), shift, axis)
            ok = np.roll(known, shift, axis)
            filled += near * ok
            count += ok
        new = ~known & (count > 0)
        if not new.any():
            break
        floor[new] = filled[new] / count[new]
    height = np.full(shape, up.max() + 0.05)
    before, free = height.copy(), np.ones(shape, bool)
    pull = {1: 0.3, 2: 0.66, 3: 0.81}.get(cloth.rigidness, 0.66)
    for _ in range(cloth.iterations):
        fall = np.where(free, (height - before) * 0.99 - 0.2 * cloth.step**2, 0)
        before = height.copy()
        height = height + fall
        padded = np.pad(height, 1, mode="edge")
        mean = (padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:]) / 4
        height = np.where(free, height + pull * (mean - height), height)
        hit = height <= floor
        height = np.where(hit, floor, height)
        free &= ~hit
        if not free.any() or np.abs(height - before).max() < 0.005:
            break
    # The cloth's height at each point, bilinear between cell centres.
    fx, fy = (x - x.min()) / cloth.resolution + 0.5, (y - y.min()) / cloth.resolution + 0.5
    c0, r0 = np.clip(np.floor(fx).astype(int), 0, shape[1] - 2), np.clip(np.floor(fy).astype(int), 0, shape[0] - 2)
    u, v = fx - c0, fy - r0
    at = (1 - v) * ((1 - u) * height[r0, c0] + u * height[r0, c0 + 1]) + v * ((1 - u) * height[r0 + 1, c0] + u * height[r0 + 1, c0 + 1])
    return np.abs(up - at) < cloth.threshold


def classify_ground(tiled: DataFrame, cloth: Cloth = Cloth()) -> DataFrame:
    """tiled (tile_x, tile_y, is_buffer, point_id, xi, yi, zi): point_id and is_ground of each tile's own points; one task has one tile with its halo."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("point_id")
        ground = cloth_ground(*(tile[c].to_numpy() / 100.0 for c in ("xi", "yi", "zi")), cloth)
        return pd.DataFrame({"point_id": tile["point_id"], "is_ground": ground})[~tile["is_buffer"].to_numpy()]

    return tiled.select("tile_x", "tile_y", "is_buffer", "point_id", "xi", "yi", "zi").groupBy("tile_x", "tile_y").applyInPandas(run, "point_id long, is_ground boolean")
