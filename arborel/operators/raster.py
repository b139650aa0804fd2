"""Raster algebra on (col, row, z) tables; a missing cell is no row or a null z. All windows are joins or frames, no dense arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import clamp, gaussian_kernel
from .spatial import cell


@dataclass(frozen=True)
class Idw:
    """Inverse distance weights of the k nearest cells within radius cells, to that power."""

    k: int = 10
    power: int = 2
    radius: int = 4


def canopy_raster(points: DataFrame, size: int, *keys: str) -> DataFrame:
    """The highest z of each cell (and of each value of keys)."""
    return points.groupBy(*keys, cell("xi", size).alias("col"), cell("yi", size).alias("row")).agg(F.max("zi").alias("z"))


def densify(raster: DataFrame) -> DataFrame:
    """Every cell of the raster's bounding box, z null where there was none. One task lists the rows, others make their cells."""
    box = raster.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("col", "row") for f in (F.min, F.max)])
    rows = box.where("min_col is not null").select(F.explode(F.sequence("min_row", "max_row")).alias("row"), "min_col", "max_col").repartition("row")
    grid = rows.select("row", F.explode(F.sequence("min_col", "max_col")).alias("col"))
    return grid.join(raster, ["col", "row"], "left").select("col", "row", "z")


def clamp_raster(raster: DataFrame, low: int, high: int) -> DataFrame:
    return raster.withColumn("z", clamp(F.col("z"), low, high))


def _neighbours(raster: DataFrame, offsets: list[tuple[int, int, float]]) -> DataFrame:
    """Rows (col, row, w, v) for each cell's neighbours at the offsets, so that v is at (col + i, row + j)."""
    o = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(w)).alias("w")) for i, j, w in offsets])
    spread = raster.where("z is not null").select(F.col("z").alias("v"), F.explode(o).alias("o"), "col", "row")
    return spread.select((F.col("col") - F.col("o.i")).alias("col"), (F.col("row") - F.col("o.j")).alias("row"), "o.i", "o.j", "o.w", "v")


def focal_fill(dense: DataFrame, size: int = 3) -> DataFrame:
    """Null cells take the mean of the known cells in the window; others stay."""
    half = size // 2
    offsets = [(i, j, 1.0) for i in range(-half, half + 1) for j in range(-half, half + 1) if i or j]
    holes = dense.where("z is null").select("col", "row")
    mean = _neighbours(dense, offsets).join(holes, ["col", "row"], "left_semi").groupBy("col", "row").agg((F.sum("v") / F.count("*")).alias("mean"))
    return dense.join(mean, ["col", "row"], "left").select("col", "row", F.coalesce(F.col("z").cast("double"), "mean").alias("z"))


def focal_mean(dense: DataFrame, size: int = 25) -> DataFrame:
    """The mean of the known cells of a square window, by running sums along rows and then along columns: 2 frames, not size squared neighbours."""
    half = size // 2
    along = Window.partitionBy("row").orderBy("col").rangeBetween(-half, half)
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-half, half)
    lines = dense.select("col", "row", F.coalesce(F.sum("z").over(along), F.lit(0)).alias("s"), F.count("z").over(along).alias("n"))
    return lines.select("col", "row", F.try_divide(F.sum("s").over(down), F.sum("n").over(down)).alias("z"))


def gaussian_smooth(dense: DataFrame, sigma: float, n: int) -> DataFrame:
    """The weighted sum over an n x n window; null where the window isn't full of known cells."""
    sums = _neighbours(dense, gaussian_kernel(sigma, n)).groupBy("col", "row").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.count("*").alias("n"))
    return dense.select("col", "row").join(sums, ["col", "row"], "left").select("col", "row", F.when(F.col("n") == n * n, F.col("s")).alias("z"))


def idw_fill(dense: DataFrame, idw: Idw = Idw()) -> DataFrame:
    """Null cells take the weighted mean of the nearest known cells; none in reach: null."""
    r = idw.radius
    offsets = [(i, j, float(i * i + j * j)) for i in range(-r, r + 1) for j in range(-r, r + 1) if 0 < i * i + j * j <= r * r]
    holes = dense.where("z is null").select("col", "row")
    near = _neighbours(dense, offsets).join(holes, ["col", "row"], "left_semi")
    order = Window.partitionBy("col", "row").orderBy("w", "j", "i")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= idw.k)
    weight = F.pow(F.col("w"), F.lit(-idw.power / 2))
    filled = near.groupBy("col", "row").agg((F.sum(F.col("v") * weight) / F.sum(weight)).alias("fill"))
    return dense.join(filled, ["col", "row"], "left").select("col", "row", F.coalesce(F.col("z").cast("double"), "fill").alias("z"))


#: Weights of the eight neighbours in the slopes along columns and along rows.
_HORN = [(-1, -1, -1, -1), (0, -1, 0, -2), (1, -1, 1, -1), (-1, 0, -2, 0), (1, 0, 2, 0), (-1, 1, -1, 1), (0, 1, 0, 2), (1, 1, 1, 1)]


def slope_aspect(dense: DataFrame, size: float) -> DataFrame:
    """Slope and aspect (clockwise from the direction of growing rows), in radians, where all eight neighbours are known. size: a cell's, in the unit of z."""
    near = _neighbours(dense, [(i, j, 0.0) for i, j, _, _ in _HORN])
    pick = lambda at: F.sum(sum((F.when((F.col("i") == h[0]) & (F.col("j") == h[1]), F.col("v") * h[at]).otherwise(0) for h in _HORN), F.lit(0)))
    g = near.groupBy("col", "row").agg(F.count("*").alias("n"), pick(2).alias("sx"), pick(3).alias("sy")).where("n = 8")
    dx, dy = F.col("sx") / (8 * size), F.col("sy") / (8 * size)
    known = dense.where("z is not null").select("col", "row")
    aspect = F.when((F.col("sx") == 0) & (F.col("sy") == 0), 0.0).otherwise(F.pmod(F.atan2(-dx, -dy), F.lit(2 * 3.141592653589793)))
    return g.join(known, ["col", "row"], "left_semi").select("col", "row", F.atan(F.sqrt(dx * dx + dy * dy)).alias("slope"), aspect.alias("aspect"))


def hillshade(terrain: DataFrame, altitude: float = 0.7853981633974483, direction: float = 5.497787143782138) -> DataFrame:
    """Light on each cell of slope_aspect(), 0 to 1, from a sun at that altitude and direction (radians)."""
    import math

    light = F.cos("slope") * math.sin(altitude) + F.sin("slope") * math.cos(altitude) * F.cos(F.lit(direction) - F.col("aspect"))
    return terrain.select("col", "row", F.greatest(F.lit(0.0), light).alias("shade"))


def mosaic(tiles: DataFrame) -> DataFrame:
    """One raster of tiles' rasters: of cells that several tiles have, the highest."""
    return tiles.groupBy("col", "row").agg(F.max("z").alias("z"))


def transfer_labels(points: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """points with the label of the cell that they lie in (null if none)."""
    keyed = points.withColumns({"col": cell("xi", size), "row": cell("yi", size)})
    return keyed.join(labels.select("col", "row", "label"), ["col", "row"], "left").drop("col", "row")
