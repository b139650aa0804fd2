"""The four segmentation plans, over points in whole centimetres (point_id, xi, yi, zi; classification and withheld where named).

Each returns point_id and treeID of the points that got a tree (0 is ground where a plan tells ground apart). Parameters are those of the
frozen dataclasses of the operators. Tiles bound what one task holds. The density clusters of hybrid() are the whole cloud's, those of layered() its tiles'.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster, ground, preprocess, raster, segment, spatial, treetops
from ..schema import GROUND_TREE


@dataclass(frozen=True)
class Tiling:
    tile: int = 25_000
    halo: int = 1_000


def layered(points: DataFrame, voxel: preprocess.Voxel = preprocess.Voxel(), outliers: preprocess.Outliers = preprocess.Outliers(), height: int = 100, layers: cluster.Layers = cluster.Layers(), tiling: Tiling = Tiling()) -> DataFrame:
    """Shift, voxel means, outliers, ground by threshold, then layered clusters by tile: x, y, z (centimetres from the origin) and treeID, ground 0. Trees
    are numbered over all tiles."""
    shifted = preprocess.offset_to_origin(points.select("point_id", "xi", "yi", "zi"))
    means = preprocess.voxel_downsample(shifted, voxel)
    key = F.xxhash64("vx", "vy", "vz")
    cells = means.select(key.alias("point_id"), *[F.round(c).cast("long").alias(f"{c}i") for c in "xyz"])
    kept = ground.threshold_split(preprocess.statistical_outliers(cells, outliers), height).cache()
    above = kept.where("not is_ground").withColumns({"tile_x": spatial.cell("xi", tiling.tile), "tile_y": spatial.cell("yi", tiling.tile)})
    trees = cluster.layered_clusters(above, layers).cache()
    ids = preprocess.renumber(trees.select("tile_x", "tile_y", F.col("treeID").alias("own")).distinct(), "tile_x", "tile_y", "own")
    named = trees.withColumnRenamed("treeID", "own").join(ids, ["tile_x", "tile_y", "own"]).select("point_id", "treeID")
    segmented = above.join(named, "point_id").select("xi", "yi", "zi", F.col("treeID").cast("long"))
    return segmented.unionByName(kept.where("is_ground").select("xi", "yi", "zi", F.lit(GROUND_TREE).cast("long").alias("treeID")))


def top_down(points: DataFrame, rule: segment.TopDown = segment.TopDown(), tiling: Tiling = Tiling()) -> DataFrame:
    """Trees by growing from the highest free point, by tile with a halo; numbered over all tiles."""
    tiled = spatial.tiles_with_halo(points.select("point_id", "xi", "yi", "zi"), tiling.tile, tiling.halo)
    found = segment.top_down_trees(tiled, rule).cache()
    ids = preprocess.renumber(found.select("tile_x", "tile_y", F.col("treeID").alias("own")).distinct(), "tile_x", "tile_y", "own")
    return found.withColumnRenamed("treeID", "own").join(ids, ["tile_x", "tile_y", "own"]).select("point_id", F.col("treeID").cast("long"))


def prepared(points: DataFrame, cloth: ground.Cloth = ground.Cloth(), noise: preprocess.IsolatedVoxels = preprocess.IsolatedVoxels(), tiling: Tiling = Tiling()) -> DataFrame:
    """points with is_ground, is_noise and height (above the triangulated ground)."""
    tiled = spatial.tiles_with_halo(points.select("point_id", "xi", "yi", "zi"), tiling.tile, tiling.halo)
    classes = ground.classify_ground(tiled, cloth)
    noisy = preprocess.isolated_voxel_noise(points.select("point_id", "xi", "yi", "zi"), noise).select("point_id", "is_noise")
    flagged = points.join(classes, "point_id").join(noisy, "point_id").cache()
    heights = segment.normalize_height(spatial.tiles_with_halo(flagged, tiling.tile, tiling.halo))
    return flagged.join(heights, "point_id")


def _crowns(points: DataFrame, tops: DataFrame, canopy: DataFrame, size: int, crowns: segment.Crowns) -> DataFrame:
    seeds = tops.select("treeID", spatial.cell("xi", size).alias("col"), spatial.cell("yi", size).alias("row"))
    labels = segment.grow_crowns(canopy, seeds, crowns)
    return raster.transfer_labels(points, labels, size).where("label is not null").select("point_id", F.col("label").alias("treeID"))


def canopy_growing(points: DataFrame, size: int = 10, lmf: treetops.LocalMaximum = treetops.LocalMaximum(), crowns: segment.Crowns = segment.Crowns(), limits: tuple[int, int] = (0, 3000)) -> DataFrame:
    """Tops by local maxima, crowns grown on the clamped canopy raster. Heights are taken as they are: normalise them first, or not, as wanted."""
    tops = preprocess.renumber(treetops.local_maxima(points, lmf), "point_id")
    canopy = raster.clamp_raster(raster.canopy_raster(points, size), *limits)
    return _crowns(points, tops, canopy, size, crowns)


def hybrid_tops(points: DataFrame, density: cluster.Density = cluster.Density(), slab: int = 400) -> DataFrame:
    """Tops as the highest points of the density clusters of the top slab, without noise points: treeID from 1, point_id, xi, yi, zi."""
    high = preprocess.top_slab(preprocess.drop_noise(points), slab)
    found = cluster.density_clusters(high, density, first=1).withColumnRenamed("cluster", "treeID")
    return treetops.highest_of_each(high.select("point_id", "xi", "yi", "zi").join(found, "point_id"), "treeID")


def hybrid(points: DataFrame, size: int = 10, density: cluster.Density = cluster.Density(), slab: int = 400, crowns: segment.Crowns = segment.Crowns(), limits: tuple[int, int] = (0, 3000)) -> DataFrame:
    """hybrid_tops(), then crowns as in canopy_growing()."""
    canopy = raster.clamp_raster(raster.canopy_raster(points, size), *limits)
    return _crowns(points, hybrid_tops(points, density, slab), canopy, size, crowns)
