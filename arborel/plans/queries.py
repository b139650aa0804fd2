"""The registered queries over the events point cloud, with parameters that suit its density."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import cluster, evaluate, ground, preprocess, raster, segment, spatial, treetops
from ..sources import segmented
from ..sources.adapter import HALO, TILE, metres, points, stems
from . import evaluation, pipelines

CELL = 50
DENSITY = cluster.Density(100, 5)
TILING = pipelines.Tiling(TILE, HALO)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def _rounded_doubles(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """As SQL rounds doubles: the product with a power of ten goes to the nearest whole number, halves away from zero (F.round() rounds the shortest decimal form instead)."""
    whole = lambda c: F.floor(F.abs(F.col(c) * 10.0**digits) + 0.5) * F.signum(c)
    return df.withColumns({c: whole(c) / 10.0**digits for c in columns})


def _chm(s, d):
    return raster.canopy_raster(points(s, d), CELL)


def _dense(s, d):
    return raster.densify(_chm(s, d))


def _solid(s, d):
    return _dense(s, d).withColumn("z", F.coalesce("z", F.lit(0)))


def _tops(s, d):
    """The highest point of each tree."""
    return treetops.highest_of_each(points(s, d), "tree_id").withColumnRenamed("tree_id", "treeID")


def _matches(s, d):
    return evaluate.nearest_reference(_tops(s, d), stems(points(s, d)))


def _tile(x: str, y: str):
    return {"tile_x": spatial.cell(x, TILE), "tile_y": spatial.cell(y, TILE)}


def _centroids(s, d):
    p = points(s, d).where("point_id % 1000 = 0")
    return p.select(F.col("point_id").alias("centroid_id"), F.col("xi").alias("cx"), F.col("yi").alias("cy"), F.col("zi").alias("cz"))


def _labels(s, d):
    """Each tree's highest cell as a seed, of trees that share a cell the smallest."""
    top = _tops(s, d)
    return top.groupBy(spatial.cell("xi", CELL).alias("col"), spatial.cell("yi", CELL).alias("row")).agg(F.min("treeID").alias("label"))


def offset_to_origin(s, d):
    return preprocess.offset_to_origin(points(s, d)).select("point_id", "xi", "yi", "zi")


def cloud_summary(s, d):
    return preprocess.cloud_summary(points(s, d))


def quality_report(s, d):
    return preprocess.quality_report(_coarse(s, d))


def _coarse(s, d):
    return points(s, d).select("point_id", *[spatial.cell(c, 50).alias(c) for c in preprocess.XYZ])


def dedup_points(s, d):
    return preprocess.dedup_points(_coarse(s, d))


def ground_threshold_split(s, d):
    return ground.threshold_split(points(s, d)).select("point_id", "is_ground")


def ground_plane_ols(s, d):
    return _rounded(ground.plane_fit(preprocess.bottom_fraction(points(s, d))), 6, "a", "b", "c")


def ransac_ground_seeded(s, d):
    return ground.ransac_ground(points(s, d)).select("point_id", "is_ground")


def bottom_fraction(s, d):
    return preprocess.bottom_fraction(points(s, d)).select("point_id", "zi")


def voxel_downsample(s, d):
    return _rounded(preprocess.voxel_downsample(points(s, d), preprocess.Voxel(200)), 4, "x", "y", "z")


def statistical_outlier(s, d):
    return preprocess.statistical_outliers(points(s, d)).select("point_id")


def isolated_voxel_noise(s, d):
    return preprocess.isolated_voxel_noise(points(s, d), preprocess.IsolatedVoxels(100, 6)).select("point_id", "is_noise")


def retile_with_halo(s, d):
    return spatial.tiles_with_halo(points(s, d), TILE, HALO).select("point_id", "tile_x", "tile_y", "is_buffer")


def height_layers(s, d):
    return cluster.height_layers(points(s, d)).select("point_id", "layer_idx", "is_clustered")


def top_slab(s, d):
    return preprocess.top_slab(points(s, d)).select("point_id", "zi")


def tree_tops_max(s, d):
    return _tops(s, d)


def lmf_tree_tops(s, d):
    return treetops.local_maxima(points(s, d)).select("point_id", "xi", "yi", "zi")


def canopy_max_raster(s, d):
    return _chm(s, d)


def raster_clamp(s, d):
    return raster.clamp_raster(_dense(s, d), 200, 1500)


def focal_fill_3x3(s, d):
    return _rounded(raster.focal_fill(_dense(s, d)), 6, "z")


def focal_mean_25(s, d):
    return _rounded(raster.focal_mean(_dense(s, d)), 6, "z")


def gaussian_smooth_chm(s, d):
    return _rounded(raster.gaussian_smooth(_solid(s, d), 2, 7), 6, "z")


def gaussian_smooth_dsm(s, d):
    return _rounded(raster.gaussian_smooth(_dense(s, d), 1, 5), 6, "z")


def idw_fill(s, d):
    return _rounded(raster.idw_fill(_dense(s, d)), 6, "z")


def slope_aspect(s, d):
    return _rounded(raster.slope_aspect(_solid(s, d), float(CELL)), 6, "slope", "aspect")


def hillshade(s, d):
    return _rounded(raster.hillshade(raster.slope_aspect(_solid(s, d), float(CELL))), 6, "shade")


def raster_mosaic(s, d):
    return raster.mosaic(raster.canopy_raster(spatial.tiles_with_halo(points(s, d), TILE, HALO), CELL, "tile_x", "tile_y"))


def dbscan_core_points(s, d):
    return cluster.core_points(preprocess.top_slab(points(s, d)), DENSITY)


def dbscan_clusters(s, d):
    return cluster.density_clusters(preprocess.top_slab(points(s, d)), DENSITY)


def hybrid_tree_tops(s, d):
    noisy = preprocess.isolated_voxel_noise(points(s, d), preprocess.IsolatedVoxels(100, 6)).withColumn("classification", F.when(F.col("is_noise"), 18).otherwise(1))
    return pipelines.hybrid_tops(noisy, DENSITY)


def kmeans_assign_step(s, d):
    return cluster.assign_centroids(points(s, d), _centroids(s, d)).select("point_id", "centroid_id", "d2")


def kmeans_update_step(s, d):
    return _rounded_doubles(cluster.update_centroids(cluster.assign_centroids(points(s, d), _centroids(s, d))), 4, "cx", "cy", "cz")


def label_transfer(s, d):
    return raster.transfer_labels(points(s, d), _labels(s, d), CELL).select("point_id", "label")


def grow_step(s, d):
    labels = _labels(s, d)
    return segment.grow_step(_chm(s, d), labels, labels.withColumnRenamed("label", "treeID"))


def layered_segmentation(s, d):
    layers = cluster.Layers(density=DENSITY)
    return pipelines.layered(points(s, d), preprocess.Voxel(20), preprocess.Outliers(), 100, layers, TILING)


def kmeans_seeded(s, d):
    """One tile's points by centroid, from seeds to the end."""
    import numpy as np
    import pandas as pd

    tiled = points(s, d).withColumns(_tile("xi", "yi"))

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("point_id", ignore_index=True)
        xyz = tile[["xi", "yi", "zi"]].to_numpy().astype(float)
        seeds = xyz[np.arange(0, len(xyz), max(1, len(xyz) // 10))]
        return tile[["point_id"]].assign(cluster=cluster.kmeans_array(xyz, seeds))

    return tiled.groupBy("tile_x", "tile_y").applyInPandas(run, "point_id long, cluster long")


def dalponte_segmentation(s, d):
    return pipelines.canopy_growing(points(s, d), CELL, crowns=segment.Crowns(max_cells=5))


def hybrid_segmentation(s, d):
    return pipelines.hybrid(metres(points(s, d)), CELL, DENSITY, crowns=segment.Crowns(max_cells=5))


def li2012_segmentation(s, d):
    return pipelines.top_down(points(s, d), tiling=TILING)


def _tiled(s, d):
    return spatial.tiles_with_halo(points(s, d), TILE, 300)


def csf_ground(s, d):
    return ground.classify_ground(_tiled(s, d), ground.Cloth(resolution=1.0))


def normalize_height(s, d):
    low = ground.threshold_split(_tiled(s, d), 100)
    return _rounded(segment.normalize_height(low), 4, "height")


def terrain_raster(s, d):
    low = ground.threshold_split(_tiled(s, d), 100)
    return _rounded(segment.terrain_raster(low, 250, TILE), 4, "z")


def tree_count(s, d):
    keyed = points(s, d).withColumns(_tile("xi", "yi")).withColumn("treeID", F.when(F.col("tree_id") % 5 != 0, F.col("tree_id")))
    return keyed.groupBy("tile_x", "tile_y").agg(F.count_distinct("treeID").alias("tree_count"))


def nearest_ground_truth(s, d):
    return _matches(s, d)


def tile_metrics(s, d):
    tops, truth = _tops(s, d), stems(points(s, d))
    predicted = tops.join(_matches(s, d), "treeID").withColumns(_tile("xi", "yi"))
    out = evaluate.metrics(predicted, truth.withColumns(_tile("gx", "gy")), "tile_x", "tile_y")
    return _rounded(out, 6, "precision", "recall", "f1_score")


def overall_metrics(s, d):
    return _rounded(evaluate.metrics(_matches(s, d), stems(points(s, d))), 6, "precision", "recall", "f1_score")


def one_to_one_matches(s, d):
    return evaluate.one_to_one(_matches(s, d))


def match_labels_union(s, d):
    return evaluate.match_labels(_tops(s, d), _matches(s, d), stems(points(s, d)))


def relative_count_error(s, d):
    return evaluate.relative_count_error(_tops(s, d).withColumns(_tile("xi", "yi")), stems(points(s, d)).withColumns(_tile("gx", "gy")), "tile_x", "tile_y")


def minmax_normalize(s, d):
    return _rounded(preprocess.minmax_normalize(_tops(s, d)).select("treeID", "xi_norm", "yi_norm"), 9, "xi_norm", "yi_norm")


def renumber_trees(s, d):
    return preprocess.renumber(_tops(s, d).select(F.col("treeID").alias("old_id"), "zi"), "old_id").select("old_id", F.col("treeID").cast("long"))


def palette_index(s, d):
    rank = F.dense_rank().over(Window.orderBy("treeID"))
    return _tops(s, d).select("treeID").withColumn("colour", kernels.palette_index(rank))


def file_name_parts(s, d):
    p = s.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    number = F.regexp_extract("path", r"(\d+)\D*$", 1)
    return p.select("page_id", kernels.base_name(F.col("path")).alias("name"), kernels.stem(F.col("path")).alias("stem"), F.when(number != "", number.cast("long")).alias("tile"))


NAMES = (
    "offset_to_origin cloud_summary quality_report dedup_points ground_threshold_split ground_plane_ols ransac_ground_seeded bottom_fraction "
    "voxel_downsample statistical_outlier isolated_voxel_noise retile_with_halo height_layers top_slab tree_tops_max lmf_tree_tops canopy_max_raster "
    "raster_clamp focal_fill_3x3 focal_mean_25 gaussian_smooth_chm gaussian_smooth_dsm idw_fill slope_aspect hillshade raster_mosaic dbscan_core_points "
    "dbscan_clusters hybrid_tree_tops kmeans_assign_step kmeans_update_step kmeans_seeded label_transfer grow_step layered_segmentation "
    "dalponte_segmentation hybrid_segmentation li2012_segmentation csf_ground normalize_height terrain_raster tree_count nearest_ground_truth tile_metrics "
    "overall_metrics one_to_one_matches match_labels_union relative_count_error minmax_normalize renumber_trees palette_index file_name_parts"
).split()
QUERIES = {name: globals()[name] for name in NAMES}


def _by_tile(s, d):
    segmented = points(s, d).withColumn("tile", spatial.cell("xi", TILE) + 100 * spatial.cell("yi", TILE)).withColumn("treeID", F.when(F.col("tree_id") % 5 != 0, F.col("tree_id")))
    truth = stems(points(s, d)).where("gt_id % 10 < 5 or gt_id > 60").withColumn("tile", spatial.cell("gx", TILE) + 100 * spatial.cell("gy", TILE))
    return segmented, truth


def segmented_tile_metrics(s, d):
    return _rounded(evaluation.evaluate_tiles(*_by_tile(s, d), exclude_zero=True), 6, "precision", "recall", "f1_score")


def skipped_tiles(s, d):
    return evaluation.skipped_tiles(*_by_tile(s, d))


def tree_colours(s, d):
    return segmented.coloured(points(s, d).withColumn("treeID", F.col("tree_id"))).select("point_id", "colour")


def numbered_trees(s, d):
    m = metres(points(s, d))
    split = m.withColumn("cluster_id", F.col("tree_id") * 3)
    return segmented.number_trees(split.where("zi > 100"), m.where("zi <= 100"))


QUERIES |= {f.__name__: f for f in (segmented_tile_metrics, skipped_tiles, tree_colours, numbered_trees)}
