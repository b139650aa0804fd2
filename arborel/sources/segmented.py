"""Segmented clouds on their way to LAS, and what viewers show of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import palette_index
from ..operators.preprocess import renumber
from ..schema import GROUND_TREE
from .las import register


def number_trees(clusters: DataFrame, ground: DataFrame) -> DataFrame:
    """Points x, y, z, treeID: trees of clusters (x, y, z, cluster_id) as 1..n in the order of cluster_id, points of ground (x, y, z) as 0."""
    ids = renumber(clusters.select("cluster_id").distinct(), "cluster_id")
    trees = clusters.join(ids, "cluster_id").select("x", "y", "z", "treeID")
    return trees.unionByName(ground.select("x", "y", "z", F.lit(GROUND_TREE).cast("long").alias("treeID")))


def save_segmented(points: DataFrame, path: str, point_format: int = 3, scale: float = 0.001) -> int:
    """Writes x, y, z and treeID as LAS and returns the largest treeID (0 if there is none)."""
    register(points.sparkSession)
    points.write.format("las").mode("overwrite").option("pointformat", point_format).option("scale", scale).save(path)
    return points.agg(F.coalesce(F.max("treeID"), F.lit(0))).first()[0]


def bind(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def coloured(points: DataFrame) -> DataFrame:
    """points with the place of their tree's colour in the palette; only ids, not points, are ranked. Without treeID there is nothing to colour: an error."""
    if "treeID" not in points.columns:
        raise ValueError("the cloud has no treeID")
    ids = renumber(points.select("treeID").distinct(), "treeID", name="colour").withColumn("colour", palette_index(F.col("colour")))
    return points.join(ids, "treeID", "left")


def random_colour(key: Column, seed: int = 1) -> Column:
    """A colour (three shares) that depends on key and seed alone."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(seed + i)), F.lit(256)) / 255 for i in range(3)])


def top_view(points: DataFrame, threshold: float = 0) -> DataFrame:
    """The points at most threshold below the highest; 0: all."""
    if not threshold:
        return points
    top = points.agg(F.max("z").alias("top"))
    return points.crossJoin(F.broadcast(top)).where(F.col("z") >= F.col("top") - threshold).drop("top")
