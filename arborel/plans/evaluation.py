"""Segmented clouds against reference positions, tile by tile, and the log of runs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, spatial, treetops


def require_same_crs(left: str | None, right: str | None, fallback: str | None = None) -> str | None:
    """The coordinate system of both sides (names or WKT; a missing one is the fallback). There is no projection library, so different ones are an error."""
    left, right = left or fallback, right or fallback
    if left != right:
        raise ValueError(f"coordinate systems differ and can't be transformed here: {left!r} and {right!r}")
    return left


def predicted_tops(segmented: DataFrame, exclude_zero: bool = False) -> DataFrame:
    """The highest point of each tree of each tile. Points without treeID are no tree; treeID 0, which is ground, is one unless exclude_zero."""
    own = segmented.where(F.col("treeID").isNotNull())
    return treetops.highest_of_each(own.where("treeID <> 0") if exclude_zero else own, "tile", "treeID")


def match_tiles(tops: DataFrame, truth: DataFrame, match: int = evaluate.MATCH) -> DataFrame:
    """tops (tile, treeID, xi, yi) with the nearest of truth (tile, gt_id, gx, gy) of the same tile: gt_id, d2, is_match. One job for all tiles."""
    a = tops.select("tile", "treeID", F.col("xi").alias("ax"), F.col("yi").alias("ay"))
    b = truth.select("tile", "gt_id", F.col("gx").alias("bx"), F.col("gy").alias("by"))
    # A prediction is settled by the cells around it where those hold a position within a cell's size; only the rest meets all positions of the tile.
    close = spatial.pairs_in_cells(a, b.withColumnRenamed("tile", "b_tile"), match, "xy").where((F.col("tile") == F.col("b_tile")) & (F.col("d2") <= match * match))
    settled = close.groupBy("tile", "treeID").agg(F.min(F.struct("d2", "gt_id")).alias("m"))
    far = a.join(settled, ["tile", "treeID"], "left_anti").join(b, "tile").withColumn("d2", spatial.square_distance("a", "b", "xy"))
    best = settled.unionByName(far.groupBy("tile", "treeID").agg(F.min(F.struct("d2", "gt_id")).alias("m")))
    return best.select("tile", "treeID", "m.gt_id", "m.d2", (F.col("m.d2") <= match * match).alias("is_match"))


def evaluate_tiles(segmented: DataFrame, truth: DataFrame, match: int = evaluate.MATCH, exclude_zero: bool = False, one_to_one: bool = False) -> DataFrame:
    """tile, true and false positives, false negatives, precision, recall and F1 of each tile that has both predictions and reference positions."""
    found = match_tiles(predicted_tops(segmented, exclude_zero), truth, match)
    if one_to_one:
        from pyspark.sql import Window

        first = F.row_number().over(Window.partitionBy("tile", "gt_id").orderBy("d2", "treeID")) == 1
        found = found.withColumn("is_match", F.col("is_match") & first)
    return evaluate.metrics(found, truth, "tile")


def skipped_tiles(segmented: DataFrame, truth: DataFrame) -> DataFrame:
    """tile and reason of the tiles that have no row in evaluate_tiles()."""
    p = segmented.groupBy("tile").agg(F.count_if(F.col("treeID").isNotNull()).alias("trees"))
    t = truth.select("tile").distinct().withColumn("has_truth", F.lit(True))
    both = p.join(t, "tile", "full_outer")
    reason = F.when(F.col("trees").isNull(), "no points").when(F.col("trees") == 0, "no trees").when(F.col("has_truth").isNull(), "no reference positions")
    return both.select("tile", reason.alias("reason")).where("reason is not null")


def timed(name: str, frame: DataFrame, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row for the log of runs: file, time_seconds and tree_count of a plan that gives treeID (ground doesn't count)."""
    began = time.perf_counter()
    trees = plan(frame).where("treeID <> 0").agg(F.count_distinct("treeID")).first()[0]
    return frame.sparkSession.createDataFrame([(name, time.perf_counter() - began, trees)], "file string, time_seconds double, tree_count long")


def average_times(log: DataFrame) -> DataFrame:
    """The mean time of each model of a log with model and time_seconds."""
    return log.groupBy("model").agg(F.avg("time_seconds").alias("average_seconds"), F.count("*").alias("runs"))
