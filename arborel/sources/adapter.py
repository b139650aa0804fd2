"""A deterministic point cloud over the events table: one tree for each user on a 5 m grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACING = 500
TILE, HALO = 2500, 1000


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, tree_id, and coordinates in whole centimetres (xi, yi, zi)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    jitter = lambda factor: F.col("event_id") * factor % 241 - 120
    return e.select(
        F.col("event_id").alias("point_id"),
        F.col("user_id").alias("tree_id"),
        (F.col("user_id") % 10 * SPACING + SPACING // 2 + jitter(7919)).cast("long").alias("xi"),
        (F.floor(F.col("user_id") / 10) * SPACING + SPACING // 2 + jitter(104729)).cast("long").alias("yi"),
        (F.round(F.col("value") * 100).cast("long") % 2000).alias("zi"),
    )


def metres(pts: DataFrame) -> DataFrame:
    """The same points with x, y, z in metres and no class, not withheld."""
    m = lambda c: (F.col(c).cast("double") / 100).alias(c[0])
    return pts.select("point_id", m("xi"), m("yi"), m("zi"), F.lit(1).alias("classification"), F.lit(False).alias("withheld"), "tree_id", "xi", "yi", "zi")


def stems(pts: DataFrame) -> DataFrame:
    """True stem positions; every seventh tree is missing, so that some predictions find none."""
    t = pts.select(F.col("tree_id").alias("gt_id")).distinct().where("gt_id % 7 <> 0")
    return t.select("gt_id", (F.col("gt_id") % 10 * SPACING + SPACING // 2).alias("gx"), (F.floor(F.col("gt_id") / 10) * SPACING + SPACING // 2).cast("long").alias("gy"))
