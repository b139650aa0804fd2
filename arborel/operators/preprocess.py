"""Cleaning and summarising a cloud. Coordinates xi, yi, zi are whole centimetres."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NOISE
from .graph import cut_lineage
from .spatial import block_distances, cell, crowded_size

XYZ = ("xi", "yi", "zi")


@dataclass(frozen=True)
class Voxel:
    """Voxels of that size; a point's voxel is counted from half a voxel below the cloud's minimum."""

    size: int = 20


@dataclass(frozen=True)
class Outliers:
    """Points whose mean distance to their k nearest (itself included) is below mean + ratio * deviation stay. cell: where the choice of the search's cells begins."""

    k: int = 10
    ratio: float = 2.0
    cell: int = 500


@dataclass(frozen=True)
class IsolatedVoxels:
    """Points with at most n points in their voxel and the 26 around it are noise."""

    size: int = 500
    n: int = 6


def offset_to_origin(points: DataFrame) -> DataFrame:
    """Each axis less its minimum; one pass for the minima, which are one row."""
    low = points.agg(*[F.min(c).alias(f"min_{c}") for c in XYZ])
    return points.crossJoin(F.broadcast(low)).withColumns({c: F.col(c) - F.col(f"min_{c}") for c in XYZ}).drop(*[f"min_{c}" for c in XYZ])


def cloud_summary(points: DataFrame) -> DataFrame:
    """Count, extent in metres, area and density, from one aggregate."""
    a = points.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c[0]}") for c in XYZ for f in (F.min, F.max)])
    m = {f"{f}_{c}": F.col(f"{f}_{c}").cast("double") / 100 for f in ("min", "max") for c in "xyz"}
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    return a.withColumns(m).withColumn("area", F.round(area, 4)).withColumn("density", F.when(area > 0, F.round(F.col("n") / area, 6)))


def quality_report(points: DataFrame) -> DataFrame:
    """One row: points, those with a null coordinate, distinct places, and repeats of a place."""
    whole = F.col("xi").isNotNull() & F.col("yi").isNotNull() & F.col("zi").isNotNull()
    places = points.where(whole).groupBy(*XYZ).agg(F.count("*").alias("n"))
    a = places.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_valid"), F.count("*").alias("n_places"), F.count_if(F.col("n") > 1).alias("n_shared_places"))
    b = points.agg(F.count("*").alias("n_points"), F.count_if(~whole).alias("n_null"))
    out = b.crossJoin(F.broadcast(a))
    return out.select("n_points", "n_null", "n_places", "n_shared_places", (F.col("n_valid") - F.col("n_places")).alias("n_repeats"))


def dedup_points(points: DataFrame) -> DataFrame:
    """Of the points in one place, the one with the smallest point_id (a minimum with partial aggregation, no window)."""
    rest = [c for c in points.columns if c not in XYZ]
    first = points.groupBy(*XYZ).agg(F.min(F.struct("point_id", *[c for c in rest if c != "point_id"])).alias("first"))
    return first.select(*[F.col(c) if c in XYZ else F.col(f"first.{c}").alias(c) for c in points.columns])


def drop_noise(points: DataFrame) -> DataFrame:
    return points.where(F.col("classification") != NOISE)


def drop_withheld(points: DataFrame) -> DataFrame:
    return points.where(~F.col("withheld"))


def voxel_downsample(points: DataFrame, voxel: Voxel = Voxel()) -> DataFrame:
    """One mean point (centimetres, not rounded) for each voxel, with its number of points; other columns are lost."""
    low = points.agg(*[F.min(c).alias(f"min_{c}") for c in XYZ])
    index = {f"v{c[0]}": F.floor((2 * (F.col(c) - F.col(f"min_{c}")) + voxel.size) / (2 * voxel.size)).cast("long") for c in XYZ}
    grouped = points.crossJoin(F.broadcast(low)).withColumns(index).groupBy("vx", "vy", "vz")
    return grouped.agg(F.count("*").alias("n"), *[(F.sum(c) / F.count("*")).alias(c[0]) for c in XYZ])


def mean_neighbour_distance(points: DataFrame, outliers: Outliers) -> DataFrame:
    """point_id and m: the mean distance (centimetres) to the k nearest points, itself included."""
    size = crowded_size(points, 4 * outliers.k, outliers.cell, XYZ)
    return block_distances(points, outliers.k, size, XYZ)


def statistical_outliers(points: DataFrame, outliers: Outliers = Outliers()) -> DataFrame:
    """points without the outliers."""
    m = mean_neighbour_distance(points, outliers).cache()
    limit = m.where("m > 0").agg((F.avg("m") + outliers.ratio * F.stddev_samp("m")).alias("most"))
    keep = m.crossJoin(F.broadcast(limit)).where("m > 0 and m < most").select("point_id")
    return points.join(keep, "point_id", "left_semi")


def isolated_voxel_noise(points: DataFrame, noise: IsolatedVoxels = IsolatedVoxels()) -> DataFrame:
    """points with is_noise; only voxel counts, not points, meet their neighbours."""
    keyed = points.withColumns({f"v{c[0]}": cell(c, noise.size) for c in XYZ})
    counts = keyed.groupBy("vx", "vy", "vz").agg(F.count("*").alias("n"))
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in product((-1, 0, 1), repeat=3)])
    spread = counts.select("n", F.explode(shifts).alias("o"), "vx", "vy", "vz").select("n", *[(F.col(f"v{c}") + F.col(f"o.{o}")).alias(f"v{c}") for c, o in zip("xyz", "ijk", strict=True)])
    around = spread.groupBy("vx", "vy", "vz").agg(F.sum("n").alias("around"))
    return keyed.join(around, ["vx", "vy", "vz"]).withColumn("is_noise", F.col("around") <= noise.n).drop("vx", "vy", "vz", "around")


def bottom_fraction(points: DataFrame, fraction: float = 0.3) -> DataFrame:
    """The lowest int(n * fraction) points by z, ties by point_id; no sort of the cloud. Heights are whole, so counts by height (one partial aggregate) tell the height
    where the limit falls; only the points of that height are ordered, to take the rest."""
    want = int(points.count() * fraction)
    total, cut = 0, None
    # A row for each centimetre of height at most, from the lowest up to the one that is wanted.
    for z, n in points.groupBy("zi").agg(F.count("*").alias("n")).orderBy(F.asc_nulls_first("zi")).toLocalIterator():
        if total + n >= want:
            cut = z
            break
        total += n
    at = points.where(F.col("zi").eqNullSafe(F.lit(cut).cast("long"))).orderBy("point_id").limit(want - total)
    if cut is None:  # the heights that are null come first
        return at
    return points.where(F.col("zi").isNull() | (F.col("zi") < cut)).unionByName(at)


def top_slab(points: DataFrame, height: int = 400) -> DataFrame:
    """Points at most height below the highest."""
    top = points.agg(F.max("zi").alias("top"))
    return points.crossJoin(F.broadcast(top)).where(F.col("zi") >= F.col("top") - height).drop("top")


def minmax_normalize(points: DataFrame, columns: tuple[str, ...] = ("xi", "yi")) -> DataFrame:
    """Each column scaled to 0..1; null where all values are equal."""
    ends = points.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])
    scaled = {f"{c}_norm": F.try_divide(F.col(c) - F.col(f"min_{c}"), F.col(f"max_{c}") - F.col(f"min_{c}")) for c in columns}
    return points.crossJoin(F.broadcast(ends)).withColumns(scaled).drop(*ends.columns)


def renumber(frame: DataFrame, *order: str, name: str = "treeID", first: int = 1) -> DataFrame:
    """name: numbers from first in that order (which must tell rows apart). Rows are dealt by ranges of the order and numbered within each; the driver sees one count for each
    range. The ranges are written down, as a second sampling could draw them otherwise."""
    part = "_" + max(frame.columns, key=len)
    ranged = cut_lineage(frame.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    before, total = {}, first - 1
    for p, n in sorted(ranged.groupBy(part).count().collect()):
        before[p], total = total, total + n
    if not before:
        return ranged.withColumn(name, F.lit(0).cast("long")).drop(part)
    offset = F.create_map(*[F.lit(v).cast("long" if i % 2 else "int") for p in before.items() for i, v in enumerate(p)])[F.col(part)]
    return ranged.withColumn(name, offset + F.row_number().over(Window.partitionBy(part).orderBy(*order))).drop(part)
