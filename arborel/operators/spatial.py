"""Neighbourhood joins by grid cells, so that Spark plans equi-joins and never compares all pairs.

Coordinates are whole numbers (centimetres), so distances are exact. One side is copied to the cells around its own; the other is
not. Cells that hold very many rows are split by AQE's skew join.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def cell(value: Column | str, size: int) -> Column:
    """The number of the cell of that size that holds value; cells are anchored at 0."""
    return F.floor((F.col(value) if isinstance(value, str) else value) / size).cast("long")


def square_distance(a: str, b: str, axes: str) -> Column:
    return reduce(lambda s, c: s + c, [(F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in axes])


def pairs_in_cells(left: DataFrame, right: DataFrame, size: int, axes: str = "xy") -> DataFrame:
    """Pairs of rows of left (columns a<axis>) and right (b<axis>) whose cells touch, with d2: every pair within size is among them."""
    own = [cell(f"a{c}", size).alias(f"c{c}") for c in axes]
    offsets = F.array(*[F.struct(*[F.lit(o).alias(f"o{c}") for c, o in zip(axes, shift, strict=True)]) for shift in product((-1, 0, 1), repeat=len(axes))])
    around = right.select("*", F.explode(offsets).alias("o"))
    around = around.select(*right.columns, *[(cell(f"b{c}", size) + F.col(f"o.o{c}")).alias(f"c{c}") for c in axes])
    keys = [f"c{c}" for c in axes]
    return left.select("*", *own).join(around, keys).drop(*keys).withColumn("d2", square_distance("a", "b", axes))


def range_join(left: DataFrame, right: DataFrame, radius: int, axes: str = "xy") -> DataFrame:
    """Pairs at most radius apart."""
    return pairs_in_cells(left, right, radius, axes).where(F.col("d2") <= radius * radius)


def knn_join(left: DataFrame, right: DataFrame, k: int, size: int, left_id: str, right_id: str, axes: str = "xy") -> DataFrame:
    """Each row of left with its k nearest of right (all, if fewer), nearest first as rank from 1; ties go to the smaller right_id.

    Rows search the cells around theirs; those whose k-th distance isn't within a cell's size search again in cells of twice
    the size, until all are settled or a cell spans everything. Each round ends in a checkpoint-free count of the rows left.
    """
    bounds = left.select(*[F.col(f"a{c}").alias(c) for c in axes]).unionByName(right.select(*[F.col(f"b{c}").alias(c) for c in axes]))
    low_high = bounds.agg(*[F.min(c).alias(f"l{c}") for c in axes], *[F.max(c).alias(f"h{c}") for c in axes]).first()
    if low_high[f"l{axes[0]}"] is None:
        return pairs_in_cells(left, right, size, axes).withColumn("rank", F.lit(1))
    span = max(low_high[f"h{c}"] - low_high[f"l{c}"] for c in axes) + 1
    order = Window.partitionBy(left_id).orderBy("d2", right_id)
    found, todo = [], left
    while True:
        near = pairs_in_cells(todo, right, size, axes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if size >= span:
            found.append(near)
            break
        near = near.withColumn("settled", F.max(F.when(F.col("rank") == k, F.col("d2"))).over(Window.partitionBy(left_id)) <= size * size).cache()
        done = near.where("settled")
        found.append(done.drop("settled"))
        todo = todo.join(done.select(left_id).distinct(), left_id, "left_anti")
        if todo.isEmpty():
            break
        size *= 2
    return reduce(DataFrame.unionByName, found)


def crowded_size(points: DataFrame, k: int, size: int, columns: tuple[str, ...]) -> int:
    """The size of cells in which the k-th neighbour of most points lies within a cell's size, from the crowd that points meet in cells of a given size: one partial aggregate."""
    cells = points.groupBy(*[cell(c, size).alias(f"c{i}") for i, c in enumerate(columns)]).agg(F.count("*").alias("n"))
    crowd = cells.agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd")).first()["crowd"]
    ball = {2: math.pi, 3: 4 / 3 * math.pi}[len(columns)]
    return max(1, round(size * (1.5 * k / ball / crowd) ** (1 / len(columns)))) if crowd else size


def block_distances(points: DataFrame, k: int, size: int, columns: tuple[str, ...]) -> DataFrame:
    """point_id and m: each point's mean distance to its k nearest (itself included; all, if fewer). size: a radius that holds k points nearly everywhere.

    Blocks of four times the size go to numpy with all that lies within size of them; a point whose k-th distance is larger searches once more with twice the
    size, among the blocks that still hold such points. The few after that, which may lie far from everything, are left to knn_join(), so no block grows with the cloud.
    """
    own = points.select("point_id", *columns)
    done, todo = [], own
    for _ in range(2):
        m = _in_blocks(own, todo, k, size, columns).cache()
        done.append(m.where("m is not null"))
        todo = m.where("m is null").select("point_id", *columns)
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, [d.select("point_id", "m") for d in done])
        size *= 2
    side = lambda frame, p: frame.select(F.col("point_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}{a}") for c, a in zip(columns, AXES, strict=False)])
    near = knn_join(side(todo, "a"), side(own, "b"), k, size, "a_id", "b_id", "".join(AXES[: len(columns)]))
    done.append(near.groupBy(F.col("a_id").alias("point_id")).agg((F.sum(F.sqrt(F.col("d2").cast("double"))) / F.count("*")).alias("m")))
    return reduce(DataFrame.unionByName, [d.select("point_id", "m") for d in done])


def _in_blocks(own: DataFrame, todo: DataFrame, k: int, size: int, columns: tuple[str, ...]) -> DataFrame:
    """todo with m, null where the k-th distance is more than size."""
    width, keys = 4 * size, [f"block_{c}" for c in columns]
    asked = todo.withColumns({b: cell(c, width) for b, c in zip(keys, columns, strict=True)}).withColumn("asked", F.lit(True))
    near = own
    for b, c in zip(keys, columns, strict=True):
        near = near.withColumn(b, F.explode(F.sequence(cell(F.col(c) - size, width), cell(F.col(c) + size, width))))
    if todo is not own:
        near = near.join(asked.select(*keys).distinct(), keys, "left_semi")
    both = near.withColumn("asked", F.lit(False)).unionByName(asked)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        asks = block["asked"].to_numpy()
        want, have = block[asks], block.loc[~asks, list(columns)].to_numpy().astype(np.int64)
        places, mean = want[list(columns)].to_numpy().astype(np.int64), np.full(len(want), np.nan)
        # Slices bound the distances in memory, whatever the block holds.
        step, least = max(1, 1_000_000 // max(1, len(have))), min(k, len(have))
        for at in range(0, len(want), step) if len(have) >= k else ():
            d2 = sum((places[at : at + step, None, i] - have[None, :, i]) ** 2 for i in range(len(columns)))
            best = np.partition(d2, least - 1, axis=1)[:, :least]
            mean[at : at + step] = np.where(best.max(axis=1) <= size * size, np.sqrt(np.sort(best, axis=1).astype(float)).mean(axis=1), np.nan)
        out = want[["point_id", *columns]].copy()
        out["m"] = pd.Series(mean, index=out.index).astype(object).where(~np.isnan(mean), None)
        return out

    kinds = ", ".join(["point_id long", *[f"{c} long" for c in columns], "m double"])
    return both.groupBy(*keys).applyInPandas(run, kinds)


def nearest(left: DataFrame, right: DataFrame, size: int, left_id: str, right_id: str, axes: str = "xy") -> DataFrame:
    return knn_join(left, right, 1, size, left_id, right_id, axes).drop("rank")


def tiles_with_halo(points: DataFrame, tile: int, halo: int, x: str = "xi", y: str = "yi") -> DataFrame:
    """points in each tile that they belong to or lie within halo of: tile_x, tile_y, is_buffer. A point outside all halos stands once; halo is at most tile."""
    reach = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    out = points.withColumn("tile_x", F.explode(reach(x))).withColumn("tile_y", F.explode(reach(y)))
    own = (F.floor(F.col(x) / tile) == F.col("tile_x")) & (F.floor(F.col(y) / tile) == F.col("tile_y"))
    return out.withColumn("is_buffer", ~own)
