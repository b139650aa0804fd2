"""Tree tops: local maxima and the highest point of each tree."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import cell


@dataclass(frozen=True)
class LocalMaximum:
    """A top is at least hmin high and has nothing higher within radius (half of the window); centimetres."""

    radius: int = 200
    hmin: int = 820


def local_maxima(points: DataFrame, lmf: LocalMaximum = LocalMaximum()) -> DataFrame:
    """The points that are tops; of equally high points in reach the smaller point_id. One anti-join on cells, which stops at the first higher point."""
    high = points.where(F.col("zi") >= lmf.hmin)
    shift = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in product((-1, 0, 1), repeat=2)])
    b = high.select(F.col("point_id").alias("b_id"), *[F.col(c).alias(f"b{c[0]}") for c in ("xi", "yi", "zi")], F.explode(shift).alias("o"))
    b = b.withColumns({"cx": cell("bx", lmf.radius) + F.col("o.i"), "cy": cell("by", lmf.radius) + F.col("o.j")}).drop("o")
    a = high.withColumns({"cx": cell("xi", lmf.radius), "cy": cell("yi", lmf.radius)})
    dx, dy = F.col("xi") - F.col("bx"), F.col("yi") - F.col("by")
    higher = (F.col("bz") > F.col("zi")) | ((F.col("bz") == F.col("zi")) & (F.col("b_id") < F.col("point_id")))
    on = (a["cx"] == b["cx"]) & (a["cy"] == b["cy"]) & (dx * dx + dy * dy <= lmf.radius**2) & higher
    return a.join(b, on, "left_anti").drop("cx", "cy")


def highest_of_each(points: DataFrame, *keys: str) -> DataFrame:
    """The highest point of each value of keys, ties by the smaller point_id: a maximum with partial aggregation, no sort."""
    best = F.max(F.struct("zi", (-F.col("point_id")).alias("order"), "xi", "yi")).alias("b")
    return points.groupBy(*keys).agg(best).select(*keys, (-F.col("b.order")).alias("point_id"), "b.xi", "b.yi", "b.zi")
