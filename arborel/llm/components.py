"""Connected components of a graph held in a DataFrame: alternating large-star and small-star rounds.

Each partition first shrinks its own edges to stars by union-find; every round then moves all edges of a
node to its smallest neighbour, by grouped minima and joins only (a node with very many edges is a
pre-aggregated minimum and a join that AQE can split). The number of rounds grows with the logarithm of
the longest path. Rounds end in tables of the shared folder.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, saved


def _stars(batches):
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def out():
        nodes = [x for x in parent if root(x) != x]
        made = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])
        parent.clear()
        return made

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 2_000_000:
            yield out()
    yield out()


def components(edges: DataFrame, native: bool = False) -> DataFrame:
    """edges (a, b), longs without nulls, in any direction, repeated or not, loops ignored.

    Returns (node, root) once for every node of an edge that isn't a loop: root is the smallest node of its
    component. No edges: no rows. native: DataFrame functions alone, without the partitions' own union-find.
    """
    edges = edges.select("a", "b").where("a <> b")
    edges = saved(edges.distinct() if native else in_arrow(edges, _stars, "a long, b long"))
    while True:
        # Stars already: every node but the roots has one edge, to a root.
        count = edges.agg(F.count("*"), F.count_distinct("a"), F.count_if(F.col("a") < F.col("b"))).first()
        if count[0] == count[1] and not count[2] and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = down.join(least, F.col("a") == F.col("u")).select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")
        )
        edges = saved(small.select("e.a", "e.b").where("a <> b").distinct())
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
