"""Density clusters over the whole cloud, centroid clusters, and the layered combination of both."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .graph import cut_lineage, smallest_labels
from .preprocess import renumber
from .spatial import range_join, tiles_with_halo

COORDINATES = ("xi", "yi", "zi")
#: Centroids of a block, points that a task searches at once, and centroids that the blocks are cut by.
BLOCK_CENTROIDS, BLOCK_POINTS, CUT_SAMPLE = 8192, 131_072, 65_536


@dataclass(frozen=True)
class Density:
    """Core points have at least min_points (themselves included) within eps in the plane."""

    eps: int = 40
    min_points: int = 20


@dataclass(frozen=True)
class Layers:
    """Heights of layers and of the top allowance, and the density clusters of the top layer; centimetres."""

    height: int = 100
    allowance: int = 400
    density: Density = Density()
    least: int = 3
    include_apex: bool = False


def _neighbours(points: DataFrame, density: Density) -> DataFrame:
    a = points.select(F.col("point_id").alias("a_id"), F.col("xi").alias("ax"), F.col("yi").alias("ay"))
    b = points.select(F.col("point_id").alias("b_id"), F.col("xi").alias("bx"), F.col("yi").alias("by"))
    return range_join(a, b, density.eps).select("a_id", "b_id")


def core_points(points: DataFrame, density: Density = Density()) -> DataFrame:
    """point_id, neighbours (itself included) and is_core."""
    n = _neighbours(points, density).groupBy(F.col("a_id").alias("point_id")).agg(F.count("*").alias("neighbours"))
    return n.withColumn("is_core", F.col("neighbours") >= density.min_points)


def density_clusters(points: DataFrame, density: Density = Density(), first: int = 0) -> DataFrame:
    """point_id and cluster of every clustered point; noise has no row. Clusters count from first in the order of their smallest core point;
    a border point goes to the smallest of those that reach it. Labels spread over the whole cloud, whatever its tiles.

    Tiles of 64 eps find their own clusters with a halo of 2 eps, in which the core points within eps of a tile are all known as such; a cluster is named by its smallest core point in the
    tile. A core point that two tiles name differently links the names, so the rounds over the whole cloud see names of clusters that cross edges, not points.
    """
    tiled = tiles_with_halo(points.select("point_id", "xi", "yi"), 64 * density.eps, 2 * density.eps)

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("point_id", ignore_index=True)
        at, near, core = _reached(tile[["xi", "yi"]].to_numpy().astype(np.int64), density)
        ids, name = tile["point_id"].to_numpy(), np.arange(len(tile))
        linked = core[at] & core[near]
        a, b = at[linked], near[linked]
        while True:
            new = name.copy()
            np.minimum.at(new, a, name[b])
            np.minimum.at(new, name[a], name[b])
            new = new[new]
            if (new == name).all():
                break
            name = new
        # A core point has its own name alone, a border point those of all clusters that reach it.
        shown = core[near] & (~core[at] | (at == near))
        out = pd.DataFrame({"point_id": ids[at[shown]], "name": ids[name[near[shown]]], "is_core": core[at[shown]], "is_buffer": tile["is_buffer"].to_numpy()[at[shown]]})
        return out.drop_duplicates()

    local = tiled.groupBy("tile_x", "tile_y").applyInPandas(run, "point_id long, name long, is_core boolean, is_buffer boolean").cache()
    spread = local.where("is_core").groupBy("point_id").agg(F.min("name").alias("a"), F.max("name").alias("b"), F.collect_set("name").alias("names")).where("a <> b")
    links = spread.select("a", F.explode("names").alias("b")).where("a <> b").distinct()
    named = local.where("not is_buffer")
    if links.isEmpty():
        reached = named.groupBy("point_id").agg(F.min("name").alias("label"))
    else:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().cache()
        merged = smallest_labels(both.select(F.col("a").alias("id")).distinct(), both).select(F.col("id").alias("name"), "label")
        reached = named.join(merged, "name", "left").groupBy("point_id").agg(F.min(F.coalesce("label", "name")).alias("label"))
    ids = renumber(reached.select("label").distinct(), "label", name="cluster", first=first)
    return reached.join(ids, "label").select("point_id", F.col("cluster").cast("long"))


def _reached(xy: np.ndarray, density: Density) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (at, near) of places in xy at most eps apart, each with itself too, and which places are core points."""
    cells = np.floor_divide(xy, density.eps)
    cells -= cells.min(axis=0) - 1 if len(xy) else 0
    width = int(cells[:, 1].max()) + 2 if len(xy) else 1
    key = cells[:, 0] * width + cells[:, 1]
    order = np.argsort(key, kind="stable")
    ordered, pairs = key[order], []
    for shift in (-width, 0, width):
        low, high = np.searchsorted(ordered, key + shift - 1, "left"), np.searchsorted(ordered, key + shift + 1, "right")
        many, start = high - low, 0
        ends = many.cumsum()
        # Slices of some four million candidates.
        while start < len(xy):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 4_000_000, "right")))
            n = many[start:stop]
            a = np.repeat(np.arange(start, stop), n)
            b = order[np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(low[start:stop], n)]
            close = ((xy[a] - xy[b]) ** 2).sum(axis=1) <= density.eps**2
            pairs.append((a[close], b[close]))
            start = stop
    at, near = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, int) for i in (0, 1))
    return at, near, np.bincount(at, minlength=len(xy)) >= density.min_points


def assign_centroids(points: DataFrame, centroids: DataFrame, block: int = BLOCK_CENTROIDS, chunk: int = BLOCK_POINTS) -> DataFrame:
    """points with the nearest centroid's centroid_id (of centroid_id, cx, cy, cz; ties to the smaller id) and d2. Without a distance, as a coordinate is null, the smallest id of all
    and a null d2; without centroids no rows.

    Centroids are cut by a k-d tree over a bounded sample into blocks of some `block`, and points go to their block in chunks that numpy searches box by box. Where another block's
    box is as near as the centroid found, the point searches that block too, so the result is exact whatever the sample.
    """
    places = ("cx", "cy", "cz")
    own = centroids.select("centroid_id", *places)
    whole = own.dropna(subset=places).groupBy(*places).agg(F.min("centroid_id").alias("centroid_id"))
    ids = dict(own.schema.fields[0].jsonValue())["type"]
    exact = all(f.dataType.typeName() in ("byte", "short", "integer", "long") for f in (*own.schema.fields[1:], *points.select(*COORDINATES).schema.fields))
    kinds = f"centroid_id {ids}, d2 {'long' if exact else 'double'}"
    found = own.agg(F.count("*").alias("all"), F.min("centroid_id").alias("first")).first()
    many = whole.count()
    nowhere = points if not many else points.where(" or ".join(f"{c} is null" for c in COORDINATES))
    nowhere = nowhere.select("*", F.lit(found["first"]).cast(ids).alias("centroid_id"), F.lit(None).cast(kinds.split()[-1]).alias("d2"))
    if not many:
        return nowhere if found["all"] else nowhere.where(F.lit(False))
    depth = max(0, min(math.ceil(math.log2(many / block)), int(math.log2(CUT_SAMPLE / 16))))
    sample = whole.orderBy(F.xxhash64(*places), *places).limit(CUT_SAMPLE).select(*places).toPandas().to_numpy() if depth else None
    leaf = _leaf(_cuts(sample, depth) if depth else [])
    cut = whole.select("*", leaf(*places).alias("_leaf"))
    boxes = {}
    if depth:
        cut = cut_lineage(cut)
        ends = [f(c).alias(f"{n}{c}") for n, f in (("low_", F.min), ("high_", F.max)) for c in places]
        boxes = {r["_leaf"]: (r[1:4], r[4:7]) for r in cut.groupBy("_leaf").agg(*ends).collect()}

    def search(asked: DataFrame, columns: list[str], others: dict) -> DataFrame:
        """asked (_leaf, columns) with centroid_id, d2 and _more, the other blocks to search."""
        chunks = asked.groupBy("_leaf").agg(F.ceil(F.count("*") / chunk).cast("int").alias("_chunks"))
        dealt = asked.join(F.broadcast(chunks), "_leaf").withColumn("_chunk", F.pmod(F.xxhash64(columns[0], *COORDINATES), "_chunks").cast("int"))
        copies = cut.join(F.broadcast(chunks), "_leaf").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        schema = asked.select(*columns).schema

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.sort_by("centroid_id")
            xyz = lambda t, names: np.stack([t[c].to_numpy() for c in names], axis=1)
            near = {k: box for k, box in others.items() if left.num_rows and k != left["_leaf"][0].as_py()}
            best, d2, at, more = nearest_places(xyz(left, COORDINATES), xyz(right, places), near)
            ends = np.searchsorted(at, np.arange(len(best) + 1))
            none = pa.array(best < 0)
            column = right["centroid_id"].combine_chunks() if right.num_rows else pa.nulls(1, right.schema.field("centroid_id").type)
            out = left.select(columns)
            out = out.append_column("centroid_id", pc.if_else(none, None, column.take(pa.array(np.maximum(best, 0)))))
            out = out.append_column("d2", pc.if_else(none, None, pa.array(d2, pa.int64() if exact else pa.float64())))
            return out.append_column("_more", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(more, pa.int32())))

        sides = dealt.select("_leaf", "_chunk", *columns).groupBy("_leaf", "_chunk").cogroup(copies.select("_leaf", "_chunk", "centroid_id", *places).groupBy("_leaf", "_chunk"))
        full = StructType([*schema.fields, *StructType.fromDDL(f"{kinds}, _more array<int>").fields])
        return sides.applyInArrow(run, full)

    placed = points.dropna(subset=COORDINATES).withColumn("_leaf", leaf(*COORDINATES))
    out = search(placed, points.columns, boxes)
    if depth:
        out = cut_lineage(out.withColumn("_row", F.monotonically_increasing_id()))
        again = search(out.where("size(_more) > 0").select("_row", *COORDINATES, F.explode("_more").alias("_leaf")), ["_row", *COORDINATES], {})
        again = again.groupBy("_row").agg(F.min(F.struct("d2", "centroid_id")).alias("_again"))
        best = F.least(F.when(F.col("d2").isNotNull(), F.struct("d2", "centroid_id")), "_again")
        out = out.join(again, "_row", "left").withColumn("_best", best).select(*points.columns, "_best.centroid_id", "_best.d2")
    return out.select(*points.columns, "centroid_id", "d2").unionByName(nowhere)


def _cuts(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """The k-d tree's (axis, place) by node, the root 1 at place 0; a node's two are 2 n and 2 n + 1. Each cut is a median on the widest axis."""
    cuts, parts = [], [sample]
    for _ in range(depth):
        halves = []
        for part in parts:
            axis = int(np.ptp(part, axis=0).argmax()) if len(part) else 0
            at = np.sort(part[:, axis])[(len(part) - 1) // 2].item() if len(part) else 0
            cuts.append((axis, at))
            halves += [part[part[:, axis] <= at], part[part[:, axis] > at]]
        parts = halves
    return cuts


def _leaf(cuts: list[tuple[int, float]]):
    """A function of three columns that gives the leaf's number in the k-d tree."""
    if not cuts:
        return lambda *_: F.lit(0)
    axes, ats = np.array([c[0] for c in cuts]), np.array([c[1] for c in cuts])

    @F.pandas_udf("int")
    def leaf(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        xyz, node = np.stack([x, y, z]), np.ones(len(x), int)
        for _ in range(len(ats).bit_length()):
            node = 2 * node + (xyz[axes[node - 1], np.arange(len(x))] > ats[node - 1])
        return pd.Series(node - len(ats) - 1, dtype="int32")

    return leaf


def nearest_places(points: np.ndarray, centroids: np.ndarray, boxes: dict, least: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each point's nearest centroid (its place, of equally near ones the first; -1: there is none) and squared distance; and pairs (place of a point, in ascending order;
    name of a box) where a box (low, high corner, all filled to the edge) may hold one as near.

    Points are halved on their widest axis; each part keeps the centroids and boxes that may be nearest to some place in it. Distances of whole numbers are exact.
    """
    kind = np.result_type(points, centroids)
    ends = np.concatenate([points, centroids]).astype(float)
    if kind.kind == "i" and len(ends) and (np.ptp(ends, axis=0) ** 2).sum() >= 2.0**63:
        raise OverflowError("squared distances exceed 64 bits")
    best, d2 = np.full(len(points), -1), np.zeros(len(points), kind)
    names = np.array(list(boxes), int)
    lows, highs = (np.array([b[i] for b in boxes.values()], float).reshape(-1, 3) for i in (0, 1))
    square = lambda *gaps: sum(g * g for g in gaps)
    slack = 1 + 1e-9  # bounds are rounded
    todo, at, more = [(np.arange(len(points)), np.arange(len(centroids)), np.arange(len(names)))] if len(points) else [], [], []
    while todo:
        own, near, far = todo.pop()
        p = points[own]
        low, high = p.min(axis=0).astype(float), p.max(axis=0).astype(float)
        c = centroids[near].astype(float)
        inner = square(*np.maximum(np.maximum(low - c, c - high), 0).T)
        outer = square(*np.maximum(c - low, high - c).T)
        most = outer.min() if len(near) else np.inf
        if len(far):
            most = min(most, square(*np.maximum(highs[far] - low, high - lows[far]).T).min())
            far = far[square(*np.maximum(np.maximum(low - highs[far], lows[far] - high), 0).T) <= most * slack]
        near = near[inner <= most * slack]
        if len(own) > least and len(near) + len(far) > 1 and (low < high).any():
            order, half = np.argpartition(p[:, (high - low).argmax()], len(own) // 2), len(own) // 2
            todo += [(own[order[:half]], near, far), (own[order[half:]], near, far)]
            continue
        if (low == high).all():
            p = p[:1]
        reach = np.full(len(p), np.inf)
        if len(near):
            d = square(*(p[:, None, i] - centroids[None, near, i] for i in range(3)))
            k = d.argmin(axis=1)
            reach = d[np.arange(len(p)), k]
            best[own], d2[own] = near[k], reach
        if len(far):
            q = p[:, None, :].astype(float)
            reach = np.minimum(reach, square(*np.moveaxis(np.maximum(highs[far] - q, q - lows[far]), 2, 0)).min(axis=1))
            hit = square(*np.moveaxis(np.maximum(np.maximum(lows[far] - q, q - highs[far]), 0), 2, 0)) <= reach[:, None] * slack
            i, k = np.nonzero(np.broadcast_to(hit, (len(own), len(far))))
            at.append(own[i])
            more.append(names[far[k]])
    at, more = (np.concatenate(x) if x else np.zeros(0, int) for x in (at, more))
    order = np.argsort(at, kind="stable")
    return best, d2, at[order], more[order]


def update_centroids(assigned: DataFrame) -> DataFrame:
    """Each centroid's new place: the mean of its points, from sums that partial aggregation merges."""
    return assigned.groupBy("centroid_id").agg(F.count("*").alias("n"), *[(F.sum(f"{a}i") / F.count("*")).alias(f"c{a}") for a in "xyz"])


def height_layers(points: DataFrame, layers: Layers = Layers()) -> DataFrame:
    """points with layer_idx (0 is the top; the highest points have none unless include_apex) and is_clustered: all but the two lowest layers.

    Bands are anchored at height 0, their number comes from the cloud's extent less the allowance.
    """
    ends = points.agg(F.min("zi").alias("low"), F.max("zi").alias("high"))
    ends = ends.withColumn("n", F.ceil((F.col("high") - F.col("low") - layers.allowance) / layers.height))
    z, n = F.col("zi"), F.col("n")
    inside = z <= F.col("high") if layers.include_apex else z < F.col("high")
    top = (z >= n * layers.height) & inside
    band = (z >= 0) & (z < n * layers.height)
    index = F.when(top, F.lit(0)).when(band, n - F.floor(z / layers.height))
    out = points.crossJoin(F.broadcast(ends)).withColumn("layer_idx", index.cast("int"))
    return out.withColumn("is_clustered", F.coalesce(F.col("layer_idx") <= n - 2, F.lit(False))).drop("low", "high", "n")


# --- one tile in memory ------------------------------------------------------------------------------


def dbscan_array(xy: np.ndarray, eps: float, min_points: int) -> np.ndarray:
    """Labels from 0 in the order of the first core point, -1 for noise; border points go to the first cluster that reaches them."""
    cells: dict[tuple[int, int], list[int]] = {}
    at = np.floor(xy / eps).astype(int)
    for i, c in enumerate(map(tuple, at)):
        cells.setdefault(c, []).append(i)
    near = []
    for i, (cx, cy) in enumerate(at):
        own = np.array([j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in cells.get((cx + dx, cy + dy), ())])
        near.append(own[((xy[own] - xy[i]) ** 2).sum(axis=1) <= eps * eps])
    core = np.array([len(n) >= min_points for n in near], bool)
    label, current = np.full(len(xy), -1), 0
    for i in range(len(xy)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], current
            while stack:
                for j in near[stack.pop()]:
                    if label[j] < 0:
                        label[j] = current
                        if core[j]:
                            stack.append(j)
            current += 1
    return label


def kmeans_array(points: np.ndarray, seeds: np.ndarray, rounds: int = 300, tolerance: float = 1e-4) -> np.ndarray:
    """Lloyd's labels from given seeds; an empty cluster takes the point farthest from its centroid; stops when the centroids' squared move is within
    tolerance times the mean variance."""
    centroids, limit = seeds.astype(float).copy(), tolerance * points.var(axis=0).mean()
    label = np.zeros(len(points), int)
    for _ in range(rounds):
        d2 = ((points[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
        label = d2.argmin(axis=1)
        new = centroids.copy()
        for k in range(len(centroids)):
            own = label == k
            if own.any():
                new[k] = points[own].mean(axis=0)
            else:
                far = int(d2[np.arange(len(points)), label].argmax())
                new[k], label[far] = points[far], k
        move = ((new - centroids) ** 2).sum()
        centroids = new
        if move <= limit:
            break
    return ((points[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)


def merge_clusters(current: list[np.ndarray], everything: list[np.ndarray], points: np.ndarray) -> list[np.ndarray]:
    """Each current cluster, in order, joins the nearest cluster that is still free, by centroids in the plane without a limit; of equally near ones the
    last. Merged clusters come first, in the current order, then the others in theirs. Clusters are arrays of places in points."""
    free, out = list(range(len(everything))), []
    centre = lambda c: points[c].mean(axis=0)[:2]
    centres = [centre(c) for c in everything]
    for own in current:
        if not free:
            break
        d = np.array([np.linalg.norm(centre(own) - centres[k]) for k in free])
        best = free[len(d) - 1 - int(d[::-1].argmin())]
        free.remove(best)
        out.append(np.concatenate([everything[best], own]))
    return out + [everything[k] for k in free]


def layered_array(points: np.ndarray, layers: Layers = Layers()) -> np.ndarray:
    """Tree numbers from 1 (0: none) of points in centimetres: density clusters in the top layer (the highest that has any), then in each lower layer centroid clusters seeded with the
    layer above's own centroids and merged into the trees. Layers that are empty or smaller than `least` are skipped and leave the seeds unchanged; layers
    of fewer points than seeds are skipped too."""
    out = np.zeros(len(points), int)
    if not len(points):
        return out
    z = points[:, 2]
    n = math.ceil((z.max() - z.min() - layers.allowance) / layers.height)
    inside = z <= z.max() if layers.include_apex else z < z.max()
    masks = [(z >= n * layers.height) & inside] + [(z >= i * layers.height) & (z < (i + 1) * layers.height) for i in range(n - 1, -1, -1)]
    trees: list[np.ndarray] = []
    seeds = None
    for mask in masks[: max(n - 1, 0)]:
        own = np.flatnonzero(mask)
        if len(own) < layers.least:
            continue
        if seeds is None:
            label = dbscan_array(points[own, :2].astype(float), layers.density.eps, layers.density.min_points)
        elif len(seeds) == 0 or len(own) < len(seeds):
            continue
        else:
            label = kmeans_array(points[own].astype(float), seeds)
        clusters = [own[label == k] for k in range(label.max() + 1) if (label == k).sum() >= layers.least]
        if seeds is None:
            trees = clusters
            if not clusters:
                continue
        else:
            trees = merge_clusters(clusters, trees, points)
        if clusters:
            seeds = np.stack([points[c].mean(axis=0) for c in clusters])
    for k, tree in enumerate(trees):
        out[tree] = k + 1
    return out


def layered_clusters(tiled: DataFrame, layers: Layers = Layers()) -> DataFrame:
    """tiled (tile_x, tile_y, point_id, xi, yi, zi): tile_x, tile_y, point_id and treeID of the clustered points. A tile is one task; tiles bound what it holds."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("point_id", ignore_index=True)
        tree = layered_array(tile[["xi", "yi", "zi"]].to_numpy(), layers)
        return tile[["tile_x", "tile_y", "point_id"]].assign(treeID=tree)[tree > 0]

    return tiled.select("tile_x", "tile_y", "point_id", "xi", "yi", "zi").groupBy("tile_x", "tile_y").applyInPandas(run, "tile_x long, tile_y long, point_id long, treeID long")
