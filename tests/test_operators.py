"""Hand-made cases: ties, gaps, layers, matches, region growing, triangulation, and files that are written and read again."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborel.functions import kernels
from arborel.operators import cluster, evaluate, ground, preprocess, raster, segment, spatial, treetops


def cloud(spark, points):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "point_id long, xi long, yi long, zi long")


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_density_clusters_two_blobs_border_and_noise(spark):
    blob = [(0, 0), (10, 0), (0, 10), (10, 10), (5, 5), (5, 0)]
    points = [(x, y, 0) for x, y in blob] + [(x + 1000, y, 0) for x, y in blob] + [(5000, 5000, 0), (38, 5, 0)]
    found = dict(values(cluster.density_clusters(cloud(spark, points), cluster.Density(30, 6)), "point_id", "cluster"))
    assert {found[i] for i in range(6)} == {0} and {found[i] for i in range(6, 12)} == {1}
    assert 12 not in found and found[13] == 0
    label = cluster.dbscan_array(np.array([p[:2] for p in points], float), 30, 6)
    assert {i: k for i, k in enumerate(label.tolist()) if k >= 0} == found


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300)), min_size=1, max_size=60), st.integers(1, 5))
def test_density_clusters_equal_sequential(spark, xy, least):
    points = [(x, y, 0) for x, y in xy]
    found = dict(values(cluster.density_clusters(cloud(spark, points), cluster.Density(40, least)), "point_id", "cluster"))
    label = cluster.dbscan_array(np.array(xy, float), 40, least)
    assert {i: k for i, k in enumerate(label.tolist()) if k >= 0} == found


def test_merge_takes_the_last_of_equally_near(spark):
    points = np.array([[0, 0, 0], [10, 0, 0], [5, 0, 0]], float)
    merged = cluster.merge_clusters([np.array([2])], [np.array([0]), np.array([1])], points)
    assert [m.tolist() for m in merged] == [[1, 2], [0]]


def test_merge_keeps_the_number_of_trees():
    points = np.random.default_rng(0).random((20, 3))
    everything = [np.array([i]) for i in range(5)]
    merged = cluster.merge_clusters([np.array([i]) for i in range(5, 8)], everything, points)
    assert len(merged) == 5 and sorted(np.concatenate(merged).tolist()) == list(range(8))


def test_height_layers_leave_apex_and_two_lowest_bands(spark):
    points = [(0, 0, z) for z in (0, 150, 250, 350, 450, 550, 650, 750)]
    found = {r.zi: (r.layer_idx, r.is_clustered) for r in cluster.height_layers(cloud(spark, points)).collect()}
    assert found[750] == (None, False)  # the apex
    assert found[650][0] == 0 and found[550][0] == 0 and found[450][0] == 0  # (750 - 0 - 400) / 100 = 4 bands below
    assert found[350] == (1, True) and found[250] == (2, True) and found[150] == (3, False) and found[0] == (4, False)


def test_layered_array_finds_two_stacked_columns():
    rng = np.random.default_rng(1)
    trees = [np.column_stack([rng.integers(-20, 20, 300) + x, rng.integers(-20, 20, 300), rng.integers(0, 1000, 300)]) for x in (0, 1000)]
    label = cluster.layered_array(np.concatenate(trees), cluster.Layers(density=cluster.Density(40, 5)))
    first, second = label[:300], label[300:]
    assert set(first[first > 0]) == {first.max()} and set(second[second > 0]) == {second.max()} and first.max() != second.max()
    assert cluster.layered_array(np.zeros((0, 3))).size == 0


def test_kmeans_seeded_keeps_order_and_refills_empty_clusters():
    points = np.array([[0, 0, 0], [1, 0, 0], [10, 0, 0], [11, 0, 0]], float)
    assert cluster.kmeans_array(points, points[[2, 0]]).tolist() == [1, 1, 0, 0]
    assert len(set(cluster.kmeans_array(points, np.array([[0.0, 0, 0], [100, 100, 100]])).tolist())) == 2


def test_many_predictions_share_a_reference(spark):
    tops = spark.createDataFrame([(1, 0, 0), (2, 100, 0), (3, 5000, 0)], "treeID long, xi long, yi long")
    truth = spark.createDataFrame([(7, 50, 0)], "gt_id long, gx long, gy long")
    matches = evaluate.nearest_reference(tops, truth)
    row = evaluate.metrics(matches, truth).first()
    assert (row.true_positives, row.false_positives, row.false_negatives) == (2, 1, -1) and row.recall == 2.0
    assert values(evaluate.one_to_one(matches), "treeID", "is_match") == [(1, True), (2, False), (3, False)]


def test_local_maxima_ties_go_to_the_smaller_id(spark):
    found = treetops.local_maxima(cloud(spark, [(0, 0, 900), (100, 0, 900), (200, 0, 850), (1000, 0, 830), (2000, 0, 100)]))
    assert values(found, "point_id") == [(0,), (3,)]


def test_focal_fill_and_clamp_keep_known_cells(spark):
    cells = [(c, r, c + 10 * r) for c in range(5) for r in range(5) if (c, r) != (2, 2)]
    dense = raster.densify(spark.createDataFrame(cells, "col long, row long, z long"))
    filled = {(r.col, r.row): r.z for r in raster.focal_fill(dense).collect()}
    assert filled[2, 2] == 22.0 and all(filled[c, r] == z for c, r, z in cells)
    clamped = {(r.col, r.row): r.z for r in raster.clamp_raster(dense, 5, 20).collect()}
    assert clamped[2, 2] is None and clamped[0, 0] == 5 and clamped[4, 4] == 20


def test_gaussian_kernel_is_symmetric_and_sums_to_one():
    k = {(i, j): w for i, j, w in kernels.gaussian_kernel(2, 7)}
    assert math.isclose(sum(k.values()), 1) and len(k) == 49 and k[-3, 1] == k[1, 3] and max(k, key=k.get) == (0, 0)


def test_crowns_are_connected_and_hold_their_seed():
    z = np.full((7, 11), 500.0)
    z[3, 2], z[3, 8], z[:, 5] = 1000.0, 900.0, 50.0
    seeds = np.zeros((7, 11), int)
    seeds[3, 2], seeds[3, 8] = 1, 2
    label = segment.grow_array(z, seeds, segment.Crowns(th_crown=0.4))
    assert label[3, 2] == 1 and label[3, 8] == 2 and (label[:, 5] == 0).all()
    assert set(label[:, :5].reshape(-1)) == {1} and set(label[:, 6:].reshape(-1)) == {2}


def test_crowns_across_a_tile_edge(spark):
    cells = [(c, r, 500) for c in range(20) for r in range(20)]
    grid = spark.createDataFrame(cells, "col long, row long, z long")
    seeds = spark.createDataFrame([(1, 9, 9), (2, 15, 15)], "treeID long, col long, row long")
    rule = segment.Crowns(th_crown=0.4, max_cells=4)
    one = {(r.col, r.row): r.label for r in segment.grow_crowns(grid, seeds, rule, tile=100).collect()}
    many = {(r.col, r.row): r.label for r in segment.grow_crowns(grid, seeds, rule, tile=10).collect()}
    assert one == many and one[9, 9] == 1 and (9, 14) not in one


def test_top_down_parts_two_peaks():
    rng = np.random.default_rng(2)
    a = np.column_stack([rng.normal(0, 0.4, 80), rng.normal(0, 0.4, 80), rng.uniform(3, 20, 80)])
    label = segment.top_down_array(np.concatenate([a, a + [8, 0, 0]]), segment.TopDown())
    assert set(label[:80]) == {label[0]} and set(label[80:]) == {label[80]} and label[0] != label[80]


@settings(max_examples=30, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=3, max_size=40))
def test_triangles_are_delaunay(places):
    xy = np.array(sorted(places), float)
    for t in segment.triangulate(xy):
        c = segment._circles(xy, t[None])[0]
        d = ((xy - c[:2]) ** 2).sum(axis=1)
        assert (d >= c[2] * (1 - 1e-6) - 1e-6).all()


def test_plane_is_interpolated_exactly():
    rng = np.random.default_rng(3)
    ground_ = rng.uniform(0, 100, (60, 2))
    z = ground_ @ [0.5, -0.25] + 7
    at = rng.uniform(30, 70, (50, 2))
    assert np.allclose(segment.interpolate(np.column_stack([ground_, z]), at), at @ [0.5, -0.25] + 7)
    assert np.isnan(segment.interpolate(np.zeros((0, 3)), at)).all()


def test_cloth_takes_flat_ground_and_no_pole():
    x, y = (a.reshape(-1).astype(float) / 2 for a in np.meshgrid(np.arange(40), np.arange(40)))
    z = np.zeros_like(x)
    pole = (x == 10) & (y == 10)
    z[pole] = 8.0
    found = ground.cloth_ground(x, y, z, ground.Cloth(resolution=0.5))
    assert found[~pole].mean() > 0.97 and not found[pole].any()


def test_ransac_ignores_high_points(spark):
    rng = np.random.default_rng(4)
    points = [(int(x), int(y), int(0.1 * x)) for x, y in rng.integers(0, 3000, (150, 2))] + [(int(x), int(y), 2500) for x, y in rng.integers(0, 3000, (100, 2))]
    found = ground.ransac_ground(cloud(spark, points), ground.Plane(fraction=0.5))
    assert found.where("is_ground").count() == 150 == found.where("is_ground and zi < 2000").count()


def test_threshold_split_has_no_class_for_null(spark):
    found = ground.threshold_split(spark.createDataFrame([(1, 0), (2, 100), (3, 101), (4, None)], "point_id long, zi long"))
    assert values(found.where("is_ground is not null"), "point_id", "is_ground") == [(1, True), (2, True), (3, False)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5000), st.integers(0, 5000)), min_size=2, max_size=50), st.integers(1, 6))
def test_nearest_neighbours_equal_brute_force(spark, xy, k):
    a = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(xy)], "a_id long, ax long, ay long")
    b = a.toDF("b_id", "bx", "by")
    found = values(spatial.knn_join(a, b, k, 100, "a_id", "b_id"), "a_id", "rank", "b_id")
    want = [(i, r + 1, j) for i, p in enumerate(xy) for r, (_, j) in enumerate(sorted(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, j) for j, q in enumerate(xy))[:k])]
    assert found == sorted(want)


def test_empty_clouds(spark):
    none = cloud(spark, [])
    assert preprocess.offset_to_origin(none).count() == 0 and preprocess.voxel_downsample(none).count() == 0 and preprocess.dedup_points(none).count() == 0
    assert treetops.local_maxima(none).count() == 0 and cluster.density_clusters(none).count() == 0 and raster.densify(raster.canopy_raster(none, 50)).count() == 0
    assert preprocess.bottom_fraction(none).count() == 0 and ground.ransac_ground(none).count() == 0


@pytest.mark.parametrize("kind", [3, 6])
def test_las_round_trip(spark, tmp_path, kind):
    from arborel.sources import las

    las.register(spark)
    rows = [(float(i) / 7, 1000.0 + i, 3.25 * i, 18 if i == 3 else 2, i % 4 or None) for i in range(20)]
    df = spark.createDataFrame(rows, "x double, y double, z double, classification int, treeID long")
    df.repartition(3).write.format("las").mode("overwrite").option("pointformat", kind).save(str(tmp_path))
    back = spark.read.format("las").option("rows", 4).load(str(tmp_path))
    got = sorted((r.y, r.x, r.z, r.classification, r.treeID) for r in back.collect())
    for (x, y, z, cls, tree), g in zip(rows, got, strict=True):
        assert abs(g[0] - y) <= 0.0005 and abs(g[1] - x) <= 0.0005 and abs(g[2] - z) <= 0.0005 and g[3:] == (cls, tree or 0)
    assert back.where("classification != 18").count() == 19 and back.where("classification = 18").count() == 1
    assert spark.read.format("las").option("columns", "z,treeID").load(str(tmp_path)).columns == ["z", "treeID"]
    header = las.las_summary(str(next(tmp_path.glob("*.las"))))
    assert header["format"] == kind and header["extra"]["treeID"][1] == "<u4"


def test_shapefile_round_trip(spark, tmp_path):
    from arborel.sources import features

    xy = np.array([[1.5, 2.5], [3.0, -4.0]])
    (tmp_path / "tile_12.shp").write_bytes(features.point_shapefile(xy))
    found = features.read_shapefiles(spark, str(tmp_path))
    assert values(found, "tile", "gt_id", "x", "y") == [(12, 1, 1.5, 2.5), (12, 2, 3.0, -4.0)]


def test_arrivals_are_segmented(spark, tmp_path):
    from arborel.streaming.ingest import segment_arrivals

    cloud(spark, [(0, 0, 900), (50, 0, 850), (1000, 0, 950)]).write.parquet(str(tmp_path / "in" / "a"))
    (tmp_path / "drop").mkdir()
    for f in (tmp_path / "in" / "a").glob("*.parquet"):
        f.rename(tmp_path / "drop" / f.name)
    query = segment_arrivals(spark, str(tmp_path / "drop"), str(tmp_path / "out"), str(tmp_path / "state"), treetops.local_maxima)
    query.awaitTermination(120)
    assert values(spark.read.parquet(str(tmp_path / "out")), "point_id") == [(0,), (2,)]


def test_segmented_cloud_is_numbered_saved_and_evaluated(spark, tmp_path):
    from arborel.plans import evaluation
    from arborel.sources import segmented

    trees = spark.createDataFrame([(0.0, 0.0, 9.0, 40), (0.1, 0.0, 8.0, 40), (5.0, 5.0, 7.0, 7)], "x double, y double, z double, cluster_id long")
    ground_ = spark.createDataFrame([(1.0, 1.0, 0.0)], "x double, y double, z double")
    whole = segmented.number_trees(trees, ground_)
    assert values(whole, "z", "treeID") == [(0.0, 0), (7.0, 1), (8.0, 2), (9.0, 2)]
    assert segmented.save_segmented(whole, str(tmp_path / "out")) == 2
    assert values(segmented.coloured(whole), "treeID", "colour") == [(0, 0), (1, 1), (2, 2), (2, 2)]
    with pytest.raises(ValueError):
        segmented.coloured(ground_)
    assert segmented.top_view(whole, 1.5).count() == 2 and segmented.top_view(whole).count() == 4
    rows = [(1, 10, 0, 0, 900, 1), (1, 11, 10, 0, 800, 1), (1, 12, 900, 0, 700, 0), (2, 13, 0, 0, 500, None), (3, 14, 0, 0, 500, 5)]
    cloud_ = spark.createDataFrame(rows, "tile int, point_id long, xi long, yi long, zi long, treeID long")
    truth = spark.createDataFrame([(1, 1, 50, 0), (4, 1, 0, 0)], "tile int, gt_id long, gx long, gy long")
    assert values(evaluation.evaluate_tiles(cloud_, truth), "tile", "true_positives", "false_positives", "false_negatives") == [(1, 1, 1, 0)]
    assert values(evaluation.evaluate_tiles(cloud_, truth, exclude_zero=True), "tile", "true_positives", "false_positives") == [(1, 1, 0)]
    assert values(evaluation.skipped_tiles(cloud_, truth), "tile", "reason") == [(2, "no trees"), (3, "no reference positions"), (4, "no points")]
    with pytest.raises(ValueError):
        evaluation.require_same_crs("EPSG:2193", "EPSG:32617")
    assert evaluation.require_same_crs(None, "EPSG:2193", "EPSG:2193") == "EPSG:2193"


def test_noise_and_withheld_points_fall_out(spark):
    df = spark.createDataFrame([(1, 2, False), (2, 18, False), (3, 1, True), (4, None, None)], "point_id long, classification int, withheld boolean")
    assert values(preprocess.drop_noise(df), "point_id") == [(1,), (3,)] and values(preprocess.drop_withheld(df), "point_id") == [(1,), (2,)]


def test_run_log_is_appended(spark, tmp_path):
    from arborel.plans import evaluation
    from arborel.sources import features

    points = spark.createDataFrame([(1, 0), (2, 5), (3, 5), (4, 6)], "point_id long, treeID long")
    row = evaluation.timed("a.las", points, lambda p: p)
    for _ in range(2):
        features.append_log(row, str(tmp_path / "log"))
    log = spark.read.option("header", True).csv(str(tmp_path / "log"))
    assert log.columns == ["file", "time_seconds", "tree_count"] and values(log, "file", "tree_count") == [("a.las", "2")] * 2


def _nearest_by_hand(points, centroids):
    d2 = lambda p, c: None if None in p[1:] + c[1:] else sum((x - y) ** 2 for x, y in zip(p[1:], c[1:], strict=True))
    best = lambda p: min(((d2(p, c), c[0]) for c in centroids), key=lambda b: (b[0] is None, b[0] or 0, b[1]))
    return sorted((p[0], best(p)[1], best(p)[0]) for p in points)


@pytest.mark.parametrize("width", [12, 300, 10**7])
def test_nearest_centroids_across_blocks(spark, width):
    """Many blocks of few centroids, with ties, equal centroids, crowds, points far from all, and missing coordinates."""
    random = np.random.default_rng(width)
    at = lambda n, w: random.integers(0, w, (n, 3)).tolist()
    centroids = [(int(i), *c) for i, c in zip(random.permutation(160), at(100, width) + at(58, 5) + [[None, 1, 1], [3, 3, None]], strict=True)]
    points = [(i, *c) for i, c in enumerate(at(300, width) + at(100, 5) + [[9 * width, 0, -width], [-width, 40 * width, 3], [1, None, 2], [None, None, None]])]
    names = lambda i, x, y, z: f"{i} long, {x} long, {y} long, {z} long"
    p = spark.createDataFrame(points, names("point_id", "xi", "yi", "zi"))
    c = spark.createDataFrame(centroids, names("centroid_id", "cx", "cy", "cz"))
    expected = _nearest_by_hand(points, centroids)
    for block, chunk in ((7, 64), (1000, 1000)):
        found = cluster.assign_centroids(p, c, block=block, chunk=chunk)
        assert found.columns == [*p.columns, "centroid_id", "d2"] and found.schema["d2"].dataType.typeName() == "long"
        assert sorted(tuple(r) for r in found.select("point_id", "centroid_id", "d2").collect()) == expected
    assert cluster.assign_centroids(p, c.where("centroid_id < 0")).count() == 0
    lost = cluster.assign_centroids(p, c.where("cx is null or cz is null")).collect()
    assert len(lost) == len(points) and {(r.centroid_id, r.d2) for r in lost} == {(min(i for i, *xyz in centroids if None in xyz), None)}


def test_nearest_centroids_of_fractions(spark):
    random = np.random.default_rng(5)
    points, centroids = random.integers(0, 90, (200, 3)), random.random((40, 3)) * 90
    p = cloud(spark, points.tolist())
    c = spark.createDataFrame([(i, *x) for i, x in enumerate(centroids.tolist())], "centroid_id long, cx double, cy double, cz double")
    expected = ((points[:, None] - centroids[None]) ** 2).sum(axis=2)
    found = sorted(cluster.assign_centroids(p, c, block=5).collect())
    assert [r.centroid_id for r in found] == expected.argmin(axis=1).tolist() and np.allclose([r.d2 for r in found], expected.min(axis=1))
