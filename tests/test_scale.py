"""Plans as they should be: neighbourhoods are equi-joins, scans read the columns that are used, highest points need no sort."""

from arborel.operators import cluster, treetops
from arborel.plans import queries
from arborel.plans.queries import QUERIES
from arborel.sources.adapter import points


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_query_compares_all_pairs(spark, small):
    for name in ("lmf_tree_tops", "dbscan_core_points", "isolated_voxel_noise", "focal_fill_3x3", "gaussian_smooth_chm", "idw_fill", "label_transfer", "grow_step", "raster_mosaic", "tile_metrics"):
        text = plan(QUERIES[name](spark, small))
        assert "CartesianProduct" not in text, name
        # Nested loops are left for single rows of an aggregate alone.
        assert text.count("BroadcastNestedLoopJoin") <= text.count("Inner BuildRight") + text.count("Cross"), name


def test_scan_reads_three_columns(spark, small):
    text = plan(treetops.local_maxima(points(spark, small)))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in text


def test_highest_points_come_from_partial_aggregates(spark, small):
    text = plan(treetops.highest_of_each(points(spark, small), "tree_id"))
    assert "Window" not in text and text.count("Aggregate") >= 2


def test_local_maxima_are_an_anti_join_on_cells(spark, small):
    text = plan(treetops.local_maxima(points(spark, small)))
    assert "LeftAnti" in text and "NestedLoop" not in text


def test_core_points_join_on_cells(spark, small):
    text = plan(cluster.core_points(points(spark, small), cluster.Density(100, 5)))
    assert "NestedLoop" not in text and "Join" in text


def test_centroids_are_searched_in_blocks(spark, small):
    found = plan(QUERIES["kmeans_assign_step"](spark, small))
    assert "FlatMapCoGroupsInArrow" in found and "array_min" not in found


def test_new_centroids_are_rounded_as_sql_rounds(spark):
    import duckdb

    sums = [(2_629_801, 800), (-2_629_801, 800), (1, 20_000), (3, 160_000), (0, 7), (5, 80_000), (302_868, 800)] + [(20 * k + 1, 800) for k in range(2000)]
    rows = spark.createDataFrame([(i, s / n) for i, (s, n) in enumerate(sums)], "i long, x double")
    found = [r.x for r in queries._rounded_doubles(rows, 4, "x").orderBy("i").collect()]
    assert found == [duckdb.connect().execute(f"select round(cast({s} as hugeint) / {n}, 4)").fetchone()[0] for s, n in sums]
