"""DuckDB SQL for the registered queries, by name; written apart from the Spark plans, with plain joins where those use cells."""

from __future__ import annotations

POINTS = """pts as (
  select event_id as point_id, user_id as tree_id,
         cast((user_id % 10) * 500 + 250 + ((event_id * 7919) % 241) - 120 as bigint) as xi,
         cast(cast(floor(user_id / 10) as bigint) * 500 + 250 + ((event_id * 104729) % 241) - 120 as bigint) as yi,
         cast(round(value * 100) as bigint) % 2000 as zi
  from events)"""
COARSE = f"""{POINTS}, coarse as (
  select point_id, cast(floor(xi / 50) as bigint) as xi, cast(floor(yi / 50) as bigint) as yi, cast(floor(zi / 50) as bigint) as zi from pts)"""
CHM = f"""{POINTS}, chm as (
  select cast(floor(xi / 50) as bigint) as col, cast(floor(yi / 50) as bigint) as row, max(zi) as z from pts group by 1, 2)"""
DENSE = f"""{CHM},
cols as (select unnest(generate_series((select min(col) from chm), (select max(col) from chm))) as col),
rows_ as (select unnest(generate_series((select min(row) from chm), (select max(row) from chm))) as row),
dense as (select cols.col, rows_.row, chm.z from cols cross join rows_ left join chm on chm.col = cols.col and chm.row = rows_.row)"""
SOLID = DENSE + ", solid as (select col, row, coalesce(z, 0) as z from dense)"
LOW = f"""{POINTS}, low as (
  select *, row_number() over (order by zi, point_id) as rank from pts
  qualify rank <= cast(floor((select count(*) from pts) * 0.3) as bigint))"""
SLAB = f"{POINTS}, slab as (select * from pts where zi >= (select max(zi) - 400 from pts))"
TOPS = f"""{POINTS}, tops as (
  select tree_id as "treeID", point_id, xi, yi, zi from pts qualify row_number() over (partition by tree_id order by zi desc, point_id) = 1),
stems as (
  select tree_id as gt_id, (tree_id % 10) * 500 + 250 as gx, cast(floor(tree_id / 10) as bigint) * 500 + 250 as gy
  from (select distinct tree_id from pts) where tree_id % 7 <> 0)"""
MATCHES = f"""{TOPS}, pairs as (
  select "treeID", gt_id, (xi - gx) * (xi - gx) + (yi - gy) * (yi - gy) as d2 from tops cross join stems),
matches as (
  select "treeID", gt_id, d2, d2 <= 40000 as is_match from pairs qualify row_number() over (partition by "treeID" order by d2, gt_id) = 1)"""
CENTROIDS = f"{POINTS}, cents as (select point_id as centroid_id, xi as cx, yi as cy, zi as cz from pts where point_id % 1000 = 0)"
ASSIGNED = f"""{CENTROIDS}, assigned as (
  select p.*, c.centroid_id, (xi - cx) * (xi - cx) + (yi - cy) * (yi - cy) + (zi - cz) * (zi - cz) as d2 from pts p cross join cents c
  qualify row_number() over (partition by point_id order by d2, centroid_id) = 1)"""
LABELS = f"""{CHM}, labels as (
  select cast(floor(xi / 50) as bigint) as col, cast(floor(yi / 50) as bigint) as row, min(tree_id) as label
  from (select * from pts qualify row_number() over (partition by tree_id order by zi desc, point_id) = 1) group by 1, 2)"""


def _clusters(source: str, eps2: int, least: int, first: int) -> str:
    return f"""near as (
  select a.point_id as a, b.point_id as b from {source} a join {source} b on abs(a.xi - b.xi) <= 100 and abs(a.yi - b.yi) <= 100
  and (a.xi - b.xi) * (a.xi - b.xi) + (a.yi - b.yi) * (a.yi - b.yi) <= {eps2}),
core as (select a as id from near group by a having count(*) >= {least}),
links as (select a, b from near where a in (select id from core) and b in (select id from core)),
reach as (select id as src, id from core union select reach.src, links.b from reach join links on links.a = reach.id),
label as (select id, min(src) as label from reach group by id),
joined as (
  select near.a as point_id, coalesce(max(case when own.id = near.a then own.label end), min(own.label)) as label
  from near join label own on own.id = near.b group by near.a),
clusters as (select point_id, cast(dense_rank() over (order by label) - 1 + {first} as bigint) as cluster from joined)"""


def _gauss(table: str, sigma: float, n: int) -> str:
    half = n // 2
    return f"""offs as (
  select i, j, exp(-(i * i + j * j) / (2.0e0 * {sigma} * {sigma})) as w from (select unnest(generate_series(-{half}, {half})) as i), (select unnest(generate_series(-{half}, {half})) as j)),
kernel as (select i, j, w / (select sum(w) from offs) as w from offs),
sums as (
  select c.col, c.row, sum(w * v.z) as s, count(v.z) as n from {table} c cross join kernel left join {table} v on v.col = c.col + i and v.row = c.row + j group by c.col, c.row)
select col, row, case when n = {n * n} then round(s, 6) end as z from sums"""


HORN = """horn(i, j, wx, wy) as (values (-1, -1, -1, -1), (0, -1, 0, -2), (1, -1, 1, -1), (-1, 0, -2, 0), (1, 0, 2, 0), (-1, 1, -1, 1), (0, 1, 0, 2), (1, 1, 1, 1)),
grads as (
  select c.col, c.row, sum(wx * v.z) / 400.0e0 as dx, sum(wy * v.z) / 400.0e0 as dy from solid c cross join horn join solid v on v.col = c.col + i and v.row = c.row + j
  group by c.col, c.row having count(*) = 8),
terrain as (
  select col, row, atan(sqrt(dx * dx + dy * dy)) as slope,
         case when dx = 0 and dy = 0 then 0.0e0 when atan2(0 - dx, 0 - dy) < 0 then atan2(0 - dx, 0 - dy) + 2 * pi() else atan2(0 - dx, 0 - dy) end as aspect from grads)"""

FIT = """means as (select avg(xi) as mx, avg(yi) as my, avg(zi) as mz from {0}),
sums as (
  select sum((xi - mx) * (xi - mx)) as xx, sum((xi - mx) * (yi - my)) as xy, sum((yi - my) * (yi - my)) as yy,
         sum((xi - mx) * (zi - mz)) as xz, sum((yi - my) * (zi - mz)) as yz from {0} cross join means),
slopes as (select (xz * yy - yz * xy) / (xx * yy - xy * xy) as a, (yz * xx - xz * xy) / (xx * yy - xy * xy) as b from sums),
fit as (select a, b, mz - a * mx - b * my as c from slopes cross join means)"""

SCORE = """round(true_positives / n_pred, 6) as precision, round(true_positives / n_true, 6) as recall,
  case when true_positives > 0 then round(2 * (true_positives / n_pred) * (true_positives / n_true) / ((true_positives / n_pred) + (true_positives / n_true)), 6) end as f1_score"""

_TILE_OF = "cast(floor({0} / 2500) as bigint) as tile_x, cast(floor({1} / 2500) as bigint) as tile_y"

ORACLES = {
    "offset_to_origin": f"with {POINTS} select point_id, xi - min(xi) over () as xi, yi - min(yi) over () as yi, zi - min(zi) over () as zi from pts",
    "cloud_summary": f"""with {POINTS}, e as (select count(*) as n, min(xi) / 100.0e0 as min_x, max(xi) / 100.0e0 as max_x, min(yi) / 100.0e0 as min_y, max(yi) / 100.0e0 as max_y,
  min(zi) / 100.0e0 as min_z, max(zi) / 100.0e0 as max_z from pts)
select *, round((max_x - min_x) * (max_y - min_y), 4) as area, round(n / ((max_x - min_x) * (max_y - min_y)), 6) as density from e""",
    "quality_report": f"""with {COARSE}, places as (select count(*) as n from coarse where xi is not null and yi is not null and zi is not null group by xi, yi, zi)
select (select count(*) from coarse) as n_points, (select count(*) from coarse where xi is null or yi is null or zi is null) as n_null, count(*) as n_places,
  cast(count(*) filter (where n > 1) as bigint) as n_shared_places, cast(sum(n) - count(*) as bigint) as n_repeats from places""",
    "dedup_points": f"with {COARSE} select min(point_id) as point_id, xi, yi, zi from coarse group by xi, yi, zi",
    "ground_threshold_split": f"with {POINTS} select point_id, zi <= 100 as is_ground from pts",
    "ground_plane_ols": f"with {LOW}, {FIT.format('low')} select round(a, 6) as a, round(b, 6) as b, round(c, 6) as c from fit",
    "ransac_ground_seeded": f"""with {LOW}, size as (select count(*) as n from low),
draws as (select h, i, ((h + 1) * step + i) % n + 1 as rank from (select unnest(generate_series(0, 49)) as h) cross join (values (0, 7919), (1, 104729), (2, 1299709)) as s(i, step) cross join size),
tri as (select h, max(case when i = 0 then xi end) x0, max(case when i = 0 then yi end) y0, max(case when i = 0 then zi end) z0, max(case when i = 1 then xi end) - max(case when i = 0 then xi end) as x1,
  max(case when i = 1 then yi end) - max(case when i = 0 then yi end) as y1, max(case when i = 1 then zi end) - max(case when i = 0 then zi end) as z1, max(case when i = 2 then xi end) - max(case when i = 0 then xi end) as x2,
  max(case when i = 2 then yi end) - max(case when i = 0 then yi end) as y2, max(case when i = 2 then zi end) - max(case when i = 0 then zi end) as z2 from draws join low using (rank) group by h),
planes as (select h, cast(z1 * y2 - z2 * y1 as double) / (x1 * y2 - x2 * y1) as a, cast(x1 * z2 - x2 * z1 as double) / (x1 * y2 - x2 * y1) as b, x0, y0, z0 from tri where x1 * y2 - x2 * y1 <> 0),
tried as (select h, a, b, z0 - a * x0 - b * y0 as c from planes),
best as (select h, a, b, c from (select h, any_value(a) as a, any_value(b) as b, any_value(c) as c, count(*) filter (where round(abs(zi - (a * xi + b * yi + c)), 6) < 40) as votes from low cross join tried group by h) order by votes desc, h limit 1),
inliers as (select low.* from low cross join best where round(abs(zi - (a * xi + b * yi + c)), 6) < 40), {FIT.format('inliers')}
select point_id, round(abs(zi - (a * xi + b * yi + c)), 6) < 40 as is_ground from pts cross join fit""",
    "bottom_fraction": f"with {LOW} select point_id, zi from low",
    "voxel_downsample": f"""with {POINTS}, lows as (select min(xi) as lx, min(yi) as ly, min(zi) as lz from pts)
select cast(floor((2 * (xi - lx) + 200) / 400) as bigint) as vx, cast(floor((2 * (yi - ly) + 200) / 400) as bigint) as vy, cast(floor((2 * (zi - lz) + 200) / 400) as bigint) as vz,
  count(*) as n, round(sum(xi) / count(*), 4) as x, round(sum(yi) / count(*), 4) as y, round(sum(zi) / count(*), 4) as z from pts cross join lows group by 1, 2, 3""",
    "statistical_outlier": f"""with {POINTS}, near as (
  select a.point_id, (a.xi - b.xi) * (a.xi - b.xi) + (a.yi - b.yi) * (a.yi - b.yi) + (a.zi - b.zi) * (a.zi - b.zi) as d2, b.point_id as b from pts a join pts b
  on b.xi between a.xi - 1000 and a.xi + 1000 and b.yi between a.yi - 1000 and a.yi + 1000
  qualify row_number() over (partition by a.point_id order by d2, b.point_id) <= 10),
m as (select point_id, sum(sqrt(d2)) / count(*) as m from near group by point_id),
limits as (select avg(m) + 2 * stddev_samp(m) as most from m where m > 0)
select point_id from m cross join limits where m > 0 and m < most""",
    "isolated_voxel_noise": f"""with {POINTS}, keyed as (select *, cast(floor(xi / 100) as bigint) as vx, cast(floor(yi / 100) as bigint) as vy, cast(floor(zi / 100) as bigint) as vz from pts),
counts as (select vx, vy, vz, count(*) as n from keyed group by 1, 2, 3),
around as (select a.vx, a.vy, a.vz, sum(b.n) as n from counts a join counts b on abs(a.vx - b.vx) <= 1 and abs(a.vy - b.vy) <= 1 and abs(a.vz - b.vz) <= 1 group by 1, 2, 3)
select point_id, n <= 6 as is_noise from keyed join around using (vx, vy, vz)""",
    "retile_with_halo": f"""with {POINTS}, wide as (
  select point_id, xi, yi, unnest(generate_series(cast(floor((xi - 1000) / 2500) as bigint), cast(floor((xi + 1000) / 2500) as bigint))) as tile_x from pts),
both_ as (select *, unnest(generate_series(cast(floor((yi - 1000) / 2500) as bigint), cast(floor((yi + 1000) / 2500) as bigint))) as tile_y from wide)
select point_id, tile_x, tile_y, not (floor(xi / 2500) = tile_x and floor(yi / 2500) = tile_y) as is_buffer from both_""",
    "height_layers": f"""with {POINTS}, e as (select max(zi) as high, cast(ceil((max(zi) - min(zi) - 400) / 100) as bigint) as n from pts),
l as (select point_id, n, cast(case when zi >= n * 100 and zi < high then 0 when zi >= 0 and zi < n * 100 then n - cast(floor(zi / 100) as bigint) end as integer) as layer_idx from pts cross join e)
select point_id, layer_idx, coalesce(layer_idx <= n - 2, false) as is_clustered from l""",
    "top_slab": f"with {SLAB} select point_id, zi from slab",
    "tree_tops_max": f'with {TOPS} select "treeID", point_id, xi, yi, zi from tops',
    "lmf_tree_tops": f"""with {POINTS}, high as (select * from pts where zi >= 820)
select point_id, xi, yi, zi from high a where not exists (
  select 1 from high b where (a.xi - b.xi) * (a.xi - b.xi) + (a.yi - b.yi) * (a.yi - b.yi) <= 40000 and (b.zi > a.zi or (b.zi = a.zi and b.point_id < a.point_id)))""",
    "canopy_max_raster": f"with {CHM} select * from chm",
    "raster_clamp": f"with {DENSE} select col, row, case when z is not null then greatest(200, least(1500, z)) end as z from dense",
    "focal_fill_3x3": f"""with {DENSE} select c.col, c.row, round(coalesce(cast(c.z as double), avg(v.z)), 6) as z from dense c
left join chm v on c.z is null and abs(v.col - c.col) <= 1 and abs(v.row - c.row) <= 1 group by c.col, c.row, c.z""",
    "focal_mean_25": f"""with {DENSE} select c.col, c.row, round(sum(v.z) / count(v.z), 6) as z from dense c
left join chm v on v.col between c.col - 12 and c.col + 12 and v.row between c.row - 12 and c.row + 12 group by c.col, c.row""",
    "gaussian_smooth_chm": f"with {SOLID}, {_gauss('solid', 2, 7)}",
    "gaussian_smooth_dsm": f"with {DENSE}, {_gauss('dense', 1, 5)}",
    "idw_fill": f"""with {DENSE}, near as (
  select c.col, c.row, v.z, (v.col - c.col) * (v.col - c.col) + (v.row - c.row) * (v.row - c.row) as w from dense c join chm v on c.z is null and abs(v.col - c.col) <= 4 and abs(v.row - c.row) <= 4
  where w <= 16 qualify row_number() over (partition by c.col, c.row order by w, v.row - c.row, v.col - c.col) <= 10),
fills as (select col, row, sum(z / w) / sum(1.0e0 / w) as fill from near group by col, row)
select d.col, d.row, round(coalesce(cast(d.z as double), fill), 6) as z from dense d left join fills f on f.col = d.col and f.row = d.row""",
    "slope_aspect": f"with {SOLID}, {HORN} select col, row, round(slope, 6) as slope, round(aspect, 6) as aspect from terrain",
    "hillshade": f"""with {SOLID}, {HORN} select col, row,
  round(greatest(0.0e0, cos(slope) * sin(0.7853981633974483) + sin(slope) * cos(0.7853981633974483) * cos(5.497787143782138 - aspect)), 6) as shade from terrain""",
    "raster_mosaic": f"with {CHM} select * from chm",
    "dbscan_core_points": f"""with {SLAB} select a.point_id, count(*) as neighbours, count(*) >= 5 as is_core from slab a join slab b
on (a.xi - b.xi) * (a.xi - b.xi) + (a.yi - b.yi) * (a.yi - b.yi) <= 10000 group by a.point_id""",
    "dbscan_clusters": f"with recursive {SLAB}, {_clusters('slab', 10000, 5, 0)} select point_id, cluster from clusters",
    "hybrid_tree_tops": f"""with recursive {POINTS}, keyed as (select *, cast(floor(xi / 100) as bigint) as vx, cast(floor(yi / 100) as bigint) as vy, cast(floor(zi / 100) as bigint) as vz from pts),
counts as (select vx, vy, vz, count(*) as n from keyed group by 1, 2, 3),
around as (select a.vx, a.vy, a.vz, sum(b.n) as n from counts a join counts b on abs(a.vx - b.vx) <= 1 and abs(a.vy - b.vy) <= 1 and abs(a.vz - b.vz) <= 1 group by 1, 2, 3),
clean as (select keyed.* from keyed join around using (vx, vy, vz) where around.n > 6), slab as (select * from clean where zi >= (select max(zi) - 400 from clean)),
{_clusters('slab', 10000, 5, 1)}
select cluster as "treeID", point_id, xi, yi, zi from clusters join slab using (point_id) qualify row_number() over (partition by cluster order by zi desc, point_id) = 1""",
    "kmeans_assign_step": f"with {ASSIGNED} select point_id, centroid_id, d2 from assigned",
    "kmeans_update_step": f"""with {ASSIGNED} select centroid_id, count(*) as n, round(sum(xi) / count(*), 4) as cx, round(sum(yi) / count(*), 4) as cy,
  round(sum(zi) / count(*), 4) as cz from assigned group by centroid_id""",
    "label_transfer": f"with {LABELS} select point_id, label from pts left join labels on col = floor(xi / 50) and row = floor(yi / 50)",
    "grow_step": f"""with {LABELS}, stats as (select label, sum(z) as total, count(*) as n from labels join chm using (col, row) group by label),
seed as (select label, col as sc, row as sr, z as sz from labels join chm using (col, row)),
rim as (select distinct label, col + i as col, row + j as row from labels cross join (values (-1, 0), (1, 0), (0, -1), (0, 1)) as o(i, j)),
free as (select rim.*, chm.z from rim join chm using (col, row) where not exists (select 1 from labels l where l.col = rim.col and l.row = rim.row)),
new as (select col, row, min(free.label) as label from free join stats using (label) join seed using (label)
  where z > 100 and 100 * z > 45 * sz and 100 * z * n > 80 * total and 100 * z <= 105 * sz and abs(col - sc) < 20 and abs(row - sr) < 20 group by col, row)
select col, row, label from labels union all select col, row, label from new""",
    "tree_count": f"with {POINTS} select {_TILE_OF.format('xi', 'yi')}, count(distinct case when tree_id % 5 <> 0 then tree_id end) as tree_count from pts group by 1, 2",
    "nearest_ground_truth": f"with {MATCHES} select * from matches",
    "tile_metrics": f"""with {MATCHES}, p as (select {_TILE_OF.format('xi', 'yi')}, count(*) filter (where is_match) as true_positives, count(*) as n_pred from tops join matches using ("treeID") group by 1, 2),
t as (select {_TILE_OF.format('gx', 'gy')}, count(*) as n_true from stems group by 1, 2)
select tile_x, tile_y, true_positives, n_pred - true_positives as false_positives, n_true - true_positives as false_negatives, {SCORE} from p join t using (tile_x, tile_y)""",
    "overall_metrics": f"""with {MATCHES}, p as (select count(*) filter (where is_match) as true_positives, count(*) as n_pred, (select count(*) from stems) as n_true from matches)
select true_positives, n_pred - true_positives as false_positives, n_true - true_positives as false_negatives, {SCORE} from p""",
    "one_to_one_matches": f"""with {MATCHES} select "treeID", gt_id, d2, is_match and row_number() over (partition by gt_id order by d2, "treeID") = 1 as is_match from matches""",
    "match_labels_union": f"""with {MATCHES} select "treeID" as id, xi as x, yi as y, case when is_match then 'true positive' else 'false positive' end as label from tops join matches using ("treeID")
union all select gt_id, gx, gy, 'ground truth' from stems""",
    "relative_count_error": f"""with {TOPS}, p as (select {_TILE_OF.format('xi', 'yi')}, count(*) as n_pred from tops group by 1, 2), t as (select {_TILE_OF.format('gx', 'gy')}, count(*) as n_true from stems group by 1, 2)
select tile_x, tile_y, n_pred, n_true, round(abs(n_pred - n_true) * 100 / n_true, 4) as error_percent from p join t using (tile_x, tile_y)""",
    "minmax_normalize": f"""with {TOPS} select "treeID", round((xi - min(xi) over ()) / (max(xi) over () - min(xi) over ()), 9) as xi_norm, round((yi - min(yi) over ()) / (max(yi) over () - min(yi) over ()), 9) as yi_norm from tops""",
    "renumber_trees": f"""with {TOPS} select "treeID" as old_id, row_number() over (order by "treeID") as "treeID" from tops""",
    "palette_index": f"""with {TOPS} select "treeID", cast((dense_rank() over (order by "treeID") - 1) % 20 as integer) as colour from tops""",
    "file_name_parts": r"""with p as (select page_id, regexp_replace(url, '[?#].*$', '') as path from pages)
select page_id, regexp_extract(path, '([^/]*)$', 1) as name, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') as stem,
  try_cast(nullif(regexp_extract(path, '(\d+)\D*$', 1), '') as bigint) as tile from p""",
}

_BY_TILE = f"""{TOPS}, seg as (
  select *, cast(floor(xi / 2500) as bigint) + 100 * cast(floor(yi / 2500) as bigint) as tile, case when tree_id % 5 <> 0 then tree_id end as t from pts),
truth as (
  select *, cast(floor(gx / 2500) as bigint) + 100 * cast(floor(gy / 2500) as bigint) as tile from stems where gt_id % 10 < 5 or gt_id > 60)"""
ORACLES |= {
    "segmented_tile_metrics": f"""with {_BY_TILE}, tt as (select * from seg where t <> 0 qualify row_number() over (partition by tile, t order by zi desc, point_id) = 1),
m as (select tt.tile, t, min((xi - gx) * (xi - gx) + (yi - gy) * (yi - gy)) <= 40000 as is_match from tt join truth on truth.tile = tt.tile group by 1, 2),
p as (select tile, count(*) filter (where is_match) as true_positives, count(*) as n_pred from m group by tile), n as (select tile, count(*) as n_true from truth group by tile)
select tile, true_positives, n_pred - true_positives as false_positives, n_true - true_positives as false_negatives, {SCORE} from p join n using (tile)""",
    "skipped_tiles": f"""with {_BY_TILE}, p as (select tile, count(t) as trees from seg group by tile), n as (select distinct tile from truth)
select coalesce(p.tile, n.tile) as tile, case when p.tile is null then 'no points' when trees = 0 then 'no trees' else 'no reference positions' end as reason
from p full join n on p.tile = n.tile where p.tile is null or n.tile is null or trees = 0""",
    "tree_colours": f"with {POINTS} select point_id, cast((dense_rank() over (order by tree_id) - 1) % 20 as integer) as colour from pts",
    "numbered_trees": f"""with {POINTS} select xi / 100.0e0 as x, yi / 100.0e0 as y, zi / 100.0e0 as z, dense_rank() over (order by tree_id) as "treeID" from pts where zi > 100
union all select xi / 100.0e0, yi / 100.0e0, zi / 100.0e0, 0 from pts where zi <= 100""",
}
