"""Queries that both engines run from one SQL text (see plans.sql)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.operators import sessions
from cytomesh.plans import views  # noqa: F401  (fills VIEWS)
from cytomesh.plans.sql import VIEWS, duck, query, view
from cytomesh.plans.views import HEIGHT, MPX, WIDTH

_OVERLAP = "greatest(0, least({a}.x + {a}.w / 2, {b}.x + {b}.w / 2) - greatest({a}.x - {a}.w / 2, {b}.x - {b}.w / 2)) * greatest(0, least({a}.y + {a}.h / 2, {b}.y + {b}.h / 2) - greatest({a}.y - {a}.h / 2, {b}.y - {b}.h / 2))"

VIEWS |= {
    "frame_steps": """
select *, sqrt(dx0 * dx0 + dy0 * dy0) as disp from (
  select *, case when frame_index = 0 then cast(0 as double) else dx end as dx0, case when frame_index = 0 then cast(0 as double) else dy end as dy0 from @frames
) f""",
    "motion_class": "select *, case when disp < 20 then 'STILL' when disp < 100 then 'SLOW' else 'FAST' end as motion, case when occupancy >= 0.62 then 'LIKELY_THICK' when occupancy <= 0.25 then 'LIKELY_THIN' else 'UNCERTAIN' end as screen from @frame_steps",
    "image_counts": """
select image_id, count(*) as n_total, count(*) filter (where candidate) as n_candidate, count(*) filter (where not touches_border) as n_interior,
  count(*) filter (where touches_border) as n_border, count(*) filter (where merge_suspect) as n_merge, count(*) filter (where possible_small) as n_small,
  count(*) filter (where possible_wbc) as n_wbc, sum(case when candidate then area else 0 end) as candidate_area
from @flagged group by image_id""",
    "tiles": f"""
select s.image_id, s.g, s.tx, s.ty, count(p.instance_id) as n from (
  select image_id, g, tx, ty from @ref_stats, (select p_partkey + 2 as g from @part where p_partkey < 3) a, (select p_partkey as tx from @part where p_partkey < 4) b, (select p_partkey as ty from @part where p_partkey < 4) c
  where tx < g and ty < g
) s left join @points p on p.image_id = s.image_id
  and s.tx = least(s.g - 1, cast(floor(p.x * s.g / {WIDTH}) as int)) and s.ty = least(s.g - 1, cast(floor(p.y * s.g / {HEIGHT}) as int))
group by s.image_id, s.g, s.tx, s.ty""",
    "grid_geometry": """
select session_id, greatest(1, MEDIAN(w) * 0.125) as cell, min(x - w / 2) - greatest(1, MEDIAN(w) * 0.125) as gx0, min(y - h / 2) - greatest(1, MEDIAN(w) * 0.125) as gy0,
  max(x + w / 2) + greatest(1, MEDIAN(w) * 0.125) as gx1, max(y + h / 2) + greatest(1, MEDIAN(w) * 0.125) as gy1
from @fields group by session_id""",
    "transforms": """
select s_suppkey as id, (s_suppkey % 7 + 1) * 0.1 as a, 0.01 * (s_suppkey % 5) as b, 5.0 * (s_suppkey % 11) as tx,
  -0.01 * (s_suppkey % 3) as c, (s_suppkey % 6 - 1) * 0.12 as d, 4.0 * (s_suppkey % 13) as ty
from @supplier""",
}

SQL: dict[str, str] = {}
# ---- cells and images
SQL["ref_stats"] = "select image_id, median_area, round(median_diameter, 6) as median_diameter, round(iqr_area, 6) as iqr_area, n_stats_cells from @ref_stats"
SQL["flag_cells"] = "select image_id, instance_id, round(ratio, 6) as area_ratio, possible_small, possible_wbc, candidate, touches_border, round(2 * r, 6) as diameter from @flagged"
SQL["merge_suspects_top12"] = """
select image_id, instance_id, area, k from (
  select image_id, instance_id, area, cast(row_number() over (partition by image_id order by area desc, instance_id) as bigint) as k from @flagged where merge_suspect
) t where k <= 12"""
SQL["image_counts"] = "select image_id, n_total, n_candidate, n_interior, n_border, round(n_border * 100.0 / nullif(n_total, 0), 6) as border_pct, n_merge, n_small, n_wbc from @image_counts"
SQL["coverage_density"] = f"select image_id, round(candidate_area / {WIDTH * HEIGHT}.0, 9) as coverage, round(n_candidate / {MPX}, 6) as density_per_mpx from @image_counts"
SQL["grid_density_cv"] = "select image_id, g, round(stddev_pop(n) / nullif(avg(n), 0), 6) as density_cv, max(n) as max_tile, min(n) as min_tile from @tiles group by image_id, g"
SQL["mask_geometry"] = """
select image_id, label, cast(n as bigint) as area_px, round(sx / n, 6) as centroid_x, round(sy / n, 6) as centroid_y, x_min, x_max, y_min, y_max,
  round(sxx / n - (sx / n) * (sx / n) + 1 / 12.0, 5) as var_x, round(syy / n - (sy / n) * (sy / n) + 1 / 12.0, 5) as var_y, round(sxy / n - (sx / n) * (sy / n), 5) as cov_xy
from (
  select image_id, label, cast(sum(x1 - x0) as double) as n, sum((x1 - x0) * (x0 + x1 - 1) / 2.0) as sx, cast(sum((x1 - x0) * row_no) as double) as sy,
    sum((x1 - 1) * x1 * (2.0 * x1 - 1) / 6 - (x0 - 1) * x0 * (2.0 * x0 - 1) / 6) as sxx, cast(sum((x1 - x0) * row_no * row_no) as double) as syy,
    sum(row_no * (x1 - x0) * (x0 + x1 - 1) / 2.0) as sxy, min(x0) as x_min, max(x1) - 1 as x_max, min(row_no) as y_min, max(row_no) as y_max
  from (select image_id, label, row_no, x0, x1 from @mask_runs) m group by image_id, label
) t"""
SQL["instance_count"] = "select image_id, count(distinct label) as instance_count, max(label) as max_label from @mask_runs group by image_id"
SQL["roi_mask_coverage"] = f"""
select image_id, cast(sum(greatest(0, least(x1, {WIDTH - 192}) - greatest(x0, 192))) as bigint) as roi_px,
  round(sum(greatest(0, least(x1, {WIDTH - 192}) - greatest(x0, 192))) / {(WIDTH - 384) * (HEIGHT - 216)}.0, 9) as summed_coverage
from @mask_runs where row_no >= 108 and row_no < {HEIGHT - 108} group by image_id"""
SQL["count_error"] = """
select c.image_id, n_candidate, manual_count, n_candidate - manual_count as error, abs(n_candidate - manual_count) as abs_error,
  round(100.0 * (n_candidate - manual_count) / nullif(manual_count, 0), 6) as pct_error
from @image_counts c left join @manual m on c.image_id = m.image_id"""
SQL["count_error_summary"] = """
select count(manual_count) as n_matched, round(avg(abs(n_candidate - manual_count)), 6) as mae, round(avg(100.0 * (n_candidate - manual_count) / nullif(manual_count, 0)), 6) as mean_pct_error
from @image_counts c left join @manual m on c.image_id = m.image_id"""
SQL["manual_template"] = "select distinct image_id, cast(null as bigint) as manual_count, cast(null as varchar(10)) as manual_label, cast(null as varchar(10)) as notes from @cells"
SQL["run_summary"] = """
select count(*) as n_images, cast(sum(n_total) as bigint) as n_cells, cast(sum(n_candidate) as bigint) as n_candidates, min(n_candidate) as min_candidates,
  MEDIAN(n_candidate) as median_candidates, max(n_candidate) as max_candidates, round(avg(n_candidate), 6) as mean_candidates from @image_counts"""
SQL["class_agreement"] = """
select cast(count(*) as bigint) as n, count(*) filter (where a.cls = b.cls) as agree, round(avg(abs(a.n_candidate - b.n_half)), 6) as mean_abs_delta,
  count(*) filter (where abs(a.n_candidate - b.n_half) > 0.000000001 or a.cls <> b.cls) as mismatches
from (select image_id, n_candidate, case when n_candidate >= 600 then 'MANY' else 'FEW' end as cls from @image_counts) a
join (select image_id, 2 * count(*) filter (where candidate and instance_id % 2 = 0) as n_half, case when 2 * count(*) filter (where candidate and instance_id % 2 = 0) >= 600 then 'MANY' else 'FEW' end as cls from @flagged group by image_id) b
on a.image_id = b.image_id"""
# ---- frames
SQL["sampled_scan"] = "select session_id, frame_index, t_sec, round(disp, 6) as disp from @frame_steps where frame_index % 10 = 0 and frame_index >= 20"
SQL["frame_deltas"] = """
select session_id, frame_index, round(disp, 6) as disp, round(disp - lag(disp) over (partition by session_id order by frame_index), 6) as step,
  round(sum(dx0) over (partition by session_id order by frame_index rows unbounded preceding), 4) as net_x, round(sum(dy0) over (partition by session_id order by frame_index rows unbounded preceding), 4) as net_y,
  round(sum(disp) over (partition by session_id order by frame_index rows unbounded preceding), 4) as path_length
from @frame_steps"""
SQL["motion_profile"] = """
select session_id, min(disp) as d_min, round(PCT(5, disp), 6) as p5, round(PCT(25, disp), 6) as p25, round(MEDIAN(disp), 6) as p50, round(PCT(75, disp), 6) as p75, round(PCT(95, disp), 6) as p95, max(disp) as d_max,
  round(100.0 * count(*) filter (where motion = 'STILL') / count(*), 6) as still_pct, round(100.0 * count(*) filter (where motion = 'SLOW') / count(*), 6) as slow_pct, round(100.0 * count(*) filter (where motion = 'FAST') / count(*), 6) as fast_pct,
  max(brightness) - min(brightness) as brightness_spread
from @motion_class group by session_id"""
SQL["screen_histogram"] = "select session_id, screen, motion, count(*) as n, count(*) filter (where sharpness < 5) as n_blurry from @motion_class group by session_id, screen, motion"
SQL["longest_run"] = """
select session_id, motion, n as frames, start_index, (n - 1) * 0.5 as seconds from (
  select session_id, motion, n, start_index, row_number() over (partition by session_id, motion order by n desc, start_index) as k from (
    select session_id, motion, island, count(*) as n, min(frame_index) as start_index from (
      select session_id, motion, frame_index, frame_index - row_number() over (partition by session_id, motion order by frame_index) as island from @motion_class
    ) a group by session_id, motion, island
  ) b
) c where k = 1"""
SQL["still_counter"] = """
select session_id, frame_index, cast(row_number() over (partition by session_id, moves order by frame_index) - case when moves > 0 then 1 else 0 end as bigint) as still
from (select session_id, frame_index, sum(case when disp > 8 then 1 else 0 end) over (partition by session_id order by frame_index rows unbounded preceding) as moves from @frame_steps) m"""
SQL["resolution_scaled"] = "select session_id, frame_index, 240.0 * 800 / 1920 as motion_threshold, round(sharpness * (1920.0 / 480) * (1920.0 / 480), 6) as native_sharpness, sharpness < 5 as blurry from @frames"
# ---- fields on the map
SQL["field_bounds"] = "select session_id, min(x - w / 2) as x0, min(y - h / 2) as y0, max(x + w / 2) as x1, max(y + h / 2) as y1, count(*) as n from @fields group by session_id"
SQL["covered_fraction"] = f"""
select a.session_id, a.job_id, round(coalesce(least(1, sum({_OVERLAP.format(a='a', b='b')}) / greatest(1, max(a.w * a.h))), 0), 6) as covered
from @fields a left join @fields b on a.session_id = b.session_id and b.job_id < a.job_id and b.raw_class = 'MONOLAYER'
  and abs(a.x - b.x) < (a.w + b.w) / 2 and abs(a.y - b.y) < (a.h + b.h) / 2
group by a.session_id, a.job_id"""
SQL["layer_overlaps"] = f"""
select a.session_id, a.job_id, b.job_id as footprint, a.raw_class = 'MONOLAYER' as affirms, case when a.human_label is not null then 2 else 1 end as weight,
  round({_OVERLAP.format(a='a', b='b')} / least(a.w * a.h, b.w * b.h), 4) as overlap
from @fields a join @fields b on a.session_id = b.session_id and b.job_id <> a.job_id and b.raw_class = 'MONOLAYER'
  and abs(a.x - b.x) < (a.w + b.w) / 2 and abs(a.y - b.y) < (a.h + b.h) / 2
where {_OVERLAP.format(a='a', b='b')} / least(a.w * a.h, b.w * b.h) >= 0.25"""
SQL["sweep_direction"] = """
select session_id, job_id, case when abs(sx) <= 10 and abs(sy) <= 10 then null when abs(sx) >= abs(sy) then case when sx > 0 then 'RIGHT' else 'LEFT' end else case when sy > 0 then 'DOWN' else 'UP' end end as direction
from (select session_id, job_id, x - lag(x) over (partition by session_id order by job_id) as sx, y - lag(y) over (partition by session_id order by job_id) as sy from @fields) s"""
SQL["registration_grades"] = "select session_id, reg_state, count(*) as n, round(avg(reg_confidence), 6) as mean_conf, max(job_id) as latest from @fields group by session_id, reg_state"
SQL["snap_candidates"] = """
select session_id, job_id, ref, round(d, 6) as distance from (
  select a.session_id, a.job_id, b.job_id as ref, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d,
    row_number() over (partition by a.session_id, a.job_id order by b.job_id desc) as k
  from @fields a join @fields b on a.session_id = b.session_id and b.job_id < a.job_id and b.reg_state = 'REGISTRATION_GOOD'
    and abs(a.x - b.x) <= 1.3 * sqrt(a.w * a.w + a.h * a.h) and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1.3 * sqrt(a.w * a.w + a.h * a.h)
) t where k <= 8"""
SQL["point_in_any"] = """
select a.session_id, a.job_id from @fields a where a.raw_class = 'TOO_THICK' and exists (
  select 1 from @fields b where b.session_id = a.session_id and b.raw_class = 'MONOLAYER' and abs(a.x - b.x) <= b.w / 2 and abs(a.y - b.y) <= b.h / 2)"""
SQL["movement_hint"] = """
select session_id, job_id, case when prev > 0.30 then 'MOVE FARTHER' when prev < 0.20 then 'MOVE BACK' else 'HOLD' end as hint,
  case when sx is null then null else cast(floor((degrees(atan2(-sy, sx)) + 382.5) / 45) as bigint) % 8 end as octant
from (
  select session_id, job_id, x - lag(x) over (partition by session_id order by job_id) as sx, y - lag(y) over (partition by session_id order by job_id) as sy,
    greatest(0, 1 - abs(x - lag(x) over (partition by session_id order by job_id)) / w) * greatest(0, 1 - abs(y - lag(y) over (partition by session_id order by job_id)) / h) as prev
  from @fields
) t"""
SQL["grid_index"] = """
select f.session_id, f.job_id, cast(floor((x - w / 2 - gx0) / cell) as bigint) as c0, cast(ceil((x + w / 2 - gx0) / cell) as bigint) as c1, cast(floor((y - h / 2 - gy0) / cell) as bigint) as r0, cast(ceil((y + h / 2 - gy0) / cell) as bigint) as r1
from @fields f join @grid_geometry g on f.session_id = g.session_id"""
SQL["calibration"] = """
select s_suppkey as id, 2.0 + s_suppkey % 4 as px_per_um, 1 / (2.0 + s_suppkey % 4) as um_per_px, 1920 / (2.0 + s_suppkey % 4) as fov_w_um, 1080 / (2.0 + s_suppkey % 4) as fov_h_um,
  400 + 80.0 * (s_suppkey % 5) / 4 as pose_x, 300 - 40.0 * (s_suppkey % 3) / 4 as pose_y from @supplier"""
# ---- jobs
SQL["priority_dequeue"] = """
select session_id, job_id, priority, cast(row_number() over (partition by session_id order by case priority when 'MANUAL' then 0 when 'FORCED' then 1 else 2 end, job_id) as bigint) as place
from (select *, row_number() over (partition by session_id, priority order by job_id desc) as newest from @jobs) j where priority <> 'AUTO' or newest = 1"""
SQL["queue_stats"] = """
select session_id, count(*) as submitted, count(*) filter (where priority = 'MANUAL') as manual, count(*) filter (where priority = 'FORCED') as forced,
  count(*) filter (where priority = 'AUTO') as autos, greatest(count(*) filter (where priority = 'AUTO') - 1, 0) as superseded,
  greatest(count(*) filter (where priority = 'MANUAL') - 20, 0) as refused from @jobs group by session_id"""
SQL["newest_jobs"] = "select job_id, session_id, priority, t_capture from @jobs order by job_id desc limit 12"
SQL["staleness"] = """
select session_id, job_id, round(d, 6) as moved, round(age, 6) as age, priority = 'AUTO' and (d > 160 or age > 25) as stale, case when priority <> 'AUTO' then null when d > 160 then 'moved' when age > 25 then 'old' end as reason
from (
  select j.session_id, j.job_id, j.priority, j.value / 15 as age, sqrt((n.net_x - m.net_x) * (n.net_x - m.net_x) + (n.net_y - m.net_y) * (n.net_y - m.net_y)) as d
  from (select session_id, event_id as job_id, frame_index, cast(floor(value / 15 / 0.5) as bigint) as lagged, value, case when event_id % 5 = 0 then 'MANUAL' else 'AUTO' end as priority from (select f.*, e.value from @frames f join @events e on f.event_id = e.event_id) q) j
  join (select session_id, frame_index, sum(dx0) over (partition by session_id order by frame_index rows unbounded preceding) as net_x, sum(dy0) over (partition by session_id order by frame_index rows unbounded preceding) as net_y from @frame_steps) m on m.session_id = j.session_id and m.frame_index = j.frame_index
  join (select session_id, frame_index, sum(dx0) over (partition by session_id order by frame_index rows unbounded preceding) as net_x, sum(dy0) over (partition by session_id order by frame_index rows unbounded preceding) as net_y from @frame_steps) n on n.session_id = j.session_id and n.frame_index = j.frame_index + j.lagged
) t"""
SQL["commit_blockers"] = """
select session_id, job_id, done_at, greatest(done_at, max(done_at) over (partition by session_id order by job_id rows unbounded preceding)) as commit_at,
  max(done_at) over (partition by session_id order by job_id rows unbounded preceding) - done_at > 15 as late
from (select session_id, job_id, t_capture + value / 10 as done_at from @jobs) j"""
SQL["session_summary"] = """
select session_id, count(*) as jobs, round(max(t_capture) - min(t_capture), 6) as elapsed, round(least(1, sum(value / 1000) / nullif(max(t_capture) - min(t_capture), 0)), 6) as busy_fraction,
  count(*) filter (where value > 250) as slow, max(job_id) as latest from @jobs group by session_id"""
SQL["latest_results"] = "select priority, session_id, max(job_id) as latest_job, count(*) as n from @jobs group by priority, session_id"
# ---- cross-magnification transforms
SQL["homography_sanity"] = """
select id, round(det, 9) as det, round(sqrt(abs(det)), 9) as scale, round(area_frac, 9) as area_frac, det > 0 and area_frac >= 0.002 and area_frac <= 1.5 and aspect <= 3 as sane,
  case when det <= 0 then 'mirrored' when area_frac < 0.002 then 'too small' when area_frac > 1.5 then 'too large' when aspect > 3 then 'aspect' end as reason
from (
  select id, a * d - b * c as det, abs(a * d - b * c) as area_frac, greatest(sqrt(a * a + c * c), sqrt(b * b + d * d)) / nullif(least(sqrt(a * a + c * c), sqrt(b * b + d * d)), 0) as aspect
  from (select id, cast(a as double) as a, cast(b as double) as b, cast(c as double) as c, cast(d as double) as d from @transforms) t
) s"""
SQL["compose_transforms"] = """
select p.id as parent, q.id as child, round(p.a * q.a + p.b * q.c, 9) + 0 as a, round(p.a * q.b + p.b * q.d, 9) + 0 as b, round(p.a * q.tx + p.b * q.ty + p.tx, 9) + 0 as tx,
  round(p.c * q.a + p.d * q.c, 9) + 0 as c, round(p.c * q.b + p.d * q.d, 9) + 0 as d, round(p.c * q.tx + p.d * q.ty + p.ty, 9) + 0 as ty,
  round(p.a * 960 + p.b * 540 + p.tx, 9) + 0 as centre_x, round(p.c * 960 + p.d * 540 + p.ty, 9) + 0 as centre_y
from (select id, cast(a as double) as a, cast(b as double) as b, cast(tx as double) as tx, cast(c as double) as c, cast(d as double) as d, cast(ty as double) as ty from @transforms) p
join (select id, cast(a as double) as a, cast(b as double) as b, cast(tx as double) as tx, cast(c as double) as c, cast(d as double) as d, cast(ty as double) as ty from @transforms) q on q.id = p.id + 1"""
SQL["natural_sort"] = """
select p_partkey as id, cast(row_number() over (order by p_partkey % 7, p_partkey % 100, p_partkey) as bigint) as place,
  concat('img', cast(p_partkey % 7 as varchar(10)), '_', cast(p_partkey % 100 as varchar(10)), '.png') as file_name from @part"""

# ---- more ordered, set and scalar operators
VIEWS |= {
    "accepted": "select session_id, frame_index, t_sec, sharpness, row_number() over (partition by session_id order by frame_index) as k from @frames where sharpness >= 5 and frame_index % 7 = 0",
    "attempts": """
select cast(o_orderkey % 200 as bigint) as pair, cast(row_number() over (partition by o_orderkey % 200 order by o_orderkey) as bigint) as attempt, (o_orderkey * 31) % 97 as inliers,
  cast((o_orderkey * 17) % 100 as double) / 100 as ratio, cast((o_orderkey * 13) % 50 as double) / 10 as reproj from @orders""",
    "shifts": "select user_id as pair, event_id, cast((event_id * 7) % 41 - 20 as double) as dx, cast((event_id * 11) % 31 - 15 as double) as dy from @events",
    "sweep_starts": "select session_id, job_id as start_job, cast(row_number() over (partition by session_id order by job_id) as bigint) as sweep_id from @fields where job_id % 37 = 1",
}
SQL["last_keyframes"] = """
select session_id, frame_index, cast(row_number() over (partition by session_id order by frame_index) as bigint) as place from (
  select session_id, frame_index, row_number() over (partition by session_id order by frame_index desc) as k from @accepted
) t where k <= 5"""
SQL["best_attempt"] = """
select pair, attempt, inliers, good from (
  select *, row_number() over (partition by pair order by inliers desc, ratio desc, reproj, attempt) as k from (
    select *, inliers >= 60 and ratio >= 0.5 and reproj <= 2 as good, max(case when inliers >= 60 and ratio >= 0.5 and reproj <= 2 then 1 else 0 end) over (partition by pair order by attempt rows between unbounded preceding and 1 preceding) as stopped from @attempts
  ) a where coalesce(stopped, 0) = 0
) b where k = 1"""
SQL["median_translation"] = """
select s.pair, count(*) as n, max(m.mx) as dx, max(m.my) as dy, count(*) filter (where sqrt((s.dx - m.mx) * (s.dx - m.mx) + (s.dy - m.my) * (s.dy - m.my)) <= 20) as inliers,
  round(1.0 * count(*) filter (where sqrt((s.dx - m.mx) * (s.dx - m.mx) + (s.dy - m.my) * (s.dy - m.my)) <= 20) / count(*), 6) as inlier_ratio
from @shifts s join (select pair, MEDIAN(dx) as mx, MEDIAN(dy) as my from @shifts group by pair) m on m.pair = s.pair group by s.pair"""
SQL["registration_state"] = """
select event_id, case when inliers >= 20 and ratio >= 0.5 then 'GOOD' when response >= 0.3 and ncc >= 0.5 then 'GOOD' when inliers >= 8 then 'WEAK' when response >= 0.1 and ncc >= 0.3 then 'WEAK' else 'FAILED' end as state,
  case when inliers >= 20 and ratio >= 0.5 then 'FEATURES' when response >= 0.3 and ncc >= 0.5 then 'PHASE' when inliers >= 8 then 'FEATURES' when response >= 0.1 and ncc >= 0.3 then 'PHASE' end as method
from (select event_id, (event_id * 13) % 40 as inliers, ((event_id * 7) % 100) * 0.01 as ratio, ((event_id * 3) % 50) * 0.01 as response, ((event_id * 11) % 100) * 0.01 as ncc from @events) e"""
SQL["orientation_difference"] = "select event_id, round(least(d, 180 - d), 6) as difference from (select event_id, abs(value - 90.0) - 180 * floor(abs(value - 90.0) / 180) as d from @events) e"
SQL["view_transform"] = """
select session_id, job_id, round(400 + (x - 3000) * zoom * 0.1 + 12, 6) as view_x, round(300 + (y - 2000) * zoom * 0.1 - 7, 6) as view_y, zoom
from (select *, least(8, greatest(0.25, score * 10)) as zoom from @fields) f"""
SQL["feather_weight"] = "select session_id, job_id, round(least(1, least(least(px, w - px) / (0.25 * w), least(py, h - py) / (0.25 * h))) + 0.02, 6) as weight from (select *, w * score as px, h * (1 - score) as py from @fields) f"
SQL["label_names"] = "select session_id, job_id, case raw_class when 'MONOLAYER' then 'm' when 'TOO_THICK' then 't' when 'TOO_THIN' then 'n' else 'u' end as letter, human_label, coalesce(human_label, raw_class) as effective from @fields"
SQL["file_names"] = "select session_id, job_id, concat('field_', lpad(cast(job_id as varchar(10)), 5, '0'), '.png') as file_name, cast(regexp_extract(concat('field_', lpad(cast(job_id as varchar(10)), 5, '0'), '.png'), '([0-9]+)', 1) as bigint) as parsed from @fields"
SQL["asof_positions"] = """
select a.session_id, a.event_id, round(sum(b.dx0), 4) as net_x from @frames a join @frame_steps b on b.session_id = a.session_id and b.frame_index <= a.frame_index group by a.session_id, a.event_id"""
SQL["sweep_membership"] = """
select f.session_id, f.job_id, coalesce(max(s.sweep_id), 0) as sweep_id, coalesce(max(s.start_job), 0) as anchor_job from @fields f left join @sweep_starts s on s.session_id = f.session_id and s.start_job <= f.job_id group by f.session_id, f.job_id"""
SQL["sweep_trails"] = """
select session_id, sweep_id, count(*) as n, min(job_id) as first_job, max(job_id) as last_job, round(sum(step), 4) as length from (
  select f.session_id, f.job_id, s.sweep_id, coalesce(sqrt((x - lag(x) over (partition by f.session_id, s.sweep_id order by f.job_id)) * (x - lag(x) over (partition by f.session_id, s.sweep_id order by f.job_id)) + (y - lag(y) over (partition by f.session_id, s.sweep_id order by f.job_id)) * (y - lag(y) over (partition by f.session_id, s.sweep_id order by f.job_id))), 0) as step
  from @fields f join (select session_id, start_job, sweep_id, lead(start_job) over (partition by session_id order by start_job) as next_job from @sweep_starts) s on s.session_id = f.session_id and f.job_id >= s.start_job and (s.next_job is null or f.job_id < s.next_job)
) t group by session_id, sweep_id"""
SQL["carried_timings"] = "select c.image_id, n_total, t.ms from @image_counts c left join (select s_suppkey as image_id, round(s_suppkey * 1.5, 3) as ms from @supplier where s_suppkey % 4 <> 0) t on t.image_id = c.image_id"
SQL["label_lookup"] = "select j.job_id, j.priority, f.session_id, f.raw_class, f.human_label from (select job_id, min(priority) as priority from @jobs group by job_id) j join @fields f on f.job_id = j.job_id and f.session_id = j.job_id % 50"
SQL["edge_set"] = "select session_id, y - h / 2 as edge from @fields union select session_id, y + h / 2 from @fields"
SQL["uncommitted"] = "select session_id, job_id from @jobs where value > 100 except select session_id, job_id from @jobs where priority = 'AUTO'"
SQL["both_layers"] = "select session_id, count(*) as both_n from (select session_id, job_id from @fields where raw_class = 'MONOLAYER' intersect select session_id, job_id from @fields where reg_state = 'REGISTRATION_GOOD') t group by session_id"
SQL["all_logs"] = "select 'field' as kind, session_id, job_id as id from @fields union all select 'job', session_id, job_id from @jobs"
SQL["gate_inference"] = "select screen, count(*) as frames, count(*) filter (where screen <> 'LIKELY_THIN' and sharpness >= 5) as analysed from @motion_class group by screen"
SQL["mosaic_blend"] = """
select session_id, gx, gy, round(sum(wt * score) / sum(wt), 6) as blended, count(*) as n from (
  select session_id, cast(floor(x / 400) as bigint) as gx, cast(floor(y / 224) as bigint) as gy, score, reg_confidence * 0.5 + 0.02 as wt from @fields where reg_state <> 'REGISTRATION_FAILED'
) t group by session_id, gx, gy having sum(wt) > 0.02"""
SQL["valid_region"] = "select image_id, count(*) filter (where x >= 192 and x < 1728 and y >= 108 and y < 972) as inside, count(*) as n from @points group by image_id"
SQL["run_performance"] = "select session_id, round(avg(value), 6) as mean_ms, MEDIAN(value) as median_ms, min(value) as min_ms, max(value) as max_ms, round(1000 / nullif(MEDIAN(value), 0), 6) as fps from @jobs group by session_id"
SQL["superseded_jobs"] = """
select session_id, job_id, coalesce(next_job is not null and next_at < t_capture + value / 100, false) as superseded from (
  select *, lead(job_id) over (partition by session_id order by job_id) as next_job, lead(t_capture) over (partition by session_id order by job_id) as next_at from @jobs where priority = 'AUTO') t"""
SQL["revisit_cursor"] = "select session_id, job_id, (job_id * 7) % 6 as target from @fields"
SQL["boundary_evidence"] = """
select session_id, gx, gy, round(avg(evidence), 6) as evidence, avg(evidence) >= 0.5 as inside from (
  select session_id, cast(floor(x / 100) as bigint) as gx, cast(floor(y / 100) as bigint) as gy, (agree + score) / (agree + disagree + 1) as evidence
  from (select *, cast(job_id % 4 as double) as agree, cast(job_id % 3 as double) as disagree from @fields where raw_class = 'MONOLAYER') f
) t group by session_id, gx, gy"""
SQL["centroid_revisit"] = """
select session_id, job_id from (
  select f.session_id, f.job_id, row_number() over (partition by f.session_id order by round((f.x - m.mx) * (f.x - m.mx) + (f.y - m.my) * (f.y - m.my), 3), f.job_id) as k
  from @fields f join (select session_id, avg(x) as mx, avg(y) as my from @fields where raw_class = 'MONOLAYER' group by session_id) m on m.session_id = f.session_id where f.raw_class = 'MONOLAYER'
) t where k = 1"""
SQL["field_state_counts"] = "select raw_class, reg_state, count(*) as n, min(score) as lo, MEDIAN(score) as mid, max(score) as hi from @fields group by raw_class, reg_state"

# ---- forms that Spark runs in place of the SQL above
SPARK: dict[str, str] = {}
SPARK["asof_positions"] = "select session_id, event_id, round(sum(dx0) over (partition by session_id order by frame_index rows unbounded preceding), 4) as net_x from @frame_steps"
# The sweep of a field is the last one begun at or before it: a window over both, not a join of every pair.
SPARK["sweep_membership"] = """
select session_id, job_id, sweep_id, anchor_job from (
  select session_id, job_id, is_field, coalesce(max(sweep_id) over w, 0) as sweep_id, coalesce(max(start_job) over w, 0) as anchor_job from (
    select session_id, job_id, true as is_field, cast(null as bigint) as sweep_id, cast(null as bigint) as start_job from @fields
    union all select session_id, start_job, false, sweep_id, start_job from @sweep_starts) u
  window w as (partition by session_id order by job_id, is_field rows unbounded preceding)
) t where is_field"""



def covered_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = view(spark, sf_dir, "fields").selectExpr("session_id", "job_id", "x", "y", "w", "h", "coalesce(raw_class = 'MONOLAYER', false) as mono")
    return sessions.by_session(fields, sessions.covered, "session_id long, job_id long, covered double").select("session_id", "job_id", F.round("covered", 6).alias("covered"))


def layer_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = view(spark, sf_dir, "fields").selectExpr("session_id", "job_id", "x", "y", "w", "h", "coalesce(raw_class = 'MONOLAYER', false) as mono", "case when human_label is not null then 2 else 1 end as weight")
    return sessions.layer_links(fields)


def point_in_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = view(spark, sf_dir, "fields").selectExpr("session_id", "job_id", "x", "y", "w", "h", "coalesce(raw_class = 'MONOLAYER', false) as mono", "coalesce(raw_class = 'TOO_THICK', false) as thick")
    return sessions.by_session(fields, sessions.inside_any, "session_id long, job_id long")


def snap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = view(spark, sf_dir, "fields").selectExpr("session_id", "job_id", "x", "y", "1.3D * sqrt(w * w + h * h) as radius", "coalesce(reg_state = 'REGISTRATION_GOOD', false) as good")
    return sessions.by_session(fields, sessions.latest_near, "session_id long, job_id long, ref long, distance double").withColumn("distance", F.round("distance", 6))


QUERIES = {name: query(text) for name, text in (SQL | SPARK).items()} | {f.__name__: f for f in (covered_fraction, layer_overlaps, point_in_any, snap_candidates)}
ORACLE_SQL = {name: duck(text) for name, text in SQL.items()}
