"""Live session queries: pose chain, freshness, sweeps, queues, streaks and full homographies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.plans import relational, spatial  # noqa: F401  (fill VIEWS)
from cytomesh.plans.sql import VIEWS, duck, query, view
from cytomesh.streaming import folds

VIEWS |= {
    # The stage's true position at each capture: rows of 12 fields, walked there and back.
    "captures": """
select session_id, job_id, w, h, score, raw_class, cast(job_id * 0.7 as double) as t_capture, 1 + ((job_id * 37) % 100) / 10.0 as texture,
  case when job_id % 37 = 1 and job_id > 20 then job_id - 20 end as anchor,
  x / 50 + 260.0 * case when cast(floor((job_id - 1) / 12) as bigint) % 2 = 0 then (job_id - 1) % 12 else 11 - (job_id - 1) % 12 end as tx, y / 50 + 150.0 * floor((job_id - 1) / 12) as ty
from @fields""",
    "fresh": "select *, job_id % 10 = 3 as stale, case when job_id % 9 = 4 then 'MANUAL' else 'AUTO' end as priority from @fields",
    "queue_events": "select session_id, frame_index as seq, case when event_id % 7 = 0 then 'TAKE' when event_id % 3 = 0 then 'MANUAL' else 'AUTO' end as kind from @frames",
    "homographies": """
select s_suppkey as id, 0.25 + 0.02 * (s_suppkey % 9) as a, 0.03 * (s_suppkey % 5) as b, 20.0 * (s_suppkey % 40) - 100 as tx, -0.02 * (s_suppkey % 3) as c, 0.25 + 0.05 * (s_suppkey % 4) - case when s_suppkey % 13 = 0 then 0.6 else 0 end as d,
  15.0 * (s_suppkey % 50) - 60 as ty, 0.00001 * (s_suppkey % 11) as g, 0.00002 * (s_suppkey % 7) + case when s_suppkey % 17 = 0 then 0.001 else 0 end as k
from @supplier""",
}

# ---- full homographies: (a b tx; c d ty; g k 1)
_X, _Y = "((m.a * {x} + m.b * {y} + m.tx) / (m.g * {x} + m.k * {y} + 1))", "((m.c * {x} + m.d * {y} + m.ty) / (m.g * {x} + m.k * {y} + 1))"
_CORNERS = ((0, 0), (1919, 0), (1919, 1079), (0, 1079))


def _at(x: float, y: float) -> tuple[str, str]:
    return _X.format(x=f"{float(x)}", y=f"{float(y)}"), _Y.format(x=f"{float(x)}", y=f"{float(y)}")


def _local(x: float, y: float, name: str) -> str:
    """The edges of the image of a small square at a point: bx, by, cx, cy."""
    (ox, oy), (px, py), (qx, qy) = _at(x, y), _at(x + 2, y), _at(x, y + 2)
    return f"({px} - {ox}) / 2 as {name}bx, ({py} - {oy}) / 2 as {name}by, ({qx} - {ox}) / 2 as {name}cx, ({qy} - {oy}) / 2 as {name}cy"


_EDGE = lambda i, j: f"sqrt((x{j} - x{i}) * (x{j} - x{i}) + (y{j} - y{i}) * (y{j} - y{i}))"
_TURN = lambda i, j, k: f"sign((x{j} - x{i}) * (y{k} - y{j}) - (y{j} - y{i}) * (x{k} - x{j}))"
_SCALE = lambda n: f"sqrt(greatest(sqrt({n}bx * {n}bx + {n}by * {n}by) * sqrt({n}cx * {n}cx + {n}cy * {n}cy), 0.000000000001))"
VIEWS["footprints"] = f"""
select id, {', '.join(f'{_at(*p)[0]} as x{i}, {_at(*p)[1]} as y{i}' for i, p in enumerate(_CORNERS))}, {_local(960, 540, 'm')}, {', '.join(_local(*p, f'c{i}') for i, p in enumerate(_CORNERS))}
from (select id, {', '.join(f'cast({c} as double) as {c}' for c in ('a', 'b', 'tx', 'c', 'd', 'ty', 'g', 'k'))} from @homographies) m"""

SQL: dict[str, str] = {}
SQL["homography_footprint"] = f"""
select id, round(area / {1920 * 1080}.0, 8) as area_frac, round(det, 8) as det, convex, round(greatest(ratio / {1920 / 1080!r}, {1920 / 1080!r} / ratio), 6) as distortion, round(variation, 6) as variation, round(cx, 4) as centre_x, round(cy, 4) as centre_y,
  det > 0 and convex and area / {1920 * 1080}.0 >= 0.002 and area / {1920 * 1080}.0 <= 1.5 and greatest(ratio / {1920 / 1080!r}, {1920 / 1080!r} / ratio) <= 3 and variation <= 4 and cx >= 0 and cx < 1920 and cy >= 0 and cy < 1080 as sane
from (
  select id, abs(x0 * y1 - x1 * y0 + x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y0 - x0 * y3) / 2 as area, mbx * mcy - mby * mcx as det,
    abs({_TURN(0, 1, 2)} + {_TURN(1, 2, 3)} + {_TURN(2, 3, 0)} + {_TURN(3, 0, 1)}) = 4 as convex,
    ({_EDGE(0, 1)} + {_EDGE(3, 2)}) / greatest({_EDGE(0, 3)} + {_EDGE(1, 2)}, 0.000000001) as ratio,
    greatest({', '.join(_SCALE(f'c{i}') for i in range(4))}) / least({', '.join(_SCALE(f'c{i}') for i in range(4))}) as variation, (x0 + x1 + x2 + x3) / 4 as cx, (y0 + y1 + y2 + y3) / 4 as cy
  from @footprints
) f"""
_H = {"a": 0, "b": 1, "tx": 2, "c": 3, "d": 4, "ty": 5, "g": 6, "k": 7}
_ROWS = (("a", "b", "tx"), ("c", "d", "ty"), ("g", "k", None))


def _product(i: int, j: int) -> str:
    term = lambda side, name: f"{side}.{name}" if name else "1.0"
    return "(" + " + ".join(f"{term('p', _ROWS[i][n])} * {term('q', _ROWS[n][j])}" for n in range(3)) + ")"


SQL["homography_chain"] = f"""
select p.id as parent, q.id as child, {', '.join(f'round({_product(i, j)} / {_product(2, 2)}, 9) + 0 as {_ROWS[i][j]}' for i in range(3) for j in range(3) if _ROWS[i][j])},
  round({_product(0, 0)} * 960 / {_product(2, 2)}, 6) + 0 as reach
from (select id, {', '.join(f'cast({c} as double) as {c}' for c in _H)} from @homographies) p join (select id, {', '.join(f'cast({c} as double) as {c}' for c in _H)} from @homographies) q on q.id = p.id + 1"""
SQL["area_theory"] = "select p.id as parent, q.id as child, round(p.um / q.um, 6) as scale_theory, round((p.um / q.um) * (p.um / q.um), 6) as area_theory from (select s_suppkey as id, 1.0 + s_suppkey % 4 as um from @supplier) p join (select s_suppkey as id, 1.0 + s_suppkey % 4 as um from @supplier) q on q.id = p.id + 1"

# ---- sweeps and rows
SQL["sweep_anchor"] = """
select s.session_id, s.sweep_id, s.start_job, a.job_id as anchor_job, coalesce(a.tx - c.tx, 0) as offset_x, coalesce(a.ty - c.ty, 0) as offset_y, round(c.tx + coalesce(a.tx - c.tx, 0), 1) as start_x, round(c.ty + coalesce(a.ty - c.ty, 0), 1) as start_y
from @sweep_starts s join @captures c on c.session_id = s.session_id and c.job_id = s.start_job left join @captures a on a.session_id = s.session_id and a.job_id = c.anchor"""
SQL["sweep_heading"] = """
select session_id, sweep_id, count(*) as n_fields, coalesce(max_by(heading, job_id) filter (where heading is not null), '-') as heading from (
  select session_id, sweep_id, job_id, case when sqrt(dx * dx + dy * dy) > 10 then case when abs(dx) >= abs(dy) then 'horizontal' else 'vertical' end end as heading from (
    select session_id, job_id, sweep_id, tx - lag(tx) over (partition by session_id, sweep_id order by job_id) as dx, ty - lag(ty) over (partition by session_id, sweep_id order by job_id) as dy
    from (select c.*, cast(floor((job_id + 35) / 37) as bigint) as sweep_id from @captures c) c
  ) d
) h group by session_id, sweep_id"""
SQL["raster_bands"] = """
select session_id, job_id, direction, phase, case
    when phase = 'ROW_SWEEP' and overlap > 0.30 then concat('ROW OVERLAP TOO HIGH - MOVE ', case direction when 'LEFT_TO_RIGHT' then 'RIGHT' else 'LEFT' end)
    when phase = 'ROW_SWEEP' and overlap < 0.20 then concat('GAP RISK - MOVE ', case direction when 'LEFT_TO_RIGHT' then 'LEFT' else 'RIGHT' end)
    when phase = 'ROW_SWEEP' then 'CAPTURE READY'
    when overlap > 0.30 then 'ROW OVERLAP TOO HIGH - MOVE FARTHER DOWN' when overlap < 0.20 then 'VERTICAL GAP RISK - MOVE BACK UP' else 'CAPTURE READY (new row)' end as hint, round(overlap, 8) as overlap, phase = 'STEP_DOWN' and overlap >= 0.20 and overlap <= 0.30 as row_done
from (
  select session_id, job_id, case when band % 2 = 0 then 'LEFT_TO_RIGHT' else 'RIGHT_TO_LEFT' end as direction, case when before is null or before = band then 'ROW_SWEEP' else 'STEP_DOWN' end as phase,
    case when before is null then 0 when before = band then greatest(0, 1 - abs(tx - px) / w) else greatest(0, 1 - abs(ty - py) / h) end as overlap
  from (
    select *, lag(band) over (partition by session_id order by job_id) as before, lag(tx) over (partition by session_id order by job_id) as px, lag(ty) over (partition by session_id order by job_id) as py
    from (select c.*, cast(floor((job_id - 1) / 12) as bigint) as band from @captures c) c
  ) d
) e"""
SQL["commands"] = """
select session_id, frame_index, kind, cast(sum(case when kind = 'start_sweep' then 1 else 0 end) over (partition by session_id, epoch order by frame_index rows unbounded preceding) as bigint) as sweep,
  cast(sum(case when kind = 'label' then 1 else 0 end) over (partition by session_id, epoch order by frame_index rows unbounded preceding) as bigint) as labels, epoch
from (
  select *, cast(sum(case when kind = 'reset' then 1 else 0 end) over (partition by session_id order by frame_index rows unbounded preceding) as bigint) as epoch from (
    select session_id, frame_index, case when event_id % 251 = 0 then 'reset' when event_id % 31 = 0 then 'start_sweep' when event_id % 11 = 0 then 'label' when event_id % 97 = 1 then 'anchor' end as kind from @frames) k where kind is not null
) c"""

# ---- counters, workers, densities
SQL["score_streaks"] = """
select session_id, job_id, cast(case when score >= 0.65 then row_number() over (partition by session_id, good_island order by job_id) - case when good_island > 0 then 1 else 0 end else 0 end as bigint) as good_streak,
  cast(case when score <= 0.45 then row_number() over (partition by session_id, bad_island order by job_id) - case when bad_island > 0 then 1 else 0 end else 0 end as bigint) as bad_streak
from (select *, sum(case when score < 0.65 then 1 else 0 end) over (partition by session_id order by job_id rows unbounded preceding) as good_island, sum(case when score > 0.45 then 1 else 0 end) over (partition by session_id order by job_id rows unbounded preceding) as bad_island from @fields) s"""
SQL["worker_pool"] = """
select worker, count(*) as jobs, round(sum(value) / 1000, 6) as busy_s, round(count(*) / nullif(max(t_capture + value / 1000) - min(t_capture), 0), 6) as jobs_per_s, round(avg(value), 6) as mean_ms, MEDIAN(value) as median_ms, min(t_capture + value / 1000) as first_done
from (select *, job_id % 3 as worker from @jobs) j group by worker"""
SQL["normalised_density"] = """
select image_id, count(*) filter (where inside) as n_valid, round(count(*) filter (where inside) / (1.327104 * ((1600.0 * 1200) / (1920.0 * 1080))), 6) as density
from (select image_id, x >= 192 and x < 1728 and y >= 108 and y < 972 as inside from @points) p group by image_id"""
SQL["result_history"] = """
select session_id, job_id, kind, stale, job_id = max(case when kind = 'auto' and not stale then job_id end) over (partition by session_id order by job_id rows unbounded preceding) as is_latest_auto,
  max(case when kind = 'manual' then job_id end) over (partition by session_id order by job_id rows unbounded preceding) as latest_manual
from (select session_id, job_id, case priority when 'AUTO' then 'auto' else 'manual' end as kind, stale and priority = 'AUTO' as stale from @fresh) f"""
SQL["raw_light_log"] = "select session_id, frame_index, t_sec, round(disp, 2) as disp_px, round(sharpness, 2) as sharpness, brightness, motion, screen from @motion_class where frame_index % 30 = 0"
SQL["cycled_keyframes"] = """
select a.session_id, s.slot, a.frame_index from (select p_partkey + 1 as slot from @part where p_partkey < 400) s join (
  select session_id, frame_index, row_number() over (partition by session_id order by frame_index) as place, count(*) over (partition by session_id) as n from (
    select session_id, frame_index, row_number() over (partition by session_id order by frame_index desc) as back from @accepted) b where back <= 400
) a on a.place = (s.slot - 1) % a.n + 1"""
SQL["mosaic_canvas"] = """
select session_id, job_id, x0, y0, cast(ceil(x1 - x0) as bigint) as canvas_w, cast(ceil(y1 - y0) as bigint) as canvas_h, cast(floor(tx - w / 2 - x0) as bigint) as place_x, cast(floor(ty - h / 2 - y0) as bigint) as place_y
from (
  select *, min(tx - w / 2) over o as x0, min(ty - h / 2) over o as y0, max(tx + w / 2) over o as x1, max(ty + h / 2) over o as y1 from @captures window o as (partition by session_id order by job_id rows unbounded preceding)
) c"""
SQL["first_images"] = """
select id, place, file_name from (
  select id, file_name, cast(row_number() over (order by a, b, id) as bigint) as place from (select p_partkey as id, p_partkey % 7 as a, p_partkey % 100 as b, concat('img', cast(p_partkey % 7 as varchar(10)), '_', cast(p_partkey % 100 as varchar(10)), '.png') as file_name from @part) p
) q where place <= 40"""
SQL["ordered_cells"] = "select image_id, instance_id, cast(row_number() over (partition by image_id order by instance_id) as bigint) as place, round(x, 2) as x, round(y, 2) as y, candidate from @flagged"
SQL["projected_columns"] = "select session_id, frame_index, t_sec, cast(null as varchar(10)) as skip_reason, round(sharpness, 4) as sharpness, cast(null as double) as score from @frames"


# ---- folds
def pose_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "captures").select("session_id", "job_id", "tx", "ty", "w", "h", "texture", "anchor")
    return folds.run(rows, folds.pose_chain(folds.made_evidence), "session_id", ("job_id",))


def registration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pose_chain(spark, sf_dir).groupBy("session_id", "state", "method").agg(F.count("*").alias("n"), F.sum(F.col("drift").cast("long")).alias("drifts"), F.max("job_id").alias("latest"))


def fresh_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field; only fresh AUTO results move the smoother and the navigation."""
    rows = view(spark, sf_dir, "fresh")
    live = rows.where("not stale and priority = 'AUTO'")
    smooth = folds.run(live, folds.smoother(), "session_id", ("job_id",))
    nav = folds.run(live, folds.navigation(), "session_id", ("job_id",)).select("session_id", "job_id", F.col("to_state").alias("nav"))
    key = ["session_id", "job_id"]
    return rows.select(*key, "stale", "priority").join(smooth.join(nav, key), key, "left")


def manual_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.run(view(spark, sf_dir, "queue_events"), folds.manual_queue(), "session_id", ("seq",))


def capture_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "frames").selectExpr("session_id", "frame_index", "0.02D + (event_id % 13) / 200D as dt")
    return folds.run(rows, folds.rate_average(), "session_id", ("frame_index",))


def running_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile's 8-bit value and weight as fields are blended into it one after another."""
    return folds.run(view(spark, sf_dir, "placements"), folds.blend(), "tile", ("job_id",))


VIEWS["placements"] = """
select session_id * 1000000 + cast(floor(x / 400) as bigint) * 1000 + cast(floor(y / 224) as bigint) as tile, job_id, cast(floor(score * 255) as bigint) as pixel, (abs(x / 400 - floor(x / 400) - 0.5) + 0.02) * least(1, greatest(0.05, reg_confidence)) as weight
from @fields where reg_state <> 'REGISTRATION_FAILED'"""

QUERIES = {name: query(text) for name, text in SQL.items()} | {f.__name__: f for f in (running_mosaic, pose_chain, registration_summary, fresh_smoothing, manual_queue, capture_rate)}

_CHAIN = """
with recursive walk as (
  select session_id, cast(0 as bigint) as job_id, cast([] as struct(j bigint, x double, y double, tx double, ty double, good boolean)[]) as flds, cast(null as bigint) as last_good, cast(null as bigint) as pref,
    cast('' as varchar) as state, cast('' as varchar) as method, cast(0 as double) as conf, cast(0 as double) as gx, cast(0 as double) as gy, cast(null as bigint) as ref_job, false as drift from (select distinct session_id from @captures) s
  union all
  select session_id, job_id, case when not keep then flds else case when len(flds) >= 30 then list_append(flds[2:], rec) else list_append(flds, rec) end end,
    case when not keep then last_good when rec.good then job_id when len(flds) >= 30 and last_good = flds[1].j then job_id else last_good end, pref, state, method, conf, gx, gy, ref_job, drift
  from (
    select *, struct_pack(j := job_id, x := gx, y := gy, tx := tx, ty := ty, good := state = 'REGISTRATION_GOOD') as rec from (
      select session_id, job_id, flds, last_good, pref, tx, ty, keep, ref.j as ref_job,
        case when not keep then 'REGISTRATION_FAILED' when ref is null then 'REGISTRATION_GOOD' when snaps then best.s else st end as state,
        case when not keep then 'FEATURELESS' when ref is null then 'FIRST_FIELD' when snaps then concat('MAP_FIELD_SNAP+', how) else how end as method,
        case when not keep then 0 when ref is null then 1 when snaps then greatest(cf, best.c) else cf end as conf,
        case when not keep or ref is null then 0 when snaps then best.x else px end as gx, case when not keep or ref is null then 0 when snaps then best.y else py end as gy,
        coalesce(keep and best is not null and sqrt(power(best.x - px, 2) + power(best.y - py, 2)) > 300, false) as drift
      from (
        select *, coalesce(best is not null and (best.c >= cf or sqrt(power(best.x - px, 2) + power(best.y - py, 2)) > 300), false) as snaps from (
          select *, list_sort(list_transform(list_filter(near, lambda f: sqrt(power(f.x - px, 2) + power(f.y - py, 2)) <= 1.3 * diag and ((f.j * 41 + job_id * 23) % 100) / 100.0 >= 0.12),
              lambda f: struct_pack(c := ((f.j * 41 + job_id * 23) % 100) / 100.0, k := -f.j, x := f.x + tx - f.tx + (f.j * 3 + job_id) % 5 - 2, y := f.y + ty - f.ty + (f.j + job_id * 3) % 5 - 2,
                s := case when ((f.j * 41 + job_id * 23) % 100) / 100.0 >= 0.22 then 'REGISTRATION_GOOD' else 'REGISTRATION_WEAK' end)), 'DESC')[1] as best
          from (
            select *, ref.x + dx as px, ref.y + dy as py, list_filter(flds, lambda f: f.good and f.j <> ref.j)[-8:] as near,
              case when sqrt(dx * dx + dy * dy) > 1.6 * diag or ncc < 0.25 then 'REGISTRATION_FAILED' else s0 end as st, case when sqrt(dx * dx + dy * dy) > 1.6 * diag then 0 when ncc < 0.25 then least(c0, 0.05) else c0 end as cf
            from (
              select *, case when orb_good or (not phase_ok and orb_weak) then odx else pdx end as dx, case when orb_good or (not phase_ok and orb_weak) then ody else pdy end as dy,
                case when orb_good then greatest(oconf, case when p_good and abs(odx - pdx) < 25 and abs(ody - pdy) < 25 then resp else oconf end) when phase_ok then resp when orb_weak then greatest(oconf, 0.2) when p_good then least(resp, 0.45) when resp >= 0.12 and not wrapped then resp else 0 end as c0,
                case when orb_good or (not phase_ok and orb_weak) then 'ORB_TRANSLATION' else 'PHASE_CORR' end as how,
                case when orb_good or phase_ok then 'REGISTRATION_GOOD' when orb_weak or p_good or (resp >= 0.12 and not wrapped) then 'REGISTRATION_WEAK' else 'REGISTRATION_FAILED' end as s0
              from (
                select *, matches >= 15 and inl >= 0.5 and oconf >= 0.3 as orb_good, matches >= 8 and inl >= 0.35 as orb_weak, resp >= 0.22 as p_good, sqrt(pdx * pdx + pdy * pdy) > 0.45 * w as wrapped,
                  resp >= 0.22 and sqrt(pdx * pdx + pdy * pdy) <= 0.45 * w and matches > 0 and not (matches >= 15 and inl >= 0.5 and oconf >= 0.3) as phase_ok
                from (
                  select *, tx - ref.tx + (ref.j * 5 + job_id * 3) % 7 - 3 as pdx, ty - ref.ty + (ref.j * 3 + job_id * 5) % 7 - 3 as pdy, ((ref.j * 37 + job_id * 11) % 100) / 100.0 as resp,
                    tx - ref.tx + (ref.j * 2 + job_id) % 5 - 2 as odx, ty - ref.ty + (ref.j + job_id * 2) % 5 - 2 as ody, ((ref.j * 19 + job_id * 23) % 100) / 100.0 as oconf, (ref.j * 7 + job_id * 13) % 50 as matches,
                    ((ref.j * 11 + job_id * 17) % 100) / 100.0 as inl, ((ref.j * 29 + job_id * 31) % 100) / 100.0 as ncc
                  from (
                    select session_id, job_id, flds, last_good, case when chosen is not null then null else pref end as pref, tx, ty, w, diag, texture >= 3 as keep,
                      coalesce(chosen, list_filter(flds, lambda f: f.j = last_good)[1], list_filter(flds, lambda f: f.good)[-1]) as ref
                    from (
                      select *, list_filter(flds, lambda f: f.j = pref and f.good)[1] as chosen from (
                        select k.session_id, c.job_id, k.flds, k.last_good, coalesce(c.anchor, k.pref) as pref, c.tx, c.ty, c.w, sqrt(c.w * c.w + c.h * c.h) as diag, c.texture from walk k join @captures c on c.session_id = k.session_id and c.job_id = k.job_id + 1
                      ) n
                    ) m
                  ) r
                ) e
              ) v
            ) d
          ) g
        ) b
      ) o
    ) z
  ) y
)"""
_LIVE = "live as (select *, row_number() over (partition by session_id order by job_id) as k from @fresh where not stale and priority = 'AUTO')"
ORACLE_SQL = {name: duck(text) for name, text in SQL.items()} | {
    "pose_chain": duck(_CHAIN + " select session_id, job_id, state, method, round(conf, 6) as conf, round(gx, 3) as gx, round(gy, 3) as gy, ref_job, drift from walk where job_id > 0"),
    "registration_summary": duck(_CHAIN + " select session_id, state, method, count(*) as n, cast(count(*) filter (where drift) as bigint) as drifts, max(job_id) as latest from walk where job_id > 0 group by all"),
    "fresh_smoothing": duck(f"""
with recursive {_LIVE}, walk as (
  select session_id, k, job_id, score as e, cast(case when score >= 0.65 then 1 else 0 end as bigint) as streak, cast(0 as bigint) as entering, cast(0 as bigint) as leaving, cast('OUTSIDE' as varchar) as nav from live where k = 1
  union all
  select session_id, k, job_id, e, streak, case when nav = 'OUTSIDE' and streak >= 2 then 0 when nav = 'ENTERING' and good then entering + 1 else entering end,
    case when nav = 'LEAVING' and good then 0 when nav in ('IN', 'LEAVING') and bad then leaving + 1 when nav = 'IN' then 0 else leaving end,
    case when nav = 'OUTSIDE' and streak >= 2 then 'ENTERING' when nav = 'ENTERING' and bad then 'OUTSIDE' when nav = 'ENTERING' and good and entering + 2 >= 2 then 'IN' when nav = 'IN' and bad and leaving + 1 >= 2 then 'LEAVING'
      when nav = 'LEAVING' and good then 'IN' when nav = 'LEAVING' and bad and leaving + 1 >= 2 then 'OUTSIDE' else nav end
  from (select l.session_id, l.k, l.job_id, 0.4 * l.score + 0.6 * w.e as e, case when l.score >= 0.65 then w.streak + 1 else 0 end as streak, w.entering, w.leaving, w.nav, l.score >= 0.65 as good, l.score <= 0.45 as bad from walk w join live l on l.session_id = w.session_id and l.k = w.k + 1) s
), votes as (select a.session_id, a.job_id, b.raw_class, count(*) as n from live a join live b on b.session_id = a.session_id and b.k between a.k - 4 and a.k group by all),
top as (select *, max(n) over (partition by session_id, job_id) as most from votes), win as (select session_id, job_id, count(*) as c, min(raw_class) as cls from top where n = most group by all)
select f.session_id, f.job_id, f.stale, f.priority, round(w.e, 6) as ema, case when c = 1 then cls when w.e >= 0.6 then 'MONOLAYER' when w.e is not null then 'UNCERTAIN' end as smoothed_class, w.nav
from @fresh f left join walk w on w.session_id = f.session_id and w.job_id = f.job_id left join win v on v.session_id = f.session_id and v.job_id = f.job_id"""),
    "manual_queue": duck("""
with recursive walk as (
  select session_id, cast(-1 as bigint) as seq, cast(0 as bigint) as pending, cast(1 as bigint) as next_id, cast(0 as bigint) as refused, cast(null as bigint) as job_id from (select distinct session_id from @queue_events) s
  union all
  select e.session_id, e.seq, case when kind = 'MANUAL' and pending < 20 then pending + 1 when kind = 'TAKE' then greatest(pending - 1, 0) else pending end,
    case when kind = 'AUTO' or (kind = 'MANUAL' and pending < 20) then next_id + 1 else next_id end, case when kind = 'MANUAL' and pending >= 20 then refused + 1 else refused end,
    case when kind = 'AUTO' or (kind = 'MANUAL' and pending < 20) then next_id end
  from walk w join @queue_events e on e.session_id = w.session_id and e.seq = w.seq + 1
) select session_id, seq, job_id, pending, refused from walk where seq >= 0"""),
    "running_mosaic": duck("""
with recursive p as (select *, row_number() over (partition by tile order by job_id) as k from @placements), walk as (
  select tile, k, job_id, floor(pixel * weight / (weight + 0.000001)) as value, weight as total from p where k = 1
  union all
  select p.tile, p.k, p.job_id, floor((w.value * w.total + p.pixel * p.weight) / (w.total + p.weight + 0.000001)), w.total + p.weight from walk w join p on p.tile = w.tile and p.k = w.k + 1
) select tile, job_id, cast(value as bigint) as value, round(total, 9) as total from walk"""),
    "capture_rate": duck("""
with recursive r as (select session_id, frame_index, 0.02 + (event_id % 13) / 200.0 as dt from @frames), walk as (
  select session_id, frame_index, 1 / dt as fps from r where frame_index = 0
  union all
  select r.session_id, r.frame_index, 0.9 * w.fps + 0.1 * (1 / r.dt) from walk w join r on r.session_id = w.session_id and r.frame_index = w.frame_index + 1
) select session_id, frame_index, round(fps, 6) as fps from walk"""),
}
