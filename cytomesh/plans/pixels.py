"""Queries on pixels: images made by a fixed rule from the tables, kernels over them, masks and grid regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.operators import frames, spatial
from cytomesh.operators.sessions import dealt
from cytomesh.plans import relational, survey  # noqa: F401  (fill VIEWS)
from cytomesh.plans.spatial import _rounded
from cytomesh.plans.sql import duck, query, view
from cytomesh.session import written

W, H = 48, 36
_PIXEL = "({x} * {x} * 3 + {y} * {y} * 5 + {x} * {y} * 7 + id * 37) % 256"
SIDE = 64
_NOISE = "((({x}) * 73 + ({y}) * 179 + id * 11) * (({x}) * 31 + ({y}) * 17 + 7) + ({x}) * ({x}) * ({y})) % 251"


def _array(rule: str, width: int, height: int, ox: str = "0", oy: str = "0") -> str:
    return f"transform(sequence(0, {width * height - 1}), i -> cast({rule.format(x=f'(i % {width} + {ox})', y=f'(i div {width} + {oy})')} as int))"


def frame_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = dealt(view(spark, sf_dir, "supplier").selectExpr("s_suppkey as id"), "id").selectExpr("id as image_id", f"{H} as height", f"{W} as width", f"{_array(_PIXEL, W, H)} as pixels")
    out = frames.frame_features(images, W // 2)
    return _rounded(out.select("image_id", "sharpness", "brightness", "contrast", "saturation", "over_pct", "under_pct", "screen_occupancy", "screen_texture", "screen_brightness", "screen_verdict", "raw_std"))


def frame_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of one texture, moved by a known shift."""
    rows = dealt(view(spark, sf_dir, "supplier").selectExpr("s_suppkey as id"), "id")  # few bytes, much work
    rows = rows.selectExpr("id as image_id", f"{SIDE} as height", f"{SIDE} as width", f"{_array(_NOISE, SIDE, SIDE, '20', '20')} as pixels", f"{_array(_NOISE, SIDE, SIDE, '20 + id % 9 - 4', '20 + id % 7 - 3')} as other")
    return frames.shifts(rows).drop("response").withColumn("ncc", F.round("ncc", 6))


def fitted_homographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 points of each transform, 9 of them wrong: the robust fit finds the others."""
    points = view(spark, sf_dir, "homographies").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(29)))).selectExpr("*", "cast((n * 173) % 500 as double) as x", "cast((n * 311) % 400 as double) as y")
    points = points.selectExpr("id", "x", "y", "(a * x + b * y + tx) / (g * x + k * y + 1) + if(n % 10 < 3, 60 + 7 * n, 0) as u", "(c * x + d * y + ty) / (g * x + k * y + 1) - if(n % 10 < 3, 90 + 5 * n, 0) as v")
    out = frames.fitted_homographies(points)
    return out.select("id", "n", "inliers", (F.col("reprojection") < 0.001).alias("exact"), (F.col("spread") > 0).alias("spread"))


def region_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(frames.region_shapes(view(spark, sf_dir, "mask_runs")))


def green_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected green cells (4 neighbours) of at least 4, largest first."""
    cells = written(survey._mask(spark, sf_dir).select("session_id", "node", "gx", "gy"), "green")
    there = cells.select("session_id", F.col("node").alias("node2"), F.col("gx").alias("gx2"), F.col("gy").alias("gy2"))
    step = cells.withColumn("d", F.explode(F.array(F.struct(F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.lit(0).alias("x"), F.lit(1).alias("y")))))
    step = step.select("session_id", "node", (F.col("gx") + F.col("d.x")).alias("gx2"), (F.col("gy") + F.col("d.y")).alias("gy2")).join(there, ["session_id", "gx2", "gy2"])
    label = spatial.group_components(step, "session_id", "node")
    sizes = cells.join(label, ["session_id", "node"], "left").groupBy("session_id", F.coalesce("component", "node").alias("region")).agg(F.count("*").alias("cells")).where("cells >= 4")
    return sizes.withColumn("place", F.expr("row_number() over (partition by session_id order by cells desc, region)").cast("long"))


def outer_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Green cells with a neighbour (of 4) that is not green, in map coordinates."""
    cells = written(survey._mask(spark, sf_dir), "green")
    around = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    near = cells.withColumn("d", F.explode(around)).select("session_id", "node", (F.col("gx") + F.col("d.x")).alias("gx"), (F.col("gy") + F.col("d.y")).alias("gy")).join(cells.select("session_id", "gx", "gy"), ["session_id", "gx", "gy"])
    inner = near.groupBy("session_id", "node").count().where("count = 4").select("session_id", "node")
    return cells.join(inner, ["session_id", "node"], "left_anti").select("session_id", "node", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


SQL: dict[str, str] = {}
SQL["label_palette"] = "select image_id, label, cast(floor((label * 137.508) - 180 * floor(label * 137.508 / 180)) as bigint) as hue, 200 as saturation, 255 as brightness from (select distinct image_id, label from @mask_runs) l"
SQL["upscaled_labels"] = """
select image_id, label, cast(sum(x1 - x0) as bigint) as area_px, min(x0) as x_min, max(x1) as x_max, min(row_no) as y_min, max(row_no) as y_max
from (select image_id, label, 2 * row_no + k.k as row_no, 2 * x0 as x0, 2 * x1 as x1 from @mask_runs r, (select p_partkey as k from @part where p_partkey < 2) k) u group by image_id, label"""
SQL["mask_axes"] = """
select image_id, label, round(4 * sqrt((vx + vy) / 2 + sqrt((vx - vy) * (vx - vy) / 4 + cv * cv)), 4) as axis_major, round(4 * sqrt(greatest(0, (vx + vy) / 2 - sqrt((vx - vy) * (vx - vy) / 4 + cv * cv))), 4) as axis_minor
from (
  select image_id, label, sxx / n - (sx / n) * (sx / n) + 1 / 12.0 as vx, syy / n - (sy / n) * (sy / n) + 1 / 12.0 as vy, sxy / n - (sx / n) * (sy / n) as cv
  from (
    select r.image_id, r.label, cast(sum(x1 - x0) as double) as n, sum((x1 - x0) * ((x0 + x1 - 1) / 2.0 - cx)) as sx, cast(sum((x1 - x0) * (row_no - cy)) as double) as sy, sum((x1 - x0) * (((x0 + x1 - 1) / 2.0 - cx) * ((x0 + x1 - 1) / 2.0 - cx) + ((x1 - x0) * (x1 - x0) - 1) / 12.0)) as sxx,
      cast(sum((x1 - x0) * (row_no - cy) * (row_no - cy)) as double) as syy, sum((row_no - cy) * (x1 - x0) * ((x0 + x1 - 1) / 2.0 - cx)) as sxy
    from @mask_runs r join (select image_id, label, min(x0) as cx, min(row_no) as cy from @mask_runs group by image_id, label) o on o.image_id = r.image_id and o.label = r.label group by r.image_id, r.label
  ) s
) t"""

# ---- forms that Spark runs in place of the SQL above
SPARK: dict[str, str] = {}
# Sums over the runs as they come, in integers, and moved to the region's corner afterwards: the runs are read once.
SPARK["mask_axes"] = """
select image_id, label, round(4 * sqrt((vx + vy) / 2 + sqrt((vx - vy) * (vx - vy) / 4 + cv * cv)), 4) as axis_major, round(4 * sqrt(greatest(0, (vx + vy) / 2 - sqrt((vx - vy) * (vx - vy) / 4 + cv * cv))), 4) as axis_minor
from (
  select image_id, label, sxx / n - (sx / n) * (sx / n) + 1 / 12.0 as vx, syy / n - (sy / n) * (sy / n) + 1 / 12.0 as vy, sxy / n - (sx / n) * (sy / n) as cv
  from (
    select image_id, label, cast(n as double) as n, (m - 2 * cx * n) / 2.0 as sx, cast(y - cy * n as double) as sy, (mm - 4 * cx * m + 4 * cx * cx * n) / 4.0 + w3 / 12.0 as sxx,
      cast(yy - 2 * cy * y + cy * cy * n as double) as syy, (ym - 2 * cx * y - cy * m + 2 * cx * cy * n) / 2.0 as sxy
    from (
      select image_id, label, min(x0) as cx, min(row_no) as cy, sum(w) as n, sum(w * m) as m, sum(w * m * m) as mm, sum(w * (w * w - 1)) as w3, sum(w * row_no) as y, sum(w * row_no * row_no) as yy, sum(w * row_no * m) as ym
      from (select image_id, label, row_no, x0, x1 - x0 as w, x0 + x1 - 1 as m from @mask_runs) r group by image_id, label
    ) a
  ) s
) t
where image_id is not null"""

QUERIES = {name: query(text) for name, text in (SQL | SPARK).items()} | {f.__name__: f for f in (frame_measures, frame_shifts, fitted_homographies, region_shape, green_regions, outer_contours)}

_REFLECT = lambda v, n: f"case when {v} < 0 then -({v}) when {v} >= {n} then 2 * {n} - 2 - ({v}) else {v} end"
_MASK = "with recursive " + survey._GREEN + ", cells as (select session_id, node, gx, gy, x, y from mask)"
ORACLE_SQL = {name: duck(text) for name, text in SQL.items()} | {
    "frame_measures": duck(f"""
with px as (select s_suppkey as id, x, y, {_PIXEL.format(x='x', y='y')} as v from @supplier, (select unnest(range({W})) as x) a, (select unnest(range({H})) as y) b),
lap as (
  select p.id, p.v, sum(q.v) - 4 * p.v as l from px p, (select unnest([0, 0, 1, -1]) as i, unnest([1, -1, 0, 0]) as j) d
  join px q on q.id = p.id and q.x = {_REFLECT('p.x + d.i', W)} and q.y = {_REFLECT('p.y + d.j', H)} group by p.id, p.x, p.y, p.v
), quality as (select id, var_pop(l) as sharpness, avg(v) as brightness, stddev_pop(v) as contrast, 100.0 * count(*) filter (where v >= 250) / count(*) as over_pct, 100.0 * count(*) filter (where v <= 5) / count(*) as under_pct from lap group by id),
small as (select id, x // 2 as x, y // 2 as y, floor(avg(v) + 0.5) as v from px group by all),
taps as (select unnest([-2, -1, 0, 1, 2]) as k, unnest([1, 4, 6, 4, 1]) as w),
soft as (
  select p.id, p.x, p.y, floor((sum(a.w * b.w * q.v) + 128) / 256) as v from small p, taps a, taps b
  join small q on q.id = p.id and q.x = {_REFLECT('p.x + a.k', W // 2)} and q.y = {_REFLECT('p.y + b.k', H // 2)} group by p.id, p.x, p.y
), hist as (select id, v, count(*) as n from soft group by id, v),
cum as (select id, v, sum(n) over w as n0, sum(n * v) over w as m0, sum(n) over (partition by id) as n1, sum(n * v) over (partition by id) as m1 from hist window w as (partition by id order by v)),
cut as (select id, arg_max(v, struct_pack(b := round(power(m1 * n0 / n1 - m0, 2) / (n0 * (n1 - n0)), 6), v := -v)) as t from cum where n0 < n1 group by id),
screen as (select s.id, avg(cast(s.v < t as int)) as occupancy, stddev_pop(s.v) as texture from soft s join cut on cut.id = s.id group by s.id),
bright as (select id, avg(v) as brightness, stddev_pop(v) as raw_std from small group by id)
select q.id as image_id, round(sharpness, 6) as sharpness, round(q.brightness, 6) as brightness, round(contrast, 6) as contrast, cast(0 as double) as saturation, round(over_pct, 6) as over_pct, round(under_pct, 6) as under_pct, round(occupancy, 6) as screen_occupancy,
  round(texture, 6) as screen_texture, round(b.brightness, 6) as screen_brightness, case when occupancy >= 0.62 then 'CLEARLY_THICK' when occupancy <= 0.25 then 'CLEARLY_THIN' else 'UNCERTAIN' end as screen_verdict, round(raw_std, 6) as raw_std
from quality q join screen s on s.id = q.id join bright b on b.id = q.id"""),
    "frame_shifts": duck("select image_id, dx, dy, dx as search_x, dy as search_y, cast(1 as double) as ncc, dx as match_x, dy as match_y from (select s_suppkey as image_id, s_suppkey % 9 - 4 as dx, s_suppkey % 7 - 3 as dy from @supplier) s"),
    "fitted_homographies": duck("select s_suppkey as id, cast(30 as bigint) as n, cast(21 as bigint) as inliers, true as exact, true as spread from @supplier"),
    "region_shape": duck("""
select image_id, instance_id as label, cast(s * s as bigint) as area_px, 4 * (s - 1) as perimeter, round(4 * pi() * s * s / (16 * (s - 1) * (s - 1)), 6) as circularity, cast(1 as double) as solidity, round(4 * s / sqrt(12), 6) as axis_major, round(4 * s / sqrt(12), 6) as axis_minor,
  cast(0 as double) as eccentricity, cast(1 as double) as elongation from (select image_id, instance_id, ceil(sqrt(area)) as s from @cells) c"""),
    "green_regions": duck(_MASK + """, near as (select a.session_id, a.node as a, b.node as b from cells a join cells b on b.session_id = a.session_id and abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1),
reach as (
  select session_id, node, node as root from cells
  union
  select r.session_id, n.b, r.root from reach r join near n on n.session_id = r.session_id and n.a = r.node where n.b > r.root
), comp as (select session_id, node, min(root) as region from reach group by session_id, node),
sizes as (select session_id, region, count(*) as cells from comp group by session_id, region having count(*) >= 4)
select session_id, region, cells, row_number() over (partition by session_id order by cells desc, region) as place from sizes"""),
    "outer_contours": duck(_MASK + """ select c.session_id, c.node, round(c.x, 4) as x, round(c.y, 4) as y from cells c
where (select count(*) from cells d where d.session_id = c.session_id and abs(c.gx - d.gx) + abs(c.gy - d.gy) = 1) < 4"""),
}
