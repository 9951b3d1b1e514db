"""Survey map queries: previews, duplicate skips, hysteresis, closing, poses against mapped cells, matched centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytomesh.operators import images
from cytomesh.operators import spatial as ops
from cytomesh.plans import live
from cytomesh.plans.spatial import _COVERAGE, _GRID, _grid, _rounded, coverage
from cytomesh.plans.sql import VIEWS, duck, view
from cytomesh.session import written

STAGES = 5
NEAR, SCALE = 220.0, 0.25
ANCHOR = (3000.0, 2000.0)


# ---- coverage of candidates
def duplicate_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic fields that would be skipped: already scanned, and the best earlier field was surely placed."""
    fields = view(spark, sf_dir, "fields")
    out = coverage(fields, fields, "reg_confidence").withColumnRenamed("best_carry", "best_conf")
    return out.select("session_id", "job_id", "state", ((F.col("state") == "ALREADY_SCANNED") & (F.coalesce("best_conf", F.lit(1.0)) >= 0.5)).alias("skipped"), F.col("state").isin("GAP_RISK", "TOO_MUCH_OVERLAP", "ALREADY_SCANNED").alias("against_guidance"))


def live_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the operator sees before each capture: its place by the last good field, what is covered there, and the hint."""
    key = ["session_id", "job_id"]
    chain = written(live.pose_chain(spark, sf_dir).join(view(spark, sf_dir, "captures").select(*key, "tx", "ty", "w", "h", "texture"), key), "chain")
    good = F.when(F.col("state") == live.folds.GOOD, F.struct("job_id", "gx", "gy", "tx", "ty"))
    before = Window.partitionBy("session_id").orderBy("job_id").rowsBetween(Window.unboundedPreceding, -1)
    at = chain.withColumn("ref", F.last(good, ignorenulls=True).over(before))
    at = at.withColumns({"dx": F.expr("tx - ref.tx + (ref.job_id * 5 + job_id * 3) % 7 - 3"), "dy": F.expr("ty - ref.ty + (ref.job_id * 3 + job_id * 5) % 7 - 3")})
    sure = F.col("ref").isNotNull() & (F.col("texture") >= 3)
    seen = coverage(at.where(sure).select(*key, (F.col("ref.gx") + F.col("dx")).alias("x"), (F.col("ref.gy") + F.col("dy")).alias("y"), "w", "h"), chain.select(*key, F.col("gx").alias("x"), F.col("gy").alias("y"), "w", "h"))
    out = at.select(*key, "ref", "texture").join(seen, key, "left")
    state = F.when(F.col("ref").isNull(), "FIRST_FIELD").when(F.col("texture") < 3, "REGISTRATION UNCERTAIN").otherwise(F.col("state"))
    hint = F.when(F.col("overlap_prev") > 0.30, "MOVE FARTHER").when(F.col("overlap_prev") < 0.20, "MOVE BACK").when(F.col("overlap_prev").isNotNull(), "HOLD")
    return out.select(*key, state.alias("state"), "overlap_prev", F.round(1 - F.col("overlap_total"), 4).alias("new_coverage"), hint.alias("hint"), state.isin("GAP_RISK", "TOO_MUCH_OVERLAP", "ALREADY_SCANNED", "REGISTRATION UNCERTAIN").alias("warned"))


# ---- the semantic grid over versions of the map
def _green(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, gx, gy, gw, gh and green of every observed cell after the last of STAGES versions.

    The grid is that of the whole map. A cell's evidence only changes with the fields that touch it, so the state
    is that of the last version at which it entered or left; between the thresholds it stays.
    """
    weight = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("reg_confidence")))
    mono = F.col("raw_class") == "MONOLAYER"
    cells = _grid(spark, sf_dir).withColumn("wt", weight).withColumn("stage", F.least(F.lit(STAGES), F.ceil(F.col("job_id") * STAGES / F.col("last_job"))).cast("int"))
    add = cells.groupBy("session_id", "gw", "gh", "gx", "gy", "stage").agg(F.sum(F.when(mono, F.col("wt") * F.col("score")).otherwise(0.0)).alias("s"), F.sum("wt").alias("w"), F.sum(F.when(mono, F.col("wt")).otherwise(0.0)).alias("m"), F.sum(F.when(mono, 0.0).otherwise(F.col("wt"))).alias("n"))
    so_far = Window.partitionBy("session_id", "gx", "gy").orderBy("stage").rowsBetween(Window.unboundedPreceding, 0)
    now = add.withColumns({c: F.sum(c).over(so_far) for c in "swmn"}).withColumn("conf", F.round(F.col("s") / F.col("w"), 6))
    event = F.when(F.col("conf") < 0.45, False).when((F.col("conf") >= 0.75) | ((F.col("conf") >= 0.65) & (F.round("m", 6) >= 2)), True)
    return now.withColumn("event", event).groupBy("session_id", "gw", "gh", "gx", "gy").agg(F.coalesce(F.expr("max_by(event, stage) filter (where event is not null)"), F.lit(False)).alias("green"))


def semantic_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _green(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("observed"), F.sum(F.col("green").cast("long")).alias("green"))


def closed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Green cells before and after a binary closing by 3 x 3 (outside of the grid is empty)."""
    green = written(_green(spark, sf_dir).where("green").select("session_id", "gw", "gh", "gx", "gy"), "green")
    shift = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    moved = lambda df: df.withColumn("d", F.explode(F.array(*shift))).select("session_id", "gw", "gh", (F.col("gx") + F.col("d.i")).alias("gx"), (F.col("gy") + F.col("d.j")).alias("gy"))
    wide = moved(green).where("gx >= 0 and gy >= 0 and gx < gw and gy < gh").distinct()
    closed = moved(wide).groupBy("session_id", "gx", "gy").count().where("count = 9").groupBy("session_id").agg(F.count("*").alias("closed"))
    return green.groupBy("session_id").agg(F.count("*").alias("green")).join(closed, "session_id", "left").fillna(0)


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of the green cells in map coordinates, numbered row by row."""
    box = view(spark, sf_dir, "grid_geometry").select("session_id", "gx0", "gy0", "cell")
    green = _green(spark, sf_dir).where("green").join(box, "session_id")
    return green.select("session_id", (F.col("gy") * F.col("gw") + F.col("gx")).cast("long").alias("node"), "gx", "gy", "cell", (F.col("gx0") + (F.col("gx") + 0.5) * F.col("cell")).alias("x"), (F.col("gy0") + (F.col("gy") + 0.5) * F.col("cell")).alias("y"))


def _contained(poses: DataFrame, mask: DataFrame) -> DataFrame:
    """session_id, job_id, node and distance of the nearest green cell of each pose, and the containment state."""
    near = ops.nearest_target(poses, mask, "session_id", "job_id", "node", 4)
    inside = near.join(poses, ["session_id", "job_id"]).join(mask.select("session_id", "node", F.col("x").alias("mx"), F.col("y").alias("my"), "cell"), ["session_id", "node"])
    within = F.greatest(F.abs(F.col("x") - F.col("mx")), F.abs(F.col("y") - F.col("my"))) < F.col("cell") / 2
    return inside.select("session_id", "job_id", "node", F.when(within, 0.0).otherwise(F.col("d")).alias("distance"), F.when(within, "INSIDE").when(F.col("d") <= NEAR, "NEAR_EDGE").otherwise("OUTSIDE").alias("state"))


def pose_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field's centre against the cells of the mapped layer."""
    mask = written(_mask(spark, sf_dir), "mask")
    return _contained(view(spark, sf_dir, "fields").select("session_id", "job_id", "x", "y"), mask)


def exploration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses at higher magnification: from the chain's first good pose since the last anchor, scaled into the survey."""
    key = ["session_id", "job_id"]
    rows = view(spark, sf_dir, "exploration_rows")
    order = Window.partitionBy("session_id").orderBy("job_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("chain", F.sum(F.col("anchors").cast("int")).over(order))
    first = Window.partitionBy("session_id", "chain").orderBy("job_id").rowsBetween(Window.unboundedPreceding, 0)
    origin = F.first(F.when(F.col("ok"), F.struct("tx", "ty")), ignorenulls=True).over(first)
    rows = rows.withColumn("origin", origin)
    placed = rows.where("chain > 0 and ok").select(*key, (ANCHOR[0] + (F.col("tx") - F.col("origin.tx")) * SCALE).alias("x"), (ANCHOR[1] + (F.col("ty") - F.col("origin.ty")) * SCALE).alias("y"))
    placed = written(placed, "placed")
    found = _contained(placed, written(_mask(spark, sf_dir), "mask")).drop("node")
    out = rows.select(*key, "chain").join(placed, key, "left").join(found, key, "left")
    state = F.when(F.col("x").isNull(), "UNKNOWN").otherwise(F.coalesce("state", F.lit("OUTSIDE")))
    return out.select(*key, F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "distance", state.alias("state"))


VIEWS["exploration_rows"] = "select session_id, job_id, tx, ty, job_id % 140 = 11 as anchors, (job_id * 29) % 100 >= 15 as ok from @captures"


def grid_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 6 green cells nearest to the 9 targets of a 3 x 3 grid over the green box, at least 3 cells apart."""
    mask = written(_mask(spark, sf_dir).select("session_id", "node", F.col("gy").alias("r"), F.col("gx").alias("c")), "mask")
    box = mask.groupBy("session_id").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.avg("r").alias("mr"), F.avg("c").alias("mc"))
    far = lambda a, b: F.round(F.sqrt((F.col("r") - a) ** 2 + (F.col("c") - b) ** 2), 9)
    best = mask.join(F.broadcast(box), "session_id").groupBy("session_id").agg(F.min(F.struct(far(F.col("mr"), F.col("mc")), "r", "c")).alias("b"))  # box: one row a session
    spine = box.join(best, "session_id").withColumn("i", F.explode(F.array(*map(F.lit, range(3))))).withColumn("j", F.explode(F.array(*map(F.lit, range(3)))))
    spine = spine.withColumns({"tr": F.expr("r0 + (i + 0.5D) * greatest(1D, (r1 - r0 + 1) / 3D)"), "tc": F.expr("c0 + (j + 0.5D) * greatest(1D, (c1 - c0 + 1) / 3D)")})
    spine = spine.withColumn("way", F.round(F.sqrt((F.col("tr") - F.col("b.r")) ** 2 + (F.col("tc") - F.col("b.c")) ** 2), 9)).select("session_id", "i", "j", "tr", "tc", "way")
    near = mask.join(F.broadcast(spine), "session_id").groupBy("session_id", "i", "j", "way").agg(F.min(F.struct(far(F.col("tr"), F.col("tc")), "r", "c")).alias("b"))  # 9 rows a session
    rows = near.select("session_id", (F.col("i") * 3 + F.col("j")).cast("long").alias("target"), "way", F.col("b.c").cast("double").alias("x"), F.col("b.r").cast("double").alias("y"))
    return ops.greedy_separated(rows, "session_id", ["way", "target"], 3.0, 6).select("session_id", "target", "x", "y")


# ---- masks and matched centroids
def layer_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the grid cells under MONOLAYER fields and under surely placed fields: both, either, and their ratio."""
    cells = _grid(spark, sf_dir).groupBy("session_id", "gx", "gy").agg(F.max((F.col("raw_class") == "MONOLAYER").cast("int")).alias("a"), F.max((F.col("reg_state") == "REGISTRATION_GOOD").cast("int")).alias("b"))
    out = cells.groupBy("session_id").agg(F.sum(F.least("a", "b")).cast("long").alias("both"), F.sum(F.greatest("a", "b")).cast("long").alias("either"))
    return out.withColumn("iou", F.round(F.col("both") / F.greatest("either", F.lit(1)), 9))


def centroid_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each even image, brought into the frame of the image before it, matched to its nearest cells."""
    points = view(spark, sf_dir, "points").where("image_id % 2 in (0, 1)")
    cells = points.selectExpr("if(image_id % 2 = 1, image_id, image_id - 1) as pair", "if(image_id % 2 = 1, x, 480 + x / 2) as x", "if(image_id % 2 = 1, y, 270 + y / 2) as y", "if(image_id % 2 = 1, r, null) as r")
    return _rounded(images.by_image(cells, images.matches, images.MATCHES, "pair"))


QUERIES = {f.__name__: f for f in (duplicate_skip, live_preview, semantic_hysteresis, closed_cells, pose_containment, exploration, grid_revisit, layer_iou, centroid_matches)}

_GREEN = f"""
{_GRID}, versions as (select unnest(range(1, {STAGES + 1})) as v), staged as (
  select g.*, greatest(0.1, least(1, reg_confidence)) as wt, least({STAGES}, cast(ceil(job_id * {STAGES} / max(job_id) over (partition by session_id)) as int)) as stage from grid g
), maps as (
  select session_id, gw, gh, gx, gy, v, round(sum(case when raw_class = 'MONOLAYER' then wt * score else 0 end) / sum(wt), 6) as conf, round(sum(case when raw_class = 'MONOLAYER' then wt else 0 end), 6) as mono
  from staged join versions on stage <= v group by all
), events as (select *, case when conf < 0.45 then 0 when conf >= 0.75 or (conf >= 0.65 and mono >= 2) then 1 end as e from maps),
observed as (select session_id, gw, gh, gx, gy, coalesce(arg_max(e, v) filter (where e is not null), 0) = 1 as green from events group by all),
mask as (
  select o.session_id, cast(gy * gw + gx as bigint) as node, gx, gy, cell, gx0 + (gx + 0.5) * cell as x, gy0 + (gy + 0.5) * cell as y from observed o join @grid_geometry g on g.session_id = o.session_id where green
)"""
_INSIDE = """
met as (
  select p.session_id, p.job_id, m.node, m.cell, greatest(abs(p.x - m.x), abs(p.y - m.y)) as off, round(sqrt(power(p.x - m.x, 2) + power(p.y - m.y, 2)), 4) as d,
    row_number() over (partition by p.session_id, p.job_id order by round(sqrt(power(p.x - m.x, 2) + power(p.y - m.y, 2)), 4), m.node) as k
  from poses p join mask m on m.session_id = p.session_id
), contained as (select session_id, job_id, node, case when off < cell / 2 then 0 else d end as distance, case when off < cell / 2 then 'INSIDE' when d <= 220 then 'NEAR_EDGE' else 'OUTSIDE' end as state from met where k = 1)"""
_CHAINED = live._CHAIN + """, good as (
  select c.session_id, c.job_id, c.tx, c.ty, c.w, c.h, c.texture, w.gx, w.gy, max(case when w.state = 'REGISTRATION_GOOD' then c.job_id end) over (partition by c.session_id order by c.job_id rows between unbounded preceding and 1 preceding) as ref
  from @captures c join (select session_id, job_id, state, round(gx, 3) as gx, round(gy, 3) as gy from walk) w on w.session_id = c.session_id and w.job_id = c.job_id
), placed as (
  select g.session_id, g.job_id, r.gx + (g.tx - r.tx + (r.job_id * 5 + g.job_id * 3) % 7 - 3) as x, r.gy + (g.ty - r.ty + (r.job_id * 3 + g.job_id * 5) % 7 - 3) as y, g.w, g.h from good g join good r on r.session_id = g.session_id and r.job_id = g.ref where g.texture >= 3
), there as (select session_id, job_id, gx as x, gy as y, w, h from good), """
ORACLE_SQL = {
    "duplicate_skip": duck("with " + _COVERAGE.format(new="@fields", old="@fields") + """
select c.session_id, c.job_id, c.state, c.state = 'ALREADY_SCANNED' and coalesce(f.reg_confidence, 1) >= 0.5 as skipped, c.state in ('GAP_RISK', 'TOO_MUCH_OVERLAP', 'ALREADY_SCANNED') as against_guidance
from coverage c left join @fields f on f.session_id = c.session_id and f.job_id = c.best_job_id"""),
    "live_preview": duck(_CHAINED + _COVERAGE.format(new="placed", old="there") + """
select session_id, job_id, state, overlap_prev, round(1 - overlap_total, 4) as new_coverage, case when overlap_prev > 0.30 then 'MOVE FARTHER' when overlap_prev < 0.20 then 'MOVE BACK' when overlap_prev is not null then 'HOLD' end as hint,
  state in ('GAP_RISK', 'TOO_MUCH_OVERLAP', 'ALREADY_SCANNED', 'REGISTRATION UNCERTAIN') as warned
from (select g.session_id, g.job_id, case when g.ref is null then 'FIRST_FIELD' when g.texture < 3 then 'REGISTRATION UNCERTAIN' else c.state end as state, overlap_prev, overlap_total from good g left join coverage c on c.session_id = g.session_id and c.job_id = g.job_id) s"""),
    "semantic_hysteresis": duck("with " + _GREEN + " select session_id, count(*) as observed, count(*) filter (where green) as green from observed group by session_id"),
    "closed_cells": duck("with " + _GREEN + """, around as (select a.i, b.i as j from (select unnest([-1, 0, 1]) as i) a, (select unnest([-1, 0, 1]) as i) b),
wide as (select distinct session_id, gw, gh, gx + i as gx, gy + j as gy from observed, around where green and gx + i between 0 and gw - 1 and gy + j between 0 and gh - 1),
closed as (select w.session_id, w.gx, w.gy from wide w, around a join wide v on v.session_id = w.session_id and v.gx = w.gx + a.i and v.gy = w.gy + a.j group by all having count(*) = 9)
select o.session_id, count(*) as green, coalesce(max(c.n), 0) as closed from observed o left join (select session_id, count(*) as n from closed group by session_id) c on c.session_id = o.session_id where green group by o.session_id"""),
    "pose_containment": duck("with " + _GREEN + ", poses as (select session_id, job_id, x, y from @fields), " + _INSIDE + " select * from contained"),
    "exploration": duck("with " + _GREEN + f""", rows_ as (select *, sum(cast(anchors as int)) over (partition by session_id order by job_id) as chain from @exploration_rows),
origin as (select session_id, chain, arg_min(tx, job_id) as ox, arg_min(ty, job_id) as oy from rows_ where ok group by all),
poses as (select r.session_id, r.job_id, {ANCHOR[0]} + (tx - ox) * {SCALE} as x, {ANCHOR[1]} + (ty - oy) * {SCALE} as y from rows_ r join origin o on o.session_id = r.session_id and o.chain = r.chain where r.chain > 0 and ok), {_INSIDE}
select r.session_id, r.job_id, round(p.x, 6) as x, round(p.y, 6) as y, c.distance, case when p.x is null then 'UNKNOWN' else coalesce(c.state, 'OUTSIDE') end as state
from rows_ r left join poses p on p.session_id = r.session_id and p.job_id = r.job_id left join contained c on c.session_id = r.session_id and c.job_id = r.job_id"""),
    "grid_revisit": duck("with recursive " + _GREEN + """, box as (select session_id, min(gy) as r0, max(gy) as r1, min(gx) as c0, max(gx) as c1, avg(gy) as mr, avg(gx) as mc from mask group by session_id),
best as (select m.session_id, arg_min(struct_pack(r := gy, c := gx), struct_pack(d := round(sqrt(power(gy - mr, 2) + power(gx - mc, 2)), 9), r := gy, c := gx)) as b from mask m join box on box.session_id = m.session_id group by m.session_id),
spine as (select box.session_id, i, j, r0 + (i + 0.5) * greatest(1, (r1 - r0 + 1) / 3) as tr, c0 + (j + 0.5) * greatest(1, (c1 - c0 + 1) / 3) as tc, b from box join best on best.session_id = box.session_id, (select unnest(range(3)) as i) a, (select unnest(range(3)) as j) d),
near as (select s.session_id, i * 3 + j as target, round(sqrt(power(tr - b.r, 2) + power(tc - b.c, 2)), 9) as way, arg_min(struct_pack(r := gy, c := gx), struct_pack(d := round(sqrt(power(gy - tr, 2) + power(gx - tc, 2)), 9), r := gy, c := gx)) as p
  from spine s join mask m on m.session_id = s.session_id group by s.session_id, i, j, tr, tc, b),
m as (select *, row_number() over (partition by session_id order by way, target) as k from near),
walk as (
  select session_id, k, target, p, [p] as taken, true as took from m where k = 1
  union all
  select m.session_id, m.k, m.target, m.p, case when len(w.taken) < 6 and len(list_filter(w.taken, lambda t: power(t.r - m.p.r, 2) + power(t.c - m.p.c, 2) < 9)) = 0 then list_append(w.taken, m.p) else w.taken end,
    len(w.taken) < 6 and len(list_filter(w.taken, lambda t: power(t.r - m.p.r, 2) + power(t.c - m.p.c, 2) < 9)) = 0
  from walk w join m on m.session_id = w.session_id and m.k = w.k + 1)
select session_id, cast(target as bigint) as target, cast(p.c as double) as x, cast(p.r as double) as y from walk where took"""),
    "layer_iou": duck("with " + _GRID + """, a as (select distinct session_id, gx, gy from grid where raw_class = 'MONOLAYER'), b as (select distinct session_id, gx, gy from grid where reg_state = 'REGISTRATION_GOOD')
select coalesce(a.session_id, b.session_id) as session_id, count(*) filter (where a.gx is not null and b.gx is not null) as both, count(*) as either, round(count(*) filter (where a.gx is not null and b.gx is not null) / count(*), 9) as iou
from a full join b on a.session_id = b.session_id and a.gx = b.gx and a.gy = b.gy group by 1"""),
    "centroid_matches": duck("""
with p as (select image_id as pair, instance_id, x, y, r from @points where image_id % 2 = 1), c as (select image_id - 1 as pair, instance_id, 480 + x / 2 as x, 270 + y / 2 as y from @points where image_id % 2 = 0),
d as (select c.pair, c.instance_id, round(min(sqrt(power(c.x - p.x, 2) + power(c.y - p.y, 2))), 6) as d from c join p on p.pair = c.pair group by c.pair, c.instance_id),
t as (select pair, count(*) as n_parent, greatest(0.75 * MEDIAN(r), 2) as threshold from p group by pair)
select d.pair, max(n_parent) as n_parent, count(*) as n_child, count(*) filter (where d <= threshold) as n_matched, round(100.0 * count(*) filter (where d <= threshold) / count(*), 6) as match_pct, round(quantile_cont(d, 0.5) filter (where d <= threshold), 6) as median_error
from d join t on t.pair = d.pair group by d.pair"""),
}
