"""Spatial and field queries, with oracles that compare all pairs of an image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytomesh.operators import field, sessions, spatial
from cytomesh.plans import relational  # noqa: F401  (fills VIEWS)
from cytomesh.plans.sql import VIEWS, duck, view
from cytomesh.session import bound_batches

#: For the queries on fields: counts of this data's images, about 300 in the valid region.
CONFIG = field.FieldConfig(count_min=560, count_max=620, density=(180.0, 320.0, 100.0), coverage=(0.15, 0.25, 0.1), thin_coverage=0.12, thin_spacing=1.2)
_PAIR = "p.image_id = q.image_id and p.instance_id <> q.instance_id"
_D = "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def nn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(field.neighbour_features(view(spark, sf_dir, "points")))


def contact_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(field.contact_ratio(view(spark, sf_dir, "points")))


def degree_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(field.degrees(view(spark, sf_dir, "points")))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(field.clusters(view(spark, sf_dir, "points")))


def image_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(field.image_features(view(spark, sf_dir, "flagged")))


_CLASSED = ("image_id", "n_candidates", "n_valid", "density", "coverage", "density_cv", "largest_fraction", "mean_degree", "score", "thick_signals", "thin_signals", "class")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field.score(field.field_features(view(spark, sf_dir, "flagged"), CONFIG), CONFIG)


def classify_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(field.classify(_scored(spark, sf_dir), CONFIG).select(*_CLASSED), 5)


def classify_dark_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the screen's occupancy: a mostly dark frame is thick whatever else holds."""
    return _rounded(field.classify(_scored(spark, sf_dir), CONFIG, F.expr("(image_id * 31) % 100 / 100D")).select(*_CLASSED), 5)


def union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects = view(spark, sf_dir, "fields").where("raw_class = 'MONOLAYER'").selectExpr("session_id", "x - w / 2 as x0", "y - h / 2 as y0", "x + w / 2 as x1", "y + h / 2 as y1")
    bands = spatial.union_bands(rects, "session_id")
    return bands.groupBy("session_id").agg(F.round(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))), 0).alias("union_area"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects = view(spark, sf_dir, "fields").withColumn("last_job", F.max("job_id").over(Window.partitionBy("session_id"))).join(view(spark, sf_dir, "grid_geometry"), "session_id")
    box = {"c0": "floor((x - w / 2 - gx0) / cell)", "c1": "ceil((x + w / 2 - gx0) / cell)", "r0": "floor((y - h / 2 - gy0) / cell)", "r1": "ceil((y + h / 2 - gy0) / cell)"}
    rects = rects.withColumns({k: F.expr(f"cast({v} as int)") for k, v in box.items()}).withColumns({"gw": F.expr("cast(ceil((gx1 - gx0) / cell) as int)"), "gh": F.expr("cast(ceil((gy1 - gy0) / cell) as int)")})
    return spatial.raster_cells(rects)


def coverage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.when(F.col("reg_state") == "REGISTRATION_GOOD", 1.0).when(F.col("reg_state") == "REGISTRATION_WEAK", F.col("reg_confidence")).otherwise(0.0)
    cells = _grid(spark, sf_dir).withColumn("conf", conf).where("conf > 0").groupBy("session_id", "gw", "gh", "gx", "gy").agg(F.max("conf").alias("best"))
    inner = (F.col("gx") >= 1) & (F.col("gx") < F.col("gw") - 1) & (F.col("gy") >= 1) & (F.col("gy") < F.col("gh") - 1)
    out = cells.groupBy("session_id", "gw", "gh").agg(F.count("*").alias("covered"), F.sum((F.col("best") >= 0.5).cast("long")).alias("scanned"), F.sum(inner.cast("long")).alias("inner_covered"))
    return out.select("session_id", "covered", "scanned", F.round(F.col("inner_covered") / ((F.col("gw") - 2) * (F.col("gh") - 2)), 9).alias("inner_pct"), F.round(F.col("covered") / (F.col("gw") * F.col("gh")), 9).alias("padded_pct"))


def semantic_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused evidence of each grid cell; green is the cell state of a first pass."""
    weight = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("reg_confidence")))
    mono = F.col("raw_class") == "MONOLAYER"
    cells = _grid(spark, sf_dir).withColumn("wt", weight).groupBy("session_id", "gx", "gy").agg(
        F.sum(F.when(mono, F.col("wt") * F.col("score")).otherwise(0.0)).alias("s"), F.sum("wt").alias("wsum"), F.sum(F.when(mono, F.col("wt")).otherwise(0.0)).alias("mono"),
        F.sum(F.when(mono, 0.0).otherwise(F.col("wt"))).alias("non"), F.count("*").alias("votes"))
    cells = cells.withColumn("conf", F.round(F.col("s") / F.col("wsum"), 6))
    green = (F.col("conf") >= 0.75) | ((F.col("conf") >= 0.65) & (F.col("mono") >= 2))
    conflict = (F.col("conf") < 0.65) & (F.col("mono") > 0) & (F.col("non") > 0)
    return cells.groupBy("session_id").agg(F.count("*").alias("observed"), F.sum("votes").alias("votes"), F.sum(green.cast("long")).alias("green"), F.sum(conflict.cast("long")).alias("conflicts"))


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interior components (4 neighbours) of at least 2 uncovered grid cells."""
    grid = _grid(spark, sf_dir)
    sizes = view(spark, sf_dir, "grid_geometry").selectExpr("session_id", "cast(ceil((gx1 - gx0) / cell) as int) as gw", "cast(ceil((gy1 - gy0) / cell) as int) as gh")
    spine = sizes.withColumn("gx", F.explode(F.sequence(F.lit(1), F.col("gw") - 2))).withColumn("gy", F.explode(F.sequence(F.lit(1), F.col("gh") - 2)))
    covered = grid.where("reg_state <> 'REGISTRATION_FAILED'").select("session_id", "gx", "gy").distinct()
    empty = spine.join(covered, ["session_id", "gx", "gy"], "left_anti").withColumn("node", (F.col("gy") * F.col("gw") + F.col("gx")).cast("long"))
    step = empty.select("session_id", F.col("node"), F.explode(F.array(F.col("node") + 1, F.col("node") + F.col("gw"))).alias("node2"), "gx", "gw")
    step = step.where("not (node2 = node + 1 and gx = gw - 2)").join(empty.select("session_id", F.col("node").alias("node2")), ["session_id", "node2"])
    label = spatial.group_components(step, "session_id", "node")
    cells = empty.join(label, ["session_id", "node"])
    out = cells.groupBy("session_id", "component").agg(F.count("*").alias("area_cells"), F.min("gx").cast("long").alias("x"), F.min("gy").cast("long").alias("y"), (F.max("gx") - F.min("gx") + 1).cast("long").alias("w"), (F.max("gy") - F.min("gy") + 1).cast("long").alias("h"))
    return out.where("area_cells >= 2").drop("component")


def coverage_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field against the fields before it: best overlap, exact union overlap, state."""
    fields = view(spark, sf_dir, "fields")
    return coverage(fields, fields)


def coverage(candidates: DataFrame, existing: DataFrame, carry: str | None = None) -> DataFrame:
    """Each candidate rectangle (session_id, job_id, centre x, y, w, h) against the existing ones of smaller job_id.

    carry: a column of doubles of the existing ones, returned as best_carry for the best of them.
    """
    columns = ["session_id", "job_id", "x", "y", "w", "h", *[carry] * (carry is not None)]
    rows = candidates.select(*columns, F.lit(True).alias("new"), F.lit(candidates is existing).alias("old"))
    if candidates is not existing:
        rows = rows.unionByName(existing.select(*columns, F.lit(False).alias("new"), F.lit(True).alias("old")))
    met = sessions.by_session(rows.withColumnRenamed(carry, "carry") if carry else rows, sessions.coverage, sessions.COVERAGE + ", best_carry double" * (carry is not None))
    area = 800.0 * 448.0
    out = met.select("session_id", "job_id", F.round(F.col("a") / area, 6).alias("overlap_prev"), F.round(F.col("u") / area, 4).alias("overlap_total"), F.when(F.col("a") > 0, F.col("o")).alias("best_job_id"), F.round("gap", 3).alias("gap"), *["best_carry"] * (carry is not None))
    state = F.when(F.col("gap").isNull(), "FIRST_FIELD").when(F.col("overlap_total") >= 0.9, "ALREADY_SCANNED").when((F.col("overlap_prev") > 0.3) | (F.col("overlap_total") > 0.3), "TOO_MUCH_OVERLAP").when(F.col("overlap_prev") < 0.2, "GAP_RISK").otherwise("CAPTURE_READY")
    return out.withColumn("state", state)


def lowe_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors (ids divisible by 20) matched to the nearest other vector if clearly nearer than the second.

    Every query meets every vector, block by block; a pair of blocks leaves two neighbours a query.
    """
    bound_batches(spark)
    vectors = view(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return _rounded(spatial.two_nearest(vectors.where("id % 20 = 0"), vectors), 5)


def revisit_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 6 best MONOLAYER fields of a session, at least 1200 apart."""
    rows = view(spark, sf_dir, "fields").where("raw_class = 'MONOLAYER'").select("session_id", "job_id", "x", "y", "score")
    return spatial.greedy_separated(rows, "session_id", ["-score", "job_id"], 1200.0, 6).select("session_id", "job_id", "score")


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each thick field against the nearest MONOLAYER centre: INSIDE, NEAR or OUTSIDE."""
    fields = view(spark, sf_dir, "fields")
    green = fields.where("raw_class = 'MONOLAYER'").select("session_id", F.col("job_id").alias("green"), "x", "y")
    near = spatial.nearest_target(fields.where("raw_class = 'TOO_THICK'"), green, "session_id", "job_id", "green", 6)
    return near.select("session_id", "job_id", "green", F.col("d").alias("distance"), F.when(F.col("d") <= 100, "INSIDE").when(F.col("d") <= 220, "NEAR").otherwise("OUTSIDE").alias("state"))


QUERIES = {f.__name__: f for f in (nn_features, contact_ratio, degree_distribution, clusters, image_features, classify_field, classify_dark_field, union_area, coverage_grid, semantic_grid, holes, coverage_eval, lowe_matches, revisit_points, containment)}

VIEWS |= {
    "nn": f"""
select image_id, instance_id, d, d - r - r2 as gap, median_diameter from (
  select p.image_id, p.instance_id, p.r, q.r as r2, p.median_diameter, {_D} as d, row_number() over (partition by p.image_id, p.instance_id order by {_D}, q.instance_id) as k
  from @points p join @points q on {_PAIR}
) t where k = 1""",
    "contact": f"""
select n.image_id, n.n, coalesce(k, 0) as n_contact, coalesce(k, 0) / n.n as contact_ratio from (select image_id, count(*) as n from @points group by image_id) n
left join (select p.image_id, count(distinct p.instance_id) as k from @points p join @points q on {_PAIR} and {_D} <= p.r + q.r + 0.15 * p.median_diameter group by p.image_id) c on c.image_id = n.image_id""",
    "near": f"select p.image_id, p.instance_id as a, q.instance_id as b from @points p join @points q on {_PAIR} and {_D} <= 1.5 * p.median_diameter",
}
VIEWS |= {"roi_points": "select image_id, instance_id, x, y, r, area, median_diameter from @flagged where candidate and x >= 192 and x < 1728 and y >= 108 and y < 972"}
VIEWS |= {f"roi_{name}": VIEWS[name].replace("@points", "@roi_points") for name in ("nn", "contact", "near")}


def _tri_sql(x: str, lo: float, hi: float, wing: float) -> str:
    return f"case when {x} is null then 0 when {x} >= {lo} and {x} <= {hi} then 1 when {x} < {lo} then greatest(0, 1 - ({lo} - {x}) / {wing}) else greatest(0, 1 - ({x} - {hi}) / {wing}) end"


def _free_sql(x: str) -> str:
    return f"case when {x} is null then 0 else 1 - least(1, greatest(0, {x})) end"


_R = lambda e, n, k=6: f"round({e}, {k}) as {n}"
_ROI = "x >= 192 and x < 1728 and y >= 108 and y < 972"
_CLUSTERS = """
with recursive reach as (
  select image_id, instance_id as node, instance_id as root from {points}
  union
  select r.image_id, n.b, r.root from reach r join {near} n on n.image_id = r.image_id and n.a = r.node where n.b > r.root
), comp as (select image_id, node, min(root) as root from reach group by image_id, node),
sizes as (select image_id, root, count(*) as size from comp group by image_id, root)"""
_GRID = """
grid as (
  select s.*, u.gy from (
    select f.*, g.cell, g.gy0, cast(ceil((gx1 - gx0) / cell) as int) as gw, cast(ceil((gy1 - gy0) / cell) as int) as gh,
      unnest(range(cast(floor((x - w / 2 - gx0) / cell) as int), cast(ceil((x + w / 2 - gx0) / cell) as int))) as gx
    from @fields f join @grid_geometry g on f.session_id = g.session_id
  ) s, unnest(range(cast(floor((y - h / 2 - gy0) / cell) as int), cast(ceil((y + h / 2 - gy0) / cell) as int))) as u(gy)
)"""
_SIZES = """
select image_id, count(*) as n_clusters, max(size) as largest, round(coalesce(quantile_cont(size, 0.5) filter (where size >= 2), 0), 6) as median_cluster,
  round(100.0 * count(*) filter (where size = 1) / count(*), 6) as isolated_pct, round(max(size)::double / sum(size), 6) as largest_fraction,
  round(coalesce(100.0 * sum(size) filter (where size >= 2) / sum(size), 0), 6) as clustered_pct, round(coalesce(100.0 * sum(size) filter (where size >= 30) / sum(size), 0), 6) as large_pct
from sizes group by image_id"""

#: Every pair of a session; the views that follow can use "coverage".
_COVERAGE = """f as (select session_id, job_id, x - w / 2 as x0, y - h / 2 as y0, x + w / 2 as x1, y + h / 2 as y1 from {new}),
e as (select session_id, job_id, x - w / 2 as x0, y - h / 2 as y0, x + w / 2 as x1, y + h / 2 as y1 from {old}),
b as (select a.session_id, a.job_id, c.job_id as other, a.x0 as cx0, a.y0 as cy0, a.x1 as cx1, a.y1 as cy1, c.x0, c.y0, c.x1, c.y1,
  greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) as inter,
  sqrt(power(greatest(c.x0 - a.x1, a.x0 - c.x1, 0), 2) + power(greatest(c.y0 - a.y1, a.y0 - c.y1, 0), 2)) as gap from f a join e c on a.session_id = c.session_id and c.job_id < a.job_id),
t as (select session_id, job_id, max(inter) as best, min(gap) as gap, arg_min(other, struct_pack(a := -inter, o := other)) as best_id from b group by all),
i as (select session_id, job_id, greatest(cx0, x0) as x0, greatest(cy0, y0) as y0, least(cx1, x1) as x1, least(cy1, y1) as y1 from b where inter > 0),
xs as (select session_id, job_id, v, lead(v) over (partition by session_id, job_id order by v) as nx from (select session_id, job_id, x0 as v from i union select session_id, job_id, x1 from i) q),
ys as (select session_id, job_id, v, lead(v) over (partition by session_id, job_id order by v) as nx from (select session_id, job_id, y0 as v from i union select session_id, job_id, y1 from i) q),
u as (select xs.session_id, xs.job_id, sum((xs.nx - xs.v) * (ys.nx - ys.v)) as u from xs join ys on xs.session_id = ys.session_id and xs.job_id = ys.job_id
  where xs.nx is not null and ys.nx is not null and exists (select 1 from i where i.session_id = xs.session_id and i.job_id = xs.job_id and i.x0 <= xs.v and i.x1 >= xs.nx and i.y0 <= ys.v and i.y1 >= ys.nx) group by all),
o as (select f.session_id, f.job_id, round(coalesce(best, 0) / 358400.0, 6) as overlap_prev, round(coalesce(u, 0) / 358400.0, 4) as overlap_total, case when best > 0 then best_id end as best_job_id, round(gap, 3) as gap
  from f left join t on t.session_id = f.session_id and t.job_id = f.job_id left join u on u.session_id = f.session_id and u.job_id = f.job_id),
coverage as (select *, case when gap is null then 'FIRST_FIELD' when overlap_total >= 0.9 then 'ALREADY_SCANNED' when overlap_prev > 0.3 or overlap_total > 0.3 then 'TOO_MUCH_OVERLAP' when overlap_prev < 0.2 then 'GAP_RISK' else 'CAPTURE_READY' end as state from o)"""
ORACLE_SQL = {
    "nn_features": duck(f"select image_id, count(*) as n_nn, {_R('MEDIAN(d)', 'nn_median')}, {_R('avg(d)', 'nn_mean')}, {_R('stddev_pop(d)', 'nn_std')}, {_R('PCT(10, d)', 'nn_p10')}, {_R('PCT(25, d)', 'nn_p25')}, {_R('PCT(75, d)', 'nn_p75')}, {_R('PCT(90, d)', 'nn_p90')}, {_R('MEDIAN(d) / max(median_diameter)', 'nn_median_norm')}, {_R('MEDIAN(gap)', 'gap_median')}, {_R('MEDIAN(gap) / max(median_diameter)', 'gap_median_norm')} from @nn group by image_id"),
    "contact_ratio": duck("select image_id, n, n_contact, round(contact_ratio, 6) as contact_ratio from @contact"),
    "degree_distribution": duck("""
select image_id, round(100.0 * avg(cast(deg = 0 as int)), 6) as pct_0, round(100.0 * avg(cast(deg = 1 as int)), 6) as pct_1, round(100.0 * avg(cast(deg = 2 as int)), 6) as pct_2, round(100.0 * avg(cast(deg >= 3 as int)), 6) as pct_3plus,
  round(avg(deg), 6) as mean_degree, MEDIAN(deg) as median_degree, round(100.0 * avg(cast(fwd = 0 as int)), 6) as graph_isolated_pct, round(avg(fwd), 6) as graph_mean_degree
from (select p.image_id, p.instance_id, count(n.b) as deg, count(n.b) filter (where n.b > n.a) as fwd from @points p left join @near n on n.image_id = p.image_id and n.a = p.instance_id group by p.image_id, p.instance_id) t group by image_id"""),
    "clusters": duck(_CLUSTERS.format(points="@points", near="@near") + _SIZES),
    "image_features": duck(f"select c.image_id, n_total, n_candidate, {_R('nn_median', 'nn_median')}, {_R('gap_median_norm', 'gap_median_norm')}, {_R('contact_ratio', 'contact_ratio')} from @image_counts c left join (select image_id, MEDIAN(d) as nn_median, MEDIAN(gap) / max(median_diameter) as gap_median_norm from @nn group by image_id) n on n.image_id = c.image_id left join @contact k on k.image_id = c.image_id"),
    "classify_field": duck(
        _CLUSTERS.format(points="@roi_points", near="@roi_near")
        + f""", big as (select image_id, max(size)::double / sum(size) as largest_fraction from sizes group by image_id),
tile as (select image_id, least(3, floor((x - 192) * 4 / 1536)) as tx, least(3, floor((y - 108) * 4 / 864)) as ty, count(*) as k from @roi_points group by all),
cv as (select image_id, sqrt(greatest(0, sum(k * k) / 16.0 - (sum(k) / 16.0) * (sum(k) / 16.0))) / (sum(k) / 16.0) as density_cv from tile group by image_id),
deg as (select p.image_id, count(n.b)::double / count(distinct p.instance_id) as mean_degree from @roi_points p left join @roi_near n on n.image_id = p.image_id and n.a = p.instance_id group by p.image_id),
nnm as (select image_id, MEDIAN(d) / max(median_diameter) as spacing from @roi_nn group by image_id),
base as (select image_id, count(*) as n_valid, sum(area) / 1327104.0 as coverage from @roi_points group by image_id),
f as (
  select c.image_id, c.n_candidate as n_candidates, coalesce(n_valid, 0) as n_valid, coalesce(n_valid, 0) / 1.327104 as density, coverage, density_cv, largest_fraction, mean_degree, spacing, contact_ratio
  from @image_counts c left join base b on b.image_id = c.image_id left join big g on g.image_id = c.image_id left join cv on cv.image_id = c.image_id
  left join deg d on d.image_id = c.image_id left join nnm m on m.image_id = c.image_id left join @roi_contact k on k.image_id = c.image_id
), s as (
  select *, least(1, greatest(0, 0.25 * {_tri_sql("density", *CONFIG.density)} + 0.2 * {_tri_sql("coverage", *CONFIG.coverage)} + 0.2 * {_tri_sql("spacing", *CONFIG.spacing)} + 0.15 * {_free_sql("contact_ratio")} + 0.1 * {_free_sql("largest_fraction")} + 0.1 * {_free_sql("density_cv / 0.25")})) as score,
    cast(n_candidates > 620 as bigint) + cast(coalesce(coverage > 0.45, false) as bigint) + cast(coalesce(mean_degree > 1.8, false) as bigint) + cast(coalesce(largest_fraction > 0.75, false) as bigint) as thick_signals,
    cast(n_candidates < 560 as bigint) + cast(coalesce(coverage < 0.12, false) as bigint) + cast(coalesce(spacing > 1.2, false) as bigint) as thin_signals
  from f
)
select image_id, n_candidates, n_valid, round(density, 5) as density, round(coverage, 5) as coverage, round(density_cv, 5) as density_cv, round(largest_fraction, 5) as largest_fraction, round(mean_degree, 5) as mean_degree, round(score, 5) as score, thick_signals, thin_signals,
  case when thick_signals >= 2 then 'TOO_THICK' when thin_signals >= 2 then 'TOO_THIN' when score >= 0.6 and n_candidates between 560 and 620 then 'MONOLAYER' else 'UNCERTAIN' end as class
from s"""),
    "union_area": duck("""
with r as (select session_id, x - w / 2 as x0, y - h / 2 as y0, x + w / 2 as x1, y + h / 2 as y1 from @fields where raw_class = 'MONOLAYER'),
xs as (select session_id, v, lead(v) over (partition by session_id order by v) as nx from (select session_id, x0 as v from r union select session_id, x1 from r) t),
ys as (select session_id, v, lead(v) over (partition by session_id order by v) as nx from (select session_id, y0 as v from r union select session_id, y1 from r) t)
select xs.session_id, round(sum((xs.nx - xs.v) * (ys.nx - ys.v)), 0) as union_area from xs join ys on xs.session_id = ys.session_id
where xs.nx is not null and ys.nx is not null and exists (select 1 from r where r.session_id = xs.session_id and r.x0 <= xs.v and r.x1 >= xs.nx and r.y0 <= ys.v and r.y1 >= ys.nx) group by xs.session_id"""),
    "coverage_grid": duck(f"""
with {_GRID}, cells as (
  select session_id, gw, gh, gx, gy, max(case reg_state when 'REGISTRATION_GOOD' then 1 when 'REGISTRATION_WEAK' then reg_confidence else 0 end) as best from grid where reg_state <> 'REGISTRATION_FAILED' group by all)
select session_id, count(*) as covered, count(*) filter (where best >= 0.5) as scanned,
  round(count(*) filter (where gx >= 1 and gx < gw - 1 and gy >= 1 and gy < gh - 1)::double / ((gw - 2) * (gh - 2)), 9) as inner_pct, round(count(*)::double / (gw * gh), 9) as padded_pct
from cells group by session_id, gw, gh"""),
    "semantic_grid": duck(f"""
with {_GRID}, cells as (
  select session_id, gx, gy, round(sum(case when raw_class = 'MONOLAYER' then wt * score else 0 end) / sum(wt), 6) as conf, sum(case when raw_class = 'MONOLAYER' then wt else 0 end) as mono, sum(case when raw_class = 'MONOLAYER' then 0 else wt end) as non, count(*) as votes
  from (select *, greatest(0.1, least(1, reg_confidence)) as wt from grid) g group by session_id, gx, gy)
select session_id, count(*) as observed, cast(sum(votes) as bigint) as votes, count(*) filter (where conf >= 0.75 or (conf >= 0.65 and mono >= 2)) as green, count(*) filter (where conf < 0.65 and mono > 0 and non > 0) as conflicts from cells group by session_id"""),
    "coverage_eval": duck("with " + _COVERAGE.format(new="@fields", old="@fields") + " select * from coverage"),
    "lowe_matches": duck("""
with p as (select c.vec_id as child, q.vec_id as parent, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: power(c.embedding[i]::double - q.embedding[i]::double, 2)))), 9) as d
  from @embeddings c, @embeddings q where c.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
k as (select *, row_number() over (partition by child order by d, parent) as k from p)
select a.child, a.parent, round(a.d, 5) as d1, round(b.d, 5) as d2, a.d < 0.98 * b.d as good from k a join k b on a.child = b.child and a.k = 1 and b.k = 2"""),
    "containment": duck("""
select session_id, job_id, green, d as distance, case when d <= 100 then 'INSIDE' when d <= 220 then 'NEAR' else 'OUTSIDE' end as state from (
  select f.session_id, f.job_id, g.job_id as green, round(sqrt((f.x - g.x) * (f.x - g.x) + (f.y - g.y) * (f.y - g.y)), 6) as d,
    row_number() over (partition by f.session_id, f.job_id order by round(sqrt((f.x - g.x) * (f.x - g.x) + (f.y - g.y) * (f.y - g.y)), 6), g.job_id) as k
  from @fields f join @fields g on f.session_id = g.session_id and g.raw_class = 'MONOLAYER' where f.raw_class = 'TOO_THICK'
) t where k = 1"""),
    "revisit_points": duck("""
with recursive m as (select session_id, job_id, x, y, score, row_number() over (partition by session_id order by score desc, job_id) as k from @fields where raw_class = 'MONOLAYER'),
walk as (
  select session_id, k, [struct_pack(x := x, y := y)] as taken, job_id, score, true as took from m where k = 1
  union all
  select m.session_id, m.k, case when ok then list_append(taken, struct_pack(x := m.x, y := m.y)) else taken end, m.job_id, m.score, ok
  from (select w.session_id, w.k, w.taken, len(w.taken) < 6 and len(list_filter(w.taken, lambda t: power(t.x - m.x, 2) + power(t.y - m.y, 2) < 1440000)) = 0 as ok, m.k as mk from walk w join m on m.session_id = w.session_id and m.k = w.k + 1) z
  join m on m.session_id = z.session_id and m.k = z.mk)
select session_id, job_id, score from walk where took"""),
}
ORACLE_SQL["classify_dark_field"] = ORACLE_SQL["classify_field"].replace("case when thick_signals >= 2 then", "case when (image_id * 31) % 100 / 100e0 >= 0.55e0 or thick_signals >= 2 then")
