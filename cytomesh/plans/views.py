"""Relations of the engine's data model, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytomesh.plans.sql import FORMS, VIEWS
from cytomesh.session import table

WIDTH, HEIGHT = 1920, 1080
MPX = WIDTH * HEIGHT / 1e6

VIEWS |= {
    # One image for each supplier, one cell for each line item.
    "cells": f"""
select *, 2 * r as diameter, (x - r < 0 or y - r < 0 or x + r >= {WIDTH} or y + r >= {HEIGHT}) as touches_border
from (
  select l_suppkey as image_id,
    cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) as bigint) as instance_id,
    cast((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 1299709) % 192000 as double) / 100 as x,
    cast((l_orderkey * 15485863 + l_partkey * 6151 + l_linenumber * 32452843) % 108000 as double) / 100 as y,
    cast(case when l_partkey % 97 = 0 then 150 when l_partkey % 101 = 0 then 3000 else 400 + cast(l_quantity as int) * 12 end as double) as area,
    sqrt(cast(case when l_partkey % 97 = 0 then 150 when l_partkey % 101 = 0 then 3000 else 400 + cast(l_quantity as int) * 12 end as double) / pi()) as r,
    1 - 2 * cast(l_discount as double) as solidity, 1 + 10 * cast(l_tax as double) as elongation, 1 + cast(l_orderkey % 7 = 0 as int) as n_dt_peaks
  from @lineitem
) c""",
    "frames": """
select *, case when cast(floor(frame_index / 40.0) as int) % 3 = 0 then cast(0.01 as double) else cast(1 as double) end * (cast(((event_id * 7919) % 20001) - 10000 as double) / 100) as dx,
  case when cast(floor(frame_index / 40.0) as int) % 3 = 0 then cast(0.01 as double) else cast(1 as double) end * (cast(((event_id * 104729) % 20001) - 10000 as double) / 100) as dy,
  cast(frame_index as double) * cast(0.5 as double) as t_sec
from (
  select event_id, user_id % 10 as session_id, cast(row_number() over (partition by user_id % 10 order by ts, event_id) - 1 as bigint) as frame_index,
    value / 3 as sharpness, 120 + event_id % 32 as brightness, cast((event_id * 31) % 1000 as double) / 1000 as occupancy
  from @events
) t""",
    "fields": """
select o_custkey % 50 as session_id, cast(row_number() over (partition by o_custkey % 50 order by o_orderkey) as bigint) as job_id,
  cast((o_orderkey * 7919) % 600000 as double) / 100 as x, cast((o_orderkey * 104729) % 400000 as double) / 100 as y,
  cast(800 as double) as w, cast(448 as double) as h, cast((o_orderkey * 31) % 1000 as double) / 1000 as score,
  case when (o_orderkey * 31) % 1000 >= 600 then 'MONOLAYER' when o_orderkey % 3 = 0 then 'TOO_THICK' when o_orderkey % 3 = 1 then 'TOO_THIN' else 'UNCERTAIN' end as raw_class,
  case when o_orderkey % 10 = 0 then 'REGISTRATION_FAILED' when o_orderkey % 10 <= 2 then 'REGISTRATION_WEAK' else 'REGISTRATION_GOOD' end as reg_state,
  cast(0.3 as double) + cast((o_orderkey * 17) % 70 as double) / 100 as reg_confidence,
  case when o_orderkey % 23 = 0 then 'MONOLAYER' end as human_label
from @orders""",
    "manual": "select s_suppkey as image_id, cast(600 + s_suppkey % 17 as bigint) as manual_count from @supplier where s_suppkey % 3 <> 0",
    "jobs": """
select event_id as job_id, user_id % 10 as session_id, case event_type when 'purchase' then 'MANUAL' when 'error' then 'FORCED' else 'AUTO' end as priority,
  cast(event_id as double) * cast(0.25 as double) as t_capture, value
from @events""",
    # Reference size of each image: two medians, the second without outliers.
    # Every step is a window over the same key as the cells', so one shuffle serves them all.
    "scope": "select * from (select *, sum(case when touches_border then 0 else 1 end) over (partition by image_id) as interior from @cells) s where interior = 0 or not touches_border",
    "first_median": "select *, MEDIAN(area) over (partition by image_id) as m, count(*) over (partition by image_id) as n from @scope",
    "core": """
select image_id, area from (
  select *, area >= 0.25 * m and area <= 4 * m as inside, sum(case when area >= 0.25 * m and area <= 4 * m then 1 else 0 end) over (partition by image_id) as survivors from @first_median
) s where inside or survivors < greatest(3, cast(floor(n / 10.0) as bigint))""",
    "ref_stats": """
select image_id, MEDIAN(area) as median_area, sqrt(4 * MEDIAN(area) / pi()) as median_diameter, PCT(75, area) - PCT(25, area) as iqr_area, count(*) as n_stats_cells
from @core group by image_id""",
    "flagged": """
select c.*, r.median_diameter, c.area / r.median_area as ratio, c.area / r.median_area < 0.35 as possible_small, c.area / r.median_area > 3.5 as possible_wbc,
  not (c.area / r.median_area < 0.35 or c.area / r.median_area > 3.5) as candidate,
  c.area / r.median_area >= 1.6 and cast(c.solidity < 0.9 as int) + cast(c.elongation > 1.5 as int) + cast(c.n_dt_peaks >= 2 as int) >= 2 as merge_suspect
from @cells c join @ref_stats r on c.image_id = r.image_id""",
    "points": "select image_id, instance_id, x, y, r, median_diameter from @flagged where candidate",
}
#: The mask of a cell as horizontal runs: a square of about its area (55 rows at most).
VIEWS["mask_runs"] = """
select c.image_id, c.label, cast(c.y0 + k.k as bigint) as row_no, cast(c.x0 as bigint) as x0, cast(c.x1 as bigint) as x1
from (
  select image_id, instance_id as label, floor(y - sqrt(area) / 2) as y0, ceil(sqrt(area)) as side, floor(x - sqrt(area) / 2) as x0, floor(x - sqrt(area) / 2) + ceil(sqrt(area)) as x1
  from @cells
) c join (select p_partkey as k from @part where p_partkey < 80) k on k.k < c.side"""


# ---- forms that Spark takes in place of the SQL above: line items are shuffled once, by image, with their own columns only
_LINES = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells by image. A cell's columns are made after the shuffle, none is carried by it; missing keys come last, as in the oracle."""
    order = Window.partitionBy("l_suppkey").orderBy(*[F.asc_nulls_last(c) for c in _LINES])
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", *_LINES).withColumn("instance_id", F.row_number().over(order).cast("long"))
    out = lines.selectExpr(
        "l_suppkey as image_id", "instance_id", "cast((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 1299709) % 192000 as double) / 100 as x",
        "cast((l_orderkey * 15485863 + l_partkey * 6151 + l_linenumber * 32452843) % 108000 as double) / 100 as y",
        "cast(case when l_partkey % 97 = 0 then 150 when l_partkey % 101 = 0 then 3000 else 400 + cast(l_quantity as int) * 12 end as double) as area",
        "1 - 2 * cast(l_discount as double) as solidity", "1 + 10 * cast(l_tax as double) as elongation", "1 + cast(l_orderkey % 7 = 0 as int) as n_dt_peaks",
    )
    out = out.withColumn("r", F.expr("sqrt(area / pi())")).select("image_id", "instance_id", "x", "y", "area", "r", "solidity", "elongation", "n_dt_peaks")
    return out.selectExpr("*", "2 * r as diameter", f"x - r < 0 or y - r < 0 or x + r >= {WIDTH} or y + r >= {HEIGHT} as touches_border")


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the reference size of their image by windows over it: no table of references is joined."""
    image = Window.partitionBy("image_id")
    count = lambda c: F.count(F.when(c, 1)).over(image)
    median = lambda c: F.percentile(F.when(c, F.col("area")), F.lit(0.5)).over(image)
    cells = _cells(spark, sf_dir)
    rows = cells.where("image_id is not null").withColumn("_interior", F.sum(F.expr("case when touches_border then 0 else 1 end")).over(image))
    rows = rows.withColumn("_scope", F.expr("coalesce(_interior = 0 or not touches_border, false)"))
    rows = rows.withColumns({"_m": median(F.col("_scope")), "_n": count(F.col("_scope"))})
    rows = rows.withColumn("_inside", F.expr("coalesce(_scope and area >= 0.25D * _m and area <= 4 * _m, false)")).withColumn("_left", count(F.col("_inside")))
    rows = rows.withColumn("_core", F.expr("_inside or (_scope and _left < greatest(3, cast(floor(_n / 10D) as bigint)))"))
    rows = rows.withColumns({"_area": median(F.col("_core")), "_kept": count(F.col("_core"))}).where("_kept > 0")
    rows = rows.selectExpr(*cells.columns, "sqrt(4 * _area / pi()) as median_diameter", "area / _area as ratio")
    rows = rows.selectExpr("*", "ratio < 0.35D as possible_small", "ratio > 3.5D as possible_wbc", "not (ratio < 0.35D or ratio > 3.5D) as candidate")
    return rows.withColumn("merge_suspect", F.expr("ratio >= 1.6D and cast(solidity < 0.9D as int) + cast(elongation > 1.5D as int) + cast(n_dt_peaks >= 2 as int) >= 2"))


def _mask_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs lie by image, as their cells do; the row numbers, 80 keys at most, are sent to every task."""
    cells = _cells(spark, sf_dir).selectExpr("image_id", "instance_id as label", "floor(y - sqrt(area) / 2) as y0", "ceil(sqrt(area)) as side", "floor(x - sqrt(area) / 2) as x0")
    rows = table(spark, sf_dir, "part").where("p_partkey < 80").selectExpr("p_partkey as k")
    return cells.join(F.broadcast(rows), F.col("k") < F.col("side")).selectExpr("image_id", "label", "cast(y0 + k as bigint) as row_no", "cast(x0 as bigint) as x0", "cast(x0 + side as bigint) as x1")


FORMS |= {"cells": _cells, "flagged": _flagged, "mask_runs": _mask_runs}
