"""Sources and sinks as queries: rows are written, read back from the files, and returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.plans import folds as fold_plans
from cytomesh.plans import pixels, survey  # noqa: F401  (fill VIEWS)
from cytomesh.plans.sql import duck, view
from cytomesh.session import scratch_path
from cytomesh.sources import readers, sinks
from cytomesh.streaming import folds

CELL_COLUMNS = ["image_id", "instance_id", "area", "solidity", "elongation", "perimeter_px", "candidate", "touches_border"]


def cells_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell table as CSV with exactly its columns; the missing one is empty."""
    path = scratch_path(spark, "cells.csv")
    sinks.write_csv(view(spark, sf_dir, "flagged"), path, CELL_COLUMNS)
    return readers.csv_table(spark, path, "image_id long, instance_id long, area double, solidity double, elongation double, perimeter_px double, candidate boolean, touches_border boolean")


def cells_by_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell table in a folder for each image; image_id comes back from the folder names."""
    path = scratch_path(spark, "cells")
    sinks.write_cells(view(spark, sf_dir, "flagged").select("image_id", "instance_id", "area", "candidate"), path)
    return readers.cells_by_image(spark, path, "instance_id long, area double, candidate boolean, image_id long").select("image_id", "instance_id", "area", "candidate")


def images_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "images.csv")
    columns = ["image_id", "n_total", "n_candidate", "n_interior", "n_border", "n_merge", "manual_label"]
    sinks.write_csv(view(spark, sf_dir, "image_counts"), path, columns)
    return readers.csv_table(spark, path, ", ".join(f"{c} {'string' if c == 'manual_label' else 'long'}" for c in columns))


def frames_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames, numbers with six significant digits, undefined ones empty."""
    path = scratch_path(spark, "frames.csv")
    frames = view(spark, sf_dir, "frames").withColumn("dx", F.when(F.col("frame_index") == 0, F.lit(float("nan"))).otherwise(F.col("dx")))
    sinks.write_csv(frames, path, ["session_id", "frame_index", "t_sec", "dx", "sharpness", "score"])
    return readers.csv_table(spark, path, "session_id long, frame_index long, t_sec string, dx string, sharpness string, score string")


def run_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "run.json")
    sinks.write_summary(view(spark, sf_dir, "image_counts").agg(F.count("*").alias("n_images"), F.sum("n_total").alias("n_cells"), F.lit(None).cast("double").alias("score")), path)
    return spark.read.schema("n_images long, n_cells long, score double").json(path)


def map_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of every session as a JSON line."""
    path = scratch_path(spark, "maps.json")
    sinks.write_scan_map(view(spark, sf_dir, "fields").select("session_id", "job_id", "x", "y", "raw_class", "human_label"), path, "session_id")
    return readers.scan_maps(spark, path, "session_id", "job_id: bigint, x: double, y: double, raw_class: string, human_label: string")


def survey_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen survey's monolayer cells: mask over 127."""
    path = scratch_path(spark, "survey")
    grid = survey._green(spark, sf_dir).select("session_id", "gx", "gy", F.when(F.col("green"), 255).otherwise((F.col("gx") + F.col("gy")) % 128).alias("mask"))
    sinks.write_survey(grid, view(spark, sf_dir, "fields").select("session_id", "job_id", "x", "y", "reg_confidence"), {"cell_fraction": 0.125}, path)
    cells, places, manifest = sinks.read_survey(spark, path)
    cells = cells.groupBy("session_id").agg(F.count("*").alias("observed"), F.sum(F.col("monolayer").cast("long")).alias("monolayer"))
    return cells.join(places.groupBy("session_id").agg(F.count("*").alias("placements")), "session_id").withColumn("cell_fraction", F.lit(float(manifest["cell_fraction"])))


def streamed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame files replayed as a stream through the key frame fold into an append log, read back."""
    base = scratch_path(spark, "replay")
    rows = view(spark, sf_dir, "frames").select("session_id", "frame_index", "t_sec", "dx", "dy", "sharpness")
    half = rows.agg(F.max("frame_index")).first()[0] // 2
    for name, part in (("0", rows.where(F.col("frame_index") <= half)), ("1", rows.where(F.col("frame_index") > half))):
        part.coalesce(1).write.parquet(f"{base}/in/part={name}")
    stream = readers.open_source(spark, f"replay:{base}/in/*?files=1")
    kept = folds.run_stream(stream, folds.keyframes(), "session_id", ("frame_index",)).where("status like 'ACCEPTED%'")
    sinks.append_log(kept, f"{base}/log", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/log")


QUERIES = {f.__name__: f for f in (cells_csv, cells_by_image, images_csv, frames_csv, run_json, map_json, survey_files, streamed_log)}
ORACLE_SQL = {
    "cells_csv": duck("select image_id, instance_id, format('{:.6g}', area)::double as area, format('{:.6g}', solidity)::double as solidity, format('{:.6g}', elongation)::double as elongation, cast(null as double) as perimeter_px, candidate, touches_border from @flagged"),
    "cells_by_image": duck("select image_id, instance_id, area, candidate from @flagged"),
    "images_csv": duck("select image_id, n_total, n_candidate, n_interior, n_border, n_merge, cast(null as varchar) as manual_label from @image_counts"),
    "frames_csv": duck("select session_id, frame_index, format('{:.6g}', t_sec) as t_sec, case when frame_index > 0 then format('{:.6g}', dx) end as dx, format('{:.6g}', sharpness) as sharpness, cast(null as varchar) as score from @frames"),
    "run_json": duck("select count(*) as n_images, cast(sum(n_total) as bigint) as n_cells, cast(null as double) as score from @image_counts"),
    "map_json": duck("select session_id, job_id, x, y, raw_class, human_label from @fields"),
    "survey_files": duck("with " + survey._GREEN + """ select o.session_id, observed, monolayer, placements, 0.125 as cell_fraction from (select session_id, count(*) as observed, count(*) filter (where green) as monolayer from observed group by session_id) o
join (select session_id, count(*) as placements from @fields group by session_id) p on p.session_id = o.session_id"""),
    "streamed_log": fold_plans.ORACLE_SQL["accepted_keyframes"],
}
