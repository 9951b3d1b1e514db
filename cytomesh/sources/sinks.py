"""Sinks: result tables, one-row summaries, scan-map snapshots, survey bundles, append logs."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def six_digits(column: str) -> Column:
    """A double as text of six significant digits without trailing zeros, as C's %.6g (ties by the exact binary value); undefined is null."""

    @F.arrow_udf("string")
    def text(values: pa.Array) -> pa.Array:
        known = values.dictionary_encode()  # a value that comes again is formatted once
        few = pa.array([None if v is None or v != v else f"{v:.6g}" for v in known.dictionary.to_pylist()], pa.string())
        return few.take(known.indices)

    return text(F.col(column))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A CSV of exactly these columns: missing ones are empty, others are dropped."""
    have = dict(df.dtypes)
    chosen = [F.lit(None).cast("string").alias(c) if c not in have else six_digits(c).alias(c) if have[c] == "double" else F.col(c) for c in columns or df.columns]
    df.select(chosen).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_cells(df: DataFrame, path: str, by: str = "image_id") -> None:
    """The cell table, one folder for each image.

    In a shared folder of scheme file a task writes the files of its images itself: there the JVM starts a process for the rights of
    every file, which takes longer than the file. A file has one name and is moved to it when whole, so a task can be repeated.
    """
    from pyspark.sql.types import IntegerType, LongType

    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file" or not isinstance(df.schema[by].dataType, (IntegerType, LongType)):
        df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)
        return
    fs.delete(target, True)
    fs.mkdirs(target)
    folder = target.toUri().getPath()

    def save(table: pa.Table) -> pa.Table:
        key = table.column(by)[0].as_py()
        own = os.path.join(folder, f"{by}={'__HIVE_DEFAULT_PARTITION__' if key is None else key}")
        os.makedirs(own, exist_ok=True)
        part = os.path.join(own, f".{uuid.uuid4().hex}")  # readers pass over such names
        pq.write_table(table.drop_columns([by]), part)
        os.replace(part, os.path.join(own, "part-0.parquet"))
        return pa.table({"n": [len(table)]})

    df.groupBy(by).applyInArrow(save, "n long").agg(F.sum("n")).collect()
    fs.create(jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS")).close()


def write_summary(df: DataFrame, path: str) -> None:
    """One row as JSON."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)


def write_scan_map(fields: DataFrame, path: str, by: str | None = None) -> None:
    """The fields of one map as one JSON document, or of each session (by) as a line (a session has some thousand fields)."""
    columns = [c for c in fields.columns if c != by]
    fields.groupBy(*[by] * (by is not None)).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("fields")).write.mode("overwrite").json(path)


def write_survey(grid: DataFrame, placements: DataFrame, manifest: dict, path: str) -> None:
    """A frozen survey: grid cells with their mask (0 to 255) and confidence, placements and a manifest row."""
    grid.write.mode("overwrite").parquet(f"{path}/grid")
    placements.write.mode("overwrite").parquet(f"{path}/placements")
    grid.sparkSession.createDataFrame([{k: str(v) for k, v in manifest.items()}]).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_survey(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Grid (with monolayer: mask over 127), placements and manifest of a frozen survey."""
    grid = spark.read.parquet(f"{path}/grid")
    if "mask" in grid.columns:
        grid = grid.withColumn("monolayer", F.col("mask") > 127)
    return grid, spark.read.parquet(f"{path}/placements"), spark.read.json(f"{path}/manifest").first().asDict()


def run_metadata(spark: SparkSession, extra: dict | None = None) -> dict:
    """What is needed to repeat a run: versions, platform, the session's settings."""
    import platform
    import sys
    from datetime import datetime

    keep = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes")
    return {"timestamp": datetime.now().isoformat(timespec="seconds"), "platform": platform.platform(), "python": sys.version.split()[0], "spark": spark.version, "master": spark.sparkContext.master} | {k: spark.conf.get(k, None) for k in keep} | (extra or {})


def write_report(spark: SparkSession, title: str, summary: dict, path: str) -> None:
    """A summary as one JSON row and as a Markdown table."""
    import json

    spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/json")
    lines = [f"# {title}", "", "| measure | value |", "|---|---|", *(f"| {k} | {v} |" for k, v in sorted(summary.items()))]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """A streaming table that is only ever appended to."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def snapshot_each_batch(stream: DataFrame, path: str, checkpoint: str):
    """The whole state of the stream's last batch, replaced with every batch."""
    return stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint)
