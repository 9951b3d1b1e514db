"""Session helpers: reading tables and finding the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, bytes_each: str = "8m") -> None:
    """Arrow batches by bytes: with long texts, batches by rows alone would grow with them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", bytes_each)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named one is set: local in local mode, else beside the warehouse."""
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            base = "file://" + tempfile.mkdtemp(prefix="cytomesh-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cytomesh"
        spark.conf.set(CHECKPOINT_KEY, base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/cytomesh/{uuid.uuid4().hex}/{name}"
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path.getParent())
    fs.deleteOnExit(hadoop_path.getParent())
    return path


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: cuts the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table made by written() once nothing reads it any more."""
    spark = df.sparkSession
    for f in {str(x).rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
