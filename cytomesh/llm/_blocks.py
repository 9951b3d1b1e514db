"""Dealing documents into ranges of doc_id, and prefix sums over partitions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Quantiles of doc_id that one aggregate is asked for; more ranges are cut again within these.
FLAT = 2_000
NULL = -(2**63)


@dataclass
class Ranges:
    """Ranges of doc_id in ascending order, nulls first; 16 bytes a range in memory.

    A doc_id (or null) with more rows than a range should have is a range of its own, dealt to
    several numbers by the row's salt. Numbers ascend with the ranges.
    """

    bounds: np.ndarray  # the first doc_id of each range after the first
    pieces: np.ndarray  # numbers of each range

    def __post_init__(self) -> None:
        self.first = np.cumsum(self.pieces) - self.pieces
        self.count = int(self.pieces.sum())

    def of(self, doc_ids: pa.Array, salt: pa.Array) -> np.ndarray:
        """The number of each row."""
        ids = doc_ids.fill_null(NULL).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.searchsorted(self.bounds, ids, "right")
        return (self.first[at] + salt.to_numpy(zero_copy_only=False) % self.pieces[at]).astype(np.int32)

    def range_of(self, number: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, number, "right") - 1


def cut_ranges(cuts: list[int], null_pieces: int) -> Ranges:
    """Ranges between quantiles; one that occurs more than once names a doc_id that fills whole ranges."""
    value, times = np.unique(np.array(cuts, np.int64), return_counts=True)
    pieces = {NULL: max(1, null_pieces)}
    if null_pieces:
        pieces[NULL + 1] = 1
    for v, k in zip(value.tolist(), times.tolist(), strict=True):
        pieces[v] = k
        if k > 1:
            pieces.setdefault(v + 1, 1)
    starts = sorted(pieces)
    return Ranges(np.array(starts[1:], np.int64), np.array([pieces[s] for s in starts], np.int64))


def range_bounds(docs: DataFrame, bytes_each: int) -> Ranges:
    """Ranges that hold about bytes_each text bytes where rows are of equal length."""
    total, rows, n = docs.agg(F.sum(F.octet_length("text")), F.count("*"), F.count("doc_id")).first()
    ranges = int(max(1, -(-(total or 0) // bytes_each)))
    null_pieces = -(-(rows - n) * ranges // max(rows, 1))
    if ranges < 2 or not n:
        return cut_ranges([], null_pieces)
    quantiles = lambda k: F.percentile_approx("doc_id", [i / k for i in range(1, k)], max(10_000, 20 * k))
    cuts = docs.agg(quantiles(min(ranges, FLAT))).first()[0]
    if ranges > FLAT:
        coarse, each = cut_ranges(cuts, 0), -(-ranges // FLAT)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(coarse.of(ids, pa.array(np.zeros(len(ids), np.int64))))], ["doc_id", "coarse"])

        fine = docs.where("doc_id is not null").select("doc_id").mapInArrow(dealt, "doc_id long, coarse int").groupBy("coarse").agg(quantiles(each).alias("cuts"))
        # A doc_id that fills several coarse ranges fills all the finer ones as well.
        cuts = [*cuts, *(c for r in fine.toLocalIterator() for c in r["cuts"])]
    return cut_ranges(cuts, null_pieces)


def before_each(totals: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """totals (one row for each file or partition) with the sum of value over smaller keys."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long").alias(out))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """file (the partition column) and content of a folder that the text writer made, perhaps an empty one."""
    found = spark.read.format("binaryFile").load(path)
    return (found if "file" in found.columns else found.withColumn("file", F.lit(0))).select("file", "content")
