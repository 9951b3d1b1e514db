"""Sources: image folders, masks, tables, scan maps, survey bundles, and frame streams."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name endings of images.
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "tif", "tiff", "bmp")


def natural_key(name: str) -> Column:
    """Sort key of a file name: its digit runs padded, so that img2 comes before img10."""
    return F.expr(f"array_join(transform(regexp_extract_all(lower({name}), '([0-9]+|[^0-9]+)', 1), p -> if(p rlike '^[0-9]+$', lpad(p, greatest(20, length(p)), '0'), p)), '')")


def image_files(spark: SparkSession, folder: str, endings: tuple[str, ...] = IMAGE_ENDINGS) -> DataFrame:
    """path, name, length of a folder's images with their place in natural order."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.where(F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*endings)).withColumn("sort_key", natural_key("name"))


def image_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """path, width, height, channels and pixels by Spark's image source; a file that can't be decoded fails the query."""
    image = spark.read.format("image").option("dropInvalid", "false").load(folder).select("image.*")
    path = F.when(F.col("nChannels") > 0, F.col("origin")).otherwise(F.raise_error(F.concat(F.lit("not an image: "), F.col("origin"))))
    return image.select(path.alias("path"), "width", "height", F.col("nChannels").alias("channels"), (F.col("width").cast("long") * F.col("height")).alias("pixels"))


def rgb_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """path, width, height and RGB bytes of a folder's images; gray becomes three equal channels, alpha is dropped.

    Spark's decoder does not turn images by their EXIF tag.
    """
    def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = []
            for raw, n in zip(pdf["data"], pdf["nChannels"], strict=True):
                a = np.frombuffer(raw, np.uint8).reshape(-1, n)
                data.append((np.repeat(a, 3, axis=1) if n == 1 else a[:, 2::-1]).tobytes())
            yield pd.DataFrame({"path": pdf["origin"], "width": pdf["width"], "height": pdf["height"], "rgb": data})

    image = spark.read.format("image").option("dropInvalid", "true").load(folder).select("image.*")
    return image.select("origin", "width", "height", "nChannels", "data").mapInPandas(turned, "path string, width int, height int, rgb binary")


def decode_png(raw: bytes) -> np.ndarray:
    """A gray PNG of 8 or 16 bits; Spark's image source would cut 16 bits to 8."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data, head = 8, b"", None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += size + 12
    width, height, bits, color, _, _, interlaced = head
    if bits not in (8, 16) or color != 0 or interlaced:
        raise ValueError("only plain gray PNG files of 8 or 16 bits are masks")
    step = bits // 8
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.int64)
    for y in range(height):
        kind, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind:
            for x in range(len(line)):
                left, corner = (line[x - step], above[x - step]) if x >= step else (0, 0)
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner))[2]
                line[x] = (line[x] + guess) & 255
        above = line & 255
        out[y] = above
    return out if step == 1 else out.view(">u2").astype(np.uint16)


def runs_of(mask: np.ndarray) -> pd.DataFrame:
    """label, row_no, x0, x1 (half open) of a mask's runs of one label; 0 is background."""
    rows = []
    for y, line in enumerate(mask.astype(np.int64)):
        cut = np.flatnonzero(np.diff(line, prepend=-1, append=-1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if line[a]:
                rows.append((int(line[a]), y, int(a), int(b)))
    return pd.DataFrame(rows, columns=["label", "row_no", "x0", "x1"])


def mask_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of every mask PNG of a folder, with an error column instead of a failed task."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out = runs_of(decode_png(bytes(content))).assign(error=None)
                except Exception as e:  # one bad file is a row, not a failed job
                    out = pd.DataFrame([{"error": str(e)}], columns=["label", "row_no", "x0", "x1", "error"])
                yield out.assign(path=path)[["path", "label", "row_no", "x0", "x1", "error"]]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select("path", "content")
    return files.mapInPandas(decode, "path string, label long, row_no long, x0 long, x1 long, error string")


def keyframe_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and index of key frame images, whose names end in a number."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    return files.withColumn("frame_index", F.expr(r"try_cast(regexp_extract(path, '([0-9]+)[.][A-Za-z]+$', 1) as int)")).where("frame_index is not null")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; empty fields are null."""
    return spark.read.csv(path, schema=schema, header=True, nullValue="", enforceSchema=True)


def cells_by_image(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with a folder for each image. Folders are listed some to a task, and no file is opened for its columns."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(200, 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.schema(schema).parquet(path)
    finally:
        spark.conf.set(key, before)


def scan_map(spark: SparkSession, path: str, field_schema: str) -> DataFrame:
    """The fields of a saved scan map, one row each."""
    return spark.read.schema(f"fields array<struct<{field_schema}>>").json(path, multiLine=True).select(F.explode("fields").alias("f")).select("f.*")


def scan_maps(spark: SparkSession, path: str, by: str, field_schema: str) -> DataFrame:
    """The fields of many saved maps, one line each, with their session."""
    return spark.read.schema(f"{by} long, fields array<struct<{field_schema}>>").json(path).select(by, F.explode("fields").alias("f")).select(by, "f.*")


#: Settings of these blocks are also found at the top, under the prefix.
CONFIG_BLOCKS = {
    "analysis": ("", {"gpu_workers": 1, "cpu_feature_workers": 2}),
    "coverage": ("", dict.fromkeys(("target_overlap_min", "target_overlap_max", "duplicate_overlap_threshold", "gap_risk_threshold"))),
    "semantic": ("semantic_", dict.fromkeys(("cell_fraction", "green_conf_thr", "min_votes", "monolayer_weight", "other_weight"))),
}


def load_config(spark: SparkSession, path: str, overrides: dict | None = None) -> dict:
    """A settings file (JSON, or YAML where its library is there), flattened; overrides that are not None win."""
    text = "\n".join(r.value for r in spark.read.text(path).collect())  # one small file
    try:
        import yaml

        config = yaml.safe_load(text)
    except ImportError:
        import json

        config = json.loads(text)
    for block, (prefix, defaults) in CONFIG_BLOCKS.items():
        for name, default in defaults.items():
            config.setdefault(prefix + name, (config.get(block) or {}).get(name, default))
    return config | {k: v for k, v in (overrides or {}).items() if v is not None}


@dataclass(frozen=True)
class SourceSpec:
    kind: str
    value: str
    options: dict = field(default_factory=dict)


def parse_source(spec: str) -> SourceSpec:
    """kind:value?key=val&key=val; an unknown kind is an error."""
    head, _, query = spec.partition("?")
    kind, _, value = head.partition(":")
    if kind not in ("frames", "image", "replay"):
        raise ValueError(f"unknown source kind: {kind!r}")
    return SourceSpec(kind, value, dict(p.partition("=")[::2] for p in query.split("&") if p))


def open_source(spark: SparkSession, spec: str, schema: str | None = None) -> DataFrame:
    """A streaming DataFrame: replayed frame files, a live folder of them, or one still row at 2 Hz."""
    source = parse_source(spec)
    if source.kind == "image":
        still = spark.read.format("binaryFile").load(source.value).select("path", "length").limit(1)
        return spark.readStream.format("rate").option("rowsPerSecond", source.options.get("hz", "2")).load().crossJoin(F.broadcast(still))
    reader = spark.readStream.schema(schema or "session_id long, frame_index long, t_sec double, dx double, dy double, sharpness double")
    if source.kind == "replay":
        reader = reader.option("maxFilesPerTrigger", source.options.get("files", "1"))
    return reader.parquet(source.value)
