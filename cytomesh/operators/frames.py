"""Pixel kernels over relations: images as rows (image_id, height, width, pixels), masks as runs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from cytomesh.operators import kernels
from cytomesh.operators.sessions import dealt


def images_of(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    for i, h, w, pixels in zip(pdf["image_id"], pdf["height"], pdf["width"], pdf["pixels"], strict=True):
        yield i, np.asarray(pixels, float).reshape(h, w)


def frame_features(images: DataFrame, width: int) -> DataFrame:
    """Quality, screen and registration measures of each gray image; width is that of the small copy."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, image in images_of(pdf):
                prep, spread = kernels.prepared(image, width)
                out.append({"image_id": i} | kernels.frame_quality(image) | {f"screen_{k}": v for k, v in kernels.fast_screen(image, width).items()} | {"raw_std": spread, "prep_max": float(prep.max())})
            yield pd.DataFrame(out)

    schema = "image_id long, sharpness double, brightness double, contrast double, saturation double, over_pct double, under_pct double, screen_occupancy double, screen_texture double, screen_brightness double, screen_verdict string, raw_std double, prep_max double"
    return images.select("image_id", "height", "width", "pixels").mapInPandas(measured, schema)


def shifts(pairs: DataFrame, reach: int = 6, part: int = 32) -> DataFrame:
    """How far each pair of images (pixels and other) is apart, found in three ways.

    By phase correlation (dx, dy, response), by searching the best correlation of the overlap
    (search_x, search_y, ncc), and by finding the middle of one in the other (match_x, match_y; null below 0.45).
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for (i, ref), other in zip(images_of(pdf), pdf["other"], strict=True):
                cur = np.asarray(other, float).reshape(ref.shape)
                dx, dy, response = kernels.phase_shift(ref, cur)
                x, y, ncc = kernels.best_shift(ref, cur, reach, 1)
                at = kernels.relocate(ref, cur[part // 2 : part // 2 + part, part // 2 : part // 2 + part])
                out.append((i, -round(dx), -round(dy), response, x, y, ncc, *((None, None) if at is None else (at[0] - part // 2, at[1] - part // 2))))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in SHIFTS.split(", ")])
            yield frame.astype({"match_x": "Int64", "match_y": "Int64"})

    return pairs.select("image_id", "height", "width", "pixels", "other").mapInPandas(found, SHIFTS)


SHIFTS = "image_id long, dx long, dy long, response double, search_x long, search_y long, ncc double, match_x long, match_y long"


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches in which equal keys lie together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(key)
        if held and held[-1].column(key)[-1].as_py() != ids[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        missing, values = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((values[1:] != values[:-1]) | (missing[1:] != missing[:-1])) + 1
        for start, end in zip(np.r_[0, cuts].tolist(), np.r_[cuts, batch.num_rows].tolist(), strict=True):
            if held and start:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def fitted_homographies(points: DataFrame) -> DataFrame:
    """For each id's point pairs (x, y, u, v): the inliers of a robust fit and the mean distance that it leaves them. A task walks through ids that lie in order."""

    def fitted(table: pa.Table) -> tuple:
        x, y, u, v = (table.column(c).to_numpy() for c in "xyuv")
        src, dst = np.stack([x, y], axis=1).astype(float), np.stack([u, v], axis=1).astype(float)
        h, inside = kernels.ransac_homography(src, dst)
        error = None if h is None else float(np.hypot(*(kernels.apply_homography(h, src[inside]) - dst[inside]).T).mean())
        spread = kernels.spread_fraction(src[inside], (1080, 1920)) if h is not None else 0.0
        return table.column("id")[0].as_py(), len(src), int(inside.sum()), error, spread

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema({"id": pa.int64(), "n": pa.int64(), "inliers": pa.int64(), "reprojection": pa.float64(), "spread": pa.float64()})
        rows = (fitted(table) for table in _groups(batches, "id"))
        while some := list(islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    return dealt(points.select("id", "x", "y", "u", "v"), "id").sortWithinPartitions("id").mapInArrow(run, "id long, n long, inliers long, reprojection double, spread double")


def region_shapes(runs: DataFrame) -> DataFrame:
    """Perimeter, circularity, solidity, axes, eccentricity and elongation of every labelled region of mask_runs."""

    known: dict[bytes, tuple] = {}  # measures of a shape, wherever it lies

    def measured(y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
        mask = np.zeros((y.max() + 1, b.max()), bool)
        for row, x0, x1 in zip(y, a, b, strict=True):
            mask[row, x0:x1] = True
        corners = np.concatenate([np.stack([x, y + k], axis=1) for x in (a, b) for k in (0, 1)])
        ys, xs = np.nonzero(mask)
        n, length = len(xs), kernels.perimeter(mask)
        vx, vy, cov = xs.var() + 1 / 12, ys.var() + 1 / 12, ((xs - xs.mean()) * (ys - ys.mean())).mean()
        root = np.hypot((vx - vy) / 2, cov)
        major, minor = 4 * np.sqrt((vx + vy) / 2 + root), 4 * np.sqrt(max((vx + vy) / 2 - root, 0))
        circularity = 4 * np.pi * n / length**2 if length > 0 else None
        return n, length, circularity, n / kernels.polygon_area(kernels.convex_hull(corners)), major, minor, np.sqrt(max(0.0, 1 - (minor / major) ** 2)), major / minor if minor > 0 else np.inf

    def shaped(table: pa.Table) -> pa.Table:
        label, *run = (table.column(c).to_numpy() for c in ("label", "row_no", "x0", "x1"))
        order = np.lexsort((run[1], run[0], label))
        label, y, a, b = label[order], *(c[order] for c in run)
        starts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        each = np.diff(np.r_[starts, len(label)])
        top, left = (np.repeat(np.minimum.reduceat(c, starts), each) for c in (y, a))
        runs = np.stack([y - top, a - left, b - left], axis=1)
        out = []
        for at, n in zip(starts.tolist(), each.tolist(), strict=True):
            one = runs[at : at + n]
            key = one.tobytes()
            if key not in known:
                if len(known) >= MOST_SHAPES:
                    known.clear()
                known[key] = measured(*one.T)
            out.append(known[key])
        columns = dict(zip([c.split()[0] for c in SHAPES.split(", ")][2:], zip(*out, strict=True), strict=True))
        types = [c.split()[1] for c in SHAPES.split(", ")][2:]
        image = table.column("image_id")[:1].to_pylist() * len(starts)
        return pa.table({"image_id": pa.array(image, pa.int64()), "label": pa.array(label[starts])} | {c: pa.array(v, pa.int64() if t == "long" else pa.float64()) for (c, v), t in zip(columns.items(), types, strict=True)})

    return runs.groupBy("image_id").applyInArrow(shaped, SHAPES)


#: Different shapes that a task remembers.
MOST_SHAPES = 10_000
SHAPES = "image_id long, label long, area_px long, perimeter double, circularity double, solidity double, axis_major double, axis_minor double, eccentricity double, elongation double"
