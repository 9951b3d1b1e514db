"""Features of a field of cells, its suitability score and its class.

The valid region leaves MARGIN of the frame on each side. Undefined features are null: they
score 0 and cast no vote.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomesh.operators import images


@dataclass(frozen=True)
class FieldConfig:
    """The published settings of the classifier and its score."""

    width: int = 1920
    height: int = 1080
    margin: float = 0.10
    contact_margin: float = 0.15
    near_diameters: float = 1.5
    large_cluster: int = 30
    grid: int = 4
    count_min: float = 920
    count_max: float = 1025
    min_signals: int = 2
    thick_coverage: float = 0.45
    thick_degree: float = 1.8
    thick_cluster: float = 0.75
    thin_coverage: float = 0.25
    thin_spacing: float = 1.35
    thick_occupancy: float = 0.55
    score_min: float = 0.60
    density: tuple = (450.0, 560.0, 150.0)
    coverage: tuple = (0.33, 0.42, 0.12)
    spacing: tuple = (0.95, 1.10, 0.30)
    cv_ref: float = 0.25
    weights: dict = field(default_factory=lambda: {"density": 0.25, "coverage": 0.20, "spacing": 0.20, "crowding": 0.15, "clustering": 0.10, "uniformity": 0.10})

    @property
    def roi(self) -> tuple[int, int, int, int]:
        mx, my = round(self.width * self.margin), round(self.height * self.margin)
        return mx, my, self.width - mx, self.height - my


_POINT = ("x", "y", "r", "median_diameter")


def neighbour_features(points: DataFrame, group: str = "image_id") -> DataFrame:
    """Nearest-neighbour distances and edge gaps of each group (points carry r and median_diameter)."""
    return images.by_image(points.select(group, "instance_id", *_POINT), images.neighbours, images.NEIGHBOURS, group)


def contact_ratio(points: DataFrame, margin: float = 0.15, group: str = "image_id") -> DataFrame:
    """Share of points in contact: centres within both radii and a margin of the diameter."""
    return images.by_image(points.select(group, *_POINT), lambda v: images.contacts(v, margin), images.CONTACTS, group)


def degrees(points: DataFrame, near: float = 1.5, group: str = "image_id") -> DataFrame:
    """Close-neighbour counts; forward counts an edge at its smaller end only."""
    return images.by_image(points.select(group, "instance_id", "x", "y", "median_diameter"), lambda v: images.graph(v, near, 1), images.DEGREES, group)


def clusters(points: DataFrame, near: float = 1.5, large: int = 30, group: str = "image_id") -> DataFrame:
    """Components of the close-neighbour graph of each group."""
    return images.by_image(points.select(group, "x", "y", "median_diameter"), lambda v: images.graph(v, near, large), images.CLUSTERS, group)


def image_features(flagged: DataFrame, margin: float = 0.15, group: str = "image_id") -> DataFrame:
    """Counts, spacing and contact of the candidates of each group, all from one pass over its flagged cells."""

    def kernel(v: dict[str, np.ndarray]) -> dict:
        points = {c: a[v["candidate"]] for c, a in v.items()}
        n = len(points["x"])
        return {"n_total": len(v["x"]), "n_candidate": n} | (images.neighbours(points) or {}) | (images.contacts(points, margin) if n else {})

    rows = flagged.select(group, "instance_id", *_POINT, _sure("candidate"))
    return images.by_image(rows, kernel, "n_total long, n_candidate long, nn_median double, gap_median_norm double, contact_ratio double", group)


def _sure(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False)).alias(flag)


def _tri(x: Column, lo: float, hi: float, wing: float) -> Column:
    """1 inside lo..hi, falling to 0 over wing; 0 where x is undefined."""
    inside = F.when((x >= lo) & (x <= hi), 1.0).when(x < lo, F.greatest(F.lit(0.0), 1 - (lo - x) / wing)).otherwise(F.greatest(F.lit(0.0), 1 - (x - hi) / wing))
    return F.when(x.isNull(), 0.0).otherwise(inside)


def field_features(flagged: DataFrame, cfg: FieldConfig = FieldConfig()) -> DataFrame:
    """One row of features for each image of flagged cells, all from one pass over them.

    Coverage is the candidates' area inside the valid region (by centroid) over its area.
    """
    x0, y0, x1, y1 = cfg.roi
    area, g = float((x1 - x0) * (y1 - y0)), cfg.grid

    def kernel(v: dict[str, np.ndarray]) -> dict:
        x, y = v["x"], v["y"]
        points = {c: a[v["candidate"] & (x >= x0) & (x < x1) & (y >= y0) & (y < y1)] for c, a in v.items()}
        n = len(points["x"])
        out = {"n_cells": len(x), "n_candidates": int(v["candidate"].sum()), "diameter": v["median_diameter"].max(), "n_valid": n, "density": n / (area / 1e6)}
        if not n:
            return out
        tx, ty = (np.minimum(g - 1, np.floor((points[c] - lo) * g / (hi - lo))).astype(np.int64) for c, lo, hi in (("x", x0, x1), ("y", y0, y1)))
        k = np.bincount(tx * g + ty)
        mean = n / (g * g)
        out |= {"coverage": points["area"].sum() / area, "density_cv": max(0.0, float((k * k).sum()) / (g * g) - mean * mean) ** 0.5 / mean}
        return out | (images.neighbours(points) or {}) | images.contacts(points, cfg.contact_margin) | images.graph(points, cfg.near_diameters, cfg.large_cluster)

    columns = ["n_cells long, n_candidates long, diameter double, n_valid long, coverage double", images.NEIGHBOURS, images.CONTACTS.removeprefix("n long, "), images.DEGREES, images.CLUSTERS, "density_cv double, density double"]
    return images.by_image(flagged.select("image_id", "instance_id", *_POINT, "area", _sure("candidate")), kernel, ", ".join(columns))


def score(features: DataFrame, cfg: FieldConfig = FieldConfig()) -> DataFrame:
    """The components and their weighted mean, clamped to 0..1."""
    free = lambda c: F.coalesce(1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), F.lit(0.0))
    parts = {
        "density": _tri(F.col("density"), *cfg.density), "coverage": _tri(F.col("coverage"), *cfg.coverage), "spacing": _tri(F.col("nn_median_norm"), *cfg.spacing),
        "crowding": F.when(F.col("contact_ratio").isNull(), 0.0).otherwise(free(F.col("contact_ratio"))),
        "clustering": F.when(F.col("largest_fraction").isNull(), 0.0).otherwise(free(F.col("largest_fraction"))),
        "uniformity": F.when(F.col("density_cv").isNull(), 0.0).otherwise(free(F.col("density_cv") / cfg.cv_ref)),
    }
    out = features.withColumns({f"comp_{k}": v for k, v in parts.items()})
    total = sum(cfg.weights[k] * F.col(f"comp_{k}") for k in parts) / sum(cfg.weights.values())
    return out.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def classify(scored: DataFrame, cfg: FieldConfig = FieldConfig(), occupancy: Column | None = None) -> DataFrame:
    """thick_signals, thin_signals and class; a mostly dark frame is thick whatever else holds."""
    votes = lambda *c: sum(F.coalesce(x, F.lit(False)).cast("int") for x in c)
    n = F.col("n_candidates")
    thick = votes(n > cfg.count_max, F.col("coverage") > cfg.thick_coverage, F.col("mean_degree") > cfg.thick_degree, F.col("largest_fraction") > cfg.thick_cluster)
    thin = votes(n < cfg.count_min, F.col("coverage") < cfg.thin_coverage, F.col("nn_median_norm") > cfg.thin_spacing)
    gross = F.lit(False) if occupancy is None else F.coalesce(occupancy >= cfg.thick_occupancy, F.lit(False))
    out = scored.withColumn("thick_signals", thick).withColumn("thin_signals", thin)
    named = F.when(gross | (F.col("thick_signals") >= cfg.min_signals), "TOO_THICK").when(F.col("thin_signals") >= cfg.min_signals, "TOO_THIN")
    return out.withColumn("class", named.when((F.col("score") >= cfg.score_min) & (n >= cfg.count_min) & (n <= cfg.count_max), "MONOLAYER").otherwise("UNCERTAIN"))
