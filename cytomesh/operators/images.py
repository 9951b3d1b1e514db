"""Cells of one image in numpy: nearest neighbours, pairs at most a distance apart, components.

One task holds an image's columns and some pairs at once (sessions.PAIRS); no pair is shuffled or written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cytomesh.operators.sessions import FINER, MANY, Grid


def by_image(rows: DataFrame, kernel: Callable[[dict[str, np.ndarray]], dict | None], schema: str, group: str = "image_id") -> DataFrame:
    """A row of the schema's columns for each image, from kernel over its columns by instance_id (if there is one); None: no row.

    Rows that lie by images already are not shuffled again. Points of a missing image have no neighbours: their places are nan.
    """
    types = [c.split() for c in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        v = {c: table.column(c).to_numpy() for c in table.column_names if c != group}
        if "instance_id" in v:
            order = np.argsort(v["instance_id"], kind="stable")
            v = {c: a[order] for c, a in v.items()}
        if table.column(group)[0].as_py() is None:
            v |= {c: np.full(len(table), np.nan) for c in ("x", "y")}
        found = kernel(v)
        out = {group: table.column(group)[: found is not None].combine_chunks()}
        for c, t in types:
            value = [] if found is None else [found.get(c)]
            out[c] = pa.array([None if a is None or a != a else a for a in value], pa.int64() if t == "long" else pa.float64())
        return pa.table(out)

    return rows.groupBy(group).applyInArrow(run, f"{group} {dict(rows.dtypes)[group]}, {schema}")


def _finite(*columns: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.all([np.isfinite(c) for c in columns], axis=0))


def nearest(x: np.ndarray, y: np.ndarray, tx: np.ndarray, ty: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distance (nan: none) and number (-1) of each place's nearest target; ties go to the smaller number.

    own: the places are the targets, and none is its own. Cells hold about two targets; places without a target as near as
    a cell's side go on in cells of four times the side, crowded ones try finer cells first.
    """
    d, at = np.full(len(x), np.nan), np.full(len(x), -1)
    sure, todo = _finite(tx, ty), _finite(x, y)
    if len(sure) < 1 + own:
        return d, at
    order = sure[np.lexsort((sure, ty[sure], tx[sure]))]
    new = np.r_[True, (tx[order][1:] != tx[order][:-1]) | (ty[order][1:] != ty[order][:-1])]
    first = order[new]  # of targets at one place the first stands for all
    if own:
        each = np.diff(np.r_[np.flatnonzero(new), len(order)])
        many = np.repeat(each > 1, each)
        d[order[many]], at[order[many]] = 0.0, np.repeat(first, each)[many]
        at[first[each > 1]] = order[np.flatnonzero(new)[each > 1] + 1]
        todo = np.sort(first[each == 1])
    if len(first) < 1 + own:
        return d, at
    first = np.sort(first)
    px, py = tx[first], ty[first]

    def look(todo: np.ndarray, side: float, finer: int) -> np.ndarray:
        """Compare with all in the windows; returns the places for which something beyond could be nearer."""
        grid = Grid(px, py, side, side)
        lo, hi = grid.window(x[todo], y[todo])
        heavy = (hi - lo).sum(axis=1) > MANY
        if finer and heavy.any():
            left = np.zeros(len(x), bool)
            left[look(todo[heavy], side / 4, finer - 1)] = True
            keep = ~heavy | left[todo]
            todo, lo, hi, heavy = todo[keep], lo[keep], hi[keep], heavy[keep]
        for i, k in grid.pairs(lo, hi):
            i, k = todo[i], first[k]
            if own:
                other = i != k
                i, k = i[other], k[other]
            if not len(i):
                continue
            dx, dy = x[i] - tx[k], y[i] - ty[k]
            far = np.sqrt(dx * dx + dy * dy)
            starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            who, least = i[starts], np.minimum.reduceat(far, starts)
            number = np.minimum.reduceat(np.where(far == np.repeat(least, np.diff(np.r_[starts, len(i)])), k, len(tx)), starts)
            better = ~(d[who] <= least) | ((d[who] == least) & (number < at[who]))
            d[who[better]], at[who[better]] = least[better], number[better]
        return todo[~(d[todo] <= min(grid.rx, grid.ry) * (1 - 1e-9))]

    side, finer = max(1e-6, 1.4 * (max(1e-6, float(np.ptp(px)) * float(np.ptp(py))) / len(first)) ** 0.5), FINER
    while len(todo):
        todo, side, finer = look(todo, side, finer), 4 * side, 0
    return d, at


def pairs_near(x: np.ndarray, y: np.ndarray, radius: float, few: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers and distance of points at most radius apart, some pairs at once: each pair i < k, or each of a few with every other."""
    sure = _finite(x, y)
    mine = sure if few is None else np.intersect1d(few, sure)
    if not len(mine) or not radius >= 0:
        return
    side = radius * (1 + 1e-9)
    grid = Grid(x[sure], y[sure], side, side)
    for i, k in grid.pairs(*grid.window(x[mine], y[mine])):
        i, k = mine[i], sure[k]
        one = i < k if few is None else i != k
        i, k = i[one], k[one]
        dx, dy = x[i] - x[k], y[i] - y[k]
        d = np.sqrt(dx * dx + dy * dy)
        near = d <= radius
        yield i[near], k[near], d[near]


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root (each point's smallest known number of its component) with the edges a, b: minima and pointer jumping."""
    while (root[a] != root[b]).any():
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root[root] != root).any():
            root = root[root]
    return root


# ---- kernels over the sorted columns of an image
def _at(values: np.ndarray, *shares: float) -> list[float | None]:
    values = values[~np.isnan(values)]
    return np.quantile(values, shares).tolist() if len(values) else [None] * len(shares)


def _over(value: float | None, size: float) -> float | None:
    return value / size if value is not None and size else None


def neighbours(v: dict[str, np.ndarray]) -> dict | None:
    """Nearest-neighbour distances and edge gaps; an image of one point has none."""
    x, y, r = v["x"], v["y"], v["r"]
    if len(x) < 2:
        return None
    d, at = nearest(x, y, x, y, own=True)
    gap, known = d - r - r[at], d[~np.isnan(d)]
    p10, p25, p50, p75, p90 = _at(d, 0.1, 0.25, 0.5, 0.75, 0.9)
    (middle,), size = _at(gap, 0.5), float(np.max(v["median_diameter"]))
    return {
        "n_nn": len(x), "nn_median": p50, "nn_mean": known.mean() if len(known) else None, "nn_std": known.std() if len(known) else None, "nn_p10": p10, "nn_p25": p25, "nn_p75": p75, "nn_p90": p90,
        "nn_median_norm": _over(p50, size), "gap_median": middle, "gap_median_norm": _over(middle, size),
    }


NEIGHBOURS = "n_nn long, nn_median double, nn_mean double, nn_std double, nn_p10 double, nn_p25 double, nn_p75 double, nn_p90 double, nn_median_norm double, gap_median double, gap_median_norm double"

#: Cells of more than so many median radii are compared apart, so that one of them doesn't widen every comparison.
WIDE = 1.5


def contacts(v: dict[str, np.ndarray], margin: float) -> dict:
    """Points in contact: centres within both radii and a margin of the diameter."""
    x, y, r, diameter = (v[c].astype(float) for c in ("x", "y", "r", "median_diameter"))
    hit = np.zeros(len(x), bool)
    sure = _finite(x, y, r, diameter)
    if len(sure):
        x, y, r, diameter = x[sure], y[sure], r[sure], diameter[sure]
        cap, more, touched = WIDE * float(np.median(r)), margin * float(diameter.max()), np.zeros(len(sure), bool)
        plain, wide = np.flatnonzero(r <= cap), np.flatnonzero(r > cap)
        among = ((plain[i], plain[k], d) for i, k, d in pairs_near(x[plain], y[plain], 2 * cap + more))
        beside = pairs_near(x, y, 2 * float(r.max()) + more, wide) if len(wide) else ()
        for pairs in (among, beside):
            for i, k, d in pairs:
                touch = d <= r[i] + r[k] + margin * diameter[i]
                touched[i[touch]] = touched[k[touch]] = True
        hit[sure] = touched
    return {"n": len(hit), "n_contact": int(hit.sum()), "contact_ratio": hit.mean() if len(hit) else None}


CONTACTS = "n long, n_contact long, contact_ratio double"


def graph(v: dict[str, np.ndarray], near: float, large: int) -> dict:
    """Close-neighbour counts (forward counts an edge at its smaller end only) and components of the points within some diameters."""
    n = len(v["x"])
    degree, forward, root = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    for i, k, _ in pairs_near(v["x"], v["y"], near * float(np.max(v["median_diameter"]))):
        forward += np.bincount(i, minlength=n)
        degree += np.bincount(i, minlength=n) + np.bincount(k, minlength=n)
        root = unite(root, i, k)
    size = np.bincount(root, minlength=n)
    size = size[size > 0]
    big = size[size >= 2]
    share = lambda c: 100 * float(c.mean())
    return {
        "pct_0": share(degree == 0), "pct_1": share(degree == 1), "pct_2": share(degree == 2), "pct_3plus": share(degree >= 3), "mean_degree": degree.mean(), "median_degree": np.median(degree),
        "graph_isolated_pct": share(forward == 0), "graph_mean_degree": forward.mean(),
        "n_clusters": len(size), "largest": int(size.max()), "median_cluster": np.median(big) if len(big) else 0.0, "isolated_pct": share(size == 1), "largest_fraction": size.max() / n,
        "clustered_pct": 100 * big.sum() / n, "large_pct": 100 * size[size >= large].sum() / n,
    }


DEGREES = "pct_0 double, pct_1 double, pct_2 double, pct_3plus double, mean_degree double, median_degree double, graph_isolated_pct double, graph_mean_degree double"
CLUSTERS = "n_clusters long, largest long, median_cluster double, isolated_pct double, largest_fraction double, clustered_pct double, large_pct double"


def matches(v: dict[str, np.ndarray]) -> dict | None:
    """Cells without r matched to the nearest one with r: a match lies within 0.75 of the median r, 2 at least."""
    x, y, r = v["x"], v["y"], v["r"].astype(float)
    to = ~np.isnan(r)
    if to.all() or not to.any():
        return None
    d = nearest(x[~to], y[~to], x[to], y[to])[0].round(6)
    hit = d <= max(2.0, 0.75 * float(np.median(r[to])))
    return {"n_parent": int(to.sum()), "n_child": len(d), "n_matched": int(hit.sum()), "match_pct": 100 * int(hit.sum()) / len(d), "median_error": _at(d[hit], 0.5)[0]}


MATCHES = "n_parent long, n_child long, n_matched long, match_pct double, median_error double"
