"""Pixel kernels in numpy, run inside mapInPandas. Images are 2-D gray or 3-D BGR arrays.

The reference libraries for these are not at hand, so results are tested against definitions
and synthetic cases within tolerances, not bit by bit.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np

#: BT.601 weights of blue, green and red.
GRAY_WEIGHTS = (0.114, 0.587, 0.299)


def gray(image: np.ndarray) -> np.ndarray:
    return image.astype(float) if image.ndim == 2 else image[..., :3].astype(float) @ np.array(GRAY_WEIGHTS)


def frame_quality(image: np.ndarray) -> dict:
    """Sharpness (variance of the Laplacian), brightness, contrast, saturation, over- and under-exposed percent."""
    g = gray(image)
    p = np.pad(g, 1, mode="reflect")
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    top = image.max(axis=2).astype(float) if image.ndim == 3 else g
    low = image.min(axis=2).astype(float) if image.ndim == 3 else g
    saturation = np.divide(255 * (top - low), top, out=np.zeros_like(top), where=top > 0)
    return {"sharpness": laplacian.var(), "brightness": g.mean(), "contrast": g.std(), "saturation": saturation.mean(), "over_pct": 100 * (g >= 250).mean(), "under_pct": 100 * (g <= 5).mean()}


def otsu(image: np.ndarray) -> int:
    """The threshold with the largest variance between the classes below or at it, and above."""
    counts = np.bincount(np.clip(image, 0, 255).astype(int).ravel(), minlength=256).astype(float)
    weight, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    total, mean = weight[-1], mass[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean * weight / total - mass) ** 2 / (weight * (total - weight))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def area_resize(image: np.ndarray, width: int) -> np.ndarray:
    """A gray image scaled to a width, each pixel the mean of the area it covers, as whole numbers."""
    h, w = image.shape
    height = max(1, int(round(h * width / w)))

    def along(values: np.ndarray, size: int) -> np.ndarray:
        total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
        edge = np.linspace(0, len(values), size + 1)
        low = np.minimum(edge.astype(int), len(values) - 1)
        at = total[low] + (edge - low)[:, None] * values[low]
        return np.diff(at, axis=0) / (len(values) / size)

    return np.floor(along(along(image.astype(float), height).T, width).T + 0.5)


def blur(image: np.ndarray) -> np.ndarray:
    """The 5 x 5 binomial blur of a gray image of whole numbers, rounded."""
    taps = np.array([1, 4, 6, 4, 1])
    p = np.pad(image.astype(np.int64), 2, mode="reflect")
    rows = sum(t * p[i : i + image.shape[0]] for i, t in enumerate(taps))
    return (sum(t * rows[:, i : i + image.shape[1]] for i, t in enumerate(taps)) + 128) >> 8


def occupancy(blurred: np.ndarray) -> float:
    """Share of pixels darker than the Otsu threshold."""
    return float((blurred < otsu(blurred)).mean())


def fast_screen(image: np.ndarray, width: int = 480, thick: float = 0.62, thin: float = 0.25) -> dict:
    """Occupancy, texture and brightness of a small blurred copy, and the verdict that occupancy alone gives.

    The edge density of the full screen needs an edge detector that is not at hand; it is left out.
    """
    small = area_resize(gray(image), width)
    soft = blur(small)
    share = occupancy(soft)
    verdict = "CLEARLY_THICK" if share >= thick else "CLEARLY_THIN" if share <= thin else "UNCERTAIN"
    return {"occupancy": share, "texture": float(soft.std()), "brightness": float(small.mean()), "verdict": verdict}


def prepared(image: np.ndarray, width: int = 480) -> tuple[np.ndarray, float]:
    """A small gray copy of mean 0 and deviation 1 (all 0 if flat), and the deviation it had."""
    small = area_resize(gray(image), width)
    spread = float(small.std())
    return (small - small.mean()) / (spread if spread > 1e-6 else 1.0), spread


def stretched(image: np.ndarray) -> np.ndarray:
    """0 to 255 between the 1st and the 99th percentile."""
    low, high = np.percentile(image, 1), np.percentile(image, 99)
    return np.zeros(image.shape, np.uint8) if high - low < 1e-6 else (np.clip((image - low) / (high - low), 0, 1) * 255).astype(np.uint8)


#: The weight of a border pixel by the code of its neighbours (1 itself, 2 beside, 10 diagonal).
PERIMETER_WEIGHTS = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0, 21: 2**0.5, 33: 2**0.5, 13: (1 + 2**0.5) / 2, 23: (1 + 2**0.5) / 2}


def perimeter(mask: np.ndarray) -> float:
    """Length of a region's border, with diagonal steps weighted."""
    p = np.pad(mask.astype(bool), 2)
    border = p[1:-1, 1:-1] & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:])
    b = np.pad(border, 1).astype(int)
    h, w = border.shape
    code = sum((1, 2, 10)[abs(i) + abs(j)] * b[1 + i : 1 + i + h, 1 + j : 1 + j + w] for i in (-1, 0, 1) for j in (-1, 0, 1))
    counts = np.bincount(code[border].ravel(), minlength=64)
    return float(sum(weight * counts[c] for c, weight in PERIMETER_WEIGHTS.items()))


def label_edges(labels: np.ndarray) -> np.ndarray:
    """Pixels whose right or lower neighbour has another label; background follows the last row and column."""
    out = np.zeros(labels.shape, bool)
    out[:, :-1] |= labels[:, :-1] != labels[:, 1:]
    out[:-1] |= labels[:-1] != labels[1:]
    out[:, -1] |= labels[:, -1] != 0
    out[-1] |= labels[-1] != 0
    return out


def spread_fraction(points: np.ndarray, shape: tuple[int, int]) -> float:
    """The share of an image that the hull of some points covers; 0 for fewer than 3."""
    return polygon_area(convex_hull(points)) / (shape[0] * shape[1]) if len(points) >= 3 else 0.0


def phase_shift(ref: np.ndarray, cur: np.ndarray) -> tuple[float, float, float]:
    """dx, dy of cur's content against ref, to a fraction of a pixel, and the peak's height."""
    h, w = ref.shape
    window = np.outer(np.hanning(h), np.hanning(w))
    size = (2 * h, 2 * w)
    a = np.fft.rfft2((ref - ref.mean()) * window, size)
    b = np.fft.rfft2((cur - cur.mean()) * window, size)
    cross = b * np.conj(a)
    surface = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-12), size)
    y, x = np.unravel_index(surface.argmax(), surface.shape)
    ys, xs = np.arange(y - 2, y + 3), np.arange(x - 2, x + 3)
    near = np.maximum(surface[np.ix_(ys % size[0], xs % size[1])], 0)
    total = near.sum()
    if total <= 0:
        return 0.0, 0.0, 0.0
    dy, dx = (near.sum(axis=1) @ ys) / total, (near.sum(axis=0) @ xs) / total
    return float(dx - size[1] * (dx > w)), float(dy - size[0] * (dy > h)), float(total)


def overlap_ncc(ref: np.ndarray, cur: np.ndarray, dx: int, dy: int, least: int = 24) -> float:
    """Normalised correlation of the parts that overlap when cur lies dx, dy from ref; 0 if flat or small."""
    h, w = ref.shape
    x0, x1, y0, y1 = max(0, dx), min(w, w + dx), max(0, dy), min(h, h + dy)
    if x1 - x0 < least or y1 - y0 < least:
        return 0.0
    a = ref[y0:y1, x0:x1] - ref[y0:y1, x0:x1].mean()
    b = cur[y0 - dy : y1 - dy, x0 - dx : x1 - dx]
    b = b - b.mean()
    norm = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / norm) if norm > 1e-9 else 0.0


def best_shift(ref: np.ndarray, cur: np.ndarray, reach: int, step: int = 2) -> tuple[int, int, float]:
    """The shift of highest correlation: every step-th one first, then its surroundings."""
    score = lambda c: (overlap_ncc(ref, cur, *c), -abs(c[0]) - abs(c[1]))
    coarse = max(((x, y) for y in range(-reach, reach + 1, step) for x in range(-reach, reach + 1, step)), key=score)
    fine = max(((coarse[0] + i, coarse[1] + j) for j in range(-step, step + 1) for i in range(-step, step + 1)), key=score)
    return *fine, overlap_ncc(ref, cur, *fine)


def template_match(image: np.ndarray, template: np.ndarray) -> tuple[int, int, float]:
    """x, y and correlation of the template's best place in the image."""
    h, w = template.shape
    if h > image.shape[0] or w > image.shape[1] or template.std() < 1e-9:
        return 0, 0, 0.0
    shape = (image.shape[0] + h, image.shape[1] + w)
    t = template - template.mean()
    dot = np.fft.irfft2(np.fft.rfft2(image, shape) * np.conj(np.fft.rfft2(t, shape)), shape)[: image.shape[0] - h + 1, : image.shape[1] - w + 1]
    total = lambda a: (s := np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))))[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]
    spread = np.sqrt(np.maximum(total(image * image) - total(image) ** 2 / (h * w), 0) * (t * t).sum())
    out = np.divide(dot, spread, out=np.zeros_like(dot), where=spread > 1e-9)
    y, x = np.unravel_index(out.argmax(), out.shape)
    return int(x), int(y), float(out[y, x])


def relocate(image: np.ndarray, template: np.ndarray, least: float = 0.45) -> tuple[int, int, float] | None:
    """template_match, or nothing where its best place is not like the template."""
    x, y, score = template_match(image, template)
    return (x, y, score) if score >= least else None


def first_good(attempt, schedule: list, good, key) -> tuple:
    """Tries the settings of a schedule in order; the first good result ends it, else the best by key wins."""
    best = None
    for setting in schedule:
        result = attempt(setting)
        if good(result):
            return setting, result
        if best is None or key(result) > key(best[1]):
            best = (setting, result)
    return best


def depth(mask: np.ndarray) -> np.ndarray:
    """Distance of every pixel of a region to the nearest one outside; beyond the image is not outside."""
    inside, outside = np.argwhere(mask), np.argwhere(~mask)
    out = np.zeros(mask.shape)
    if not len(outside):
        return np.where(mask, np.inf, 0.0)
    for at in range(0, len(inside), 4096):
        part = inside[at : at + 4096]
        gap = ((part[:, None, :] - outside[None]) ** 2).sum(axis=2).min(axis=1) if len(outside) < 20_000 else np.array([((outside - p) ** 2).sum(axis=1).min() for p in part])
        out[part[:, 0], part[:, 1]] = np.sqrt(gap)
    return out


def smoothed(image: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian blur, cut off at four sigma, mirrored at the edges."""
    reach = int(4 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    taps /= taps.sum()
    for axis in (0, 1):
        p = np.pad(image, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
        image = sum(t * np.take(p, np.arange(i, i + image.shape[axis]), axis=axis) for i, t in enumerate(taps))
    return image


def peak_places(mask: np.ndarray, radius: float) -> np.ndarray:
    """Row and column of the maxima of the smoothed depth: at least 0.45 radius deep, 0.6 radius apart."""
    if not mask.any():
        return np.zeros((0, 2), int)
    soft = smoothed(depth(np.pad(mask, 1))[1:-1, 1:-1], max(1.0, 0.25 * radius))
    apart = max(2, round(0.6 * radius))
    p = np.pad(soft, apart, constant_values=-1.0)
    top = np.max([p[i : i + soft.shape[0], j : j + soft.shape[1]] for i in range(2 * apart + 1) for j in range(2 * apart + 1)], axis=0)
    found = np.argwhere(mask & (soft == top) & (soft >= 0.45 * radius))
    taken: list[np.ndarray] = []
    for place in found[np.argsort(-soft[found[:, 0], found[:, 1]], kind="stable")]:
        if all(np.abs(place - t).max() >= apart for t in taken):
            taken.append(place)
    return np.array(taken, int).reshape(-1, 2)


def distance_peaks(mask: np.ndarray, radius: float) -> int:
    return len(peak_places(mask, radius))


def split_region(mask: np.ndarray, radius: float) -> np.ndarray | None:
    """Labels of a region flooded from its depth's peaks; None where the parts aren't plausible cells.

    Each part must have 0.35 to 2.5 times the area of one cell, and their number must be within one of what
    the whole area holds.
    """
    peaks = peak_places(mask, radius)
    if len(peaks) < 2:
        return None
    deep = depth(np.pad(mask, 1))[1:-1, 1:-1]
    labels = np.zeros(mask.shape, np.int32)
    queue = [(-deep[r, c], n, r, c) for n, (r, c) in enumerate(peaks.tolist())]
    for n, (r, c) in enumerate(peaks.tolist(), 1):
        labels[r, c] = n
    heapq.heapify(queue)
    count = len(queue)
    while queue:
        _, _, r, c = heapq.heappop(queue)
        for y, x in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)):
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not labels[y, x]:
                labels[y, x] = labels[r, c]
                heapq.heappush(queue, (-deep[y, x], count, y, x))
                count += 1
    one = np.pi * radius**2
    areas = np.bincount(labels.ravel())[1:]
    if (areas < 0.35 * one).any() or (areas > 2.5 * one).any() or abs(len(areas) - max(1, round(mask.sum() / one))) > 1:
        return None
    return labels


def convex_hull(points: np.ndarray) -> np.ndarray:
    """The hull's corners, counter-clockwise, by a monotone chain."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts, float)

    def chain(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]), float)


def polygon_area(corners: np.ndarray) -> float:
    x, y = corners[:, 0], corners[:, 1]
    return 0.5 * abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) if len(corners) > 2 else 0.0


def solidity(mask: np.ndarray) -> float:
    """Pixels over the area of the hull of their corners."""
    y, x = np.nonzero(mask)
    if not len(x):
        return 0.0
    corners = np.concatenate([np.stack([x + i, y + j], axis=1) for i in (0, 1) for j in (0, 1)])
    return len(x) / polygon_area(convex_hull(corners))


def quad_iou(a: np.ndarray, b: np.ndarray, shape: tuple[int, int]) -> float:
    """Intersection over union of two convex polygons on a grid of pixel centres."""

    def raster(q: np.ndarray) -> np.ndarray:
        y, x = np.mgrid[: shape[0], : shape[1]] + 0.5
        side = [(q[(i + 1) % len(q)][0] - q[i][0]) * (y - q[i][1]) - (q[(i + 1) % len(q)][1] - q[i][1]) * (x - q[i][0]) for i in range(len(q))]
        return np.all([s >= 0 for s in side], axis=0) | np.all([s <= 0 for s in side], axis=0)

    one, two = raster(a), raster(b)
    union = (one | two).sum()
    return float((one & two).sum() / union) if union else 0.0


def closing(mask: np.ndarray, size: int = 1) -> np.ndarray:
    """Dilation, then erosion, by a square of 2 * size + 1; outside counts as empty."""

    def grow(m: np.ndarray, pad: bool) -> np.ndarray:
        p = np.pad(m, size, constant_values=pad)
        parts = [p[i : i + m.shape[0], j : j + m.shape[1]] for i in range(2 * size + 1) for j in range(2 * size + 1)]
        return np.any(parts, axis=0)

    return ~grow(~grow(mask, False), True)


def _equations(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Two rows for each pair of points (..., n, 2): their product with a transform's 9 numbers is 0."""
    x, y, u, v = src[..., 0], src[..., 1], dst[..., 0], dst[..., 1]
    one, none = np.ones_like(x), np.zeros_like(x)
    rows = np.stack([np.stack([x, y, one, none, none, none, -u * x, -u * y, -u], -1), np.stack([none, none, none, x, y, one, -v * x, -v * y, -v], -1)], -2)
    return rows.reshape(*rows.shape[:-3], -1, 9)


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least-squares 3 x 3 transform of src to dst points (of each set, where they are n, ... sets), with H[2, 2] = 1."""
    rows = _equations(np.asarray(src, float), np.asarray(dst, float))
    h = np.linalg.svd(rows, full_matrices=rows.shape[-2] < 9)[2][..., -1, :].reshape(*rows.shape[:-2], 3, 3)
    return h / h[..., 2:, 2:]


def apply_homography(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = np.c_[points, np.ones(len(points))] @ h.T
    return p[:, :2] / p[:, 2:]


def four_point_homographies(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transforms of 4 points onto 4 (n, 4, 2), up to a factor and without a decomposition; and which of them are certain: no 3 points in a line."""

    def frame(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Areas of the triangles of 3 points and the last one, and whether all are well above rounding."""
        cross = lambda i, j, k: (x[j] - x[i]) * (y[k] - y[i]) - (x[k] - x[i]) * (y[j] - y[i])
        areas = np.stack([cross(3, 1, 2), cross(0, 3, 2), cross(0, 1, 3)])
        least = np.minimum(np.abs(areas).min(axis=0), np.abs(cross(0, 1, 2)))
        return areas, least > 1e-7 * (np.ptp(x, axis=0) ** 2 + np.ptp(y, axis=0) ** 2)

    (x, y), (u, v) = (np.ascontiguousarray(p.transpose(2, 1, 0)) for p in (src, dst))
    (a, a_sure), (b, b_sure) = frame(x, y), frame(u, v)
    weight = b * a[[1, 2, 0]] * a[[2, 0, 1]]
    corners = np.stack([weight * u[:3], weight * v[:3], weight])
    j, k = [1, 2, 0], [2, 0, 1]
    sides = np.stack([y[j] - y[k], x[k] - x[j], x[j] * y[k] - x[k] * y[j]])
    h = np.stack([(corners[r] * sides[c]).sum(axis=0) for r in range(3) for c in range(3)], axis=1)
    return h.reshape(-1, 3, 3), a_sure & b_sure


@functools.lru_cache(64)
def _picks(n: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.array([rng.choice(n, 4, replace=False) for _ in range(rounds)]).reshape(-1, 4)


#: Pairs of a round and a point that are tried at once.
TRIED = 2**17


def ransac_homography(src: np.ndarray, dst: np.ndarray, threshold: float = 3.0, rounds: int = 500, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """A transform that most pairs agree with, refitted on those; and which they are.

    All rounds are tried together. Picks with 3 points in a line have no single transform; for them alone equations are solved.
    """
    n = len(src)
    best = np.zeros(n, bool)
    picks = _picks(n, rounds, seed) if n >= 4 else np.zeros((0, 4), int)
    places = np.stack([src[:, 0], src[:, 1], np.ones(n)])
    step = max(1, TRIED // max(1, n))
    for at in range(0, len(picks), step):
        part = picks[at : at + step]
        with np.errstate(all="ignore"):
            h, sure = four_point_homographies(src[part], dst[part])
            other = np.flatnonzero(~sure)
            other = other[np.isfinite(np.concatenate([src[part[other]], dst[part[other]]], axis=2)).all(axis=(1, 2))]
            if len(other):
                h[other] = homography(src[part[other]], dst[part[other]])
            to = np.swapaxes(h, 0, 1).reshape(-1, 3) @ places
            u, v, w = to.reshape(3, len(part), n)
            u /= w
            u -= dst[:, 0]
            u *= u
            v /= w
            v -= dst[:, 1]
            v *= v
            u += v
            inside = u <= threshold * threshold
        each = np.count_nonzero(inside, axis=1)
        first = int(each.argmax())
        if each[first] > best.sum():
            best = inside[first]
    return (homography(src[best], dst[best]), best) if best.sum() >= 4 else (None, best)
