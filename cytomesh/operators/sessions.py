"""Fields of one session against the fields before them, in numpy.

One task holds a session (64 bytes a field). Nothing here compares all pairs of a session: fields are looked up in grids,
among blocks of a power of two of the fields before (so that a search can stop once enough is found), and a map that is
covered already is not cut again. Where all pairs are asked for (links), a task holds a tile of a session's map and a batch of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pairs that are held at once.
PAIRS = 2_000_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys, over a fixed number of partitions: small rows with much work are not put together into few tasks."""
    return df.repartition(max(200, 4 * df.sparkSession.sparkContext.defaultParallelism), *keys)


def by_session(rows: DataFrame, kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str, group: str = "session_id", order: str | None = "job_id") -> DataFrame:
    """kernel over the columns of each session in order; a missing session has no fields to compare with (its columns hold "lone")."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order) if order else table
        columns = {c: table.column(c).to_numpy() for c in table.column_names if c != group}
        out = kernel(columns | {"lone": np.array(table.column(group)[0].as_py() is None)})
        n = len(next(iter(out.values())))
        return pa.table({group: pa.array([table.column(group)[0].as_py()] * n, table.schema.field(group).type)} | {c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in out.items()})

    return dealt(rows, group).groupBy(group).applyInArrow(run, schema)


class Grid:
    """Points in cells of sides rx, ry, block by block; windows are 3 x 3 cells about a place."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rx: float, ry: float, block: np.ndarray | None = None):
        self.x0, self.y0 = x.min(), y.min()
        self.rx, self.ry = max(rx, (x.max() - self.x0) / 2**18, 1e-9), max(ry, (y.max() - self.y0) / 2**18, 1e-9)
        gx, gy = self._cell(x, y)
        self.nx, self.ny = int(gx.max()) + 3, int(gy.max()) + 3
        key = ((0 if block is None else block) * self.ny + gy) * self.nx + gx
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]

    def _cell(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.floor(np.clip((x - self.x0) / self.rx, -2, 2**19)).astype(np.int64) + 2, np.floor(np.clip((y - self.y0) / self.ry, -2, 2**19)).astype(np.int64) + 2

    def window(self, x: np.ndarray, y: np.ndarray, block: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) in order of the three rows of each window."""
        gx, gy = self._cell(x, y)
        gx, gy = np.minimum(gx, self.nx - 1), np.minimum(gy, self.ny - 1)
        row = gy[:, None] + np.array([-1, 0, 1])
        base = ((np.asarray(block)[..., None] * self.ny) + row) * self.nx + gx[:, None]
        lo, hi = np.searchsorted(self.key, base - 1), np.searchsorted(self.key, base + 1, "right")
        outside = (row < 0) | (row >= self.ny)
        return np.where(outside, 0, lo), np.where(outside, 0, hi)

    def pairs(self, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows' numbers, in order, and the points in them, PAIRS or one window at once."""
        each = (hi - lo).sum(axis=1)
        ends = np.cumsum(each)
        at = 0
        while at < len(each):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            first, n = lo[at:to].ravel(), (hi[at:to] - lo[at:to]).ravel()
            total = int(n.sum())
            if total:
                places = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)
                yield np.repeat(np.arange(at, to), each[at:to]), self.order[places]
            at = to


def earlier(x: np.ndarray, y: np.ndarray, before: np.ndarray, px: np.ndarray, py: np.ndarray, rx: float, ry: float, open_: np.ndarray) -> Iterator[tuple[int, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Pairs of places and points at most rx, ry apart or a little more, the points among the first before[i].

    Comes in blocks of points, the newest and smallest first; places that are no longer open are left out.
    """
    place = np.arange(len(px))
    for level in range(int(before.max(initial=0)).bit_length()):
        chosen = np.flatnonzero(open_ & ((before >> level) & 1 == 1))
        if not len(chosen):
            continue
        few = np.flatnonzero((place >> level) & 1 == 0)
        grid = Grid(px[few], py[few], rx, ry, few >> (level + 1))
        lo, hi = grid.window(x[chosen], y[chosen], before[chosen] >> (level + 1))
        yield level, ((chosen[i], few[k]) for i, k in grid.pairs(lo, hi))


def _shared(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Common area of boxes (x0, y0, x1, y1)."""
    return np.maximum(0.0, np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])) * np.maximum(0.0, np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]))


def boxes(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.stack([x - w / 2, y - h / 2, x + w / 2, y + h / 2])


def _subtract(rest: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Disjoint rectangles (one a column) without the box."""
    hit = (rest[0] < box[2]) & (rest[2] > box[0]) & (rest[1] < box[3]) & (rest[3] > box[1])
    if not hit.any():
        return rest
    old = rest[:, hit]
    low, high = np.maximum(old[1], box[1]), np.minimum(old[3], box[3])
    new = np.concatenate([
        np.stack([old[0], old[1], old[2], low]), np.stack([old[0], high, old[2], old[3]]),
        np.stack([old[0], low, np.minimum(old[2], box[0]), high]), np.stack([np.maximum(old[0], box[2]), low, old[2], high]),
    ], axis=1)
    return np.concatenate([rest[:, ~hit], new[:, (new[2] > new[0]) & (new[3] > new[1])]], axis=1)


def adding(b: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Numbers of the boxes that cover ground of the tile which none before them covers."""
    rest, out = tile[:, None], []
    for at in range(0, b.shape[1], 512):
        part = b[:, at : at + 512, None]
        r = rest[:, None]
        for i in np.flatnonzero(((r[0] < part[2]) & (r[2] > part[0]) & (r[1] < part[3]) & (r[3] > part[1])).any(axis=1)):
            left = _subtract(rest, b[:, at + i])
            if left is not rest:
                rest = left
                out.append(at + i)
        if not rest.shape[1]:
            break
    return np.array(out, np.int64)


#: Tiles of the map, in sides of the largest box: a box is in 4 of them at most.
TILE = 4.0


def tiled(b: np.ndarray, side: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tiles (row and column as one number) and of the boxes in them, by tile and then in order."""
    c = [np.floor(b[k] / side[k % 2]).astype(np.int64) for k in range(4)]
    number = np.arange(b.shape[1])
    tiles, whose = [], []
    for i in range(int((c[2] - c[0]).max(initial=0)) + 1):
        for j in range(int((c[3] - c[1]).max(initial=0)) + 1):
            there = (c[0] + i <= c[2]) & (c[1] + j <= c[3])
            tiles.append(((c[1] + j) * 2**31 + c[0] + i)[there])
            whose.append(number[there])
    tiles, whose = np.concatenate(tiles), np.concatenate(whose)
    order = np.lexsort((whose, tiles))
    return tiles[order], whose[order]


def tile_box(tile: int, side: tuple[float, float]) -> np.ndarray:
    row, column = (tile + 2**30) >> 31, (tile + 2**30) % 2**31 - 2**30
    return np.array([column * side[0], row * side[1], (column + 1) * side[0], (row + 1) * side[1]])


def outline(b: np.ndarray) -> np.ndarray:
    """Numbers of boxes whose union is that of all."""
    b = np.asarray(b, float)
    solid = np.flatnonzero((b[2] > b[0]) & (b[3] > b[1]))
    if not len(solid):
        return solid
    s = b[:, solid]
    side = (TILE * float((s[2] - s[0]).max()), TILE * float((s[3] - s[1]).max()))
    tiles, whose = tiled(s, side)
    cuts = np.flatnonzero(np.r_[True, tiles[1:] != tiles[:-1], True])
    found = [whose[a:z][adding(s[:, whose[a:z]], tile_box(int(tiles[a]), side))] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    return solid[np.unique(np.concatenate(found))]


def united(c: np.ndarray, before: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each box of c, how much of it the union of the first before[i] boxes of b covers."""
    out = np.zeros(c.shape[1])
    if not b.shape[1] or not c.shape[1]:
        return out
    both = np.concatenate([b, c], axis=1)
    side = (max(1e-9, TILE * float((both[2] - both[0]).max())), max(1e-9, TILE * float((both[3] - both[1]).max())))
    tiles, whose = tiled(b, side)
    c_tiles, c_whose = tiled(c, side)
    for a, z in _ranges(c_tiles):
        tile = int(c_tiles[a])
        first, last = np.searchsorted(tiles, [tile, tile + 1])
        if first == last:
            continue
        ground, there = tile_box(tile, side), whose[first:last]
        new = there[adding(b[:, there], ground)]
        mine = c_whose[a:z]
        stage = np.searchsorted(new, before[mine])
        order = np.argsort(stage, kind="stable")
        mine, stage = mine[order], stage[order]
        clip = np.stack([np.maximum(c[0, mine], ground[0]), np.maximum(c[1, mine], ground[1]), np.minimum(c[2, mine], ground[2]), np.minimum(c[3, mine], ground[3])])
        area = np.maximum(0.0, clip[2] - clip[0]) * np.maximum(0.0, clip[3] - clip[1])
        rest, done = ground[:, None], 0
        for p, q in _ranges(stage):
            while done < stage[p]:
                rest = _subtract(rest, b[:, new[done]])
                done += 1
            if done:
                for at in range(p, q, 4096):
                    to = min(q, at + 4096)
                    out[mine[at:to]] += area[at:to] - _shared(tuple(clip[:, at:to, None]), tuple(rest[:, None])).sum(axis=1)
    return out


def _ranges(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True])
    return zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if len(values) else iter(())


#: Windows with more points are tried in finer cells first.
MANY, FINER = 256, 8


def best_and_gap(c: tuple[np.ndarray, ...], before: np.ndarray, p: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place (x, y, w, h): the largest overlap with one of the first before[i] fields of p, that field's number (-1: none),
    and the distance of the nearest one (nan: none before). Equal overlaps go to the smaller number.
    """
    n = len(before)
    best, at, gap = np.zeros(n), np.full(n, -1), np.full(n, np.nan)
    order = np.lexsort((np.arange(len(p[0])), *p))
    same = np.r_[False, np.all([v[order][1:] == v[order][:-1] for v in p], axis=0)] if len(order) else np.zeros(0, bool)
    first = np.sort(order[~same])  # of fields at one place the first serves all after it
    before = np.searchsorted(first, before)
    p = tuple(v[first] for v in p)
    cb, pb = boxes(*c), boxes(*p)
    for level in range(int(before.max(initial=0)).bit_length()):
        mine = np.flatnonzero((before >> level) == 1)
        if not len(mine):
            continue
        m = min(len(first), 2 ** (level + 1))
        w_most, h_most = float(p[2][:m].max()), float(p[3][:m].max())
        wide, high = np.ptp(p[0][:m]) + 1e-6, np.ptp(p[1][:m]) + 1e-6
        w, h = c[2], c[3]

        def look(todo: np.ndarray, rx: float, ry: float, finer: int, overlap: bool) -> np.ndarray:
            """Compare with all in the windows; returns those for which something beyond could be better."""
            grid = Grid(p[0][:m], p[1][:m], rx, ry)
            lo, hi = grid.window(c[0][todo], c[1][todo])
            heavy = (hi - lo).sum(axis=1) > MANY
            if overlap and finer and heavy.any():
                left = np.zeros(n, bool)
                left[look(todo[heavy], rx / 4, ry / 4, finer - 1, overlap)] = True
                keep = ~heavy | left[todo]
                todo, lo, hi = todo[keep], lo[keep], hi[keep]
            for i, k in grid.pairs(lo, hi):
                i = todo[i]
                known = k < before[i]
                i, k = i[known], k[known]
                if not len(i):
                    continue
                starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                who, size = i[starts], np.diff(np.r_[starts, len(i)])
                a, b = cb[:, i], pb[:, k]
                if overlap:
                    area = _shared(tuple(a), tuple(b))
                    most = np.maximum.reduceat(area, starts)
                    least = np.minimum.reduceat(np.where((area == np.repeat(most, size)) & (area > 0), k, len(first)), starts)
                    better = (most > best[who]) | ((most == best[who]) & (most > 0) & (least < at[who]))
                    best[who[better]], at[who[better]] = most[better], least[better]
                else:
                    far = np.hypot(np.maximum(0.0, np.maximum(b[0] - a[2], a[0] - b[2])), np.maximum(0.0, np.maximum(b[1] - a[3], a[1] - b[3])))
                    gap[who] = np.fmin(gap[who], np.minimum.reduceat(far, starts))
            mw, mh = (w[todo] + w_most) / 2, (h[todo] + h_most) / 2
            if overlap:
                lw, lh = np.minimum(w[todo], w_most), np.minimum(h[todo], h_most)
                beyond = np.maximum(np.clip(mw - grid.rx, 0, lw) * lh, np.clip(mh - grid.ry, 0, lh) * lw)
                return todo[(beyond > 0) & ~(best[todo] > beyond * (1 + 1e-9))]
            beyond = np.minimum(grid.rx - mw, grid.ry - mh)
            whole = (grid.rx >= wide) & (grid.ry >= high) & (np.abs(c[0][todo] - p[0][0]) < grid.rx - wide) & (np.abs(c[1][todo] - p[1][0]) < grid.ry - high)
            return todo[~(gap[todo] <= beyond) & ~whole]

        s = min(1.0, (1.5 * wide * high / (m * max(1e-9, w_most * h_most))) ** 0.5)
        todo = mine[np.isfinite(c[0][mine]) & np.isfinite(c[1][mine])]
        rx, ry = max(1e-6, s * w_most), max(1e-6, s * h_most)
        while len(todo):
            todo = look(todo, rx, ry, FINER, True)
            rx, ry = 2 * rx, 2 * ry
        todo = mine[best[mine] <= 0]
        todo = todo[np.isfinite(c[0][todo]) & np.isfinite(c[1][todo])]
        rx, ry = 4 * max(1e-6, w_most), 4 * max(1e-6, h_most)
        while len(todo):
            todo = look(todo, rx, ry, 0, False)
            rx, ry = 4 * rx, 4 * ry
        gap[mine[best[mine] > 0]] = 0.0
    at[at >= 0] = first[at[at >= 0]]
    return best, at, gap


# ---- all pairs that overlap, by tiles of the map
#: Sides of a tile in sides of a session's largest field, fields in a cell and most cells in a field's side; pairs compared and given out at once.
SIDES, CROWD, CELLS, COMPARED, GIVEN = 2, 32, 16, 2**15, 2**18


def tiles(fields: DataFrame) -> DataFrame:
    """fields (session_id, x, y, w, h, mono) with tx, ty and home: each in the tile of its place, those with mono in all tiles that a field's side reaches too."""
    session = Window.partitionBy("session_id")
    known = fields.where("session_id is not null and x is not null and y is not null and w is not null and h is not null")
    known = known.withColumns({"_w": F.greatest(F.max("w").over(session), F.lit(1e-9)), "_h": F.greatest(F.max("h").over(session), F.lit(1e-9))})
    cell = lambda place, side, reach: f"cast(floor(({place} {reach}) / ({SIDES}D * {side})) as long)"
    for t, place, side in (("tx", "x", "_w"), ("ty", "y", "_h")):
        known = known.withColumn(t, F.expr(f"explode(if(mono, sequence({cell(place, side, f'- {side}')}, {cell(place, side, f'+ {side}')}), array({cell(place, side, '')})))"))
    return known.withColumn("home", F.expr(f"tx = {cell('x', '_w', '')} and ty = {cell('y', '_h', '')}")).drop("_w", "_h")


def links(a: dict[str, np.ndarray], b: dict[str, np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Fields of b that share at least this part (above 0) of the smaller of both with a field of a, job_id's own left out.

    Gives fields of a, how many each has, their numbers in b and the parts, for a cell or less at once. A field of a may come several times.
    """
    if not len(a["x"]) or not len(b["x"]):
        return
    wide, high, small = float(b["w"].max()), float(b["h"].max()), float((b["w"] * b["h"]).min())
    left, top = float(b["x"].min()), float(b["y"].min())
    most_w, most_h = max(wide, float(a["w"].max())), max(high, float(a["h"].max()))
    if not most_w > 0 or not most_h > 0:
        return
    cells = max(1.0, np.ptp(a["x"]) / most_w) * max(1.0, np.ptp(a["y"]) / most_h)
    cut = min(float(CELLS), max(1.0, np.sqrt(len(a["x"]) / CROWD / cells)))
    band = most_h / cut
    row = np.floor((b["y"] - top) / band)
    order = np.lexsort((b["x"], row))
    b_x = b["x"][order]
    rows, starts = np.unique(row[order], return_index=True)
    ends = np.r_[starts[1:], len(order)]
    (bx0, by0, bx1, by1), b_area, b_job = boxes(*(b[k][order] for k in "xywh")), (b["w"] * b["h"])[order], b["job_id"][order]
    (ax0, ay0, ax1, ay1), a_area = boxes(*(a[k] for k in "xywh")), a["w"] * a["h"]
    cx, cy = np.floor((a["x"] - left) / (most_w / cut)), np.floor((a["y"] - top) / band)
    by_cell = np.lexsort((cx, cy))
    room = np.empty((3, COMPARED))
    for p, q in _ranges(cy[by_cell] + 1j * cx[by_cell]):
        mine = by_cell[p:q]
        x, y = a["x"][mine], a["y"][mine]
        x0, x1, w, h = float(x.min()), float(x.max()), float(a["w"][mine].max()), float(a["h"][mine].max())
        # the part asked for limits how far apart two fields can be along x, given how far apart they are along y; a little is added for rounding
        first, last = np.searchsorted(rows, [np.floor((y.min() - (h + high) / 2 - top) / band) - 1, np.floor((y.max() + (h + high) / 2 - top) / band) + 1])
        last = min(len(rows), last + 1)
        near = np.maximum(0.0, np.maximum(rows[first:last] * band + top - y.max(), y.min() - (rows[first:last] + 1) * band - top))
        tall = np.minimum(min(h, high), (h + high) / 2 - near + 1e-6 * band)
        reach = np.where(tall > 0, (w + wide) / 2 - least * min(float(a_area[mine].min()), small) / np.maximum(tall, 1e-300) * (1 - 1e-9) + 1e-6 * most_w, -1.0)
        found = [np.zeros(0, np.int64)]
        for s, e, r in zip(starts[first:last].tolist(), ends[first:last].tolist(), reach.tolist(), strict=True):
            if r >= 0:
                lo, hi = np.searchsorted(b_x[s:e], (x0 - r, x1 + r))
                found.append(np.arange(s + lo, min(e, s + hi + 1)))
        k = np.concatenate(found)
        for b_at in range(0, len(k), COMPARED):
            c = k[b_at : b_at + COMPARED]
            c0, c1, d0, d1, size, job = bx0[c], bx1[c], by0[c], by1[c], b_area[c], b_job[c]
            step = max(1, COMPARED // len(c))
            for at in range(0, len(mine), step):
                m = mine[at : at + step]
                part, other, third = (r[: len(m) * len(c)].reshape(len(m), len(c)) for r in room)
                np.minimum(ax1[m, None], c1, out=part)
                part -= np.maximum(ax0[m, None], c0, out=other)
                np.maximum(part, 0.0, out=part)
                np.minimum(ay1[m, None], d1, out=other)
                other -= np.maximum(ay0[m, None], d0, out=third)
                np.maximum(other, 0.0, out=other)
                part *= other
                np.minimum(a_area[m, None], size, out=other)
                with np.errstate(divide="ignore", invalid="ignore"):
                    part /= other
                hit = part >= least
                hit &= a["job_id"][m, None] != job
                at_hit = np.flatnonzero(hit)
                yield m, np.count_nonzero(hit, axis=1), np.tile(order[c], len(m)).take(at_hit), part.ravel().take(at_hit)


def four_digits(v: np.ndarray) -> np.ndarray:
    """round(v, 4) of numbers from 0 to 1."""
    return np.floor(v * 1e4 + 0.5) / 1e4


LINKS = "session_id long, job_id long, affirms boolean, weight int, footprint array<bigint>, overlap array<double>"


def layer_links(fields: DataFrame, least: float = 0.25) -> DataFrame:
    """session_id, job_id, affirms (the field's mono), weight, footprint and overlap: each pair of a field and another one with mono that shares
    this part of the smaller. A task holds a tile; a field's links leave it in lists of some thousands, which are made rows by Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        v = {c: table.column(c).to_numpy() for c in ("job_id", "x", "y", "w", "h", "mono", "home", "weight")}
        a, b = ({c: v[c][v[k].astype(bool)] for c in v} for k in ("home", "mono"))
        session, schema = table.column("session_id")[0].as_py(), pa.schema({"session_id": pa.int64(), "job_id": pa.int64(), "affirms": pa.bool_(), "weight": pa.int32(), "footprint": pa.list_(pa.int64()), "overlap": pa.list_(pa.float64())})
        held: list[tuple[np.ndarray, ...]] = []

        def batch() -> pa.RecordBatch:
            m, n, k, part = (np.concatenate(c) for c in zip(*held, strict=True))
            m, n = m[n > 0], n[n > 0]
            at = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(c)) for c in (b["job_id"][k], four_digits(part))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(m), session)), pa.array(a["job_id"][m]), pa.array(a["mono"][m].astype(bool)), pa.array(a["weight"][m].astype(np.int32)), *lists], schema=schema)

        size = 0
        for one in links(a, b, least):
            held.append(one)
            size += len(one[2]) + len(one[0])
            if size >= GIVEN:
                yield batch()
                size = 0
        if held:
            yield batch()

    keys = ("session_id", "tx", "ty")
    pairs = dealt(tiles(fields), *keys).groupBy(*keys).applyInArrow(run, LINKS)
    return pairs.select("session_id", "job_id", "affirms", "weight", F.posexplode("footprint").alias("_at", "footprint"), F.col("overlap").alias("_parts")).selectExpr(
        "session_id", "job_id", "footprint", "affirms", "weight", "_parts[_at] as overlap")


# ---- kernels over the sorted columns of a session
def coverage(v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """job_id, a and o (largest overlap with an earlier field, and whose), u (area under the earlier ones) and gap of each row with new; rows with old are the earlier ones."""
    new = np.flatnonzero(v["new"])
    place = [v[k].astype(float) for k in "xywh"]
    sure = np.isfinite(place).all(axis=0)
    old = np.flatnonzero(v["old"].astype(bool) & sure & ~v["lone"])
    c, p, ids = tuple(k[new] for k in place), tuple(k[old] for k in place), v["job_id"][old]
    before = np.where(sure[new], np.searchsorted(ids, v["job_id"][new]), 0)
    best, at, gap = best_and_gap(c, before, p)
    cut = np.flatnonzero(before > 0)
    under = np.zeros(len(new))
    under[cut] = united(boxes(*(k[cut] for k in c)), before[cut], boxes(*p))
    other = pa.array(ids[at] if len(ids) else at, pa.int64(), mask=at < 0)
    out = {"job_id": v["job_id"][new], "a": best, "o": other, "u": under, "gap": pa.array(gap, pa.float64(), mask=np.isnan(gap))}
    if "carry" in v:
        carried = v["carry"].astype(float)[old]
        carried = carried[at] if len(ids) else np.full(len(at), np.nan)
        out["best_carry"] = pa.array(carried, pa.float64(), mask=(at < 0) | np.isnan(carried))
    return out


COVERAGE = "session_id long, job_id long, a double, o long, u double, gap double"


def outlined(v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    kept = outline(np.stack([v[k].astype(float) for k in ("x0", "y0", "x1", "y1")]))
    return {k: v[k][kept] for k in ("x0", "y0", "x1", "y1")}


def covered(v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """covered: the summed overlaps of each row with the earlier rows with mono, over its area, 1 at most; a row with 1 looks no further.

    A row that meets none before it has 1 too: the query's SQL says so (least(1, null) is 1).
    """
    x, y, w, h = (v[k].astype(float) for k in "xywh")
    sure = np.isfinite(np.stack([x, y, w, h])).all(axis=0)
    p = np.flatnonzero(v["mono"].astype(bool) & sure & ~v["lone"])
    limit, total = np.maximum(1.0, w * h), np.zeros(len(x))
    if len(p):
        b = boxes(x, y, w, h)
        before = np.searchsorted(v["job_id"][p], v["job_id"])
        todo = sure.copy()
        for _, pairs in earlier(x, y, before, x[p], y[p], float(w[sure].max()) or 1.0, float(h[sure].max()) or 1.0, todo):
            for i, k in pairs:
                total += np.bincount(i, _shared(tuple(b[:, i]), tuple(b[:, p[k]])), len(x))
            todo &= total < limit * (1 + 1e-9)
    return {"job_id": v["job_id"], "covered": np.where(total > 0, np.minimum(1.0, total / limit), 1.0)}


def inside_any(v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """job_id of the rows with thick whose place lies in a row with mono (its border too): looked for among 64 of these, then 128 more and so on."""
    x, y, w, h = (v[k].astype(float) for k in "xywh")
    sure = np.isfinite(np.stack([x, y, w, h])).all(axis=0)
    p = np.flatnonzero(v["mono"].astype(bool) & sure & ~v["lone"])
    todo, inside = v["thick"].astype(bool) & np.isfinite(x) & np.isfinite(y), np.zeros(len(x), bool)
    at, size = 0, 64
    while at < len(p) and todo.any():
        few, chosen = p[at : at + size], np.flatnonzero(todo)
        grid = Grid(x[few], y[few], float(w[few].max()) / 2 * (1 + 1e-6), float(h[few].max()) / 2 * (1 + 1e-6))
        for i, k in grid.pairs(*grid.window(x[chosen], y[chosen])):
            i, k = chosen[i], few[k]
            inside[i[(np.abs(x[i] - x[k]) <= w[k] / 2) & (np.abs(y[i] - y[k]) <= h[k] / 2)]] = True
        todo &= ~inside
        at, size = at + size, 2 * size
    return {"job_id": v["job_id"][inside]}


def latest_near(v: dict[str, np.ndarray], most: int = 8) -> dict[str, np.ndarray]:
    """job_id, ref and distance: the last earlier rows with good, most at most, within a row's radius."""
    x, y, radius = (v[k].astype(float) for k in ("x", "y", "radius"))
    sure = np.isfinite(np.stack([x, y, radius])).all(axis=0)
    p = np.flatnonzero(v["good"].astype(bool) & sure & ~v["lone"])
    found, out = np.zeros(len(x), np.int64), []
    if len(p):
        before = np.searchsorted(v["job_id"][p], v["job_id"])
        reach, todo = float(radius[sure].max()) or 1.0, sure.copy()
        for _, pairs in earlier(x, y, before, x[p], y[p], reach, reach, todo):
            for i, k in pairs:
                dx, dy = x[i] - x[p[k]], y[i] - y[p[k]]
                d = np.sqrt(dx * dx + dy * dy)
                near = np.flatnonzero(d <= radius[i])
                near = near[np.lexsort((-k[near], i[near]))]
                i, k, d = i[near], k[near], d[near]
                if len(i):
                    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                    rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
                    few = found[i] + rank < most
                    out.append((i[few], p[k[few]], d[few]))
                    found += np.bincount(i[few], minlength=len(x))
            todo &= found < most
    i, k, d = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return {"job_id": v["job_id"][i], "ref": v["job_id"][k], "distance": d}


# ---- the evidence layer
#: Fields that come at once in counts and in evidence; cells of the evidence map in a side of the largest field, and their most.
COUNTED, STEPS, RASTER, MOST_CELLS = 8192, 1024, 32, 2**18


def _hits(box: np.ndarray, area: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Shared areas of the fields a and b (numbers, broadcast), and which are at least this part of the smaller."""
    part = _shared(tuple(box[:, a]), tuple(box[:, b]))
    with np.errstate(divide="ignore", invalid="ignore"):
        return part, (part > 0) & (part / np.minimum(area[a], area[b]) >= least)


def hits_before(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, mono: np.ndarray, least: float) -> np.ndarray:
    """How many fields with mono before each field share at least this part of the smaller with it.

    They lie in thin bands, sorted by x. In a band those near enough whatever their height are counted by two searches; only those
    in a strip on either side, whose width goes with the band's height, are looked at one by one.
    """
    n, area = len(x), w * h
    every = np.concatenate([boxes(x, y, w, h), area[None]])
    wide, high, narrow, low, large, small = (float(c) for c in (w.max(), h.max(), w.min(), h.min(), area.max(), area.min()))
    left, top = float(x.min()) - wide, float(y.min())
    length = float(x.max()) + wide - left
    band = float(np.clip(np.sqrt(3.0 * max(np.ptp(x), wide) * max(np.ptp(y), high) / max(1, mono.sum())), high / 128, high / 2))
    row = np.floor((y - top) / band)
    key = row * length + (x - left)
    slack = 1e-6 * (wide + length * 1e-3)
    out = np.zeros(n, np.int64)
    reach = int(np.ceil(high / band)) + 1

    def count(s: int, q: np.ndarray, keys: np.ndarray, there: np.ndarray, who: np.ndarray | None) -> None:
        """Among footprints by key (there: their boxes and areas); who: their numbers where not all come before the fields q."""
        here = every[:, q]
        for o in range(-reach, reach + 1):
            r = row[q] + o
            lower = top + r * band
            near = np.maximum(0.0, np.maximum(lower - y[q], y[q] - lower - band)) - 1e-9 * high
            far = np.maximum(np.abs(lower - y[q]), np.abs(lower + band - y[q])) + 1e-9 * high
            with np.errstate(divide="ignore", invalid="ignore"):
                most = np.where(near < high, wide - least * small / (high - near), -1.0) + slack
                safe = np.where(far < low, narrow - least * large / (low - far), -1.0) - slack
            mine = np.flatnonzero(most > 0)
            if not len(mine):
                continue
            at, base, most, safe = x[q[mine]] - left, r[mine] * length, np.minimum(most[mine], wide), safe[mine]
            first, last = np.searchsorted(keys, base + np.maximum(at - most, 0)), np.searchsorted(keys, base + np.minimum(at + most, length), "right")
            if who is None:
                has = safe > 0
                safe = np.maximum(safe, 0)
                second, third = np.searchsorted(keys, base + at - safe), np.searchsorted(keys, base + at + safe, "right")
                second, third = np.where(has, second, last), np.where(has, third, last)
                out[q[mine]] += third - second
                lo, hi = np.r_[first, third], np.r_[second, last]
                mine = np.r_[mine, mine]
            else:
                lo, hi = first, last
            each = hi - lo
            ends = np.cumsum(each)
            i = 0
            while i < len(each):
                to = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
                some = each[i:to]
                total = int(some.sum())
                if total:
                    at = np.repeat(lo[i:to] - (np.cumsum(some) - some), some) + np.arange(total)
                    j = np.repeat(mine[i:to], some)
                    if who is not None:
                        early = who[at] < q[j]
                        at, j = at[early], j[early]
                    own, other = here[:, j], there[:, at]
                    part = _shared(tuple(own), tuple(other))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        hit = (part > 0) & (part / np.minimum(own[4], other[4]) >= least)
                    j = q[j]
                    out[s : s + len(q)] += np.bincount(j[hit] - s, minlength=len(q))
                i = to

    keys, there = np.zeros(0), np.zeros((5, 0))
    for s in range(0, n, COUNTED):
        q = np.arange(s, min(n, s + COUNTED))
        q = q[np.argsort(key[q], kind="stable")]  # searches near each other are fast
        new = q[mono[q]]
        if len(keys):
            count(s, q, keys, there, None)
        if len(new):
            count(s, q, key[new], every[:, new], new)
            at = np.searchsorted(keys, key[new])
            keys, there = np.insert(keys, at, key[new]), np.insert(there, at, every[:, new], axis=1)
    return out


class Reach:
    """Sums of fields' weights over a map's cells: of all fields that may meet a footprint of a cell (most), and of those that surely do."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, least: float) -> None:
        gx, gy = float(w.max()) / RASTER, float(h.max()) / RASTER
        more = max(1.0, np.sqrt((np.ptp(x) / gx + 1) * (np.ptp(y) / gy + 1) / MOST_CELLS))
        self.gx, self.gy = max(gx * more, np.ptp(x) / MOST_CELLS), max(gy * more, np.ptp(y) / MOST_CELLS)
        self.x, self.y = (x - x.min()) / self.gx, (y - y.min()) / self.gy
        column, self.row = np.floor(self.x).astype(np.int64), np.floor(self.y).astype(np.int64)
        self.nx, self.ny = int(column.max()) + 2, int(self.row.max()) + 1
        self.cell = self.row * self.nx + column
        area = w * h
        self.most = (float(w.max()) * (1 + 1e-9), float(h.max()) * (1 + 1e-9), least * float(area.min()))
        self.surely = (float(w.min()) * (1 - 1e-9), float(h.min()) * (1 - 1e-9), least * float(area.max()))

    def sums(self, fields: np.ndarray, weight: np.ndarray, most: bool) -> np.ndarray:
        """For each cell; a field adds its weight from the first to the last cell of its reach in each row."""
        wide, high, size = self.most if most else self.surely
        rows = int(high / self.gy) + 1
        x, y, row = self.x[fields][:, None], self.y[fields][:, None], self.row[fields][:, None] + np.arange(-rows, rows + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            if most:
                left = high - self.gy * np.maximum(0.0, np.maximum(row - y, y - row - 1))
                half = (wide - size / left) / self.gx + 1e-6
                first, end = np.floor(x - half), np.floor(x + half) + 1
            else:
                left = high - self.gy * np.maximum(np.abs(row - y), np.abs(row + 1 - y))
                half = (wide - size / left) / self.gx - 1e-6
                first, end = np.ceil(x - half), np.floor(x + half)
            there = (left > 0) & (half > 0) & (row >= 0) & (row < self.ny)
        first, end = np.clip(first[there], 0, self.nx - 1), np.clip(end[there], 0, self.nx - 1)
        some, base = first < end, row[there] * self.nx
        each = np.broadcast_to(weight[:, None], there.shape)[there][some]
        places = np.r_[(base + first)[some], (base + end)[some]].astype(np.int64)
        steps = np.bincount(places, np.r_[each, -each], self.nx * self.ny)
        return np.cumsum(steps.reshape(self.ny, self.nx), axis=1).ravel()


def evidence(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, mono: np.ndarray, weight: np.ndarray, least: float, demote: int, covered_max: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """demoted, restored and joined of layer(), from blocks of fields.

    A footprint that is low is left alone while its agreement cannot pass what speaks against it: the bound on their difference takes all fields
    with mono that may meet its cell of a map and those without that surely do. One that could pass is counted again from where it was left.
    """
    n, box, area = len(x), boxes(x, y, w, h), w * h
    wide, high = float(w.max()), float(h.max())
    reach = Reach(x, y, w, h, least)
    cell, signed = reach.cell, np.where(mono, weight, -weight).astype(np.int32)
    tx, ty = np.floor((x - x.min()) / (3 * wide)).astype(np.int64) + 1, np.floor((y - y.min()) / high).astype(np.int64) + 1
    across = int(tx.max()) + 2
    tile = ty * across + tx
    demoted, restored, joined = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    ahead, against, low, left_at = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
    passed = np.zeros(reach.nx * reach.ny)
    awake, asleep, base = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def walk(k: np.ndarray, j: np.ndarray, start: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ends of ahead and against, whether low after each field, and where it became low or not."""
        with_mono = mono[j]
        d = start[:, None] + np.cumsum(hit * signed[j], axis=1, dtype=np.int32)
        c = against[k][:, None] + np.cumsum(hit * np.where(with_mono, 0, -signed[j]), axis=1, dtype=np.int32)
        down = hit & ~with_mono & (c >= demote) & (d < 0)
        up = hit & with_mono & (d > 0)
        turn = np.where(down | up, np.arange(2, 2 * len(j) + 2, 2, dtype=np.int32) + down, low[k][:, None])  # odd: low from here
        after = (np.maximum.accumulate(turn, axis=1) & 1).astype(bool)
        before = np.concatenate([low[k][:, None], after[:, :-1]], axis=1)
        return d[:, -1], c[:, -1], after, down & ~before, up & before

    for s in range(0, n, STEPS):
        q = np.arange(s, min(n, s + STEPS))
        new = q[mono[q]]
        could = reach.sums(new, weight[new], True)
        other = q[~mono[q]]
        surely = reach.sums(other, weight[other], False)
        wake = base + passed[cell[asleep]] + could[cell[asleep]] > 0
        if wake.any():
            for k in asleep[wake].tolist():
                since = np.arange(left_at[k], s)
                net = since[_hits(box, area, np.array([k]), since, least)[1]]
                ahead[k] += signed[net].sum()
                against[k] += weight[net[~mono[net]]].sum()
            awake, asleep, base = np.r_[awake, asleep[wake]], asleep[~wake], base[~wake]
        awake = np.r_[awake, new]
        awake = awake[np.argsort(tile[awake], kind="stable")]
        touched = np.unique((tile[q][:, None] + np.array([i * across + j for i in (-1, 0, 1) for j in (-1, 0, 1)])).ravel())
        under, held = np.zeros(len(q)), {}
        for a, z in _ranges(tile[awake]):
            t = tile[awake[a]]
            at = np.searchsorted(touched, t)
            if at == len(touched) or touched[at] != t:
                continue
            k = awake[a:z]
            x0, x1, y0, y1 = x[k].min() - wide, x[k].max() + wide, y[k].min() - high, y[k].max() + high
            j = q[(x[q] >= x0) & (x[q] <= x1) & (y[q] >= y0) & (y[q] <= y1)]
            if not len(j):
                continue
            fresh = k >= s
            for k in (k[~fresh], k[fresh]):
                if not len(k):
                    continue
                part, hit = _hits(box, area, k[:, None], j[None], least)
                if k[0] < s:
                    ahead[k], against[k], after, gone, back = walk(k, j, ahead[k], hit)
                    low[k] = after[:, -1]
                    demoted[j] += gone.sum(axis=0)
                    restored[j] += back.sum(axis=0)
                    under[j - s] += (part * ~after).sum(axis=0)
                else:  # whether they join is not known yet: both ways
                    later = j[None] > k[:, None]
                    part, hit = part * later, hit & later
                    ways = [walk(k, j, np.full(len(k), way), hit) for way in (0, 1)]
                    seen = [part * ~w[2] for w in ways]
                    held |= {one: (i, j, ways, seen) for i, one in enumerate(k.tolist())}
        for k in new.tolist():
            joined[k] = min(1.0, under[k - s] / max(1.0, area[k])) < covered_max
            i, j, ways, seen = held[k]
            d, c, after, gone, back = ways[int(joined[k])]
            ahead[k], against[k], low[k] = d[i], c[i], after[i, -1]
            if gone[i].any():
                demoted[j] += gone[i]
                restored[j] += back[i]
            under[j - s] += seen[int(joined[k])][i]
        passed += could - surely
        rest = low[awake] & (ahead[awake] + could[cell[awake]] + 4 <= 0)
        sleep = awake[rest]
        left_at[sleep] = s + len(q)
        asleep, base, awake = np.r_[asleep, sleep], np.r_[base, ahead[sleep] - passed[cell[sleep]]], awake[~rest]
    return demoted, restored, joined


def layer(v: dict[str, np.ndarray], overlap_min: float = 0.25, demote: int = 2, covered_max: float = 0.8) -> dict[str, np.ndarray]:
    """streaming.folds.layer over a whole session, without its steps: hits are counted in bands, and evidence is kept of the footprints that it can change."""
    x, y, w, h = (v[k].astype(float) for k in "xywh")
    mono, weight = v["mono"].astype(bool), v["weight"].astype(np.int64)
    out = {c: np.zeros(len(x), np.int64) for c in ("affirmed", "contradicted", "demoted", "restored")} | {"joined": mono.copy()}
    sure = np.flatnonzero(np.isfinite(np.stack([x, y, w, h])).all(axis=0))
    x, y, w, h, mono, weight = (c[sure] for c in (x, y, w, h, mono, weight))
    if mono.any() and w.max() > 0 and h.max() > 0:
        hits = hits_before(x, y, w, h, mono, overlap_min)
        out["affirmed"][sure], out["contradicted"][sure] = np.where(mono, hits, 0), np.where(mono, 0, hits)
        out["demoted"][sure], out["restored"][sure], out["joined"][sure] = evidence(x, y, w, h, mono, weight, overlap_min, demote, covered_max)
    return {"job_id": v["job_id"]} | out
