"""Spatial joins on buckets: pairs within a distance, nearest neighbours, components, unions.

Points are (group, id, x, y, ...). Joins are equi-joins on (group, bucket), so a dense group
is spread over its buckets, and AQE can split a bucket that is dense itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomesh.session import written


def _bucketed(points: DataFrame, size: Column | str, spread: bool) -> DataFrame:
    out = points.withColumn("bx", F.floor(F.col("x") / size).cast("int")).withColumn("by", F.floor(F.col("y") / size).cast("int"))
    if spread:
        out = out.withColumn("bx", F.explode(F.expr("sequence(bx - 1, bx + 1)"))).withColumn("by", F.explode(F.expr("sequence(by - 1, by + 1)")))
    return out


#: A bucket and half of its neighbours: every pair of touching buckets once.
FORWARD = ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))


def pairs_within(points: DataFrame, radius: Column, group: str = "image_id", key: str = "instance_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs key < key2 of a group at most radius apart, with d and the carried columns of both.

    radius is the same for a whole group.
    """
    own = [key, "x", "y", *carry]
    sized = _bucketed(points.select(group, *own, radius.alias("_size")), F.col("_size"), False)
    there = sized.select(group, "bx", "by", *[F.col(c).alias(f"{c}2") for c in own])
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in FORWARD]))
    here = sized.withColumn("_step", step).withColumns({"bx": F.col("bx") + F.col("_step.i"), "by": F.col("by") + F.col("_step.j"), "_same": F.expr("_step.i = 0 and _step.j = 0")}).drop("_step")
    met = here.join(there, [group, "bx", "by"]).where(~F.col("_same") | (F.col(key) < F.col(f"{key}2")))
    met = met.withColumn("d", F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))).where(F.col("d") <= F.col("_size"))
    first = F.col(key) < F.col(f"{key}2")
    sides = [F.when(first, F.col(a)).otherwise(F.col(b)).alias(a) for c in own for a, b in ((c, f"{c}2"), (f"{c}2", c))]
    return met.select(group, *sides, "d")


def nearest(points: DataFrame, group: str = "image_id", key: str = "instance_id", carry: tuple[str, ...] = ("r",)) -> DataFrame:
    """Each point's nearest other point of its group: nn (key), d and the carried columns as c2.

    Ties go to the smaller key. A group of one point has no row.
    """
    named = points.select(group, F.col(key).alias("_key"), "x", "y", *carry)
    named = named.join(named.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1").select(group), group)
    out = _nearest(named, named, group, "_key", carry, F.col("_key") != F.col("_key2"), None)
    return out.select(group, F.col("_key").alias(key), "best.*").withColumnRenamed("_key2", "nn").select(group, key, "d", "nn", *[f"{c}2" for c in carry])


#: Rounds, and how the buckets' side grows with each; points that are still open then are compared with their whole group.
ROUNDS, WIDER = 4, 4


def _nearest(points: DataFrame, targets: DataFrame, group: str, key: str, carry: tuple[str, ...], other: Column | None, digits: int | None) -> DataFrame:
    """group, key and best (d, _key2, carried): buckets of about two targets, then of WIDER times the side, until all are proven.

    A target found no farther than a bucket's side is nearer than any beyond the neighbouring buckets.
    """
    extent = targets.groupBy(group).agg(F.count("*").alias("_n"), (F.max("x") - F.min("x")).alias("_w"), (F.max("y") - F.min("y")).alias("_h"))
    extent = extent.select(group, F.greatest(F.lit(1e-6), 1.4 * F.sqrt(F.greatest(F.lit(1e-6), F.col("_w") * F.col("_h")) / F.col("_n"))).alias("_size"), F.hypot("_w", "_h").alias("_most"))
    there = targets.select(group, F.col(key).alias(f"{key}2"), F.col("x").alias("x2"), F.col("y").alias("y2"), *[F.col(c).alias(f"{c}2") for c in carry])
    distance = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    distance = distance if digits is None else F.round(distance, digits)
    slack = 0.0 if digits is None else 10.0**-digits  # no target beyond the buckets can round to the same d
    pick = F.min(F.struct("d", f"{key}2", *[f"{c}2" for c in carry])).alias("best")
    rest, out = points.select(group, key, "x", "y").join(extent, group), None
    for _ in range(ROUNDS):
        here = there.join(extent.drop("_most") if out is None else sizes, group).withColumn("bx", F.floor(F.col("x2") / F.col("_size")).cast("int")).withColumn("by", F.floor(F.col("y2") / F.col("_size")).cast("int")).drop("_size")
        met = _bucketed(rest, F.col("_size"), True).join(here, [group, "bx", "by"])
        met = met.where(other) if other is not None else met
        best = met.withColumn("d", distance).groupBy(group, key).agg(pick, F.first("_size").alias("_size")).where(F.col("best.d") <= F.col("_size") - slack).select(group, key, "best")
        best = written(best, "nearest")
        out = best if out is None else out.unionByName(best)
        rest = written(rest.join(best.select(group, key), [group, key], "left_anti").withColumn("_size", WIDER * F.col("_size")), "open")
        if rest.isEmpty():
            return out
        sizes = rest.groupBy(group).agg(F.first("_size").alias("_size"))
    far = rest.join(there, group)
    far = far.where(other) if other is not None else far
    return out.unionByName(far.withColumn("d", distance).groupBy(group, key).agg(pick))


def nearest_target(points: DataFrame, targets: DataFrame, group: str, key: str, target: str, digits: int) -> DataFrame:
    """Each point's nearest target of its group: the target's key and d, rounded to digits; ties go to the smaller key.

    A point of a group without targets has no row.
    """
    out = _nearest(points.withColumnRenamed(key, "_key"), targets.withColumnRenamed(target, "_key"), group, "_key", (), None, digits)
    return out.select(group, F.col("_key").alias(key), F.col("best.d").alias("d"), F.col("best._key2").alias(target))


def clipped_union(k: np.ndarray) -> float:
    """The area of the union of the rectangles (x0, y0, x1, y1), one a row.

    Rectangles inside another are dropped first; then bands between y edges, as in union_bands.
    """
    k = k[np.argsort(-(k[:, 2] - k[:, 0]) * (k[:, 3] - k[:, 1]), kind="stable")]
    kept = k[:0]
    while len(k):
        a = k[0]
        kept = np.concatenate([kept, k[:1]])
        k = k[(k[:, 0] < a[0]) | (k[:, 1] < a[1]) | (k[:, 2] > a[2]) | (k[:, 3] > a[3])]
    kept = kept[np.argsort(kept[:, 0], kind="stable")]
    edges = np.unique(kept[:, [1, 3]])
    total = 0.0
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        row = kept[(kept[:, 1] <= low) & (kept[:, 3] >= high)]
        if len(row):
            reach = np.maximum.accumulate(row[:, 2])
            before = np.concatenate([row[:1, 0], reach[:-1]])
            total += float((high - low) * np.maximum(0.0, reach - np.maximum(before, row[:, 0])).sum())
    return total


def group_components(edges: DataFrame, group: str = "image_id", key: str = "instance_id") -> DataFrame:
    """group, key and component (smallest key) of all points that have an edge.

    A group is one image with some thousand cells, or one session's grid: one task holds its edges,
    and labels them by minima over edges and pointer jumping, without a loop over points.
    """

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, ends = np.unique(pdf[[key, f"{key}2"]].to_numpy(), return_inverse=True)
        a, b = ends.reshape(-1, 2).T
        root = np.arange(len(nodes))
        while (root[a] != root[b]).any():
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], least)
            np.minimum.at(root, root[b], least)
            while (root[root] != root).any():
                root = root[root]
        return pd.DataFrame({group: pdf[group].iloc[0], key: nodes, "component": nodes[root]})

    return edges.select(group, key, f"{key}2").groupBy(group).applyInPandas(label, f"{group} long, {key} long, component long")


def union_bands(rects: DataFrame, group: str) -> DataFrame:
    """Disjoint rectangles (x0, y0, x1, y1) that cover the union of each group's rectangles.

    Rectangles on ground that others cover are left out first. Bands between neighbouring y edges; in a band,
    x intervals that meet are merged. Bands meet rectangles by buckets along y, as high as the group's highest rectangle.
    """
    from pyspark.sql import Window

    from cytomesh.operators import sessions

    types = dict(rects.dtypes)
    corners = rects.select(group, *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).dropna()
    rects = written(sessions.by_session(corners, sessions.outlined, f"{group} {types[group]}, x0 double, y0 double, x1 double, y1 double", group, None), "outline")
    edges = rects.select(group, F.explode(F.array("y0", "y1")).alias("b0")).distinct()
    bands = edges.withColumn("b1", F.lead("b0").over(Window.partitionBy(group).orderBy("b0"))).where("b1 is not null")
    side = rects.groupBy(group).agg(F.greatest(F.lit(1e-6), F.max(F.col("y1") - F.col("y0"))).alias("_side"))
    bands = bands.join(side, group).withColumn("_by", F.floor(F.col("b0") / F.col("_side")))
    spread = rects.where("x1 > x0 and y1 > y0").join(side, group).withColumn("_by", F.explode(F.sequence(F.floor(F.col("y0") / F.col("_side")), F.floor(F.col("y1") / F.col("_side"))))).drop("_side")
    inside = bands.drop("_side").join(spread, [group, "_by"]).where("y0 <= b0 and y1 >= b1").drop("_by")
    order = Window.partitionBy(group, "b0").orderBy("x0", "x1")
    inside = inside.withColumn("reach", F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    inside = inside.withColumn("island", F.sum(F.when(F.col("x0") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return inside.groupBy(group, F.col("b0").alias("y0"), F.col("b1").alias("y1"), "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("island")


def raster_cells(rects: DataFrame) -> DataFrame:
    """A row (gx, gy) for each grid cell from c0 to c1 - 1 and r0 to r1 - 1 of each row."""
    out = rects.where("c1 > c0 and r1 > r0").withColumn("gx", F.explode(F.sequence("c0", F.col("c1") - 1)))
    return out.withColumn("gy", F.explode(F.sequence("r0", F.col("r1") - 1)))


def greedy_separated(rows: DataFrame, group: str, order: list[str], distance: float, count: int) -> DataFrame:
    """The first rows in order that keep a distance from all taken before, count at most a group."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, taken = None, []
        for pdf in batches:
            keep = []
            for i, (g, x, y) in enumerate(zip(pdf[group], pdf["x"], pdf["y"], strict=True)):
                if g != current:
                    current, taken = g, []
                if len(taken) < count and all((x - a) ** 2 + (y - b) ** 2 >= distance**2 for a, b in taken):
                    taken.append((x, y))
                    keep.append(i)
            yield pdf.iloc[keep]

    ordered = rows.repartition(group).sortWithinPartitions(group, *[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order])
    return ordered.mapInPandas(take, rows.schema)


#: Queries and vectors that are compared at once.
QUERY_BLOCK, VECTOR_BLOCK = 512, 1024


def two_nearest(queries: DataFrame, vectors: DataFrame, ratio: float = 0.98) -> DataFrame:
    """child, parent, d1, d2 and good (d1 < ratio * d2) of each query (id, v) and its two nearest vectors of another id.

    The queries' blocks go to every block of vectors, dealt by block number and not broadcast;
    distances are rounded to 9 digits and ties go to the smaller id.
    """

    def blocks(side: str, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), rows):
                    part = batch.slice(at, rows)
                    ids, v = part.column(0).to_numpy().astype(np.int64), part.column(1).flatten().to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], [f"{side}_ids", f"{side}_v"])

        return packed

    def nearest_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                child, parent = (np.frombuffer(row[c], np.int64) for c in ("c_ids", "p_ids"))
                c, p = (np.frombuffer(row[k]).reshape(len(ids), -1) for k, ids in (("c_v", child), ("p_v", parent)))
                found = []
                for own, one in zip(child, c, strict=True):
                    d = np.sqrt(((p - one) ** 2).sum(axis=1)).round(9)
                    few = np.flatnonzero(parent != own)
                    few = few[np.lexsort((parent[few], d[few]))[:2]] if len(few) <= 64 else few[d[few] <= np.partition(d[few], 1)[1]]
                    found.append([(d[i], parent[i]) for i in few[np.lexsort((parent[few], d[few]))][:2]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(child, [len(x) for x in found])), pa.array([d for x in found for d, _ in x], pa.float64()), pa.array([i for x in found for _, i in x], pa.int64())],
                    ["child", "d", "parent"],
                )

    parent = written(vectors.mapInArrow(blocks("p", VECTOR_BLOCK), "p_ids binary, p_v binary").withColumn("block", F.monotonically_increasing_id()), "vectors")
    numbers = parent.agg(F.collect_list("block").alias("blocks"))
    pairs = written(queries.mapInArrow(blocks("c", QUERY_BLOCK), "c_ids binary, c_v binary"), "queries").crossJoin(F.broadcast(numbers)).withColumn("block", F.explode("blocks")).drop("blocks")
    pairs = pairs.join(parent.hint("shuffle_hash"), "block").drop("block")
    found = pairs.mapInArrow(nearest_two, "child long, d double, parent long")
    two = found.groupBy("child").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "parent"))), 1, 2).alias("two")).where("size(two) = 2")
    one, other = F.col("two")[0], F.col("two")[1]
    return two.select("child", one["parent"].alias("parent"), one["d"].alias("d1"), other["d"].alias("d2"), (one["d"] < ratio * other["d"]).alias("good"))


def global_places(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with place, from 1, in the order of keys: ranges are sorted each by itself and their sizes summed."""
    from pyspark.sql import Window

    # In a written range, ids ascend with the rows; its high bits are the range.
    ranged = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()), "ordered")
    ranged = ranged.withColumns({"_part": F.shiftright("_m", 33), "_at": F.expr("_m & 8589934591")}).drop("_m")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
