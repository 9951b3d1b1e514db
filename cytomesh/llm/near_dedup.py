"""Op 3, near-duplicates by an LSH forest over MinHash signatures.

A document's set is its distinct 5-word shingles. Documents with equal sets form a class;
only classes are searched. The forest has several sorted orders of the signatures, each by
its own 8 of 128 MinHash values. In an order, neighbours that agree in the first 4 values
are candidates; a region of more than REGION rows that agree is split at the next value, and
so on to the depth where it fits, so depth adapts to how dense a region is. Neighbours along
the order always stay candidates, and a region still too large at the last depth is tied to
its first row as well. Orders are sorted by range, so one dense region spreads over tasks.

Candidates are confirmed on full sets. First the two candidates that meet a class in the
most orders; classes then known to be connected need no further comparison between them,
and every other candidate is confirmed in the second pass. A region of more than REGION
classes that are still in several components is then compared in full, block by block: the
classes outside its largest component with all its classes, on MinHash values first (at a
similarity of 0.75 fewer than AGREE of 128 agree with probability 3e-6) and at once on full
sets. A block pair returns a spanning forest of the links it finds, so what is written grows
with the classes, not with their pairs. The first FIRST_TREES orders go first; classes they
connect need no comparison in the other orders.

At a similarity of 0.75 two classes are neighbours at depth 4 in at least one of 32 orders
with probability 1 - (1 - 0.75**4)**32 = 0.999995.

Defined results: null, empty and blank texts have no shingles and link with nothing;
shorter texts than 5 words have one shingle; repeated rows of a doc_id share a component; a
null doc_id has a null component and is kept; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.llm import _packed, _text
from cytomesh.llm.components import components
from cytomesh.session import bound_batches, drop_written, table, written

SHINGLE = 5
PERCENT = 75
HASHES = 128
ORDERS = 32
FIRST_DEPTH, LAST_DEPTH = 4, 8
REGION = 8
AGREE = 74
FIRST_TREES = 4
#: Bytes of signatures and sets of one block of a dense region.
BLOCK_BYTES = 4 << 20
#: Rows of an order that are compared at once; a longer range goes in several steps.
STEP_ROWS = 400_000

_RNG = np.random.Generator(np.random.PCG64(77))
_FACTORS = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The values each order sorts by: 4 of its own, then 4 that others have first.
_ORDERS = np.array([np.concatenate([np.arange(4 * t, 4 * t + 4), _RNG.choice(np.setdiff1d(np.arange(HASHES), np.arange(4 * t, 4 * t + 4)), 4, replace=False)]) for t in range(ORDERS)])


def shingle_sets(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each slab the first document's number, and the sorted set of each document."""
    data, offs = _text.buffers(texts)
    for lo, hi in _text.slabs(offs):
        part = data[offs[lo] : offs[hi]]
        words = _text.find_words(part, offs[lo : hi + 1] - offs[lo])
        hashes = _text.span_hash(part, words.start, words.end, lower=True)
        windows = _text.window_hash(hashes, SHINGLE)
        sets = []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            sets.append(np.unique(windows[a : b - SHINGLE + 1]) if b - a >= SHINGLE else _text.window_hash(hashes[a:b], b - a, b - a) if b > a else windows[:0])
        yield lo, sets


def class_key(members: np.ndarray) -> int:
    """A 64-bit name of a set, from two independent sums over its members."""
    if not len(members):
        return 0
    one, two = members.sum(dtype=np.uint64), _text.mix(members ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(_text.mix(np.array([one ^ _text.mix(np.array([two + np.uint64(len(members))]))[0]]))[0].view(np.int64))


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each MinHash value, HASHES for each set; none may be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint16)
    for j, factor in enumerate(_FACTORS):
        out[:, j] = _text.mix(np.minimum.reduceat(flat * factor, starts)) >> np.uint64(48)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n (set size), class (0: empty set), sig (binary, null for empty sets)."""

    @_text.tidy
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in shingle_sets(batch.column(1)):
                full = [s for s in sets if len(s)]
                sig = iter(minhash(full)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(sets)), batch.column(2).slice(lo, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) for s in sets], pa.int64()), pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["doc_id", "text_key", "n", "class", "sig"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(signed, "doc_id long, text_key long, n long, class long, sig binary")


def _orders(classes: DataFrame) -> DataFrame:
    """A row (tree, near, deep, class) for each class and order; near and deep are 4 values each."""

    @_text.tidy
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                data, _ = _text.buffers(part.column(1))
                sig = np.frombuffer(data, np.uint16).reshape(len(part), HASHES).astype(np.uint64)
                key = sig[:, _ORDERS]  # class, order, depth
                join = lambda k: ((k[..., 0] << np.uint64(48)) | (k[..., 1] << np.uint64(32)) | (k[..., 2] << np.uint64(16)) | k[..., 3]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(ORDERS, dtype=np.int32), len(part))), pa.array(join(key[..., :4])), pa.array(join(key[..., 4:])), pa.array(np.repeat(part.column(0).to_numpy(), ORDERS))],
                    ["tree", "near", "deep", "class"],
                )

    return classes.select("class", "sig").mapInArrow(dealt, "tree int, near long, deep long, class long")


def neighbours(tree: np.ndarray, near: np.ndarray, deep: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs among rows sorted by tree, near, deep and node."""
    n = len(node)
    if n < 2:
        return node[:0], node[:0]
    deep = deep.view(np.uint64)
    same = (tree[1:] == tree[:-1]) & (near[1:] == near[:-1])  # agree to the first depth
    left, right = [np.flatnonzero(same)], [np.flatnonzero(same) + 1]  # next along the order
    open_rows = np.ones(n, bool)  # rows whose region is still too large
    for depth in range(FIRST_DEPTH, LAST_DEPTH + 1):
        if depth > FIRST_DEPTH:
            shift = np.uint64(16 * (LAST_DEPTH - depth))
            same = same & ((deep[1:] >> shift) == (deep[:-1] >> shift))
        region = np.concatenate([[0], np.cumsum(~same)])
        size = np.bincount(region)[region]
        now = np.flatnonzero(open_rows & (size <= REGION))
        for step in range(2, REGION):
            a = now[now + step < n]
            a = a[region[a] == region[a + step]]
            left.append(a)
            right.append(a + step)
        open_rows[now] = False
        if depth == LAST_DEPTH:
            rest = np.flatnonzero(open_rows)
            first = np.searchsorted(region, region[rest])
            left.append(first[first < rest])
            right.append(rest[first < rest])
    a, b = node[np.concatenate(left)], node[np.concatenate(right)]
    return np.minimum(a, b), np.maximum(a, b)


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs u < v of classes that are neighbours in some order, and in how many (met).

    The second table has the rows tree, near and class of all regions too large at the first
    depth, and of some smaller ones. The third is the written table behind both.
    """
    order = ["tree", "near", "deep", "class"]
    rows = _orders(classes).repartitionByRange(*order).sortWithinPartitions(*order)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, len(batch), STEP_ROWS):
                held.append(batch.slice(at, STEP_ROWS))
                n += len(held[-1])
                if n >= STEP_ROWS:
                    yield [np.concatenate([h.column(i).to_numpy() for h in held]) for i in range(4)]
                    held, n = [], 0
        if n:
            yield [np.concatenate([h.column(i).to_numpy() for h in held]) for i in range(4)]

    @_text.tidy
    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["u", "v", "met", "tree", "near", "deep"]
        none = lambda k, t: pa.nulls(k, t)
        for tree, near, deep, node in steps(batches):
            u, v = neighbours(tree, near, deep, node)
            pair, met = np.unique(np.stack([u, v]), axis=1, return_counts=True) if len(u) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(met), none(len(met), pa.int32()), none(len(met), pa.int64()), none(len(met), pa.int64())], names)
            # The ends of the step, for regions that go on in the next one.
            edge = np.unique(np.concatenate([np.arange(min(REGION, len(tree))), np.arange(max(0, len(tree) - REGION), len(tree))]))
            yield pa.RecordBatch.from_arrays([pa.array(node[edge]), none(len(edge), pa.int64()), none(len(edge), pa.int64()), pa.array(tree[edge]), pa.array(near[edge]), pa.array(deep[edge])], names)
            # Large regions, and those at the ends of the step, which can be parts of large ones.
            region = np.concatenate([[0], np.cumsum((tree[1:] != tree[:-1]) | (near[1:] != near[:-1]))])
            size = np.bincount(region)
            size[[0, -1]] = REGION + 1
            dense = np.flatnonzero(size[region] > REGION)
            yield pa.RecordBatch.from_arrays([pa.array(node[dense]), none(len(dense), pa.int64()), none(len(dense), pa.int64()), pa.array(tree[dense]), pa.array(near[dense]), none(len(dense), pa.int64())], names)

    found = written(rows.mapInArrow(paired, "u long, v long, met long, tree int, near long, deep long"), "candidates")
    edges = found.where("v is null and deep is not null").select("tree", "near", "deep", F.col("u").alias("class"))

    def stitched(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in order])
        u, v = neighbours(*(group[c].to_numpy() for c in order))
        return pa.table({"u": u, "v": v, "met": np.ones(len(u), np.int64)})

    # At most 2 * REGION rows of each step; a region's rows at the ends of steps meet in one group.
    across = edges.groupBy("tree").applyInArrow(stitched, "u long, v long, met long").where("u <> v")
    pairs = found.where("v is not null and u <> v").select("u", "v", "met").unionByName(across).groupBy("u", "v").agg(F.sum("met").alias("met"))
    return pairs, found.where("v is null and deep is null").select("tree", "near", F.col("u").alias("class")), found


def overlaps(one: np.ndarray, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many members of one (sorted) each of the sets flat[start : start + length] has."""
    value = flat[_text.spread(start, length)]
    hit = one[np.minimum(np.searchsorted(one, value), len(one) - 1)] == value
    return np.diff(np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(length)])])


def block_links(tree: int, left: tuple, right: tuple, percent: int = PERCENT) -> tuple[list[int], list[int]]:
    """Links of one block of a dense region with another that join components, as a forest.

    A side is (class, root, sig, first, members): members of set i are members[first[i] : first[i + 1]].
    A pair counts in the first order in which it meets.
    """
    firsts = _ORDERS[:, :FIRST_DEPTH]
    (a, ra, sa, fa, ma), (b, rb, sb, fb, mb) = left, right
    nb = np.diff(fb)
    of: dict[int, int] = {}

    def find(x: int) -> int:
        while of.setdefault(x, x) != x:
            of[x] = x = of[of[x]]
        return x

    us, vs = [], []
    for j in range(len(a)):
        one = ma[fa[j] : fa[j + 1]]
        k = np.flatnonzero((rb != ra[j]) & (100 * np.minimum(nb, len(one)) >= percent * np.maximum(nb, len(one))))
        k = k[(sb[k] == sa[j]).sum(axis=1) >= AGREE]
        if len(k):
            k = k[(sb[k][:, firsts] == sa[j][firsts]).all(axis=2).argmax(axis=1) == tree]
        if not len(k):
            continue
        roots = np.array([find(r) for r in rb[k].tolist()])
        k = k[roots != find(int(ra[j]))]
        if not len(k):
            continue
        both = overlaps(one, mb, fb[k], nb[k])
        for i in k[100 * both >= percent * (len(one) + nb[k] - both)].tolist():
            x, y = find(int(ra[j])), find(int(rb[i]))
            if x != y:
                of[max(x, y)] = min(x, y)
                us.append(min(int(a[j]), int(b[i])))
                vs.append(max(int(a[j]), int(b[i])))
    return us, vs


def dense_links(classes: DataFrame, sets: DataFrame, dense: DataFrame, groups: DataFrame) -> DataFrame:
    """Links u < v between different components of one dense region, enough to join them.

    Of two components one at least is not the region's largest, so only classes outside the
    largest are compared with the whole region, block by block.
    """
    key = ["tree", "near"]
    bytes_of = F.octet_length("set") + 2 * HASHES
    rows = dense.join(groups.withColumnRenamed("node", "class"), "class", "left").select(*key, "class", F.coalesce("root", "class").alias("root"))
    mixed = rows.groupBy(*key, "root").agg(F.count("*").alias("k")).groupBy(*key).agg(F.sum("k").alias("n"), F.count("*").alias("roots"), F.max_by("root", F.struct("k", "root")).alias("largest"))
    mixed = mixed.where((F.col("n") > REGION) & (F.col("roots") > 1)).select(*key, "largest")
    rows = rows.join(mixed, key).join(classes.select("class", "sig"), "class").join(sets, "class")
    rows = rows_written = written(rows, "dense")
    blocks = rows.groupBy(*key).agg(F.ceil(F.sum(bytes_of) / BLOCK_BYTES).cast("int").alias("blocks"))
    rows = rows.join(blocks, key).withColumn("block", F.pmod(F.hash("class"), F.col("blocks")))
    packed = lambda p: [F.collect_list(F.struct("class", "root", "sig", "set")).alias(p)]
    members = rows.groupBy(*key, "block").agg(*packed("members"))
    outside = rows.where("root <> largest").groupBy(*key, F.col("block").alias("from"), "blocks").agg(*packed("outside"))
    outside = outside.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = outside.join(members, [*key, "block"]).select("tree", "outside", "members")

    def side(part: pa.StructArray) -> tuple:
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.field(3)]
        sig = np.frombuffer(b"".join(part.field(2).to_pylist()), np.uint16).reshape(-1, HASHES)
        return part.field(0).to_numpy(), part.field(1).to_numpy(), sig, np.cumsum([0, *map(len, held)]), np.concatenate(held)

    @_text.tidy
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                u, v = block_links(batch.column(0)[i].as_py(), *(side(batch.column(c)[i].values) for c in (1, 2)))
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    out = written(both.mapInArrow(compared, "u long, v long").distinct(), "late")
    drop_written(rows_written)
    return out


def _sets_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """class and set (sorted hashes as binary) of the classes in pairs, from one document each."""
    needed = pairs.select(F.col("u").alias("class")).unionByName(pairs.select(F.col("v").alias("class"))).distinct()
    needed = classes.join(needed, "class").select("class", "doc_id")
    count = needed.count()
    bits = int(min(26, max(16, (16 * count).bit_length())))  # the table is 64 MB at most; fuller, it lets more through

    def slot(doc_id: np.ndarray, key: np.ndarray) -> np.ndarray:
        return (_text.mix(key.view(np.uint64) ^ _text.mix(doc_id.view(np.uint64))) >> np.uint64(64 - bits)).astype(np.int64)

    @_text.tidy
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[slot(batch.column(1).to_numpy(), batch.column(0).to_numpy())] = True
        packed = np.packbits(seen).reshape(64, -1)
        use = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(use.astype(np.int32)), pa.array([packed[i].tobytes() for i in use], pa.binary())], ["slice", "bits"])

    def merged(group: pa.Table) -> pa.Table:
        rows = np.stack([np.frombuffer(b.as_buffer(), np.uint8) for b in group["bits"]])
        return pa.table({"slice": group["slice"][:1], "bits": pa.array([np.bitwise_or.reduce(rows).tobytes()], pa.binary())})

    table_bits = np.zeros((64, (1 << bits) // 512), np.uint8)
    for row in needed.mapInArrow(marked, "slice int, bits binary").groupBy("slice").applyInArrow(merged, "slice int, bits binary").collect():
        table_bits[row["slice"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(table_bits.tobytes())

    @_text.tidy
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        for batch in batches:
            for lo, sets in shingle_sets(batch.column(1)):
                ids = batch.column(0).slice(lo, len(sets)).to_numpy(zero_copy_only=False).astype(np.int64)
                keys = np.array([class_key(s) for s in sets], np.int64)
                use = [i for i in np.flatnonzero(seen[slot(ids, keys)]).tolist() if keys[i]]
                yield pa.RecordBatch.from_arrays([pa.array(keys[use]), pa.array([sets[i].tobytes() for i in use], pa.binary())], ["class", "set"])

    rows = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(kept, "class long, set binary")
    return rows.join(needed.select("class"), "class", "left_semi").groupBy("class").agg(F.first("set").alias("set"))


def plausible(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose set sizes allow the similarity and that agree in AGREE MinHash values."""

    @_text.tidy
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(_text.buffers(batch.column(i))[0], np.uint16).reshape(len(batch), HASHES) for i in (4, 5))
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            mask = pa.array((100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((a == b).sum(axis=1) >= AGREE))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    side = lambda c, n, s: classes.select(F.col("class").alias(c), F.col("n").alias(n), F.col("sig").alias(s))
    return pairs.join(side("u", "n", "a"), "u").join(side("v", "m", "b"), "v").select("u", "v", "n", "m", "a", "b").mapInArrow(checked, "u long, v long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    @_text.tidy
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = 0
                if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    merged = np.sort(np.concatenate([a, b]))
                    both = int((merged[1:] == merged[:-1]).sum())
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    left = sets.select(F.col("class").alias("u"), F.col("set").alias("a"))
    right = sets.select(F.col("class").alias("v"), F.col("set").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(checked, "u long, v long")


def labelled(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, text_key, root, n_shingles, component_id for every document, and the written tables it still reads.

    text_key tells the texts of a doc_id apart. Components of one doc_id differ by root, which is
    null for texts without shingles.
    """
    bound_batches(docs.sparkSession)
    signed = written(signatures(docs), "signatures")
    named = signed.where("class <> 0 and doc_id is not null")
    classes = written(named.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    pairs, dense, found = candidates(classes)
    pairs = written(pairs, "pairs")
    dense = written(dense.distinct(), "regions")
    drop_written(found)
    sets = written(_sets_of(docs, classes, pairs), "sets")
    ends = pairs.select("u", "v", "met").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "met"))
    # The two best neighbours of each class, found with a bounded state for each class.
    best = ends.groupBy("u").agg(F.expr("max_by(v, struct(met, -v))").alias("v1"))
    second = ends.join(best, "u").where("v <> v1").groupBy("u").agg(F.expr("max_by(v, struct(met, -v))").alias("v2"))
    chosen = best.select("u", F.col("v1").alias("v")).unionByName(second.select("u", F.col("v2").alias("v")))
    chosen = written(chosen.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "chosen")
    links = written(confirm(chosen, sets), "links")
    groups = written(components(links), "groups")
    root = lambda c: groups.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    left = pairs.select("u", "v").join(chosen, ["u", "v"], "left_anti").join(root("u"), "u", "left").join(root("v"), "v", "left")
    left = left.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")
    later = (lambda: confirm(plausible(left, classes), sets), lambda: dense_links(classes, sets, dense.where(f"tree < {FIRST_TREES}"), groups), lambda: dense_links(classes, sets, dense.where(f"tree >= {FIRST_TREES}"), groups))
    for step in later:
        more = written(step(), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            groups = written(components(links), "groups")
    for table_ in (pairs, dense, sets, chosen):
        drop_written(table_)
    label = classes.select("class", "doc_id").join(groups.withColumnRenamed("node", "class"), "class", "left")
    label = label.select("class", "doc_id", F.coalesce("root", "class").alias("root"))
    least = label.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    label = label.join(least, "root").select("class", "root", "component_id")
    out = signed.select("doc_id", "text_key", "n", F.when(F.col("doc_id").isNotNull() & (F.col("class") != 0), F.col("class")).alias("class")).join(label, "class", "left")
    return out.select("doc_id", "text_key", "root", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), [signed, classes, groups]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    out = labelled(docs)[0].select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def survivors(docs: DataFrame) -> DataFrame:
    """One row of each component: of its smallest doc_id, and of that the text of the smallest text_key.

    Rows of one doc_id whose texts are alike by no rule all stay, and so does every null doc_id.
    Texts without shingles of one doc_id are alike. Of rows with equal doc_id and text the one
    whose columns come first as JSON stays.
    """
    every, used = labelled(docs)
    rows = written(every.where("doc_id is not null").groupBy("doc_id", "component_id", "text_key", F.coalesce("root", F.lit(0)).alias("root")).agg(F.count("*").alias("n")), "labelled")
    for table_ in used:
        drop_written(table_)
    kept = rows.where("doc_id = component_id").groupBy("doc_id", "root").agg(F.min("text_key").alias("text_key"))
    key = ["doc_id", "text_key"]
    gone = rows.join(kept, [*key, "root"], "left_anti").select(key)
    many = rows.where("n > 1").join(kept, [*key, "root"], "left_semi").select(key)
    named = docs.where("doc_id is not null").withColumn("text_key", F.xxhash64("text"))
    once = named.join(gone.unionByName(many).distinct(), key, "left_anti").select(docs.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = named.join(many, key, "left_semi").groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return once.unionByName(first).unionByName(docs.where("doc_id is null"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
