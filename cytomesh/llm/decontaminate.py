"""Op 4, benchmark decontamination by CGK embedding and bit-sampling LSH.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z as a-z. A document
is contaminated by an item of n words if some passage is within floor(EDITS * n) word edits.

1. Windows as long as an item start wherever a shared 3-gram of words would align with it.
   Windows with fewer item 3-grams than any passage within the edits must keep
   (n - 2 - 3 * edits) are dropped, which loses nothing.
2. The CGK walk embeds a window: at each of 3n steps it writes the current word and moves on
   or stays by a random bit of the word, so that few edits become few differing steps.
   WALKS walks, each read at SAMPLES positions for TABLES tables, give hash keys; a window
   is compared with the items that share a key.
3. A candidate is confirmed by exact edit distance, with free ends in the document.

Recall: for 15 % edits the chance to share a key is measured in tests/llm to be over 0.95;
verbatim passages always share all keys.

Items of fewer than MIN_WORDS words allow no edit, so they are looked up by the hashes of all
passages of their lengths. Items come in blocks of at most ITEM_BLOCK items and about
BLOCK_BYTES of text, each with its own scan, so what is broadcast is bounded.

Defined results: items without words, and null, empty or blank texts match nothing; an item
given twice counts once; repeated rows each match; a null doc_id is kept as null, and a null
item_id likewise; empty tables give no rows; other columns are ignored by matches() and kept
by clean().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.llm import _packed, _text
from cytomesh.session import bound_batches, table

EDITS = 0.15
MIN_WORDS = 5
SEED = 3
WALKS, TABLES, SAMPLES = 16, 12, 3
ITEM_BLOCK = 20_000
BLOCK_BYTES = 16 << 20
MATCHES = "doc_id long, item_id long, start long, n_words long, distance int"
#: Words of the windows embedded at once, places of items looked up at once.
WINDOW_WORDS = 1 << 15
PLACES = 1 << 20
_PAD = np.uint64(0xA5A5A5A55A5A5A5B)


def embed_keys(words: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash keys of windows (a row each, padded to one width): WALKS * TABLES for each.

    The walks' bits depend on the step and the word alone, so windows of any length walk
    together; a key is read at steps below 3 * length and holds the length.
    """
    rows, width = words.shape
    padded = np.concatenate([words, np.full((rows, 1), _PAD)], axis=1)
    rng = np.random.Generator(np.random.PCG64(4))
    written = np.empty((3 * width, rows, WALKS), np.uint64)
    place = np.zeros((rows, WALKS), np.int64)
    at_row = np.arange(rows)[:, None]
    for step in range(3 * width):
        salts = rng.integers(0, 1 << 63, WALKS, dtype=np.uint64)
        here = padded[at_row, place]
        here[place >= length[:, None]] = _PAD
        written[step] = here
        place = np.minimum(place + (_text.mix(here ^ salts) & np.uint64(1)).astype(np.int64), length[:, None])
    out = np.empty((rows, WALKS, TABLES), np.uint64)
    part = np.random.Generator(np.random.PCG64(9)).random((TABLES, SAMPLES, WALKS))
    for t in range(TABLES):
        key = np.broadcast_to(((length.astype(np.uint64) << np.uint64(20)) + np.uint64(t))[:, None], (rows, WALKS)) * np.uint64(64) + np.arange(WALKS, dtype=np.uint64)
        for picks in part[t]:
            at = (picks * 3 * length[:, None]).astype(np.int64)
            key = _text.mix(key * np.uint64(31) + written[at, at_row, np.arange(WALKS)])
        out[:, :, t] = key
    return out.reshape(rows, WALKS * TABLES)


def passage_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edits from item to any part of text, and where the first such part ends."""
    row = np.zeros(len(text) + 1, np.int64)
    step = np.arange(len(text) + 1)
    for i, word in enumerate(item, 1):
        change = row[:-1] + (text != word)
        new = np.concatenate([[i], np.minimum(change, row[1:] + 1)])
        row = np.minimum.accumulate(new - step) + step
    end = int(row.argmin())
    return int(row[end]), end


@dataclass
class Items:
    """One block of benchmark items, as sent to the tasks."""

    ids: list[int | None]
    words: list[np.ndarray]
    seeds: np.ndarray  # distinct 3-grams, ascending
    places: np.ndarray  # code of (offset, length) for each seed, grouped by seed
    first: np.ndarray
    keys: np.ndarray  # hash keys, ascending
    owner: np.ndarray  # the item of each key
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by length, the hashes of short items, ascending, and their items


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the words before each document."""
    words = _text.find_words(data, offs, _text.PLAIN_BLANK)
    return _text.span_hash(data, words.start, words.end, lower=True), words.first


def prepare(ids: list[int | None], texts: list[str | None]) -> Items:
    hashes, first = words_of(*_text.buffers(pa.array(texts, pa.string())))
    items = [(i, hashes[a:b]) for i, a, b in zip(ids, first[:-1], first[1:], strict=True) if b > a]
    seed, place, keys, owner, short = [], [], [], [], {}
    for size in range(1, MIN_WORDS):
        of = [k for k, (_, w) in enumerate(items) if len(w) == size]
        if of:
            name = np.concatenate([_text.window_hash(items[k][1], size, size) for k in of])
            order = np.argsort(name, kind="stable")
            short[size] = name[order], np.array(of)[order]
    for _, w in items:
        if len(w) < MIN_WORDS:
            continue
        grams = _text.window_hash(w, SEED)
        seed.append(grams)
        place.append((np.arange(len(grams)) << 32) | len(w))
    order = sorted((k for k in range(len(items)) if len(items[k][1]) >= MIN_WORDS), key=lambda k: len(items[k][1]))
    for part in _by_width(order, [len(items[k][1]) for k in order]):
        length = np.array([len(items[k][1]) for k in part])
        rows = np.full((len(part), length.max()), _PAD)
        for row, k in zip(rows, part, strict=True):
            row[: len(items[k][1])] = items[k][1]
        got = embed_keys(rows, length)
        keys.append(got.ravel())
        owner.append(np.repeat(part, got.shape[1]))
    none = np.zeros(0, np.uint64)
    pairs = np.unique(np.stack([np.concatenate(seed or [none]), np.concatenate(place or [none]).astype(np.uint64)]), axis=1)
    seeds, begin = np.unique(pairs[0], return_index=True)
    keys, owner = np.concatenate(keys or [none]), np.concatenate(owner or [none.astype(np.int64)])
    order = np.argsort(keys, kind="stable")
    return Items([i for i, _ in items], [w for _, w in items], seeds, pairs[1].astype(np.int64), np.append(begin, pairs.shape[1]), keys[order], owner[order], short)


def _by_width(rows, width) -> Iterator:
    """rows, of ascending width, in parts of up to WINDOW_WORDS words, or one longer row."""
    lo = 0
    while lo < len(rows):
        hi = lo + 1
        while hi < len(rows) and (hi + 1 - lo) * int(width[hi]) <= WINDOW_WORDS:
            hi += 1
        yield rows[lo:hi]
        lo = hi


def _allowed(n: np.ndarray | int):
    return np.floor(EDITS * np.asarray(n) + 1e-9).astype(np.int64)


def windows(items: Items, hashes: np.ndarray, first: np.ndarray, at: np.ndarray, doc: np.ndarray, seed: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """start, length and document of the windows that the items' 3-grams at `at` align, with enough of them."""
    many = items.first[seed + 1] - items.first[seed]
    code = items.places[_text.spread(items.first[seed], many)]
    start, length, doc = np.repeat(at, many) - (code >> 32), code & 0xFFFFFFFF, np.repeat(doc, many)
    # The window lies in its document but for edits at the ends.
    slack = _allowed(length)
    fits = (start >= first[doc] - slack) & (start + length <= first[doc + 1] + slack)
    start, length, doc = start[fits], length[fits], doc[fits]
    start = np.clip(start, first[doc], np.maximum(first[doc], first[doc + 1] - length))
    start, length, doc = np.unique(np.stack([start, length, doc]), axis=1) if len(start) else np.zeros((3, 0), np.int64)
    slack = _allowed(length)
    low, high = np.maximum(first[doc], start - slack), np.minimum(first[doc + 1], start + length + slack)
    enough = hits[np.maximum(high - SEED + 1, low)] - hits[low] >= length - (SEED - 1) - SEED * slack
    pick = enough & (high - low >= length - slack)
    return np.stack([start[pick], length[pick], doc[pick]])


def short_hits(items: Items, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """document, item, start and words of the passages that are short items."""
    for size, (names, of) in items.short.items():
        grams = _text.window_hash(hashes, size, size)
        at = _packed.Filter(names, 16).members(grams)
        doc = np.searchsorted(first, at, "right") - 1
        at, doc = at[at + size <= first[doc + 1]], doc[at + size <= first[doc + 1]]
        a, b = np.searchsorted(names, grams[at]), np.searchsorted(names, grams[at], "right")
        owner = of[_text.spread(a, b - a)]
        yield from zip(np.repeat(doc, b - a).tolist(), owner.tolist(), np.repeat(at, b - a).tolist(), [size] * len(owner), strict=True)


def search(items: Items, hashes: np.ndarray, first: np.ndarray, seeds: _packed.Filter) -> list[tuple[int, int, int, int, int]]:
    """(document, item, start, words, distance) of every confirmed passage."""
    out: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for d, item, begin, size in short_hits(items, hashes, first):
        out.setdefault((d, item), []).append((begin, size, 0))
    grams = _text.window_hash(hashes, SEED)
    at = seeds.members(grams)
    doc = np.searchsorted(first, at, "right") - 1
    inside = at + SEED <= first[doc + 1]
    at, doc = at[inside], doc[inside]
    hits = np.zeros(len(hashes) + 1, np.int64)
    hits[at] = 1
    hits = np.concatenate([[0], np.cumsum(hits)])
    seed = np.searchsorted(items.seeds, grams[at])
    places = np.cumsum(items.first[seed + 1] - items.first[seed]) if len(at) else np.zeros(0, np.int64)
    cuts = np.unique(np.searchsorted(places, np.arange(0, (places[-1] if len(at) else 0) + PLACES, PLACES)))
    found = [windows(items, hashes, first, at[a:b], doc[a:b], seed[a:b], hits) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    start, length, doc = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), np.int64)
    slack = _allowed(length)
    low, high = np.maximum(first[doc], start - slack), np.minimum(first[doc + 1], start + length + slack)
    pick = np.argsort(length, kind="stable")
    pairs: set[tuple[int, int]] = set()
    for part in _by_width(pick, length[pick]):
        place = start[part][:, None] + np.arange(length[part].max())
        beyond = (place >= first[doc[part] + 1][:, None]) | (place >= (start + length)[part][:, None])
        keys = embed_keys(np.where(beyond, _PAD, hashes[np.minimum(place, len(hashes) - 1)]), length[part]).ravel()
        a, b = np.searchsorted(items.keys, keys), np.searchsorted(items.keys, keys, "right")
        found = np.flatnonzero(b > a)
        many = (b - a)[found]
        owner = items.owner[_text.spread(a[found], many)]
        pairs |= set(zip(np.repeat(part[found // (WALKS * TABLES)], many).tolist(), owner.tolist(), strict=True))
    rest = []
    for w, item in sorted(pairs):
        target = items.words[item]
        if len(target) == length[w]:
            if np.array_equal(hashes[start[w] : start[w] + length[w]], target):
                out.setdefault((int(doc[w]), item), []).append((int(start[w]), len(target), 0))
            else:
                rest.append((w, item, target))
    for w, item, target in rest:
        begin, n = int(start[w]), len(target)
        if any(begin < a + k and a < begin + n for a, k, distance in out.get((int(doc[w]), item), ()) if not distance):
            continue  # over a verbatim passage
        text = hashes[low[w] : high[w]]
        if np.isin(target, text).sum() < n - slack[w]:
            continue  # each edit loses one word of the item at most
        distance, end = passage_distance(target, text)
        if distance <= slack[w]:
            _, back = passage_distance(target[::-1], text[:end][::-1])
            out.setdefault((int(doc[w]), item), []).append((int(low[w]) + end - back, back, distance))
    rows = []
    for (d, item), spans in sorted(out.items()):
        taken: list[tuple[int, int]] = []
        for begin, words, distance in sorted(set(spans), key=lambda s: (s[2], s[0], s[1])):
            if all(begin + words <= a or begin >= b for a, b in taken):
                taken.append((begin, begin + words))
                rows.append((d, item, begin - int(first[d]), words, distance))
    return rows


def item_blocks(benchmark: DataFrame, item_block: int = ITEM_BLOCK) -> Iterator[Items]:
    """The prepared items, a bounded block at a time."""
    items = benchmark.select("item_id", "text").distinct()
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-n // item_block), -(-(size or 0) // BLOCK_BYTES))
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = sorted(part.collect(), key=lambda r: (r["item_id"] is not None, r["item_id"], r["text"] or ""))  # one block
        yield prepare([r["item_id"] for r in rows], [r["text"] for r in rows])


def _slab_hits(known: Items, seeds: _packed.Filter, texts: pa.Array) -> Iterator[tuple[int, list]]:
    """For each slab its first document and what search() finds in it."""
    data, offs = _text.buffers(texts)
    for lo, hi in _text.slabs(offs):
        yield lo, search(known, *words_of(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]), seeds)


def matches(docs: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK) -> DataFrame:
    """Every passage of an item in a document, see MATCHES."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", "text")
    out = None
    for block in item_blocks(benchmark, item_block):
        items = spark.sparkContext.broadcast(block)

        @_text.tidy
        def found(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            known = items.value
            seeds = _packed.Filter(known.seeds, 20)
            for batch in batches:
                for lo, rows in _slab_hits(known, seeds, batch.column(1)):
                    if rows:
                        doc, item, *rest = zip(*rows, strict=True)
                        ids = batch.column(0).take(pa.array([lo + d for d in doc]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([known.ids[i] for i in item], pa.int64()), pa.array(rest[0], pa.int64()), pa.array(rest[1], pa.int64()), pa.array(rest[2], pa.int32())], [c.split()[0] for c in MATCHES.split(", ")])

        one = docs.mapInArrow(found, MATCHES)
        out = one if out is None else out.unionByName(one)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK) -> DataFrame:
    """The rows of docs without a passage of an item, with all their columns; each row is judged by itself."""
    spark = docs.sparkSession
    bound_batches(spark)
    at_text = docs.columns.index("text")
    for block in item_blocks(benchmark, item_block):
        items = spark.sparkContext.broadcast(block)

        @_text.tidy
        def kept(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            known = items.value
            seeds = _packed.Filter(known.seeds, 20)
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for lo, rows in _slab_hits(known, seeds, batch.column(at_text)):
                    keep[[lo + row[0] for row in rows]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
