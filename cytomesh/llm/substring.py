"""Op 10, substring dedup by prefix-partitioned suffix trees.

Suffixes start at words. A group of suffixes is named by a prefix of variable length: one
word, and one more as long as the prefix is so frequent that its group would exceed its
share of memory (counted over all documents). A suffix travels to its group as the
fingerprint of its first 13 words, so a group's sorted list is the level of its suffix tree
at depth 13: a value that occurs again is an internal node at least that deep, and its
leaves are repeats. Runs of such leaves in a document are its maximal repeats. Deeper
levels change neither what is repeated nor where, so they are not sent.

Documents are dealt into blocks of consecutive doc_ids. A block sends each group one packed
list without repeats, so a passage that a third of all documents share costs one entry a
block, and a group answers with one bit an entry: does an earlier block have it. Repeats
inside a block are found there. Fingerprints with the group's number are 64 bits; two
different windows of one group agree with a probability of about entries * 2**-57 a window.

Defined results: null, empty and short texts have no window and lose nothing; rows of equal
doc_id don't count as smaller; a null doc_id neither removes nor loses words; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.llm import _blocks, _packed, _text
from cytomesh.session import bound_batches, table, written

WINDOW = 13
BLOCK_BYTES = 8 << 20
#: Longest prefix that names a group by itself; a longer one is cut by the window's fingerprint.
PREFIX_WORDS = 4
REPEATS = "doc_id long, n_words long, n_removed long, repeats array<struct<first:long,words:long>>, kept string"


def frequent_prefixes(docs: DataFrame, groups: int) -> list[np.ndarray]:
    """For 1.. words, the hashes of prefixes with more than half a group's share of all words.

    Counts cover all documents. A prefix that frequent is frequent in some slab of text too,
    so slabs report those alone; at most 2 * groups prefixes of each length come back.
    """

    @_text.tidy
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = _text.buffers(batch.column(0))
            for lo, hi in _text.slabs(offs, 4 * _text.SLAB):
                part = data[offs[lo] : offs[hi]]
                words = _text.find_words(part, offs[lo : hi + 1] - offs[lo])
                hashes = _text.span_hash(part, words.start, words.end)
                out = [([0], [0], [len(hashes)])]
                heavy = hashes
                for size in range(1, PREFIX_WORDS):
                    values, counts = np.unique(heavy, return_counts=True)
                    often = counts * (4 * groups) >= len(hashes)
                    values, counts = values[often], counts[often]
                    out.append((np.full(len(values), size), values.view(np.int64), counts))
                    at = _packed.Filter(values).members(_text.window_hash(hashes, size, size) if size > 1 else hashes)
                    at = at[at + size < len(hashes)]
                    heavy = _text.window_hash(hashes, size + 1, size + 1)[at]
                size, value, count = (pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([size, value, count], ["size", "value", "count"])

    found = docs.select("text").mapInArrow(local, "size long, value long, count long").groupBy("size", "value").agg(F.sum("count").alias("count"))
    found = written(found, "prefixes")  # some thousand rows for each task
    total = found.where("size = 0").agg(F.sum("count")).first()[0] or 0
    rows = found.where((F.col("size") > 0) & (F.col("count") * (2 * groups) > total)).collect()  # at most 2 * groups of a size
    return [np.array(sorted(r["value"] for r in rows if r["size"] == size), np.int64).view(np.uint64) for size in range(1, PREFIX_WORDS)]


def window_keys(data: np.ndarray, offs: np.ndarray, window: int, groups: int, frequent: list[np.ndarray]) -> tuple[_text.Words, np.ndarray, np.ndarray]:
    """Words of some documents, the windows' first words, and the windows' keys.

    A key is the group's number followed by the window's fingerprint; keys sort by group.
    """
    words = _text.find_words(data, offs)
    hashes = _text.span_hash(data, words.start, words.end)
    starts = _text.window_starts(words.first, window)
    prints = _text.window_hash(hashes, window)[starts] if len(starts) else np.zeros(0, np.uint64)
    route = hashes[starts].copy()
    long = np.arange(len(starts))
    for size, values in enumerate(frequent, 1):
        long = long[_packed.Filter(values, 16).members(route[long])]
        if not len(long):
            break
        if size < len(frequent):
            route[long] = _text.window_hash(hashes, size + 1, size + 1)[starts[long]]
        else:
            route[long] = prints[long]
    bits = max(1, (groups - 1).bit_length())
    group = _text.mix(route) % np.uint64(groups)
    return words, starts, (group << np.uint64(64 - bits)) | (prints >> np.uint64(bits))


def _unique(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _block_keys(texts: pa.ChunkedArray, window: int, groups: int, frequent: list[np.ndarray]):
    data, offs = _text.buffers(texts)
    first, starts, keys, base = [np.zeros(1, np.int64)], [], [], 0
    for lo, hi in _text.slabs(offs):
        words, at, key = window_keys(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], window, groups, frequent)
        first.append(words.first[1:] + base)
        starts.append(at + base)
        keys.append(key)
        base += len(words.start)
    none = np.zeros(0, np.int64)
    return np.concatenate(first), np.concatenate(starts or [none]), np.concatenate(keys or [none.view(np.uint64)])


def removals(texts: pa.ChunkedArray, doc_ids: np.ndarray, has_id: np.ndarray, bits: list[bytes], counts: list[int], window: int, groups: int, frequent: list[np.ndarray]):
    """Words before each document and a mask of the words to remove, for one block."""
    first, starts, keys = _block_keys(texts, window, groups, frequent)
    doc = np.searchsorted(first, starts, "right") - 1
    mine = has_id[doc]
    starts, keys, doc = starts[mine], keys[mine], doc[mine]
    ordered = np.sort(keys)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    unique = _unique(ordered)
    earlier = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=c) for b, c in zip(bits, counts, strict=True)]).astype(bool) if bits else np.zeros(len(unique), bool)
    hit = [_packed.Filter(unique[earlier]).members(keys)]
    inside = _packed.Filter(again).members(keys)  # in several places of this block
    if len(inside):
        order = inside[np.lexsort((doc_ids[doc[inside]], keys[inside]))]
        new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        smallest = doc_ids[doc[order]][np.flatnonzero(new)][np.cumsum(new) - 1]
        hit.append(order[doc_ids[doc[order]] > smallest])
    edges = np.zeros(first[-1] + 1, np.int32)
    at = np.unique(np.concatenate(hit))
    edges[starts[at]] += 1
    np.add.at(edges, starts[at] + window, -1)
    return first, np.cumsum(edges[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """See REPEATS: the maximal repeats (in words of the input) and the text that is kept."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("salt"))
    bounds = _blocks.range_bounds(docs, block_bytes)
    groups = bounds.count
    frequent = frequent_prefixes(docs, groups)

    @_text.tidy
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bounds.of(batch.column(0), batch.column(2))), *batch.columns[:2]], ["block", "doc_id", "text"])

    blocks = docs.mapInArrow(dealt, "block int, doc_id long, text string")

    def ask(block: pa.Table) -> pa.Table:
        _, starts, keys = _block_keys(block["text"].filter(block["doc_id"].is_valid()), window, groups, frequent)
        keys = _unique(keys)
        shift = np.uint64(64 - max(1, (groups - 1).bit_length()))
        cuts = np.searchsorted(keys, np.arange(groups + 1).astype(np.uint64) << shift) if groups > 1 else np.array([0, len(keys)])
        cuts[-1] = len(keys)
        used = np.flatnonzero(np.diff(cuts))
        return pa.table({
            "group": pa.array(used.astype(np.int32)),
            "block": pa.array([block["block"][0].as_py()] * len(used), pa.int32()),
            "n": pa.array(np.diff(cuts)[used].astype(np.int32)),
            "keys": pa.array([_packed.pack_sorted(keys[cuts[g] : cuts[g + 1]]) for g in used.tolist()], pa.binary()),
        })

    def answer(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        lists = [_packed.unpack_sorted(k.as_buffer()) for k in group["keys"]]
        keys = np.concatenate(lists)
        ordered = np.sort(keys)
        at = _packed.Filter(ordered[1:][ordered[1:] == ordered[:-1]]).members(keys)  # ascending: earlier blocks come first
        seen = np.zeros(len(keys), bool)
        order = at[np.argsort(keys[at], kind="stable")]
        cuts = np.cumsum([0, *map(len, lists)])
        if len(order):
            place = bounds.range_of(group["block"].to_numpy())[np.searchsorted(cuts, order, "right") - 1]
            new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
            seen[order] = place > place[np.flatnonzero(new)][np.cumsum(new) - 1]  # blocks of one doc_id are not earlier than each other
        return pa.table({
            "block": group["block"], "group": group["group"], "n": group["n"],
            "bits": pa.array([np.packbits(seen[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        })

    def strip(block: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("group")
        ids = block["doc_id"]
        has = ids.is_valid().to_numpy()
        first, gone = removals(block["text"], ids.fill_null(0).to_numpy(), has, [b.as_py() for b in answers["bits"]], answers["n"].to_pylist(), window, groups, frequent)
        edge = np.diff(gone.astype(np.int8), prepend=0)
        inner = first[1:-1]
        inner = inner[(inner > 0) & (inner < len(gone))]
        begins = np.union1d(np.flatnonzero(edge > 0), inner[gone[inner]])
        stops = np.ones(len(gone) + 1, bool)
        stops[:-1] = ~gone
        stops[first] = True
        stop_at = np.flatnonzero(stops)
        length = stop_at[np.searchsorted(stop_at, begins, "right")] - begins
        doc = np.searchsorted(first, begins, "right") - 1
        removed = np.concatenate([[0], np.cumsum(gone)])[first]
        kept = []
        for i, text in enumerate(block["text"].to_pylist()):
            words = (text or "").encode().split()
            if removed[i + 1] > removed[i]:
                mask = gone[first[i] : first[i + 1]].tolist()
                words = [w for w, g in zip(words, mask, strict=True) if not g]
            kept.append(b" ".join(words))
        spans = pa.StructArray.from_arrays([pa.array(begins - first[doc]), pa.array(length)], ["first", "words"])
        return pa.table({
            "doc_id": ids, "n_words": pa.array(np.diff(first)), "n_removed": pa.array(np.diff(removed)),
            "repeats": pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(first))), pa.int32()), spans),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    asked = blocks.groupBy("block").applyInArrow(ask, "group int, block int, n int, keys binary")
    answers = asked.groupBy("group").applyInArrow(answer, "block int, group int, n int, bits binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(strip, REPEATS)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = """
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents
), g as (
  select doc_id, i, array_to_string(ws[i : i + 12], ' ') as win
  from w, unnest(generate_series(1, len(ws) - 12)) as t(i)
), m as (select win, min(doc_id) as first_doc from g group by win),
bad as (select doc_id, list(i) as spots from g join m using (win) where first_doc < doc_id group by doc_id),
hit as (
  select doc_id, list_distinct(flatten(list_transform(spots, lambda s: range(s, s + 13)))) as gone from bad
), k as (
  select w.doc_id, ws, coalesce(gone, []) as gone from w left join hit using (doc_id)
), r as (
  select doc_id, ws, gone, list_sort(list_filter(range(1, len(ws) + 1), lambda i: not list_contains(gone, i))) as keep from k
)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(gone) as bigint) as n_removed,
       sha256(coalesce(array_to_string(list_transform(keep, lambda i: ws[i]), ' '), '')) as kept_sha256
from r
"""
