"""Op 1, token counts by a separator scan of flat token files.

A token file is a plain run of little-endian unsigned 16-bit ids; each document ends with
the end-of-document id. There is no index: the scan cuts the files into blocks, finds the
end ids of a block with one vectorised comparison, and stitches documents that cross
block or file borders with a prefix scan over block summaries (tokens so far, documents
so far, last end id so far), first inside each file, then over files.

Defined results: a null or empty text is a document of its end id alone; an empty table
gives no rows; equal doc_ids keep one row each, in any order among them; a null doc_id
sorts first; columns other than doc_id and text are ignored, whatever they are named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytomesh.llm import _blocks, _text, _tokenize
from cytomesh.session import bound_batches, scratch_path, table

END_ID = 1
#: Text bytes of the documents of one token file.
FILE_BYTES = 32 << 20
#: Tokens of one scan block.
BLOCK_TOKENS = 1 << 20


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word ids 2..65535 of all texts, and the bounds of each text in them."""
    data, offs = _text.buffers(texts)
    ids, counts = [], []
    for lo, hi in _text.slabs(offs):
        part = data[offs[lo] : offs[hi]]
        words = _text.find_words(part, offs[lo : hi + 1] - offs[lo])
        ids.append((_text.span_hash(part, words.start, words.end) % np.uint64(65534) + np.uint64(2)).astype(np.uint16))
        counts.append(words.count)
    return np.concatenate(ids or [np.zeros(0, np.uint16)]), np.concatenate([[0], np.cumsum(np.concatenate(counts or [np.zeros(0, np.int64)]))])


def library_ids(tokenizer: str):
    """An encoder of the tokenizers library's ids, two higher, so that 0 and the end id stay free."""

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, cuts = _tokenize.coder(tokenizer).encode(texts)
        if len(ids) and ids.max() > 65533:
            raise ValueError("the tokenizer's ids need more than 16 bits")
        return (ids + 2).astype(np.uint16), cuts

    return encode


def write_token_files(docs: DataFrame, path: str, encode=word_ids, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> _blocks.Ranges:
    """Write flat token files in ascending doc_id order, one for each range of doc_id.

    encode: from an Arrow string column to 16-bit ids and their bounds, never with end_id.
    Returns the ranges; a doc_id that fills several files has them to itself. The ids are shuffled, not the texts.
    Spark's text writer commits the files; its line separator is the end id.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("salt"))
    bounds = _blocks.range_bounds(docs, file_bytes)

    @_text.tidy
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.bounded(batches, 1):
            ids, cuts = encode(batch.column(1))
            file = bounds.of(batch.column(0), batch.column(2))
            yield pa.RecordBatch.from_arrays([pa.array(file), batch.column(0), _text.pack_binary(ids.astype("<u2"), cuts)], ["file", "doc_id", "ids"])

    out = docs.mapInArrow(encoded, "file int, doc_id long, ids binary").repartitionById(bounds.count, F.col("file"))
    out = out.sortWithinPartitions("file", "doc_id").select("file", F.col("ids").cast("string"))
    separator = int(end_id).to_bytes(2, "little").decode("latin-1")
    if end_id > 127:
        raise ValueError("the end id must be below 128: the writer's separator is UTF-8")
    out.write.partitionBy("file").text(path, lineSep=separator)
    return bounds


def scan_tokens(spark: SparkSession, path: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents of a folder of flat token files: file, ordinal, start, n_tokens.

    file is the files' partition column and gives their order; ordinal counts documents
    that end in a file; start counts tokens over all files. Tokens after the last end id
    are no document. A document may begin in one file and end in a later one.
    """

    @_text.tidy
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                buf = content.as_buffer()
                tokens = np.frombuffer(buf, "<u2", len(buf) // 2)
                for block in range(0, max(len(tokens), 1), block_tokens):
                    part = tokens[block : block + block_tokens]
                    ends = np.flatnonzero(part == end_id).astype(np.int32)
                    last = int(ends[-1]) + block if len(ends) else None
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([len(part)], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([last], pa.int64()), pa.array([ends.tobytes()], pa.binary())],
                        ["file", "block", "n_tokens", "n_ends", "last_end", "ends"],
                    )

    schema = "file int, block long, n_tokens long, n_ends long, last_end long, ends binary"
    found = _blocks.binary_files(spark, path).mapInArrow(blocks, schema)
    # Inside each file: documents and the last end before each block.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("ends_before", F.coalesce(F.sum("n_ends").over(earlier), F.lit(0))).withColumn("end_before", F.max("last_end").over(earlier))
    # Over files: one row each.
    files = found.groupBy("file").agg(F.sum("n_tokens").alias("n_tokens"), F.max("last_end").alias("last_end"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("base"), "last_end")
    files = files.select("file", "base", F.coalesce(F.max(F.col("base") + F.col("last_end")).over(earlier), F.lit(-1)).alias("carry"))

    @_text.tidy
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.frombuffer(row["ends"], np.int32).astype(np.int64) + row["block"] + row["base"]
                if not len(ends):
                    continue
                prev = row["carry"] if row["end_before"] is None else row["end_before"] + row["base"]
                start = np.concatenate([[prev], ends[:-1]]) + 1
                ordinal = np.arange(len(ends)) + row["ends_before"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), row["file"], np.int32)), pa.array(ordinal), pa.array(start), pa.array(ends - start + 1)], ["file", "ordinal", "start", "n_tokens"])

    found = found.join(F.broadcast(files), "file")  # one small row for each file
    return found.mapInArrow(documents, "file int, ordinal long, start long, n_tokens long")


def token_counts(docs: DataFrame, file_bytes: int = FILE_BYTES, encode=word_ids) -> DataFrame:
    """doc_id, start and n_tokens (with the end id) of every document, from its token files."""
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    bounds = write_token_files(docs, path, encode, file_bytes=file_bytes)

    @_text.tidy
    def file_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bounds.of(batch.column(0), batch.column(1)))], ["doc_id", "file"])

    order = Window.partitionBy("file").orderBy("doc_id")
    names = docs.select("doc_id", F.xxhash64("text").alias("salt")).mapInArrow(file_of, "doc_id long, file int").withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))
    return names.join(scan_tokens(spark, path), ["file", "ordinal"]).select("doc_id", "start", "n_tokens")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


OP1_SQL = """
with d as (
  select doc_id, 1 + length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 'w', 'g'), '[\\x20\\x09-\\x0D]+', '', 'g')) as n_tokens
  from documents
)
select doc_id, cast(coalesce(sum(n_tokens) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start,
       cast(n_tokens as bigint) as n_tokens
from d
"""
