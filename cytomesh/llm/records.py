"""Op 9, token ids as length-delimited binary records with a separate offset index.

A record file is a run of frames in ascending doc_id order. A frame is
    u32 payload length | u32 masked checksum of those 4 bytes | payload | u32 masked checksum of the payload | 0x0A
with payload u8 flags (1: the doc_id is null) | i64 doc_id | u16 ids, all little-endian. A masked
checksum is zlib's crc32, rotated right by 15 bits, plus a fixed number, so that a checksum
over bytes that hold checksums stays sound. The index, Parquet, has for each record its file,
byte offset, length, doc_id, tokens and the tokens before it, so that a reader can fetch
records in any order.

Defined results: a null or empty text is a record of the end id alone; an empty table gives
no rows; rows of the same doc_id give a record each, next to each other; a null doc_id
sorts first; other columns are ignored. A frame whose checksum is wrong raises ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.llm import _blocks, _text, _tokenize
from cytomesh.session import bound_batches, drop_written, scratch_path, table, written

END_ID = 1
FILE_BYTES = 32 << 20
TOKENIZER = "word_bpe_49k.json"
_HEAD, _NULL_ID, _MASK = 8, 1, 0xA282EAD8
_PAYLOAD = "<Bq"  # flags, doc_id


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def masked(checksum: int) -> int:
    return (((checksum >> 15) | (checksum << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record, without the 0x0A that the writer sets after it."""
    length = len(payload).to_bytes(4, "little")
    return b"".join((length, masked(zlib.crc32(length)).to_bytes(4, "little"), payload, masked(zlib.crc32(payload)).to_bytes(4, "little")))


def frames(content, name: str = "") -> Iterator[tuple[int, memoryview]]:
    """Offset and payload of each record of a file, checked."""
    at, view = 0, memoryview(content)
    while at < len(view):
        length = int.from_bytes(view[at : at + 4], "little")
        end = at + _HEAD + length
        if masked(zlib.crc32(view[at : at + 4])) != int.from_bytes(view[at + 4 : at + 8], "little") or end + 5 > len(view) or view[end + 4] != 10:
            raise ValueError(f"{name}: damaged record length at byte {at}")
        payload = view[at + _HEAD : end]
        if masked(zlib.crc32(payload)) != int.from_bytes(view[end : end + 4], "little"):
            raise ValueError(f"{name}: damaged record at byte {at}")
        yield at, payload
        at = end + 5


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Tokenise every text and write path/records, one file for each range of doc_id, and path/index."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("salt"))
    bounds = _blocks.range_bounds(docs, file_bytes)

    @_text.tidy
    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenize.coder(tokenizer)
        for batch in _text.bounded(batches, 1):
            ids, cuts = _tokenize.with_end(*coder.encode(batch.column(1)), end_id)
            ids = ids.astype("<u2")
            doc_ids = batch.column(0).to_pylist()
            rows = [frame(struct.pack(_PAYLOAD, _NULL_ID * (d is None), d or 0) + ids[a:b].tobytes()) for d, a, b in zip(doc_ids, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bounds.of(batch.column(0), batch.column(2))), batch.column(0), pa.array(rows, pa.binary())], ["file", "doc_id", "frame"])

    rows = docs.mapInArrow(framed, "file int, doc_id long, frame binary").repartitionById(bounds.count, F.col("file"))
    rows.sortWithinPartitions("file", "doc_id").select("file", F.col("frame").cast("string")).write.partitionBy("file").text(f"{path}/records", lineSep="\n")
    scan = _scan(docs.sparkSession, path).drop("ids_crc32")
    scan = written(scan, "scan")
    base = _blocks.before_each(scan.groupBy("file").agg(F.sum("n_tokens").alias("n")), "file", "n", "base")
    scan.join(F.broadcast(base), "file").select("file", "offset", "length", "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens").write.parquet(f"{path}/index")
    drop_written(scan)


SCAN = "file int, offset long, length int, doc_id long, start long, n_tokens long, ids_crc32 long"


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the files, decoded and checked; start counts the tokens of its file."""

    @_text.tidy
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out, start = [], 0
                for at, payload in frames(content.as_buffer(), f"file {file}"):
                    flags, doc_id = struct.unpack_from(_PAYLOAD, payload)
                    ids = np.frombuffer(payload, "<u2", offset=struct.calcsize(_PAYLOAD)).astype("<u4")
                    out.append((file, at, len(payload), None if flags & _NULL_ID else doc_id, start, len(ids), zlib.crc32(ids)))
                    start += len(ids)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW, strict=True)], [f.split()[0] for f in SCAN.split(", ")])

    return _blocks.binary_files(spark, f"{path}/records").mapInArrow(decoded, SCAN)


_ARROW = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, decoded and checked again from the files.

    The index gives each file's first place, one small row a file.
    """
    base = spark.read.parquet(f"{path}/index").groupBy("file").agg(F.min("start").alias("base"))
    return _scan(spark, path).join(F.broadcast(base), "file").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids (array) of the records in wanted (file, offset, length), in any order.

    wanted is grouped by file, so each file is read once however its rows are shuffled.
    """
    files = _blocks.binary_files(spark, f"{path}/records")
    asked = wanted.groupBy("file").agg(F.collect_list("offset").alias("offsets"))

    @_text.tidy
    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, offsets in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                view = memoryview(content.as_buffer())
                rows = []
                for at in offsets:
                    _, payload = next(frames(view[at:], f"record at {at}"))
                    flags, doc_id = struct.unpack_from(_PAYLOAD, payload)
                    rows.append((None if flags & _NULL_ID else doc_id, np.frombuffer(payload, "<u2", offset=struct.calcsize(_PAYLOAD)).tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return files.join(asked, "file").select("content", "offsets").mapInArrow(picked, "doc_id long, ids array<int>")


def op9_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "records")
    write_records(table(spark, sf_dir, "documents"), path, tokenizer_path(TOKENIZER))
    return read_records(spark, path)
