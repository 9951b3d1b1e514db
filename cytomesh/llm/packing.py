"""Op 5, packing by concatenate and cut.

Pass 1 tokenises every text once and writes the ids as a table whose rows know their
partition and the ids before them in it. The partitions' totals (one small row each) are
summed into global offsets. Pass 2 adds them and cuts the stream at every multiple of the
sequence length; each piece is a boundary record. Only the last sequence is not full.

Defined results: a null or empty text is a document of its end id alone; an empty table
gives no rows; repeated rows are packed once each; a null doc_id stays null; other columns
are ignored. The order of documents is that of the scan that wrote the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.llm import _blocks, _text, _tokenize
from cytomesh.llm.records import tokenizer_path
from cytomesh.session import bound_batches, table, written

SEQUENCE = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """part, doc_id, before (ids earlier in the part), ids (binary, unsigned 16-bit)."""

    @_text.tidy
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenize.coder(tokenizer)
        before = 0
        for batch in _text.bounded(batches, 1):
            ids, cuts = _tokenize.with_end(*coder.encode(batch.column(1)), end_id)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(cuts[:-1] + before), _text.pack_binary(ids.astype("<u2"), cuts)], ["part", "doc_id", "before", "ids"])
            before += int(cuts[-1])

    return docs.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(encoded, "part int, doc_id long, before long, ids binary")


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents, see PIECES."""
    bound_batches(docs.sparkSession)
    ids = written(tokenized(docs, tokenizer, end_id), "packing")
    totals = ids.groupBy("part").agg(F.sum(F.octet_length("ids") / 2).cast("long").alias("n"))
    base = _blocks.before_each(totals, "part", "n", "base")

    @_text.tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = _text.buffers(batch.column(2))
            stream, bounds = np.frombuffer(data, "<u2").astype("<u4"), offs // 2
            first = batch.column(1).to_numpy()
            tokens = np.diff(bounds)
            pieces = (first + tokens - 1) // sequence - first // sequence + 1
            row = np.repeat(np.arange(len(first)), pieces)
            place = _text.spread(first // sequence, pieces)  # the sequence of each piece
            lo = np.maximum(first[row], place * sequence)
            hi = np.minimum(first[row] + tokens[row], (place + 1) * sequence)
            start = lo - first[row]
            at = bounds[row] + start
            crc = [zlib.crc32(stream[a:b]) for a, b in zip(at.tolist(), (at + hi - lo).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *map(pa.array, (start, hi - lo, np.array(crc, np.int64), tokens[row], place, lo - place * sequence))], [c.split()[0] for c in PIECES.split(", ")])

    # base has one small row for each partition of pass 1
    return ids.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("before")).alias("first"), "ids").mapInArrow(cut, PIECES)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))
