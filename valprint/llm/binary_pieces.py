"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded (operator 11)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from valprint.llm.byte_ids import encoder
from valprint.llm.shared import slices, written

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, part int, place long"


def decompose(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document in turn its number of pieces, and the lengths of all pieces, the longest of a document first.

    A document of n ids has a piece of capacity, a power of two, for each whole capacity in n, and one for each binary
    digit of what is left.
    """
    digits = capacity >> np.arange(1, capacity.bit_length())
    has = (sizes[:, None] & digits) > 0
    counts = np.column_stack([sizes // capacity, has])
    lengths = np.repeat(np.tile(np.append(capacity, digits), len(sizes)), counts.ravel())
    return counts.sum(axis=1), lengths


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """The pieces of docs (doc_id, text) in one pass without a shuffle, numbered in each input partition and bucket.

    bucket is the binary logarithm of the length; part and place tell a piece's partition and its place among those of
    its partition and bucket, from 0.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(vocabulary).encode, np.array([end_id], "<u4").tobytes()
        part, upto = TaskContext.get().partitionId(), np.zeros(capacity.bit_length(), np.int64)
        for batch, texts in slices(batches):
            blobs = encode(texts)
            raw = b"".join(ids + tail for ids in blobs)
            sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4 + 1
            n, length = decompose(sizes, capacity)
            end = np.cumsum(length)
            start = end - length
            view = memoryview(raw)
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            bucket = np.log2(length).astype(np.int64)
            place = np.empty_like(length)
            for b in np.unique(bucket):
                mine = np.flatnonzero(bucket == b)
                place[mine] = upto[b] + np.arange(len(mine))
                upto[b] += len(mine)
            doc = np.repeat(np.arange(len(sizes)), n)
            columns = [
                batch.column(0).cast(pa.int64()).take(pa.array(doc)), pa.array(start - (np.cumsum(sizes) - sizes)[doc]), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[doc]),
                pa.array(bucket.astype(np.int32)), pa.array(np.full(len(doc), part, np.int32)), pa.array(place),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PIECE.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def bucketed(cut: DataFrame) -> DataFrame:
    """Numbers the sequences of each bucket of pieces() without gaps: slot within the bucket, sequence_id over all.

    Each piece is a sequence by itself. Only counts of partition and bucket are summed in order, a bucket of them by
    one task; pieces meet them by a join that Spark broadcasts only under its size limit.
    """
    counts = cut.groupBy("part", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    slot = F.col("before") + F.col("place")
    number = F.shiftleft(F.col("bucket").cast("long"), 56) + slot
    return cut.join(counts.select("part", "bucket", before.alias("before")), ["part", "bucket"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket", slot.alias("slot"))


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, slot of each piece of docs (doc_id, text).

    The ids of a document and end_id are cut into pieces of capacity and of the powers of two that make up the rest,
    the longest first. Each is a sequence of its own at offset 0, so nothing is padded and no sequence holds two
    documents. Pieces of one length are a bucket (the length's binary logarithm), numbered by slot without gaps; a
    sequence_id holds the bucket above its 56 lower bits and the slot in them. A null text counts as empty: one piece
    of the end id alone. A null doc_id stays null. Repeated rows are cut as often as they come; an empty table gives
    no rows; further columns are left out. The pieces are written once, so no text is encoded twice.
    """
    return bucketed(written(pieces(docs, capacity, end_id, vocabulary), "binary-pieces"))


def batches(packed: DataFrame, tokens: int) -> DataFrame:
    """packed with batch, the training batch of each sequence: equal lengths only, so many that they have these tokens.

    A batch of bucket b holds tokens >> b sequences, at least one; only the last batch of a bucket may hold fewer.
    """
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(tokens) / F.col("length")))
    return packed.withColumn("batch", F.expr("slot").cast("long") - F.pmod(F.col("slot"), each)).withColumn("batch", F.floor(F.col("batch") / each))
