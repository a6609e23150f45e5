"""Token ids in Simple-8b words, with block offsets that let all words decode at once (operator 10)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valprint.llm.byte_ids import encoder
from valprint.llm.shared import MOST_PARTS, parts_for, slices, written

#: Ids of a block; blocks begin at word boundaries that the file lists.
BLOCK = 256
#: Ids after which a chunk of documents is closed.
CHUNK = 1 << 18
#: Values and bits each for selectors 1 to 14; selector 0 is the escape, a word whose value follows as a whole word.
COUNT = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
HEAD = struct.Struct("<4sIQQQQ")
MAGIC = b"VP8B"


def _selectors(ids: np.ndarray, blocks: int) -> np.ndarray:
    """For each place the selector of the most ids from there on that one word holds, 0 if only an escape holds the id."""
    # the first selector wide enough for an id; nothing is asked beyond a block's end, so a last word may be part-filled
    need = np.zeros(blocks * BLOCK, np.uint8)
    need[: len(ids)] = 1
    for bits in BITS[1:]:
        need[: len(ids)] += ids >= np.uint64(1 << int(bits))
    most = np.pad(need.reshape(blocks, BLOCK), ((0, 0), (0, int(COUNT[1]) - 1)))
    choice = np.zeros((blocks, BLOCK), np.int64)
    span = 1
    for s in range(len(COUNT) - 1, 0, -1):
        wider = int(COUNT[s]) - span  # no count is over twice the one before
        if wider:
            most = np.maximum(most[:, :-wider], most[:, wider:])
            span += wider
        choice[most[:, :BLOCK] <= s] = s
    return choice.ravel()[: len(ids)]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) and each block's first word, with the number of words at the end, of unsigned ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    index = np.arange(n)
    left = np.minimum((index // BLOCK + 1) * BLOCK, n) - index
    choice = _selectors(ids, blocks)
    step = np.minimum(COUNT[choice], left)
    # all blocks walk from word to word together
    at = np.arange(blocks) * BLOCK
    end = np.minimum(at + BLOCK, n)
    first = np.zeros(n, bool)  # of a word
    while len(at):
        first[at] = True
        at = at + step[at]
        more = at < end
        at, end = at[more], end[more]
    starts = np.flatnonzero(first)
    select = choice[starts]
    width = np.where(select == 0, 2, 1)
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    words[place] = select.astype(np.uint64) << np.uint64(60)
    for s in np.unique(select):
        mine = np.flatnonzero(select == s)
        if s == 0:
            words[place[mine] + 1] = ids[starts[mine]]
            continue
        for j in range(int(COUNT[s])):
            live = mine[step[starts[mine]] > j]
            words[place[live]] |= ids[starts[live] + j] << np.uint64(j * BITS[s])
    offsets = np.append(place[np.searchsorted(starts, np.arange(blocks) * BLOCK)], len(words))
    return words, offsets.astype(np.uint32)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids of pack()."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    select = (words >> np.uint64(60)).astype(np.int64)
    # the word after an escape is a value of 2^60 or more, so it never looks like an escape itself
    follows = np.append(False, select[:-1] == 0)
    select[follows] = 0
    count = np.where(follows, 0, COUNT[select])
    upto = np.cumsum(count) - count
    first = offsets[:-1].astype(np.int64)
    block = np.repeat(np.arange(len(first)), np.diff(offsets.astype(np.int64)))
    begin = block * BLOCK + upto - upto[first][block]
    end = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(select):
        mine = np.flatnonzero((select == s) & ~follows)
        if s == 0:
            out[begin[mine]] = words[mine + 1]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(int(COUNT[s])):
            live = mine[begin[mine] + j < end[mine]]
            out[begin[live] + j] = (words[live] >> np.uint64(j * BITS[s])) & mask
    return out


def to_bytes(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A chunk of the file: head, doc_ids (int64), ids of each (uint32), block offsets (uint32), words (uint64)."""
    words, offsets = pack(ids)
    return b"".join([HEAD.pack(MAGIC, 1, len(doc_ids), len(ids), len(offsets), len(words)), doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    magic, version, docs, n, offsets, words = HEAD.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a chunk of packed token ids")
    at = HEAD.size
    parts = []
    for kind, count in (("<i8", docs), ("<u4", docs), ("<u4", offsets), ("<u8", words)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    return parts[0], parts[1], unpack(parts[3].astype(np.uint64), parts[2], n)


FILE = "part int, chunk int, before long, n_ids long, data binary"


def write_ids(docs: DataFrame, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Encodes docs (doc_id, text) into files in the shared folder, in ascending doc_id order; returns their table.

    Rows are dealt by ranges of doc_id, so part p holds no larger doc_ids than part p + 1, a null doc_id first and
    equal doc_ids by a hash of the text. Each row of the table is a chunk of whole documents with the ids before it in its part.
    A null text counts as empty and holds the end id alone.
    """
    parts = parts_for(docs.count(), 4096, docs.sparkSession, MOST_PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, tail = encoder(vocabulary).encode, np.array([end_id], "<u4").tobytes()
        doc_ids: list[int] = []
        nulls = 0
        blobs: list[bytes] = []
        chunk = before = held = 0

        def close() -> pa.RecordBatch:
            nonlocal chunk, before, held
            sizes = np.array([len(b) // 4 for b in blobs])
            data = to_bytes(np.array(doc_ids, np.int64), sizes, np.frombuffer(b"".join(blobs), "<u4"))
            row = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (chunk, pa.int32()), (before, pa.int64()), (held, pa.int64()), (data, pa.binary()))], ["part", "chunk", "before", "n_ids", "data"])
            chunk, before, held = chunk + 1, before + held, 0
            doc_ids.clear()
            blobs.clear()
            return row

        for batch, texts in slices(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                doc_ids.append(NULL_ID if doc_id is None else doc_id)
                blobs.append(ids + tail)
                held += len(ids) // 4 + 1
                if held >= CHUNK:
                    yield close()
        if blobs:
            yield close()

    # rows of one doc_id, or of none, spread by a hash of the text, and repeated rows by their number
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("by_text"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "by_text", "row"]
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(ordered.mapInArrow(run, FILE), "token-ids")


#: Stands for a null doc_id in the files.
NULL_ID = -(1 << 63)


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, all from files that write_ids() made.

    The driver gathers one number for each part to know what stands before it.
    """
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg({"n_ids": "sum"}).withColumnRenamed("sum(n_ids)", "n").collect())
    base, upto = {}, 0
    for part, n in totals:
        base[part], upto = upto, upto + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, sizes, ids = from_bytes(batch.column(2)[i].as_py())
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(sizes.astype(np.int64))
                starts = ends - sizes
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                start = starts + base[batch.column(0)[i].as_py()] + batch.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(start), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "before", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_ids(docs: DataFrame, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Writes docs by write_ids() and returns what read_ids() finds in the files.

    A null text counts as empty, a null doc_id comes first, repeated rows are written as often as they come. An empty
    table gives no rows; further columns are left out.
    """
    return read_ids(write_ids(docs, end_id, vocabulary))
