"""Packing into sequences by best-fit decreasing with certified partitions (operator 6)."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valprint.llm.byte_ids import encoder
from valprint.llm.shared import dropped, parts_for, slices, written

#: Pieces that one task packs.
EACH = 2048
#: Parts of the capacity (sixteenths) below which a sequence's pieces are exchanged.
LOOSE = 15
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", row long, sequence_id long, offset long, fill long, gap long"


def cut(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """The pieces of each document: its ids and end_id, cut only if longer than capacity.

    All pieces but the first have capacity ids, so a document leaves at most one piece to be packed with others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(vocabulary).encode, np.array([end_id], "<u4").tobytes()
        for part, texts in slices(batches):
            doc, piece, start, length, crc = [], [], [], [], []
            for doc_id, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                raw = memoryview(ids + tail)
                n = len(raw) // 4
                at, k = 0, 0
                while at < n:
                    to = at + ((n - 1) % capacity + 1 if k == 0 else capacity)
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(raw[4 * at : 4 * to]))
                    at, k = to, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that these lengths need at least: the best of two families of dual feasible functions.

    Such a function f keeps the sum of f over any bin at most 1, so the sum over all items is a bound. The first
    family counts items above capacity - a as whole bins and leaves out those below a; the second rounds size *
    (k + 1) / capacity down to k-ths and keeps exact multiples.
    """
    return bound_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of(count: np.ndarray, capacity: int) -> int:
    """lower_bound() of so many items of each length."""
    size = np.arange(capacity + 1)
    best = -(-int(count @ size) // capacity)
    above = np.cumsum(count[::-1])[::-1]
    weight = np.cumsum((count * size)[::-1])[::-1]
    for a in range(1, capacity // 2 + 1):
        whole = int(above[capacity - a + 1])
        best = max(best, whole + -(-int(weight[a] - weight[capacity - a + 1]) // capacity))
    for k in range(1, 33):
        scaled = size * (k + 1)
        f = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int(count @ f) // (k * capacity)))
    return best


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item and the fill of each bin; items come in the order to be placed."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    bins, offsets, fills = [], [], []
    for n in lengths:
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins.append(b)
        offsets.append(fills[b])
        fills[b] += n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, fills


def _packed(pieces: DataFrame, rows: int, capacity: int, turn: int, before: int) -> DataFrame:
    """pieces packed in partitions dealt anew each turn; before counts the partitions of earlier turns, for the numbers."""
    buckets = -(-rows // EACH)
    if before + buckets >= 1 << 34:
        raise ValueError("too many pieces for the numbering of sequences")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        bins, offsets, fills = best_fit(pdf["length"].tolist(), capacity)
        gap = len(fills) - lower_bound(pdf["length"].to_numpy(), capacity)
        sequence = ((before + int(pdf["bucket"].iloc[0])) << 28) + np.array(bins, np.int64)
        return pdf.drop(columns="bucket").assign(sequence_id=sequence, offset=offsets, fill=np.array(fills, np.int64)[bins], gap=gap)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
    dealt = pieces.select(*names, F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(max(1, buckets))).alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(run, PLACED)


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, fill of each piece of docs (doc_id, text).

    Pieces are dealt by their row number, so that repeated rows spread, into partitions of about 2048, each packed by
    best-fit decreasing. A partition is certified if it has no more bins than its lower_bound(). Of the others the
    bins under 15/16 full, and of all partitions the emptiest bin if it is so, go into a pool that is dealt anew and
    packed again; that goes on until it saves no bin. certificate() holds the result against one bound for all. A
    null text counts as empty: one piece of the end id alone. A null doc_id stays null. Repeated rows are packed as
    often as they come; an empty table gives no rows; further columns are left out.
    """
    pieces = written(cut(docs, capacity, end_id, vocabulary).withColumn("row", F.monotonically_increasing_id()), "pieces")
    n = pieces.count()
    placed, before = written(_packed(pieces, n, capacity, 0, 0), "packed"), -(-n // EACH)
    dropped(pieces)
    done = None
    for turn in itertools.count(1):
        # a bin's partition is the upper part of its number
        part = F.shiftright("sequence_id", 28)
        bins = placed.groupBy("sequence_id", "fill", "gap").agg(F.count("*").alias("n"))
        emptiest = bins.groupBy(part.alias("part")).agg(F.min_by("sequence_id", F.struct("fill", "sequence_id")).alias("sequence_id"))
        slack = bins.filter(F.col("fill") * 16 < capacity * LOOSE)
        chosen = written(slack.join(emptiest.select("sequence_id", F.lit(True).alias("least")), "sequence_id", "left").filter("gap > 0 or least").select("sequence_id", "n"), "loose")
        loose, rows = chosen.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if loose < 2:
            break
        pool = placed.join(chosen.select("sequence_id"), "sequence_id", "left_semi")
        again = written(_packed(pool, rows, capacity, turn, before), "packed")
        before += -(-rows // EACH)
        if again.agg(F.count_distinct("sequence_id")).first()[0] >= loose:
            dropped(again)
            break
        kept = placed.join(chosen.select("sequence_id"), "sequence_id", "left_anti")
        done = kept if done is None else done.unionByName(kept)
        placed = again
    result = placed if done is None else done.unionByName(placed)
    return result.drop("gap", "row")


def certificate(packed: DataFrame, capacity: int = 1024) -> tuple[int, int]:
    """How many sequences packed has, and how many any packing of its pieces needs at least."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in packed.groupBy("length").count().collect():
        count[length] = n
    return packed.agg(F.count_distinct("sequence_id")).first()[0], bound_of(count, capacity)
