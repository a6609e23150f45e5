"""Sets of any size as rows: one for each set and upper part of its numbers, with a container of the lower 16 bits.

A table of these has cid, hi, card and data. It is built by partial aggregation of 64-bit words, so repeated values
are dropped before the shuffle and no task holds more of a set than one container. Algebra works container by
container; the bytes of a whole set are put together only where a set is to leave the engine.

The numbers are 32-bit hashes, which is what other tools exchange, or in exact() sets the values themselves; sets of the
two kinds do not belong together. Values of exact() sets that are no whole numbers stay as text, in containers by hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valprint.functions import codec, containers
from valprint.functions.hashing import MASK, value_hash, value_hash_normalized

CONTAINER = "hi int, card int, data binary"
#: Upper parts from here on are of texts, and lie beyond those of all 64-bit numbers.
TEXTS = 1 << 48


def _texts(hi: pa.Array) -> np.ndarray:
    """Which containers hold texts: the hexadecimal bytes of each between commas, in order."""
    return hi.to_numpy().astype(np.int64) >= TEXTS


def _numbers(hi: pa.Array) -> np.ndarray:
    """The upper parts of containers, of which none may hold texts."""
    if _texts(hi).any():
        raise ValueError("sets of texts have no numbers")
    return hi.to_numpy().astype(np.int64)


def _batch(columns: dict, keys: np.ndarray, n: int, empty: bool = False) -> pa.RecordBatch:
    """Rows of containers behind further columns; those without members are left out unless asked for."""
    cards, data = containers.pack(keys, n)
    batch = pa.RecordBatch.from_pydict({**columns, "card": pa.array(cards.astype(np.int32)), "data": data})
    return batch if empty else batch.filter(pa.array(cards > 0))


def from_hashes(members: DataFrame) -> DataFrame:
    """cid, hi, card, data of the sets of hashes (cid, h); null hashes are left out and numbers cut to 32 bits."""
    h = F.col("h").cast("long").bitwiseAND(F.lit(MASK))
    bit = F.expr("shiftleft(1L, int(h & 63))")
    words = members.filter("h is not null").select("cid", h.alias("h")).select("cid", F.shiftright("h", 6).alias("word"), bit.alias("bit")).groupBy("cid", "word").agg(F.bit_or("bit").alias("bits"))
    # at most 1024 words
    chunks = words.groupBy("cid", F.shiftright("word", 10).cast("int").alias("hi")).agg(F.collect_list(F.struct((F.col("word") % 1024).cast("int").alias("w"), "bits")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            row = np.repeat(np.arange(len(column)), pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
            w, bits = (x.to_numpy(zero_copy_only=False) for x in column.flatten().flatten())
            yield _batch({"cid": batch.column(0), "hi": batch.column(1)}, containers.from_words(row, w, bits), len(column))

    return chunks.mapInArrow(run, f"cid {_type(members)}, {CONTAINER}")


def _type(df: DataFrame, name: str = "cid") -> str:
    return dict(df.dtypes)[name]


def _container(hi: str) -> str:
    """The type of containers whose upper part has a type."""
    return CONTAINER.replace("hi int", f"hi {hi}")


def build(values: DataFrame, normalize: bool = False) -> DataFrame:
    """from_hashes() of values (cid, val). A value is hashed once a distinct value of its set."""
    hashed = value_hash_normalized("val") if normalize else value_hash("val")
    return from_hashes(values.select("cid", "val").distinct().select("cid", hashed.alias("h")))


def exact(values: DataFrame) -> DataFrame:
    """The sets of values (cid, val) without hashing two of them to one; nulls are left out.

    A 64-bit whole number in plain digits is its own number, so keys without large gaps make dense containers. All else,
    "007" too, is kept as text.
    """
    val = F.col("val").cast("string")
    number = val.try_cast("long")
    n, text = F.col("n"), F.col("n").isNull()
    each = values.filter("val is not null").select("cid", val.alias("val"), F.when(number.cast("string") == val, number).alias("n"))
    hi = F.when(text, F.lit(TEXTS) + F.shiftrightunsigned(F.xxhash64("val"), 48)).otherwise(F.shiftright(n, 16))
    w = F.when(text, 0).otherwise(F.shiftright(n.bitwiseAND(F.lit(0xFFFF)), 6).cast("int"))
    bit = F.when(text, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, int(n & 63))"))
    words = each.select("cid", hi.alias("hi"), w.alias("w"), F.when(text, F.hex(F.col("val").cast("binary"))).alias("text"), bit.alias("bit")).groupBy("cid", "hi", "w", "text").agg(F.bit_or("bit").alias("bits"))
    chunks = words.groupBy("cid", "hi").agg(F.collect_list(F.struct("w", "bits", "text")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            many = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
            row, texts = np.repeat(np.arange(len(column)), many), _texts(batch.column(1))
            w, bits, text = column.flatten().flatten()
            mine = ~texts[row]
            keys = containers.from_words(row[mine], w.to_numpy(zero_copy_only=False)[mine], bits.to_numpy(zero_copy_only=False)[mine])
            yield _batch({"cid": batch.column(0), "hi": batch.column(1)}, keys, len(column))
            if texts.any():
                at = np.flatnonzero(texts)
                parts = [sorted(text.slice(s, k).to_pylist()) for s, k in zip((np.cumsum(many) - many)[at].tolist(), many[at].tolist(), strict=True)]
                kept = [batch.column(i).take(pa.array(at)) for i in (0, 1)]
                yield pa.RecordBatch.from_pydict({"cid": kept[0], "hi": kept[1], "card": pa.array([len(p) for p in parts], pa.int32()), "data": pa.array([",".join(p).encode() for p in parts], pa.binary())})

    return chunks.mapInArrow(run, f"cid {_type(values)}, {_container('bigint')}")


def cardinality(sets: DataFrame) -> DataFrame:
    """cid and n, the number of members."""
    return sets.groupBy("cid").agg(F.sum("card").alias("n"))


def common(a: DataFrame, b: DataFrame, keep: Column | None = None) -> DataFrame:
    """ca, cb, inter of the sets of a and b that share a member; keep narrows the pairs (ca, cb) that are looked at.

    Containers meet by their upper half, so a pair is the work of as many tasks as it has containers.
    """
    pairs = a.toDF("ca", "hi", "card", "data").join(b.toDF("cb", "hi", "card2", "data2"), "hi")
    pairs = (pairs if keep is None else pairs.filter(keep)).select("ca", "cb", "card", "data", "card2", "data2", "hi")

    def counted(batch: pa.RecordBatch, n: Iterable[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"ca": batch.column(0), "cb": batch.column(1), "inter": pa.array(n, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for both in batches:
            texts = _texts(both.column(6))
            batch = both.filter(pa.array(~texts)) if texts.any() else both
            x, y = (containers.expand(batch.column(i).to_numpy(), batch.column(i + 1)) for i in (2, 4))
            yield counted(batch, np.bincount(containers.combine("intersect", x, y) >> containers.LOW, minlength=batch.num_rows))
            if texts.any():
                batch = both.filter(pa.array(texts))
                yield counted(batch, [len(set(x.split(b",")).intersection(y.split(b","))) for x, y in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)])

    counts = pairs.mapInArrow(run, f"ca {_type(a)}, cb {_type(b)}, inter long")
    return counts.groupBy("ca", "cb").agg(F.sum("inter").alias("inter")).filter("inter > 0")


def measures(a: DataFrame, b: DataFrame, keep: Column) -> DataFrame:
    """ca, cb, inter, na, nb, containment, jaccard of the pairs of sets of a and b that keep asks for (as a condition on ca and cb).

    Pairs without a common member stay. An empty set has no rows and so no pairs. The pairs are made of the sets'
    sizes, a row a set.
    """
    na, nb = cardinality(a).toDF("ca", "na"), cardinality(b).toDF("cb", "nb")
    pairs = na.join(nb, keep).join(common(a, b, keep), ["ca", "cb"], "left").withColumn("inter", F.coalesce("inter", F.lit(0).cast("long")))
    return pairs.select("ca", "cb", "inter", "na", "nb", (F.col("inter") / F.col("na")).alias("containment"), (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("jaccard"))


def combined(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """The sets that the sets of one cid in a and b make: how is intersect, union or difference."""
    kind = {"intersect": "inner", "union": "full", "difference": "left"}[how]
    both = a.join(b.toDF("cid", "hi", "card2", "data2"), ["cid", "hi"], kind)
    zero = lambda c, t: F.coalesce(c, F.lit(t)).alias(c)
    both = both.select("cid", "hi", zero("card", 0), zero("data", b""), zero("card2", 0), zero("data2", b""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _numbers(batch.column(1))
            x, y = (containers.expand(batch.column(i).to_numpy(), batch.column(i + 1)) for i in (2, 4))
            yield _batch({"cid": batch.column(0), "hi": batch.column(1)}, containers.combine(how, x, y), batch.num_rows)

    return both.mapInArrow(run, f"cid {_type(a)}, {_container(_type(both, 'hi'))}")


def merged(sets: DataFrame) -> DataFrame:
    """Sets of which several states may be in the table, as the union of each set's states.

    A group holds one container of each state of a set.
    """
    groups = sets.groupBy("cid", "hi").agg(F.collect_list(F.struct("card", "data")).alias("states"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _numbers(batch.column(1))
            column = batch.column(2)
            group = np.repeat(np.arange(len(column)), pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
            cards, data = column.flatten().flatten()
            keys = containers.expand(cards.to_numpy(), data)
            keys = np.unique((group[keys >> containers.LOW] << containers.LOW) | (keys & 0xFFFF))
            yield _batch({"cid": batch.column(0), "hi": batch.column(1)}, keys, len(column))

    return groups.mapInArrow(run, f"cid {_type(sets)}, {_container(_type(sets, 'hi'))}")


def members(sets: DataFrame) -> DataFrame:
    """cid and h, a row a member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, keys = _numbers(batch.column(1)), containers.expand(batch.column(2).to_numpy(), batch.column(3))
            row = keys >> containers.LOW
            h = (hi[row] << 16) | (keys & 0xFFFF)
            yield pa.RecordBatch.from_pydict({"cid": batch.column(0).take(pa.array(row)), "h": pa.array(h)})

    return sets.select("cid", "hi", "card", "data").mapInArrow(run, f"cid {_type(sets)}, h long")


def holding(sets: DataFrame, hashes: DataFrame) -> DataFrame:
    """cid and h for each hash (h) and set that holds it; hashes meet the containers of their upper half only."""
    probes = hashes.select(F.col("h").cast("long").bitwiseAND(F.lit(MASK)).alias("h")).filter("h is not null").distinct()
    low = probes.groupBy(F.shiftright("h", 16).cast("int").alias("hi")).agg(F.collect_list(F.struct((F.shiftright("h", 6) % 1024).cast("int").alias("w"), F.expr("shiftleft(1L, int(h & 63))").alias("bits"))).alias("words"))
    pairs = sets.join(low, "hi").select("cid", "hi", "card", "data", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(4)
            row = np.repeat(np.arange(len(column)), pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
            w, bits = (x.to_numpy(zero_copy_only=False) for x in column.flatten().flatten())
            keys = containers.combine("intersect", containers.expand(batch.column(2).to_numpy(), batch.column(3)), containers.from_words(row, w, bits))
            h = (batch.column(1).to_numpy().astype(np.int64)[keys >> containers.LOW] << 16) | (keys & 0xFFFF)
            yield pa.RecordBatch.from_pydict({"cid": batch.column(0).take(pa.array(keys >> containers.LOW)), "h": pa.array(h)})

    return pairs.mapInArrow(run, f"cid {_type(sets)}, h long")


def exported(sets: DataFrame) -> DataFrame:
    """cid and data, each whole set in the public portable format; the one place where a set is one row."""
    whole = sets.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("hi", "card", "data"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(1):
                hi, cards, data = parts.values.flatten()
                if (hi.to_numpy().astype(np.int64) >> 16).any():
                    raise ValueError("only 32-bit numbers have portable bytes")
                keys = containers.expand(cards.to_numpy(), data)
                out.append(codec.encode((hi.to_numpy().astype(np.int64)[keys >> containers.LOW] << 16) | (keys & 0xFFFF)))
            yield pa.RecordBatch.from_pydict({"cid": batch.column(0), "data": pa.array(out, pa.binary())})

    return whole.mapInArrow(run, f"cid {_type(sets)}, data binary")


def imported(blobs: DataFrame) -> DataFrame:
    """The sets of portable bytes (cid, data); rows whose bytes are none are left out, as are empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                try:
                    values = codec.decode(data) if data is not None else np.zeros(0, np.int64)
                except ValueError:
                    continue
                hi, row = np.unique(values >> 16, return_inverse=True)
                if len(hi):
                    yield _batch({"cid": batch.column(0).take(pa.array(np.full(len(hi), i))), "hi": pa.array(hi.astype(np.int32))}, (row << containers.LOW) | (values & 0xFFFF), len(hi))

    return blobs.select("cid", "data").mapInArrow(run, f"cid {_type(blobs)}, {CONTAINER}")
