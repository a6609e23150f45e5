"""Shards of near-equal bytes by Karmarkar-Karp differencing of indivisible groups (operator 9)."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from valprint.llm.gray_index import FEW
from valprint.llm.shared import dropped, written

#: A group is placed alone, not in a bucket, from this part of all bytes or rows on; so at most twice as many are.
ALONE = 1 << 14
#: Groups of a bucket, about; partial partitions that a task or the driver combines, at most about.
EACH, TOGETHER = 2048, 1024
#: Parts of the rows that are numbered apart, at most.
SLICES = 4096


def combined(partitions: Sequence[Sequence[int]], ways: int) -> list[list[int]]:
    """For each partial partition (sums of its sets, ways of them at most) the way (0 to ways - 1) of each set.

    The two partitions of largest spread (largest sum less smallest) become one, largest sets joined with smallest,
    until one is left. Way 0 has the largest sum.
    """
    heap = []
    for i, given in enumerate(partitions):
        order = sorted(range(len(given)), key=lambda k: (-int(given[k]), k))
        sums = [int(given[k]) for k in order] + [0] * (ways - len(given))
        sums.sort(reverse=True)
        sets = [[(i, k)] for k in order if given[k] > 0] + [[(i, k)] for k in order if given[k] <= 0]
        heap.append((sums[-1] - sums[0], i, sums, sets + [[] for _ in range(ways - len(sets))]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, sums, sets = heapq.heappop(heap)
        _, j, other_sums, other_sets = heap[0]
        joined = []
        for k in range(ways):
            s, a, b = sums[k] + other_sums[-1 - k], sets[k], other_sets[-1 - k]
            if len(a) < len(b):
                a, b = b, a
            a.extend(b)
            joined.append((s, k, a))
        joined.sort(reverse=True)
        heapq.heapreplace(heap, (joined[-1][0] - joined[0][0], min(i, j), [x[0] for x in joined], [x[2] for x in joined]))
    way = [[0] * len(p) for p in partitions]
    for _, _, _, sets in heap:
        for w, members in enumerate(sets):
            for i, k in members:
                way[i][k] = w
    return way


def differencing(sizes: Sequence[int], ways: int) -> list[int]:
    """The way of each item; each begins as a partial partition with itself in one set and the others empty."""
    return [w[0] for w in combined([[n] for n in sizes], ways)]


def _sums(pdf: pd.DataFrame, shards: int) -> tuple[list[int], list[list[int]]]:
    """Buckets of rows (bucket, bundle, bytes), and the bytes of each bucket's bundles."""
    wide = pdf.pivot_table(index="bucket", columns="bundle", values="bytes", aggfunc="sum", fill_value=0).reindex(columns=range(shards), fill_value=0).sort_index()
    return wide.index.tolist(), wide.to_numpy().tolist()


LEVEL = "bucket long, bundle long, bytes long, above long, way long"


def byte_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs (doc_id, text).

    Equal texts are one group and stay in one shard; a null text equals an empty one, size 1. Groups from 1/16384
    of all bytes or rows on are items of their own. The others are dealt by their hash into buckets of about 2048,
    each differenced in its own task into a partial partition of as many bundles as shards; partial partitions are
    combined by differencing, 1024 in a task, level by level until 1024 are left. The driver combines these and the
    single groups, at most 32768 + 1024 * shards numbers whatever the input, so a group of a third of all rows gets
    a shard that others avoid. Shards are as equal as such groups let them be. Slots run from 0 in each shard, by
    slices of the rows' numbers, so repeated rows spread. A null doc_id stays null. Repeated rows are rows of their
    own; an empty table gives no rows; further columns are left out.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("key"))
    meta = written(meta.withColumn("row", F.monotonically_increasing_id()), "shard-sizes")
    rows, total = meta.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    groups = written(meta.groupBy("size", "key").agg(F.count("*").alias("n")).withColumn("bytes", F.col("size") * F.col("n")), "shard-groups")
    alone = (F.col("bytes") * ALONE >= total) | (F.col("n") * ALONE >= rows)
    single = groups.filter(alone).select("size", "key", "bytes").orderBy("bytes", "key").toPandas()
    buckets = max(1, -(-(groups.count() - len(single)) // EACH))

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"])
        return pdf.assign(bundle=differencing(pdf["bytes"].tolist(), shards))[["size", "key", "bytes", "bucket", "bundle"]]

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        names, sums = _sums(pdf, shards)
        way = dict(zip(names, combined(sums, shards), strict=True))
        return pdf.assign(way=[way[b][k] for b, k in zip(pdf["bucket"], pdf["bundle"], strict=True)])[["bucket", "bundle", "bytes", "above", "way"]]

    dealt = groups.filter(~alone).select("size", "key", "bytes", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    small = written(dealt.groupBy("bucket").applyInPandas(bundle, "size long, key string, bytes long, bucket long, bundle long"), "shard-bundles")
    parts, levels = small.groupBy("bucket", "bundle").agg(F.sum("bytes").alias("bytes")), []
    while buckets > TOGETHER:
        buckets = -(-buckets // TOGETHER)
        level = written(parts.withColumn("above", F.pmod(F.xxhash64("bucket", F.lit(len(levels))), F.lit(buckets))).groupBy("above").applyInPandas(combine, LEVEL), "shard-level")
        levels.append(level)
        parts = level.groupBy(F.col("above").alias("bucket"), F.col("way").alias("bundle")).agg(F.sum("bytes").alias("bytes"))
    names, sums = _sums(parts.toPandas(), shards)
    way = combined([*([n] for n in single["bytes"]), *sums], shards)
    of_single = spark.createDataFrame(list(zip(single["size"].tolist(), single["key"], [w[0] for w in way[: len(single)]], strict=True)), "size long, key string, shard int")
    placed = [(int(b), k, w) for b, ws in zip(names, way[len(single) :], strict=True) for k, w in enumerate(ws)]
    of_bundle = spark.createDataFrame(placed, "bucket long, bundle long, shard int")
    for level in reversed(levels):
        above = level.join(F.broadcast(of_bundle) if level is levels[-1] else of_bundle, (level["above"] == of_bundle["bucket"]) & (level["way"] == of_bundle["bundle"]))
        of_bundle = written(above.select(level["bucket"], level["bundle"], "shard"), "shard-of-bundle")
    few = not levels or of_bundle.count() <= FEW

    marked = meta.join(F.broadcast(of_single), ["size", "key"], "left")
    kept = ["doc_id", "size", "text_crc32", "row", "shard"]
    rest = marked.filter(F.col("shard").isNull()).drop("shard").join(small.select("size", "key", "bucket", "bundle"), ["size", "key"]).join(F.broadcast(of_bundle) if few else of_bundle, ["bucket", "bundle"])
    slices = min(SLICES, max(1, rows // 2048))
    placed = written(marked.filter(F.col("shard").isNotNull()).select(kept).unionByName(rest.select(kept)).withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")), "shard-placed")
    dropped(meta, groups, small, *levels)
    counts = placed.groupBy("shard", "slice").count().orderBy("shard", "slice").toPandas()
    counts["before"] = counts.groupby("shard")["count"].cumsum() - counts["count"]
    before = spark.createDataFrame(list(zip(*(counts[c].tolist() for c in ("shard", "slice", "before")), strict=True)), "shard int, slice int, before long")
    number = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("row")) - 1
    return placed.withColumn("number", number).join(F.broadcast(before), ["shard", "slice"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
