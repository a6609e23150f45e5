"""Groups of similar texts by operator 7's fingerprints with exact checks, and of what these miss by rare-first prefixes."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valprint.llm.components import roots
from valprint.llm.gray_index import FEW, forest, links, prints, shingle_hashes
from valprint.llm.shared import MOST_PARTS, dropped, forgetful, parts_for, slices, small_batches, written

#: Texts from which it is estimated how common a shingle is, about; common shingles that are remembered at most.
SAMPLE, COMMON = 20_000, 500_000
#: Texts that share a shingle and meet their neighbours in one task, about; by the sample, more are dealt into several.
GROUP = 8192
#: Texts that share a shingle and are paired in one cell; more are dealt into several.
CELL = 512
#: Bits of a text that its cell compares.
BITS = 512
#: Partners of a text that are checked in one task; more are dealt into several.
PARTNERS = 256
#: Shingles that a task sends out at once, about.
SENT = 500_000
#: Pairs that a task holds before it passes them on.
HELD = 1_000_000
#: Room for rounding in bounds; a bound only decides what is checked.
SLACK = 1e-6
#: A text in a shingle's group (pair = 0), two that share a shingle (pair = 1, their nodes in node and other), or the
#: first text of one of a shingle's several groups (pair = 2).
MET = "pair int, shingle long, size int, node long, place int, other long"
SET = "u long, part int, asks int, node long, hashes array<long>"


def _prefix_length(n: int, similarity: float) -> int:
    """Shingles of a set of n, in any order that all sets obey, of which a similar set shares one in its own prefix."""
    return n - math.ceil(similarity * n - SLACK) + 1


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of whole groups of rows that are sorted by the first keys columns, and where each row's group ends."""
    rest = None
    for batch in itertools.chain(batches, [None]):
        rows = rest
        if batch is not None:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
        if rows is None or not len(rows[0]):
            continue
        begin = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in rows[:keys]], axis=0)))
        n = len(rows[0])
        if batch is not None:  # the last group may go on
            n = int(begin[-1])
            rest = [c[n:] for c in rows]
            begin = begin[:-1]
        if n:
            yield [c[:n] for c in rows], np.repeat(np.append(begin[1:], n), np.diff(np.append(begin, n)))


def _possible(i: np.ndarray, j: np.ndarray, size: np.ndarray, node: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows of a shingle may be similar if it is the first that they share: enough shingles are left."""
    left = np.minimum(size[i] - place[i], size[j] - place[j])
    return (left >= similarity / (1 + similarity) * (size[i] + size[j]) - SLACK) & (node[i] != node[j])


def _pairs(node: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Distinct pairs of nodes of rows i and j, in this order.

    Rows of a group go by size and node, so two texts have one order wherever they meet, and the first of many comes
    first with each of them.
    """
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.unique(np.stack([node[i], node[j]], axis=1), axis=0)


def _neighbours(size: np.ndarray, node: np.ndarray, place: np.ndarray, end: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs of nodes of groups that end at end: each row with the first of its group and with the next, where similar texts are possible."""
    at = np.arange(len(node))
    next_ = at[end > at + 1]
    return _pairs(node, [(i[ok], j[ok]) for i, j in ((np.searchsorted(end, end, "left"), at), (next_, next_ + 1)) for ok in [_possible(i, j, size, node, place, similarity)]])


def numbered(docs: DataFrame, name: str = "__row") -> DataFrame:
    """docs with a column of this name, which docs lacks, that names each row for good: its file and its place there.

    Rows that no file holds are written first. A column of docs named as Spark's own metadata is no hindrance.
    """

    def placed(df: DataFrame) -> DataFrame:
        own = df.metadataColumn("_metadata")
        return df.withColumn(name, F.struct(F.xxhash64(own["file_path"]).alias("file"), own["row_index"].alias("at")))

    try:
        return placed(docs)
    except AnalysisException:
        return placed(written(docs, "rows"))


def _joined(df: DataFrame, ids: DataFrame, n: int, on: str, how: str = "inner") -> DataFrame:
    """df joined with n ids, by broadcast if they are few."""
    return df.join(F.broadcast(ids) if n <= FEW else ids, on, how)


def _met(texts: DataFrame, n: int, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Texts (node, text) that share a shingle of their prefixes, as rows of MET, and pairs (u, v) of neighbours among them.

    A text is paired with the next of its size and the first in each group; of up to three these are all pairs, and
    larger groups are rows of the result. A shingle that the sample shows in very many texts has several groups, dealt
    by a hash of the text, whose first texts are paired in the same way; all its texts are rows of the result.
    """
    spark = texts.sparkSession

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in slices(batches):
            sets = [np.unique(shingle_hashes(t, words)) for t in part]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])

    share = min(1.0, SAMPLE / max(1, n))
    each = share * GROUP  # texts of the sample to a group
    some = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * share)
    counts = texts.filter(some).mapInArrow(forgetful(all_of), "shingle long").groupBy("shingle").count()
    top = counts.filter("count > 2").orderBy(F.desc("count"), "shingle").limit(COMMON).toPandas()
    common = top["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(common)
    # a last entry that is no shingle's saves asking for the end
    sent = spark.sparkContext.broadcast((np.append(common[order], np.uint64(0)), np.append(top["count"].to_numpy(np.int64)[order], 0)))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, count = sent.value
        for batch, part in slices(batches):
            out = []
            for node, t in zip(batch.column(0).to_pylist(), part, strict=True):
                h = np.unique(shingle_hashes(t, words))
                if not len(h):
                    continue
                at = np.searchsorted(common[:-1], h)
                often = np.where(common[at] == h, count[at], 0)
                take = np.lexsort((h, often))[: _prefix_length(len(h), similarity)]
                groups = np.maximum(1, np.ceil(often[take] / each)).astype(np.int32)
                out.append((h[take], (node * 0x9E3779B97F4A7C15 % (1 << 64) >> 33) % groups, groups, np.full(len(take), len(h), np.int32), np.full(len(take), node), np.arange(len(take), dtype=np.int32)))
            if out:
                h, cell, groups, size, node, place = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), cell.astype(np.int32), groups, size, node, place)], ["shingle", "cell", "groups", "size", "node", "place"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split(" ")[0] for x in MET.split(",")]
        for (shingle, _, groups, size, node, place), end in _groups(batches, 2):
            pairs = _neighbours(size, node, place, end, similarity)
            none = np.zeros(len(pairs), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (none + 1, none.astype(np.int64), none, pairs[:, 0], none, pairs[:, 1])], names)
            head = np.searchsorted(end, end, "left")
            for pair, on in ((0, (end - head > 3) | (groups > 1)), (2, (groups > 1) & (head == np.arange(len(node))))):
                none = np.zeros(int(on.sum()), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (none + np.int32(pair), shingle[on], size[on], node[on], place[on], none.astype(np.int64))], names)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, size, node, place), end in _groups(batches, 1):
            pairs = _neighbours(size, node, place, end, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    parts = parts_for(n * 64, 400_000, spark, MOST_PARTS)
    rows = texts.mapInArrow(forgetful(prefixes), "shingle long, cell int, groups int, size int, node long, place int")
    dealt = rows.repartition(parts, "shingle", "cell").sortWithinPartitions("shingle", "cell", "size", "node")
    met = written(dealt.mapInArrow(forgetful(meet), MET), "met")
    first = met.filter("pair = 2").select("shingle", "size", "node", "place").repartition("shingle").sortWithinPartitions("shingle", "size", "node")
    near = met.filter("pair = 1").select(F.col("node").alias("u"), F.col("other").alias("v")).unionByName(first.mapInArrow(forgetful(heads), "u long, v long"))
    return met, near.distinct()


def _printed(texts: DataFrame) -> DataFrame:
    """Pairs (u, v) of texts (node, text) that operator 7 links, enough for its components.

    A text goes with the first of its fingerprint, and the first texts of two fingerprints that the Gray-order index
    links go together.
    """
    each = written(prints(texts.select(F.col("node").alias("doc_id"), "text")), "text-prints")
    nodes = written(each.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")), "text-nodes")
    many = nodes.filter("n > 1").select("fp", "doc")
    same = _joined(each, many, many.count(), "fp").filter("doc <> doc_id").select(F.col("doc").alias("u"), F.col("doc_id").alias("v"))
    near = links(nodes.select("doc", "fp")).select(F.col("a_doc").alias("u"), F.col("b_doc").alias("v"))
    pairs = written(same.unionByName(near).distinct(), "print-pairs")
    dropped(each, nodes)
    return pairs


def _apart(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """The pairs (u, v) that are not of one component by root."""
    n = root.count()
    tops = _joined(_joined(pairs, root.toDF("u", "a"), n, "u", "left"), root.toDF("v", "b"), n, "v", "left")
    return tops.filter(F.coalesce("a", "u") != F.coalesce("b", "v")).select("u", "v")


def _open(met: DataFrame, root: DataFrame, similarity: float) -> DataFrame:
    """The rows of met with top, their component by root, of shingles whose texts are not all joined, and the ways to deal them."""
    tops = _joined(met, root.toDF("node", "top"), root.count(), "node", "left").withColumn("top", F.coalesce("top", "node"))
    apart = tops.groupBy("shingle").agg(F.count("*").alias("n"), F.min("top").alias("low"), F.max("top").alias("high")).filter("low < high")
    ways = written(apart.select("shingle", F.ceil(F.col("n") / CELL).cast("int").alias("ways")), "open-shingles")
    rows = written(_joined(tops, ways, ways.count(), "shingle"), "open-rows")
    dropped(ways)
    return rows


def _bits(texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node and a map of 512 bits of each of these texts."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in slices(batches):
            bits = [_parity(np.unique(shingle_hashes(t, words)), BITS) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("node")), pa.array(bits, pa.binary())], ["node", "bits"])

    nodes = written(nodes, "open-nodes")
    return written(_joined(texts, nodes, nodes.count(), "node").mapInArrow(forgetful(maps), "node long, bits binary"), "open-bits")


def _others(open_: DataFrame, bits: DataFrame, similarity: float, few: bool) -> DataFrame:
    """All pairs of the groups that may be similar and are not of one component; if few, those alone that would join what others do not.

    The cell where two texts meet rules them out by a map of 512 bits each, so few leave it that are not similar.
    """
    spark = open_.sparkSession
    # of a hot shingle each two parts of its rows meet in a cell of their own
    own = F.pmod(F.xxhash64("node"), F.col("ways")).cast("int")
    split = open_.join(bits, "node").withColumn("part", own).withColumn("with", F.explode(F.expr("sequence(0, ways - 1)")))
    cells = split.select("shingle", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "size", "node", "place", "top", "part", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high, size, node, place, top, part, bits), end in _groups(batches, 3):
            bits = np.frombuffer(b"".join(bits.tolist()), np.uint64).reshape(len(node), -1)
            found, held = [], 0

            def out(found: list, node=node, top=top) -> pa.RecordBatch:
                if few:  # the most similar first
                    i, j, part = (np.concatenate(x) for x in zip(*found, strict=True))
                    order = np.argsort(part, kind="stable")
                    i, j = i[order], j[order]
                    keep = forest(top[i], top[j])
                    found = [(i[keep], j[keep])]
                pairs = _pairs(node, [x[:2] for x in found])
                return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

            i = np.arange(len(node))
            for k in itertools.count(1):
                i = i[end[i] > i + k]
                # sizes rise, so what is too large ends the search
                i = i[size[i] >= similarity * size[i + k] - SLACK]
                if not len(i):
                    break
                j = i + k
                ok = (top[i] != top[j]) & ((low[i] == high[i]) | (part[i] != part[j])) & _possible(i, j, size, node, place, similarity)
                a, b = i[ok], j[ok]
                apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
                both = size[a].astype(np.int64) + size[b]
                near = apart <= (1 - similarity) / (1 + similarity) * both + SLACK
                found.append((a[near], b[near], (apart / both)[near]))
                held += int(near.sum())
                if held > HELD:
                    yield out(found)
                    found, held = [], 0
            if held:
                yield out(found)

    dealt = cells.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "shingle", "low", "high").sortWithinPartitions("shingle", "low", "high", "size", "node")
    return written(dealt.mapInArrow(forgetful(run), "u long, v long").distinct(), "other-pairs")


def parity_bits(hashes: np.ndarray) -> bytes:
    """For each value of some bits of a hash whether an odd number of a set's hashes has it; as many bits as hashes, 256 at least.

    Two such maps differ in no more bits than their sets in members, whatever the sets; half as many bits are those
    of the two halves' difference.
    """
    return _parity(hashes, max(256, 1 << max(0, len(hashes) - 1).bit_length()))


def _parity(hashes: np.ndarray, n: int) -> bytes:
    return np.packbits(np.bincount((hashes >> np.uint64(17)).astype(np.int64) & (n - 1), minlength=n).astype(np.uint8) & 1, bitorder="little").tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Bits in which two maps of parity_bits() differ, the larger folded to the size of the smaller."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _promising(texts: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) that maps of some bits for each text do not rule out; similar texts are never ruled out."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in slices(batches):
            sets = [np.unique(shingle_hashes(t, words)) for t in part]
            node = batch.column(batch.schema.get_field_index("node"))
            yield pa.RecordBatch.from_arrays([node, pa.array([len(h) for h in sets], pa.int32()), pa.array([parity_bits(h) for h in sets], pa.binary())], ["node", "size", "bits"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, n, m = (batch.column(i).to_numpy() for i in range(4))
            apart = np.array([bits_apart(a, b) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            ok = apart <= (1 - similarity) / (1 + similarity) * (n.astype(np.int64) + m) + SLACK
            yield pa.RecordBatch.from_arrays([pa.array(u[ok]), pa.array(v[ok])], ["u", "v"])

    ends = written(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "near-ends")
    bits = written(_joined(texts, ends, ends.count(), "node").mapInArrow(forgetful(maps), "node long, size int, bits binary"), "near-bits")
    both = pairs.join(bits.toDF("u", "n", "a"), "u").join(bits.toDF("v", "m", "b"), "v").select("u", "v", "n", "m", "a", "b")
    kept = written(both.mapInArrow(forgetful(check), "u long, v long"), "near-pairs")
    dropped(ends, bits)
    return kept


def _linked(texts: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets of shingles have the similarity, from all shingles of both texts.

    Most others are ruled out by _promising(). Of the rest the set of v goes to the task of u, which has the set of u.
    A text that is u with many has several tasks, to each of which its set goes once.
    """
    spark = texts.sparkSession
    pairs = _promising(texts, pairs, words, similarity)
    ways = pairs.groupBy("u").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("ways"))
    asks = pairs.join(ways, "u").select(F.col("v").alias("node"), "u", F.pmod(F.xxhash64("v"), F.col("ways")).cast("int").alias("part"), F.lit(1).alias("asks"))
    owns = ways.select(F.col("u").alias("node"), "u", F.explode(F.expr("sequence(0, ways - 1)")).alias("part"), F.lit(0).alias("asks"))
    needs = written(asks.unionByName(owns).groupBy("node").agg(F.collect_list("u").alias("us"), F.collect_list("part").alias("parts"), F.collect_list("asks").alias("asks")), "needs")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split(" ")[0] for x in SET.split(",")]
        for batch, part in slices(batches, chars=1_000_000):
            node, us, parts, asks = (batch.column(batch.schema.get_field_index(c)) for c in ("node", "us", "parts", "asks"))
            hashes = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in part]
            many = pa.compute.list_value_length(us).to_numpy()
            at = np.repeat(np.arange(len(many)), many)
            flat = [x.flatten() for x in (us, parts, asks)]
            # a text of very many partners, or a long one of several, is sent out in parts
            room = np.cumsum([len(hashes[k]) + 64 for k in at]) // SENT
            cuts = np.flatnonzero(np.diff(room)) + 1
            for i, j in itertools.pairwise([0, *cuts.tolist(), len(at)]):
                some = at[i:j]
                yield pa.RecordBatch.from_arrays([*(x.slice(i, j - i) for x in flat), node.take(pa.array(some)), pa.array([hashes[k] for k in some], pa.list_(pa.int64()))], names)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            us, parts, asks, nodes = (batch.column(i).to_pylist() for i in range(4))
            flat, offsets = batch.column(4).values.to_numpy(), batch.column(4).offsets.to_numpy()
            found = []
            for i, (u, part, ask, node) in enumerate(zip(us, parts, asks, nodes, strict=True)):
                theirs = flat[offsets[i] : offsets[i + 1]].view(np.uint64)
                if not ask:
                    now, own = (u, part), theirs.copy()
                elif now == (u, part):
                    both = np.concatenate([own, theirs])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    if common and common >= similarity * (len(both) - common):
                        found.append((u, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    sent = _joined(texts, needs, needs.count(), "node").mapInArrow(forgetful(sets), SET)
    dealt = sent.repartition(parts_for(needs.count() * 3, 4096, spark, MOST_PARTS), "u", "part").sortWithinPartitions("u", "part", "asks")
    linked = written(dealt.mapInArrow(forgetful(check), "u long, v long"), "near-links")
    dropped(needs, pairs)
    return linked


def _grouped(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, __row and root (doc_id and row of the first) of each row that is not the first of its group; rows as of numbered()."""
    small_batches(rows.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    # rows without doc_id come last
    each = written(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "__row", F.unhex(F.sha2(text, 256)).alias("key")), "copies")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("__row").alias("row"))
    first = written(each.groupBy("key").agg(F.min(order).alias("first")).withColumn("node", F.monotonically_increasing_id()), "texts")
    n = first.count()
    # read several times, so they are joined once and not at each reading
    texts = written(_joined(rows.select("__row", "text"), first.select(F.col("first.row").alias("__row"), "node"), n, "__row").select("node", "text"), "distinct-texts")
    # first what the fingerprints link, then what these have not joined
    printed = _printed(texts)
    linked = _linked(texts, printed, words, similarity)
    joined = roots(linked)
    dropped(printed)
    met, near = _met(texts, n, words, similarity)
    linked = linked.unionByName(_linked(texts, _apart(near, joined), words, similarity))
    joined = roots(linked)
    met = met.filter("pair = 0").drop("pair", "other")
    open_, bits = _open(met, joined, similarity), None
    # first what joins the most, then all pairs that are still apart
    for few in (True, False):
        if open_.isEmpty():
            break
        bits = bits or _bits(texts, open_.select("node").distinct(), words)
        pairs = _others(open_, bits, similarity, few)
        linked = linked.unionByName(_linked(texts, pairs, words, similarity))
        joined = roots(linked)
        dropped(pairs, open_)
        open_ = _open(met, joined, similarity) if few else open_
    top = first.join(joined, "node", "left").select("key", "first", F.coalesce("root", "node").alias("root"))
    best = top.groupBy("root").agg(F.min("first").alias("best"))
    named = written(top.join(best, "root").select("key", "best"), "named")
    dropped(met, texts)
    # texts that many rows have, of which there are few, go by broadcast
    hot = F.broadcast(each.groupBy("key").count().filter(F.col("count") * 4096 > each.count()).join(named, "key").select("key", F.col("best").alias("hot")))
    marked = each.join(hot, "key", "left")
    usual = marked.filter("hot is null").drop("hot").join(named, "key")
    every = marked.filter("hot is not null").withColumnRenamed("hot", "best").unionByName(usual)
    return every.filter(F.col("__row") != F.col("best.row")).select("doc_id", "__row", F.col("best.doc_id").alias("root"))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and root of each row that is not the first of its group; root is the smallest doc_id of the group.

    Texts link if the Jaccard similarity of their sets of 5-word shingles is 0.8 or more; equal texts link; groups
    are what links reach, and no link is missed. Distinct texts are first linked by operator 7: SimHash fingerprints,
    whose near ones its Gray-order index finds, each pair checked exactly on all shingles. Similar texts often differ
    in more bits than it allows, so what it has not joined is found otherwise: of each distinct text the shingles are
    put in one order of all, those first that are rare in a sample; two similar texts share one in the first fifth of
    theirs, and after the first that they share enough are left. Texts so met are first paired with a neighbour and
    the first of those they meet, and checked in the same way; then those that would join the most; then every other
    pair that these links have not joined already is checked, too. A shingle that many texts share is dealt into cells, a text of many partners into several tasks.
    Texts without words link only if equal; a null text equals an empty one. A row without doc_id comes after all
    with one, repeated rows after the first of them; root is null if no row of the group has a doc_id.
    """
    return _grouped(numbered(docs.select("doc_id", "text")), words, similarity).select("doc_id", "root")


def first_of_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with the first row alone of each group of similar_groups(); all columns stay, whatever their names.

    Rows are told apart by their place, so those without doc_id, or that repeat one, stand or fall by themselves. An
    empty table gives no rows.
    """
    name = "__row"
    while name in docs.columns:
        name += "_"
    rows = numbered(docs, name)
    mine = rows.select("doc_id", "text", F.col(name).alias("__row"))
    gone = written(_grouped(mine, words, similarity).select(F.col("__row").alias(name)), "dropped-copies")
    return _joined(rows, gone, gone.count(), name, "left_anti").drop(name)
