"""SimHash fingerprints and near-duplicate links by a Gray-order hierarchical index (operator 7)."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valprint.llm.components import roots
from valprint.llm.shared import dropped, parts_for, slices, written

#: Entries below a node of the index.
FAN = 8
#: Fingerprints of a range with an index of its own, at least; and ranges at most, about, which bounds what is broadcast.
EACH, RANGES = 16_384, 16_384
#: Queries that go down an index together.
TOGETHER = 4096
#: Fingerprints that hold over this part of all rows, or more, get their components by broadcast.
HOT = 4096
#: Ids that may be broadcast.
FEW = 1_000_000
MAX = (1 << 63) - 1


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of a text in lower-case A-Z, repeats included; of the whole text if it is shorter."""
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    data, digest = memoryview(b" ".join(parts)), xxhash.xxh64_intdigest
    ends = list(itertools.accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends]
    n = max(1, len(parts) - words + 1)
    return np.fromiter((digest(data[a : b - 1], seed) for a, b in zip(starts, ends[len(parts) - n :], strict=False)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the order of the binary reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


#: gray_rank() as an expression whose signed order is the order of ranks.
PLACE = "aggregate(array(1, 2, 4, 8, 16, 32), fp, (x, s) -> x ^ shiftrightunsigned(x, s)) ^ -9223372036854775808L"


def prints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the 64-bit fingerprint of the whole text (null: empty, 0), of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            fp = np.array([majority(shingle_hashes(t, words)) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


class Tree:
    """A hierarchical index over entries in Gray order.

    An entry has a mask and the bits that all it stands for share in that mask: all 64 for one fingerprint, fewer for
    a range of them. A node stands for up to 8 neighbours in the order and holds the bits that they share and its own
    upper node does not hold. A query adds up its differences in those bits on the way down and leaves a node with
    all below it once they are more than reach.
    """

    def __init__(self, mask: np.ndarray, bits: np.ndarray):
        levels = [(mask, bits & mask)]
        while len(levels[-1][0]) > FAN:
            mask, bits = levels[-1]
            at = np.arange(0, len(mask), FAN)
            ones, zeros = np.bitwise_and.reduceat(bits, at), np.bitwise_and.reduceat(mask & ~bits, at)
            levels.append((ones | zeros, ones))
        self.levels = []
        for depth, (mask, bits) in enumerate(levels):
            if depth + 1 < len(levels):
                mask = mask & ~np.repeat(levels[depth + 1][0], FAN)[: len(mask)]
            self.levels.append((mask, bits & mask))
        #: Nodes and entries that queries were compared with.
        self.compared = 0

    def search(self, fps: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of queries and of entries that differ in at most reach bits of the entries' masks, in parts."""
        for first in range(0, len(fps), TOGETHER):
            q = fps[first : first + TOGETHER]
            top = len(self.levels[-1][0])
            who, node = np.repeat(np.arange(len(q), dtype=np.int32), top), np.tile(np.arange(top, dtype=np.int32), len(q))
            spent = np.zeros(len(who), np.uint8)
            for depth in range(len(self.levels) - 1, -1, -1):
                mask, bits = self.levels[depth]
                self.compared += len(who)
                spent = spent + np.bitwise_count((q[who] & mask[node]) ^ bits[node])
                keep = np.flatnonzero(spent <= reach)
                who, node, spent = who[keep], node[keep], spent[keep]
                if depth:
                    below = np.minimum(FAN, len(self.levels[depth - 1][0]) - node * FAN)
                    if (below == FAN).all():
                        node = (node[:, None] * FAN + np.arange(FAN, dtype=np.int32)).ravel()
                        who, spent = np.repeat(who, FAN), np.repeat(spent, FAN)
                    else:
                        step = np.arange(below.sum(), dtype=np.int32) - np.repeat(np.cumsum(below) - below, below).astype(np.int32)
                        who, spent, node = np.repeat(who, below), np.repeat(spent, below), np.repeat(node * FAN, below).astype(np.int32) + step
            yield who.astype(np.int64) + first, node.astype(np.int64)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which links of a list join what no earlier link has joined; the others change no component."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[i] = True
    return keep


LINK = "a_doc long, a_fp long, b_doc long, b_fp long"
SENT = "pid int, asks int, doc long, fp long"


def _rows(columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64()}
    names, kinds = zip(*(x.strip().split(" ") for x in schema.split(",")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def links(nodes: DataFrame, reach: int = 2) -> DataFrame:
    """Links between distinct fingerprints (doc, fp) that differ in at most reach bits, enough for components.

    The fingerprints are sorted by Gray rank and cut into ranges of equal counts, each with an index. A small index
    over the ranges' shared bits, which goes to all tasks, tells which ranges a fingerprint may have links in; it
    asks those, of each two ranges one the other. A task builds the index of a range and sends the ranges' askers
    down, in batches, and keeps of the links of a batch a spanning forest. So no group of fingerprints meets in one
    task but a range, and a dense range only has more askers, whose links are at most 2080 each.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    parts = max(parts_for(n, max(EACH, n // RANGES), spark), 2 * spark.sparkContext.defaultParallelism)
    ordered = nodes.select("doc", "fp", F.expr(PLACE).alias("place")).repartitionByRange(parts, "place")
    placed = written(ordered.select(F.spark_partition_id().alias("pid"), "doc", "fp"), "gray-order")
    found = placed.groupBy("pid").agg(F.bit_and("fp").alias("ones"), F.bit_and(F.bitwise_not("fp")).alias("zeros"), F.count("*").alias("n")).orderBy("pid").toPandas()
    # neighbours become one range until there are as many as asked for, however finely the cluster has dealt the rows
    upto = found["n"].cumsum() - found["n"]
    found["range"] = (upto * parts // max(1, n)).rank(method="dense").astype(int) - 1
    pids, number = found["pid"].to_numpy(np.int64), found["range"].to_numpy(np.int64)
    begin = np.flatnonzero(np.diff(number, prepend=-1))
    ones, zeros = (np.bitwise_and.reduceat(found[c].to_numpy(np.int64), begin) if n else np.zeros(0, np.int64) for c in ("ones", "zeros"))
    sent = spark.sparkContext.broadcast((pids, number, ones, zeros))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pids, number, ones, zeros = sent.value
        index = Tree((ones | zeros).view(np.uint64), ones.view(np.uint64))
        for batch in batches:
            own, doc, fp = (c.to_numpy() for c in batch.columns)
            own = number[np.searchsorted(pids, own)]
            yield _rows([own, np.zeros(len(own), np.int32), doc, fp], SENT)
            for who, to in index.search(fp.view(np.uint64), reach):
                mine = own[who]
                # of two ranges the lower asks if their numbers are even together, else the higher
                ask = (to != mine) & ((mine < to) == ((mine + to) % 2 == 0))
                yield _rows([to[ask], np.ones(int(ask.sum()), np.int32), doc[who[ask]], fp[who[ask]]], SENT)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = -1, [], None

        def found(doc: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            for who, at in index[0].search(fp, reach):
                other = fp[who] != index[2][at]
                who, at = who[other], at[other]
                keep = forest(fp[who].view(np.int64), index[2][at].view(np.int64))
                who, at = who[keep], at[keep]
                yield _rows([doc[who], fp[who].view(np.int64), index[1][at], index[2][at].view(np.int64)], LINK)

        def built() -> Iterator[pa.RecordBatch]:
            nonlocal index
            doc, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(gray_rank(fp))
            doc, fp = doc[order], fp[order]
            index = (Tree(np.full(len(fp), ~np.uint64(0)), fp), doc, fp)
            held.clear()
            yield from found(doc, fp)

        for batch in batches:
            pid, asks, doc, fp = (c.to_numpy() for c in batch.columns)
            fp = fp.view(np.uint64)
            cut = np.flatnonzero(np.append(True, (pid[1:] != pid[:-1]) | (asks[1:] != asks[:-1])))
            for a, b in zip(cut, np.append(cut[1:], len(pid)), strict=True):
                if pid[a] != now and held:
                    yield from built()
                now = pid[a]
                if not asks[a]:
                    held.append((doc[a:b], fp[a:b]))
                    continue
                if held:
                    yield from built()
                yield from found(doc[a:b], fp[a:b])
        if held:
            yield from built()

    dealt = placed.mapInArrow(route, SENT).repartition(parts, "pid").sortWithinPartitions("pid", "asks")
    return dealt.mapInArrow(search, LINK)


def simhash_components(docs: DataFrame, words: int = 3, reach: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of docs (doc_id, text), whole texts.

    Rows of one fingerprint are one node, so copies are never paired; a fingerprint of over 1/4096 of all rows (there
    are at most 4096) gets its component by broadcast. component_id is the smallest doc_id that links reach, the
    row's own included. A null text counts as empty; texts without words have fingerprint 0 and link like others. A
    row without doc_id takes part but names no component (null if all of it are such). Repeated rows get a row each;
    an empty table gives no rows; further columns are left out.
    """
    each = written(prints(docs, words), "prints")
    nodes = written(each.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(MAX)).alias("doc"), F.count("*").alias("n")), "nodes")
    edges = links(nodes, reach).select(F.struct(F.col("a_doc").alias("doc"), F.col("a_fp").alias("fp")).alias("u"), F.struct(F.col("b_doc").alias("doc"), F.col("b_fp").alias("fp")).alias("v"))
    root = roots(edges).select(F.col("node.fp").alias("fp"), F.col("root.doc").alias("top"))
    named = written(nodes.join(root, "fp", "left").select("fp", F.nullif(F.coalesce("top", "doc"), F.lit(MAX)).alias("component_id"), "n"), "named")
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * HOT > total
    few = F.broadcast(named.filter(hot).select("fp", "component_id", F.lit(True).alias("hot")))
    marked = each.join(few, "fp", "left")
    rest = marked.filter("hot is null").drop("component_id").join(named.filter(~hot).select("fp", "component_id"), "fp")
    kept = ["doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"]
    dropped(nodes)
    return marked.filter("hot").select(*kept).unionByName(rest.select(*kept))
