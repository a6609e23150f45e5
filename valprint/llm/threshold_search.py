"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from valprint.llm.shared import parts_for, written

#: Candidates and queries that meet in one task's cell, about.
CANDIDATES, QUERIES = 1 << 16, 4096
#: Candidates whose lists are sorted together, at most; of one block about so many at least.
BLOCK, LEAST = 4096, 64
#: Vectors that name the blocks of near candidates, at most; taken by a hash, whatever the input's size.
CENTRES = 256
#: Queries that go down a block's lists together; and those that try whether the lists help at all in the block.
TOGETHER, TRY = 512, 32
#: Depths, as parts of a list, between which a list is read.
GRID = 2.0 ** np.arange(-10, 0)


def _exact(a: np.ndarray, b: np.ndarray) -> np.dtype:
    """A type in which inner products of the rows of a and b are exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.dtype(np.float32) if most < 1 << 24 else np.dtype(np.float64) if most < 1 << 53 else np.dtype(np.int64)


def best_of(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the k best scores, ties to smaller ids, ordered."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], ids[keep], score[keep]


class Lists:
    """The sorted lists of a block of candidates: one a dimension, of the candidates by their component."""

    def __init__(self, v: np.ndarray):
        self.v = v
        self.order = np.argsort(v, axis=0, kind="stable")
        values = np.take_along_axis(v, self.order, axis=0)
        n = len(v)
        self.depths = np.unique(np.append(0, np.ceil(GRID * n).astype(np.int64)))
        self.depths = self.depths[self.depths < n]
        # the next entry at each depth, from the largest and from the smallest on
        self.most, self.least = values[n - 1 - self.depths].astype(np.float64), values[self.depths].astype(np.float64)

    def plan(self, q: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How deep each query reads each list until no candidate unseen can reach its floor, and whether that is so.

        A query that weighs a dimension positively reads it from its largest component, else from its smallest. What
        an unseen candidate can score is the sum of weights times the next entries. The list whose reading lowers that
        sum most for an entry goes first. A query gives up once its lists have shown half as many entries as the
        block holds; scoring the block is then less work than reading on.
        """
        (size, width), steps = q.shape, len(self.depths) - 1
        edge = np.where(q > 0, q * self.most[:, None], q * self.least[:, None])  # depth x query x list
        sums = edge[0].sum(axis=1)
        if not steps:
            return np.zeros((size, width), np.int64), sums < floor
        falls, costs = edge[:-1] - edge[1:], np.diff(self.depths)
        rate = np.minimum.accumulate(falls / costs[:, None, None], axis=0)  # so no step goes before an earlier one
        order = np.argsort(-rate.transpose(1, 0, 2).reshape(size, -1), axis=1, kind="stable")
        fallen = np.take_along_axis(falls.transpose(1, 0, 2).reshape(size, -1), order, axis=1).cumsum(axis=1)
        shown = costs[order // width].cumsum(axis=1)
        able = (sums[:, None] - fallen < floor[:, None]) & (shown * 2 <= len(self.v))
        taken = np.where(able.any(axis=1), able.argmax(axis=1) + 1, 0)
        taken[sums < floor] = 0
        used = np.arange(order.shape[1])[None, :] < taken[:, None]
        at = np.zeros((size, width), np.int64)
        np.add.at(at, (np.nonzero(used)[0], order[used] % width), 1)
        return self.depths[at], (taken > 0) | (sums < floor)

    def seen(self, q: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The candidates that the lists show one query down to its depths."""
        parts = [self.order[len(self.v) - d :, i] if q[i] > 0 else self.order[:d, i] for i in np.flatnonzero(depth) if (d := depth[i])]
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _blocks(v: np.ndarray, centres: np.ndarray) -> list[np.ndarray]:
    """The rows of v in blocks of near vectors: by their nearest centre, of so many centres as leave 64 rows each."""
    c = centres[: max(1, len(v) // LEAST)].astype(np.float64)
    if not len(c):
        return [np.arange(len(v))]
    half = (c * c).sum(axis=1) / 2
    near = np.concatenate([(v[a : a + BLOCK].astype(np.float64) @ c.T - half).argmax(axis=1) for a in range(0, len(v), BLOCK)])
    order = np.argsort(near, kind="stable")
    cut = np.flatnonzero(np.diff(near[order], prepend=-1))
    return [order[at : min(at + BLOCK, b)] for a, b in zip(cut, np.append(cut[1:], len(v)), strict=True) for at in range(a, b, BLOCK)]


def cell(q: np.ndarray, own: np.ndarray, v: np.ndarray, ids: np.ndarray, centres: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each query (rows of q, with their ids) the k best of the candidates (v, ids): query row, id, score.

    Also how many candidates were scored for each query, and how many list entries it read. A query first takes the
    block that promises most, then each block whose largest components can reach its kth score so far.
    """
    kind = _exact(q, v)
    blocks = _blocks(v, centres)
    top, low = (np.array([f(v[b], axis=0) for b in blocks]).astype(np.float64) for f in (np.max, np.min))
    plus, minus = np.where(q > 0, q, 0).astype(np.float64), np.where(q < 0, q, 0).astype(np.float64)
    promise = (plus @ top.T + minus @ low.T) if kind != np.int64 else np.full((len(q), len(blocks)), np.inf)
    first = promise.argmax(axis=1)
    floor = np.full(len(q), -np.inf)
    scored, read = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    # score and id of each query's best, the worst last; missing ones have no id
    best_score, best_id = np.full((len(q), k), np.iinfo(np.int64).min), np.full((len(q), k), -1, np.int64)
    have = np.zeros(len(q), np.int64)

    def take(asking: np.ndarray, block: np.ndarray, lists: Lists, read_lists: bool) -> bool:
        rows, hits, scores = [], [], []
        whole = np.ones(len(asking), bool)
        if read_lists and (able := np.flatnonzero(floor[asking] > -np.inf)).size:
            depth, done = lists.plan(q[asking[able]].astype(np.float64), floor[asking[able]])
            whole[able[done]] = False
            for i, d in zip(asking[able[done]], depth[done], strict=True):
                seen = lists.seen(q[i], d)
                s = lists.v[seen].astype(kind) @ q[i].astype(kind)
                keep = (s >= floor[i]) & (ids[block[seen]] != own[i])
                rows.append(np.full(int(keep.sum()), i))
                hits.append(ids[block[seen[keep]]])
                scores.append(s[keep].astype(np.int64))
                scored[i] += len(seen)
                read[i] += d.sum()
        if whole.any():
            who = asking[whole]
            s = q[who].astype(kind) @ lists.v.astype(kind).T
            scored[who] += len(block)
            read[who] += len(block)
            mine = ids[block][None, :] == own[who][:, None]
            bar = floor[who]
            if len(block) > k:  # what is below the kth of the block, its own row aside, is below the kth of all
                bar = np.maximum(bar, np.partition(s, len(block) - k - 1, axis=1)[:, len(block) - k - 1])
            r, c = np.nonzero((s >= bar[:, None]) & ~mine)
            rows.append(who[r])
            hits.append(ids[block[c]])
            scores.append(s[r, c].astype(np.int64))
        row, hit, score = (np.concatenate(x) for x in (rows, hits, scores))
        touched = np.unique(row)
        old = np.arange(k)[None, :] < have[touched, None]
        row = np.concatenate([np.repeat(touched, have[touched]), row])
        row, hit, score = best_of(row, np.concatenate([best_id[touched][old], hit]), np.concatenate([best_score[touched][old], score]), k)
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best_score[row, place], best_id[row, place] = score, hit
        have[touched] = np.searchsorted(row, touched, "right") - np.searchsorted(row, touched)
        full = touched[have[touched] == k]
        floor[full] = best_score[full, k - 1]
        return not whole.all()

    for turn in (0, 1):
        for b in np.argsort(-promise.max(axis=0, initial=-np.inf)) if len(q) else ():
            asking = np.flatnonzero((first == b) if turn == 0 else (first != b) & (promise[:, b] >= floor))
            lists = Lists(v[blocks[b]]) if len(asking) else None
            helps = kind != np.int64
            for part in np.split(asking, np.append(TRY, np.arange(TRY + TOGETHER, len(asking), TOGETHER))):
                if len(part):
                    # where the first could not stop within half the block, the others need not try
                    helps = take(part, blocks[b], lists, helps) or (helps and turn == 0)
    row, place = np.nonzero(np.arange(k)[None, :] < have[:, None])
    return row, best_id[row, place], best_score[row, place], scored, read


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


FOUND = "query long, query_id long, vec_id long, score long, scored long, listed long"


def _found(vectors: DataFrame, every: int, k: int, scale: int) -> DataFrame:
    """The best of each cell for each of its queries, and a row (no vec_id) of what that took."""
    spark = vectors.sparkSession
    x = F.col("embedding")
    fit = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.col("vec_id").isNotNull()
    rows = vectors.filter(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asks = F.col("vec_id") % every == 0
    n, asked, width = rows.agg(F.count("*"), F.count_if(asks), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    near = rows.select("v").orderBy(F.xxhash64("row"), "row").limit(CENTRES).toArrow().combine_chunks().column("v")
    sent = spark.sparkContext.broadcast(_matrix(pa.chunked_array(near.chunks, pa.list_(pa.int64())).combine_chunks(), width))
    groups, turns = max(parts_for(n, CANDIDATES, spark), 2 * spark.sparkContext.defaultParallelism), max(1, -(-asked // QUERIES))
    part = lambda ways: F.pmod(F.xxhash64("row", F.lit(ways)), F.lit(ways)).cast("int")
    numbers = lambda ways: F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))
    named = ["row", "vec_id", "v"]
    candidates = rows.select(numbers(turns).alias("turn"), part(groups).alias("group"), F.lit(False).alias("asks"), *named)
    asking = rows.filter(asks).select(part(turns).alias("turn"), numbers(groups).alias("group"), F.lit(True).alias("asks"), *named)

    def run(both: pa.Table) -> pa.Table:
        both = both.combine_chunks()
        mark, row, ids = (both.column(c).to_numpy() for c in ("asks", "row", "vec_id"))
        v = _matrix(pa.concat_arrays(both.column("v").chunks), width)
        query, own = row[mark], ids[mark]
        at, hit, score, scored, read = cell(v[mark], own, v[~mark], ids[~mark], sent.value, k) if (~mark).any() else (*(np.zeros(0, np.int64),) * 3, *(np.zeros(len(own), np.int64),) * 2)
        blank, zero = pa.nulls(len(own), pa.int64()), np.zeros(len(at), np.int64)
        columns = [np.concatenate([query[at], query]), np.concatenate([own[at], own]), pa.concat_arrays([pa.array(hit, pa.int64()), blank]), pa.concat_arrays([pa.array(score, pa.int64()), blank]), np.concatenate([zero, scored]), np.concatenate([zero, read])]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=[x.strip().split(" ")[0] for x in FOUND.split(",")])

    return candidates.unionByName(asking).groupBy("turn", "group").applyInArrow(run, FOUND)


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of each vector whose vec_id every divides.

    vectors has vec_id and embedding; components become floor(scale * x). Vectors that are null or hold a null or
    a component that is not finite take no part, nor do rows without a vec_id. Rows are candidates for all queries of
    another vec_id, and queries, each for itself, even if several have one vec_id. Of vectors of different length the
    shorter ends in zeros. Scores tie to the smaller vec_id. Fewer than k candidates give fewer rows, none no rows.

    Queries and candidates are dealt by their row number into cells of about 4096 by 65536, so no copies meet in
    one task more than others. In a cell, candidates lie in blocks of near vectors with a sorted list a dimension.
    A query passes over a block whose largest components cannot reach its kth score; in another it reads lists until
    what is unseen cannot, and scores only what they have shown; where half a block's entries do not suffice (for it,
    or for all of 32 queries before it), it scores the block. Each cell gives no more than k rows a query.
    """
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    found = _found(vectors, every, k, scale).filter("vec_id is not null")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def effort(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, scored and listed of each query of top_k(): candidates it scored and list entries it read."""
    each = _found(vectors, every, k, scale).filter("vec_id is null").groupBy("query", "query_id")
    return each.agg(F.sum("scored").alias("scored"), F.sum("listed").alias("listed")).drop("query")
