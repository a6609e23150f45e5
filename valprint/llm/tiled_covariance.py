"""Whitening of embeddings by a covariance that is multiplied tile by tile (operator 12)."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valprint.llm.shared import dropped, written

#: Dimensions of a tile's side and rows of a row block.
TILE, ROWS = 32, 4096
#: Steps of a unit in which vectors are counted.
STEPS = 256
_SAFE = 1 << 62


def whole_vectors(table: DataFrame, vector: str = "embedding", steps: int = STEPS) -> DataFrame:
    """table with x, each entry's floor(steps * entry) as a long, without rows whose vector takes no part.

    These are null vectors and those with a null, NaN or infinite entry. Numbers beyond a long go to its ends.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    usable = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = lambda c: F.floor(F.least(F.greatest(c * F.lit(float(steps)), F.lit(-(2.0**63))), F.lit(float(2**63 - 1024))))
    return table.filter(usable).withColumn("x", F.transform(v, scaled))


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    """Rows by dimensions of a list column whose rows have d entries each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _narrow(x: np.ndarray) -> np.ndarray:
    """x in the smallest signed type that holds it."""
    for kind in (np.int8, np.int16, np.int32):
        if len(x) == 0 or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


@dataclasses.dataclass(frozen=True)
class Fit:
    """What whitening needs: n fit vectors with sums S, eigenvalues and unit eigenvectors (columns) of their covariance, largest first, and its trace."""

    d: int
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def floors(self) -> list[int]:
        return [s // self.n for s in self.sums]

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - S/n as doubles, and the sums over dimensions of (n * x - S)^2, exact; in Python numbers where a long is too short."""
        q, r = self.floors, [s % self.n for s in self.sums]
        far = max((max(abs(int(x[:, j].min()) - q[j]), abs(int(x[:, j].max()) - q[j])) for j in range(self.d)), default=0) if len(x) else 0
        large = max(map(abs, q), default=0) + far + 1
        if large >= _SAFE or self.d * ((far + 1) * self.n) ** 2 >= _SAFE:
            whole = x.astype(object) - np.array(q, object)
            away = (whole * self.n - np.array(r, object)) ** 2
            return whole.astype(float) - np.array(r, float) / self.n, away.sum(axis=1)
        whole = x - np.array(q, np.int64)
        away = (whole * self.n - np.array(r, np.int64)) ** 2
        return whole - np.array(r, float) / self.n, away.sum(axis=1)


def _summed(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors fit has, and the exact sum of each dimension: a row a task and dimension, then one a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            x = _matrix(batch.column(0), d)
            if not len(x):
                continue
            fits = max(abs(int(x.min())), abs(int(x.max()))) * len(x) < _SAFE
            n += len(x)
            sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0) if fits else x.astype(object).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_pydict({"dim": pa.array([*range(d), -1], pa.int32()), "s": pa.array([str(v) for v in [*sums, n]])})

    rows = fit.select("x").mapInArrow(run, "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found = {r["dim"]: int(r["s"]) for r in rows}
    return found.get(-1, 0), [found.get(j, 0) for j in range(d)]


def column_blocks(fit: DataFrame, floors: list[int], tile: int = TILE, rows: int = ROWS) -> DataFrame:
    """row_block, block, data: the columns of a block of dimensions for a block of rows, less each dimension's floored mean.

    The differences are whole numbers in the smallest type that holds them.
    """
    d = len(floors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for begin in range(0, len(x), rows):
                away = x[begin : begin + rows] - np.array(floors, np.int64)
                out = []
                for block in range(-(-d // tile)):
                    data = _narrow(away[:, block * tile : (block + 1) * tile])
                    out.append((block, data.dtype.str.encode() + data.tobytes()))
                yield pa.RecordBatch.from_pydict({"row_block": pa.array([(part << 32) + at] * len(out), pa.int64()), "block": pa.array([b for b, _ in out], pa.int32()), "data": pa.array([x for _, x in out], pa.binary())})
                at += 1

    return fit.select("x").mapInArrow(run, "row_block long, block int, data binary")


def tiles(blocks: DataFrame, means: np.ndarray, tile: int = TILE) -> DataFrame:
    """i, j, data: for each pair of dimension blocks i <= j the sum over all rows of the products of centred columns.

    Column blocks meet by their row block. A task sums the products of a tile at once, and what the tasks have of a
    tile meets by its key and is added as it comes, so memory is one tile's side squared for each tile of a task.
    """
    d = len(means)
    side = lambda i: slice(i * tile, min(d, (i + 1) * tile))
    schema = "i int, j int, data binary"

    def emitted(sums: dict) -> pa.RecordBatch:
        keys = list(sums)
        return pa.RecordBatch.from_pydict({"i": pa.array([i for i, _ in keys], pa.int32()), "j": pa.array([j for _, j in keys], pa.int32()), "data": pa.array([sums[k].tobytes() for k in keys], pa.binary())})

    def centred(data: bytes, i: int) -> np.ndarray:
        mean = means[side(i)]
        return np.frombuffer(data[3:], np.dtype(data[:3].decode())).reshape(-1, len(mean)) - mean

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for i, j, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                product = centred(a, i).T @ centred(b, j)
                sums[i, j] = sums[i, j] + product if (i, j) in sums else product
        yield emitted(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for i, j, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                product = np.frombuffer(data)
                sums[i, j] = sums[i, j] + product if (i, j) in sums else product
        yield emitted(sums)

    a, b = blocks.toDF("row_block", "i", "a"), blocks.toDF("row_block", "j", "b")
    pairs = a.join(b, "row_block").filter("i <= j").select("i", "j", "a", "b")
    return pairs.mapInArrow(multiply, schema).repartition("i", "j").mapInArrow(add, schema)


def fit(distinct: DataFrame, d: int, tile: int = TILE, rows: int = ROWS) -> Fit:
    """The Fit of a written table of distinct vectors x of d entries each, at least one.

    The driver gets the sums and the tiles, as large as the square of the dimensions whatever the rows, and finds the
    eigenvectors. Row blocks go by the order of the table, so it must be one that reads alike each time.
    """
    n, sums = _summed(distinct, d)
    floors = [s // n for s in sums]
    means = np.array([(s % n) / n for s in sums])
    v = np.zeros((d, d))
    for r in tiles(column_blocks(distinct, floors, tile, rows), means, tile).collect():
        a, b = r["i"] * tile, r["j"] * tile
        data = np.frombuffer(r["data"]).reshape(min(tile, d - a), -1) / n
        v[a : a + data.shape[0], b : b + data.shape[1]] = data
        v[b : b + data.shape[1], a : a + data.shape[0]] = data.T
    values, found = np.linalg.eigh((v + v.T) / 2)
    values, found = values[::-1], found[:, ::-1]
    found = found * np.where(found[np.abs(found).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return Fit(d, n, tuple(sums), np.maximum(values, 0.0), found, float(np.trace(v)))


def _projected(found: Fit, most: int) -> tuple[int, np.ndarray]:
    """How many of the first components have variance beyond rounding, and the matrix that whitens by them."""
    k = min(most, found.d)
    live = int((found.values[:k] > found.values[0] * found.d * 2.3e-16).sum()) if found.trace > 0 else 0
    return live, found.vectors[:, :live] / np.sqrt(found.values[:live])


def identity_error(distinct: DataFrame, found: Fit, components: int = 4) -> float | None:
    """The largest entry of the whitened fit vectors' covariance less the identity; None if no component has variance.

    The covariance is summed from whitened vectors, a row a task, and centred before it is multiplied.
    """
    live, project = _projected(found, components)
    if not live:
        return None
    d = found.d

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((live, live)), 0
        for batch in batches:
            w = found.centred(_matrix(batch.column(0), d))[0] @ project
            total, n = total + w.T @ w, n + len(w)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(range(live * live), pa.int32()), "s": pa.array(total.ravel())})

    rows = distinct.select("x").mapInArrow(sums, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()
    total = np.zeros(live * live)
    for r in rows:
        total[r["cell"]] = r["s"]
    return float(np.abs(total.reshape(live, live) / found.n - np.eye(live)).max())


def whitened(table: DataFrame, vector: str = "embedding", components: int = 4, tile: int = TILE, rows: int = ROWS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector and each of the first components.

    A vector's entries count in whole steps of 1/256 (x). The covariance is that of the distinct x, however often they
    come; its tiles are multiplied by row blocks and put together on the driver, which finds the eigenvectors. Each
    has its largest entry positive. Rows without a usable vector are left out, as are those of another length than
    the most frequent (of equals the longest). Repeated rows and rows of a null vec_id stay, each with its own result.
    A component without variance has whitened null; identity_error leaves it out, and is null, as explained is, if
    there is none with any. A deviation beyond a long is null. An empty table gives no rows; further columns,
    whatever their names, are left out.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable = whole_vectors(table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v")), "v")
    lengths = usable.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).filter("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return table.sparkSession.createDataFrame([], schema)
    usable = usable.filter(F.size("x") == lengths["d"]).select("vec_id", "x")
    distinct = written(usable.select("x").distinct(), "fit-vectors")
    found = fit(distinct, lengths["d"], tile, rows)
    error = identity_error(distinct, found, components)
    dropped(distinct)
    live, project = _projected(found, components)
    k = min(components, found.d)
    share = found.values[:k] / found.trace if found.trace > 0 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                m = part.num_rows
                away, deviation = found.centred(_matrix(part.column(1), found.d))
                w = np.zeros((m, k))
                w[:, :live] = away @ project
                exact = [int(v) if int(v) < 1 << 63 else None for v in deviation]
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column(0).take(pa.array(np.repeat(np.arange(m), k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), "n": pa.array(np.full(m * k, found.n, np.int64)),
                    "deviation": pa.array([v for v in exact for _ in range(k)], pa.int64()), "whitened": pa.array(w.ravel(), mask=np.tile(np.arange(k) >= live, m)),
                    "explained": pa.array(np.tile(share, m)) if share is not None else pa.nulls(m * k, pa.float64()), "identity_error": pa.array([error] * (m * k), pa.float64()),
                })

    return usable.mapInArrow(run, schema)
