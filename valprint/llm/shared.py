"""What several operators need: tables, shared scratch tables, texts of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='valprint-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df to a new table in the shared folder and reads it back, which cuts the lineage."""
    path = f"{scratch_root(df.sparkSession)}/valprint/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes tables made by written() that no later result reads; other tables stay."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark._jvm
        ours = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/valprint").toUri().getPath()
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            if path.toUri().getPath().startswith(f"{ours}/"):
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches whose texts have about so many bytes together, with the texts as a list, null as empty.

    A single longer text is a part of its own, so memory follows the longest text and not the rows of a batch.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > chars:
                part = batch.slice(start, i - start)
                yield part, [x or "" for x in column.slice(start, i - start).to_pylist()]
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start), [x or "" for x in column.slice(start).to_pylist()]


#: Bytes of texts that a filter judges at once, about.
FILTERED = 250_000
#: Bytes of rows that Spark hands to a worker at once, about; it holds them several times over, outside its heap.
BATCH = 1_000_000


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of a session in bytes, not in rows alone; a smaller bound of the session's own stays.

    Spark's rule of 10,000 rows makes 20 MB and more of texts, in each running task as a vector, as a stream and in the worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH:
        spark.conf.set(name, str(BATCH))


def kept_rows(docs: DataFrame, decider: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text") -> DataFrame:
    """The rows of docs whose text decider's function keeps; rows pass with all their columns and nothing is shuffled.

    decider makes, in each task, what takes texts (null as empty) and gives a boolean for each. A worker keeps none of
    it for the next task, which may be another operator's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = decider()
        for part, texts in slices(batches, text, FILTERED):
            yield part.filter(pa.array(np.asarray(decide(texts), bool)))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(forgetful(run), docs.schema)


_kept: dict = {}


def kept(key: tuple, make: Callable):
    """What a Python worker keeps between tasks under a key, made anew if it keeps something else.

    It keeps one thing at a time, so its memory follows the largest operator of a job and not all of them.
    """
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Gives up what a Python worker keeps, and its free memory back to the machine where that is possible."""
    if _kept:
        _kept.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def forgetful(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, in a worker that keeps nothing of other operators and gives its memory back after each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from run(batches)
        forget()

    return task


def held_out(doc_id: str = "doc_id"):
    """True for the documents that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: Partitions whose ranges or totals the driver keeps, at most; beyond them partitions grow, and sorts spill.
MOST_PARTS = 16_384


def parts_for(rows: int, each: int, spark: SparkSession, most: int | None = None) -> int:
    """Partitions for so many rows, at least one for each core; with most no more than these."""
    parts = max(-(-rows // each), spark.sparkContext.defaultParallelism, 1)
    return parts if most is None else min(parts, most)
