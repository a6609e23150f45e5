"""Tables in the folder that driver and executors share, for results that several plans read and for cut lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a folder of our own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='valprint-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """The path of a new folder among our own in the shared one; what is left of it goes when the driver ends."""
    name = f"{shared_folder(spark)}/valprint/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(path)  # only what is there can be named for deletion
    files.deleteOnExit(path)
    files.delete(path, True)
    return name


def written(df: DataFrame, label: str) -> DataFrame:
    """df written once to a new table of the shared folder and read back; unlike a checkpoint its input runs once."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more; other tables stay."""
    for df in frames:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs
        ours = hadoop.Path(f"{shared_folder(spark)}/valprint").toUri().getPath()
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = hadoop.Path(name)
            if path.toUri().getPath().startswith(f"{ours}/"):
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
