"""Reading tables of any format and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column as text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def csv_typed(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header and typed columns; give the schema where it is known, which saves a pass."""
    return spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True, inferSchema=True)


def csv_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file without the rows that do not fit the schema."""
    return spark.read.csv(path, header=True, schema=schema, mode="DROPMALFORMED")


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query that another database answers, over its JDBC driver."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def json_rows(spark: SparkSession, path: str, field: str, schema: str, lines: bool = False) -> DataFrame:
    """The elements of an array field of JSON documents, one row each; a document is a file, or with lines a line."""
    return spark.read.json(path, schema=f"{field} array<struct<{schema}>>", multiLine=not lines).select(F.inline(field))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_captures(df: DataFrame, path: str) -> None:
    """Column fingerprints of one capture, by server and database; df has dataserver, database and sample_time."""
    df.write.mode("append").partitionBy("dataserver", "database").parquet(path)


def captures_as_of(df: DataFrame, keys: list[str], when: str) -> DataFrame:
    """Of each key the rows of the latest sample_time up to when."""
    before = df.filter(F.col("sample_time") <= F.lit(when).cast("timestamp"))
    latest = before.groupBy(*keys).agg(F.max("sample_time").alias("sample_time"))
    return before.join(latest, [*keys, "sample_time"])


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions of a table that df has rows for, and keeps the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
