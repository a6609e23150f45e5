"""Tables of any shape as cells: one row a column and value, all as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from valprint.operators import chunked


def as_text(df: DataFrame) -> DataFrame:
    """Every column cast to string."""
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def cells(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """cid (`name.column`) and val for each non-null, non-blank value, trimmed."""
    columns = columns or df.columns
    pairs = F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("cid"), F.trim(F.col(f"`{c}`").cast("string")).alias("val")) for c in columns]))
    return df.select(pairs.alias("x")).select("x.cid", "x.val").filter(F.col("val") != "")


def canonical(value: Column | str) -> Column:
    """Digits without leading zeros, other text in upper case."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v.rlike(r"\A[0-9]+\z"), F.regexp_replace(v, "^0+(?=[0-9])", "")).otherwise(F.upper(v))


def value_sets(df: DataFrame, canon: bool = False) -> DataFrame:
    """The distinct values of each column: exact sets, one row a member."""
    return df.select("cid", (canonical("val") if canon else F.col("val")).alias("val")).distinct()


def frequencies(df: DataFrame) -> DataFrame:
    """cid, val and how often it comes, as a double."""
    return df.groupBy("cid", "val").agg(F.count("*").cast("double").alias("freq"))


def sampled(df: DataFrame, percent: float, seed: int = 42) -> DataFrame:
    """A Bernoulli sample of rows."""
    return df.sample(fraction=percent / 100, seed=seed)


def sample_distinct(df: DataFrame, limit: int = 4096) -> DataFrame:
    """At most limit distinct values of each column, the first in the order of their hash, so that runs agree."""
    w = Window.partitionBy("cid").orderBy(F.md5(F.col("val").cast("binary")), "val")
    return df.select("cid", "val").distinct().withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).drop("rn")


def fingerprints(df: DataFrame) -> DataFrame:
    """cid, n_sampled, n_distinct and the sets of values and of folded values in the portable format."""
    each = df.groupBy("cid").agg(F.count("*").alias("n_sampled"), F.count_distinct("val").alias("n_distinct"))
    exported = lambda name, fold: chunked.exported(chunked.build(df, fold)).toDF("cid", name)
    return each.join(exported("raw", False), "cid").join(exported("folded", True), "cid").select("cid", "n_sampled", "n_distinct", "raw", "folded")


def family(values: Column) -> Column:
    """Aggregate: `integer` if all non-blank values read as integers, `numeric` if as numbers, else `string`."""
    v = F.trim(values)
    v = F.when(v != "", v)
    whole = F.bool_and(v.rlike(r"\A[-+]?[0-9]+\z"))
    number = F.bool_and(v.rlike(r"\A[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\z"))
    return F.when(whole, "integer").when(number, "numeric").otherwise("string")
