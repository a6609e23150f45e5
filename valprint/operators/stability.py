"""How far the shapes of columns hold from one sample to another."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valprint.functions.histogram import MOST_REPEATED


def sample_of(key: Column | str, parts: int) -> Column:
    """The sample of a row, from 0 to parts - 1, by the first 32 bits of the MD5 of its key as text; null keys count as empty."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % parts).cast("int")


def sampled_cells(df: DataFrame, name: str, columns: list[str], key: Column | str, parts: int, percent: float = 100.0) -> DataFrame:
    """part, cid, val: the cells of columns in disjoint samples of rows, all made by one scan.

    Of 10,000 slots by the key's hash each part takes percent / parts, so parts never share a row and come out alike
    each time. null and blank cells are left out.
    """
    slot = sample_of(key, 10_000)
    each = F.lit(100.0 * percent / parts)
    pairs = F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("cid"), F.trim(F.col(f"`{c}`").cast("string")).alias("val")) for c in columns]))
    parted = df.select(F.floor(slot / each).cast("int").alias("part"), *[F.col(f"`{c}`") for c in columns]).filter(F.col("part") < parts)
    return parted.select("part", pairs.alias("x")).select("part", "x.cid", "x.val").filter("val <> ''")


def sample_shapes(cells: DataFrame) -> DataFrame:
    """cid, part, rows, n, cardinality_ratio, repeatability of each column in each sample."""
    f = cells.groupBy("cid", "part", "val").agg(F.count("*").alias("f"))
    t = f.groupBy("cid", "part").agg(F.sum("f").alias("rows"), F.count("*").alias("n"))
    return t.select("cid", "part", "rows", "n", (F.col("n") / F.col("rows")).alias("cardinality_ratio"), (F.col("rows") / F.col("n")).alias("repeatability"))


def shape_stability(cells: DataFrame) -> DataFrame:
    """cid, samples, distance, spread, ratio_deviation of columns over all pairs of their samples.

    distance is the mean distance of two samples' shapes, as similarity() has it with the same discreteness on both
    sides; spread is the largest less the smallest; ratio_deviation is the standard deviation of the cardinality
    ratio. A column that only one sample has is as stable as can be told: null.
    """
    shapes = sample_shapes(cells)
    log = F.log1p("repeatability") / math.log(1 + MOST_REPEATED)
    points = shapes.select("cid", "part", F.col("cardinality_ratio").alias("x"), log.alias("y"))
    a, b = points.toDF("cid", "p", "x", "y"), points.toDF("cid", "q", "u", "v")
    gap = F.sqrt((F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v")))
    pairs = a.join(b, "cid").filter("p < q").groupBy("cid").agg(F.avg(gap).alias("distance"), (F.max(gap) - F.min(gap)).alias("spread"))
    each = points.groupBy("cid").agg(F.count("*").alias("samples"), F.stddev_samp("x").alias("ratio_deviation"))
    return each.join(pairs, "cid", "left").select("cid", "samples", "distance", "spread", "ratio_deviation")
