"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valprint.llm.shared import dropped, written


def roots(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that its links reach, for each node of edges (u, v) that is not its root.

    u and v have one orderable type. Each round hangs every node on the smallest node near it, first its larger
    neighbours and then the others; rounds end when the edges stay as they are. All steps group with partial
    aggregates or join, so a node with many links is split like any skewed join key.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").filter("v <> m").toDF("u", "v").unionByName(low.toDF("u", "v"))
        after = written(small.distinct(), "small-star")
        dropped(large, now)
        seen, mark, now = mark, _mark(after), after
        if mark == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
