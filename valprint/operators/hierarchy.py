"""Labels of hierarchies: whole paths from links to parents, and labels that a registry lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valprint.sources.scratch import dropped, written


def label_paths(nodes: DataFrame, between: str = " > ") -> DataFrame:
    """id, path, depth, root of each node (id, parent, label): the labels from its root down to it.

    Each round every node jumps to where its ancestor had come, so the way behind it doubles: rounds follow the
    logarithm of the depth, with a row a node. A parent that is no node counts as none. A node on or under a cycle
    never ends; after as many rounds as the longest way could take it has path, depth and root null. A null or empty
    label is left out of paths; of rows of one id the first by parent and label counts.
    """
    one = nodes.filter("id is not null").groupBy("id").agg(F.min(F.struct("parent", "label")).alias("x")).select("id", "x.parent", "x.label")
    known = one.select(F.col("id").alias("parent"), F.lit(True).alias("is_node"))
    began = one.join(known, "parent", "left").select("id", F.when(F.col("is_node"), F.col("parent")).alias("top"), F.nullif(F.col("label"), F.lit("")).alias("path"), F.lit(0).cast("long").alias("depth"), F.col("id").alias("root"))
    ways = written(began, "paths")
    most = max(1, ways.count()).bit_length() + 1
    for _ in range(most):
        if ways.filter("top is not null").isEmpty():
            break
        above = ways.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("path").alias("before"), F.col("depth").alias("up"), F.col("root").alias("their"))
        far = ways.filter("top is not null").join(above, "top").select("id", F.col("next").alias("top"), F.nullif(F.concat_ws(between, "before", "path"), F.lit("")).alias("path"), (F.col("depth") + F.col("up") + 1).alias("depth"), F.col("their").alias("root"))
        after = written(ways.filter("top is null").unionByName(far), "paths")
        dropped(ways)
        ways = after
    ended = F.col("top").isNull()
    return ways.select("id", F.when(ended, F.coalesce("path", F.lit(""))).alias("path"), *[F.when(ended, F.col(c)).alias(c) for c in ("depth", "root")])


def new_labels(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """label of the candidates (label) that existing labels lack whatever the case, each once as it is written."""
    upper = lambda df: df.filter("label is not null").select(F.upper("label").alias("upper"), "label")
    return upper(candidates).distinct().join(upper(existing).select("upper").distinct(), "upper", "left_anti").select("label")
