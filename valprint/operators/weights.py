"""Weighted histograms as rows, for columns of any number of values: one row a value with its weight, one a column with its shape.

The form of one row a histogram (valprint.functions.histogram) is for exchange; what is compared here stays in rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from valprint.functions.histogram import MOST_REPEATED


def weights(rows: DataFrame) -> DataFrame:
    """cid, val, weight, steps of rows (cid, val, freq): weights of a value add up, a null freq is 0, null values are left out.

    steps counts the rows of a value, which are what a statistics table lists.
    """
    return rows.filter("val is not null").groupBy("cid", "val").agg(F.sum(F.coalesce(F.col("freq").cast("double"), F.lit(0.0))).alias("weight"), F.count("*").alias("steps"))


def shapes(weighted: DataFrame) -> DataFrame:
    """cid, steps, total_rows, cardinality_ratio, repeatability, discreteness, range_density of weights(); all values are steps of their own."""
    s = weighted.groupBy("cid").agg(F.sum("steps").alias("steps"), F.sum("weight").alias("total_rows"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return s.select("cid", "steps", "total_rows", ratio(F.col("steps"), F.col("total_rows")).alias("cardinality_ratio"), ratio(F.col("total_rows"), F.col("steps")).alias("repeatability"), F.lit(0.0).alias("discreteness"), F.lit(0.0).alias("range_density"))


def held(weighted: DataFrame, domains: DataFrame) -> DataFrame:
    """cid, domain, held: the part of each column's weight on values of each domain (cid, val) that shares one; a column without weight has 0.

    One equi-join on the value, summed before the shuffle by column and domain.
    """
    inside = weighted.join(domains.select(F.col("cid").alias("domain"), "val").distinct(), "val").groupBy("cid", "domain").agg(F.sum("weight").alias("inside"))
    total = weighted.groupBy("cid").agg(F.sum("weight").alias("total"))
    return inside.join(total, "cid").select("cid", "domain", F.when(F.col("total") > 0, F.col("inside") / F.col("total")).otherwise(0.0).alias("held"))


def classified(weighted: DataFrame, domains: DataFrame) -> DataFrame:
    """cid, n, total_rows, cardinality_ratio, domain, held, ties: the domain that holds most of each column's weight, null if none holds any.

    Of equals the first by name counts, and ties says how many are as good.
    """
    w = Window.partitionBy("cid").orderBy(F.desc("held"), "domain")
    ties = F.count("*").over(Window.partitionBy("cid", "held"))
    best = held(weighted, domains).withColumns({"place": F.row_number().over(w), "ties": ties}).filter("place = 1").drop("place")
    n = weighted.groupBy("cid").agg(F.count("*").alias("n"), F.sum("weight").alias("total_rows"))
    return n.join(best, "cid", "left").select("cid", "n", "total_rows", F.when(F.col("total_rows") > 0, F.col("n") / F.col("total_rows")).otherwise(0.0).alias("cardinality_ratio"), "domain", F.coalesce("held", F.lit(0.0)).alias("held"), F.coalesce("ties", F.lit(0).cast("long")).alias("ties"))


def distances(shaped: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, distance of pairs (a, b) of columns by their shapes(): as histogram.similarity(), for rows."""
    log = F.log1p("repeatability") / math.log(1 + MOST_REPEATED)
    point = lambda c, s: shaped.select(F.col("cid").alias(c), F.struct(F.col("cardinality_ratio").alias("x"), log.alias("y"), F.col("discreteness").alias("z")).alias(s))
    gap = lambda f: (F.col(f"p.{f}") - F.col(f"q.{f}")) * (F.col(f"p.{f}") - F.col(f"q.{f}"))
    return pairs.join(point("a", "p"), "a").join(point("b", "q"), "b").select("a", "b", F.sqrt(gap("x") + gap("y") + gap("z")).alias("distance"))
