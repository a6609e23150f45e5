"""References between columns found in layers, each of which sees only what the one before could not rule out.

First every column is summed up once: rows, distinct values, family, ends and its first values by a hash. From the
summaries alone columns are classed, those of unique values are taken as keys, and pairs of a column and a key get an
upper bound of containment. Only pairs that the bound lets pass are counted exactly. The bound is certain, so no reference is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from valprint.operators.cells import family
from valprint.operators.match import validated_keys

#: Values that a summary keeps, at most: few enough that Spark cuts each task's share of a column before the shuffle.
FIRST = 512


def digest(value: Column | str) -> Column:
    """The hash by which a column's first values are chosen; no two different values share it."""
    return F.md5((F.col(value) if isinstance(value, str) else value).cast("binary"))


def summaries(cells: DataFrame, first: int = FIRST) -> DataFrame:
    """cid, rows, n, family, low, high, head, whole of each column of cells (cid, val).

    low and high are the smallest and largest value if all are whole numbers of at most 18 digits, else null. head
    holds the first values by digest(), whole says that these are all.
    """
    counts = cells.groupBy("cid", "val").agg(F.count("*").alias("rows"))
    number = F.when(F.col("val").rlike(r"\A[-+]?[0-9]{1,18}\z"), F.col("val").cast("long"))
    each = counts.groupBy("cid").agg(
        F.sum("rows").alias("rows"), F.count("*").alias("n"), family(F.col("val")).alias("family"), F.min(number).alias("low"), F.max(number).alias("high"), F.count(number).alias("numbers"),
        # "1", "+1" and "01" are three values but one number
        F.count_if(number.cast("string") == F.col("val")).alias("plain"),
    )
    by_hash = Window.partitionBy("cid").orderBy("hash")
    heads = counts.select("cid", digest("val").alias("hash")).withColumn("k", F.row_number().over(by_hash)).filter(F.col("k") <= first).groupBy("cid").agg(F.array_sort(F.collect_list("hash")).alias("head"))
    ends = lambda c: F.when((F.col("numbers") == F.col("n")) & (F.col("plain") == F.col("n")), F.col(c)).alias(c)
    return each.join(heads, "cid").select("cid", "rows", "n", "family", ends("low"), ends("high"), "head", (F.size("head") == F.col("n")).alias("whole"))


def column_class(rows: Column, n: Column) -> Column:
    """What rows and distinct values make of a column: a key holds each value once, a measure hardly repeats one."""
    return F.when(n == rows, "key").when(n * 20 < rows, "low-cardinality dimension").when(n * 2 > rows, "measure").otherwise("dimension")


def size_bound(a: Column, b: Column) -> Column:
    """The largest part of column a that can lie in b by their sizes and the ends of whole numbers, from structs of their summaries."""
    na = a["n"]
    room = F.greatest(F.least(a["high"], b["high"]).cast("decimal(20,0)") - F.greatest(a["low"], b["low"]) + 1, F.lit(0))
    inside = F.when(a["low"].isNotNull() & b["low"].isNotNull(), F.least(na.cast("decimal(20,0)"), room)).otherwise(na.cast("decimal(20,0)")).cast("double")
    return F.least(F.lit(1.0), b["n"] / na, inside / na)


def head_bound(a: Column, b: Column) -> Column:
    """The same by the first values: what a's hold up to where b's reach and b's lack is certainly missing."""
    reach = F.when(~b["whole"], F.array_max(b["head"]))
    seen = F.filter(a["head"], lambda h: reach.isNull() | (h <= reach))
    return (a["n"] - F.size(F.array_except(seen, b["head"]))) / a["n"]


def bounded_pairs(summed: DataFrame, least: int = 8, threshold: float = 0.0) -> DataFrame:
    """child, parent, child_class, bound for each column against each key of its family with least or more values.

    The rows are columns by keys, not values; both sides meet by their family with sizes and ends alone. Only pairs
    whose bound by these reaches the threshold are told, and get the first values of both to be held against each other.
    """
    column = lambda name: F.struct("n", "low", "high").alias(name)
    kind = column_class(F.col("rows"), F.col("n"))
    children = summed.select("family", F.col("cid").alias("child"), kind.alias("child_class"), column("a"))
    parents = summed.filter((kind == "key") & (F.col("n") >= least)).select("family", F.col("cid").alias("parent"), column("b"))
    met = children.join(parents, "family").filter("child <> parent").select("child", "parent", "child_class", size_bound(F.col("a"), F.col("b")).alias("bound")).filter(F.col("bound") >= threshold)
    heads = lambda cid, name: summed.select(F.col("cid").alias(cid), F.struct("n", "head", "whole").alias(name))
    both = met.join(heads("child", "a"), "child").join(heads("parent", "b"), "parent")
    return both.select("child", "parent", "child_class", F.least("bound", head_bound(F.col("a"), F.col("b"))).alias("bound"))


def layered_keys(sets: DataFrame, pairs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """child, parent, child_class, containment, violations of the bounded_pairs() that are references by an exact count.

    Of sets only the columns of pairs whose bound reaches the threshold are read. The class of a child is told and
    rules nothing out, as a sparse reference to a large table looks like a measure. violations counts the distinct
    values that the parent lacks.
    """
    able = pairs.filter(F.col("bound") >= threshold)
    exact = validated_keys(sets, able, None).filter(F.col("containment") >= threshold)
    return exact.join(able, ["child", "parent"]).select("child", "parent", "child_class", "containment", (F.col("fk_card") - F.col("inter")).alias("violations"))
