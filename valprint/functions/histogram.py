"""Weighted value sets with shape measures: building from samples or from statistics steps, and comparing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valprint.functions.codec import to_base64
from valprint.functions.hashing import value_hash, value_hash_normalized

SHAPE = ("cardinality_ratio", "discreteness", "range_density", "repeatability")
#: Repeatability that counts as the largest on the log scale of similarity().
MOST_REPEATED = 1e6


def _finished(df: DataFrame, by: list[str], steps: Column, equal: Column, ranged: Column, distinct: Column, zero: Column, weights: DataFrame) -> DataFrame:
    totals = df.groupBy(*by).agg(steps.alias("steps"), equal.alias("total_equal_rows"), ranged.alias("total_range_rows"), distinct.alias("total_distinct_range_rows"), zero.alias("zero_range_steps"))
    whole = F.col("total_equal_rows") + F.col("total_range_rows")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    shaped = totals.withColumn("total_rows", whole).withColumn(
        "shape",
        F.struct(
            ratio(F.col("steps") + F.col("total_distinct_range_rows"), whole).alias("cardinality_ratio"),
            ratio(F.col("zero_range_steps").cast("double"), F.col("steps")).alias("discreteness"),
            ratio(F.col("total_distinct_range_rows"), F.col("steps") - F.col("zero_range_steps")).alias("range_density"),
            ratio(F.col("total_equal_rows"), F.col("steps")).alias("repeatability"),
        ),
    )
    shaped = shaped.withColumn("shape_extra", F.create_map().cast("map<string,string>"))
    entries = weights.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("hash", "weight"))).alias("weights"))
    fixed = ["steps", "total_rows", "total_equal_rows", "total_range_rows", "total_distinct_range_rows", "zero_range_steps", "shape", "shape_extra", "weights"]
    return shaped.join(entries, by, "left").select(*by, F.struct(*fixed).alias("histogram"))


def _hashed(df: DataFrame, key: str, normalize: bool) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).withColumn("hash", value_hash_normalized(key) if normalize else value_hash(key))


def build_weighted(df: DataFrame, by: list[str], key: str, weight: str, normalize: bool = False) -> DataFrame:
    """A histogram for each group from values with weights. Weights of one value add up; a null weight is 0.

    steps counts rows, so give one row a value for a true ratio. A null value is left out.
    """
    rows = _hashed(df, key, normalize).withColumn("w", F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))
    zero = F.lit(0.0)
    weights = rows.groupBy(*by, "hash").agg(F.sum("w").alias("weight"))
    return _finished(rows, by, F.count("*"), F.sum("w"), F.first(zero), F.first(zero), F.first(F.lit(0).cast("long")), weights)


def build_steps(df: DataFrame, by: list[str], key: str, equal: str, ranged: str, distinct: str, order: str, normalize: bool = False) -> DataFrame:
    """A histogram for each group from statistics steps. Of a value's steps the last by order gives its weight."""
    rows = _hashed(df, key, normalize).select(*by, "hash", order, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in ((equal, "eq"), (ranged, "rng"), (distinct, "drng"))])
    weights = rows.groupBy(*by, "hash").agg(F.max_by("eq", order).alias("weight"))
    return _finished(rows, by, F.count("*"), F.sum("eq"), F.sum("rng"), F.sum("drng"), F.count_if(F.col("rng") == 0), weights)


def set_shape(histogram: Column, **known: Column | float | str) -> Column:
    """A histogram with shape measures taken from elsewhere; names beyond the four measures replace all extras."""
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    shape = F.struct(*[(value(known[n]).cast("double") if n in known else histogram["shape"][n]).alias(n) for n in SHAPE])
    extras = {n: value(x) for n, x in known.items() if n not in SHAPE}
    extra = F.create_map(*[c for n, x in sorted(extras.items()) for c in (F.lit(n), x.cast("string"))]).cast("map<string,string>")
    return histogram.withField("shape", shape).withField("shape_extra", extra)


def bitmap(histogram: Column) -> Column:
    """The set of a histogram's values."""
    return F.array_sort(F.map_keys(histogram["weights"]))


def weighted_containment(histogram: Column, domain: Column) -> Column:
    """The part of a histogram's weight on values of a domain; 0 if it has no weight."""
    zero = F.lit(0.0)
    total = F.aggregate(F.map_values(histogram["weights"]), zero, lambda a, x: a + x)
    held = F.aggregate(F.map_values(F.map_filter(histogram["weights"], lambda k, _: F.array_contains(domain, k))), zero, lambda a, x: a + x)
    return F.when(histogram.isNotNull() & domain.isNotNull(), F.when(total > 0, held / total).otherwise(0.0))


def shape_json(histogram: Column) -> Column:
    """The four measures and the extras as JSON text, in the order of names for the four."""
    base = F.to_json(histogram["shape"])
    extra = F.to_json(histogram["shape_extra"])
    return F.when(F.size(histogram["shape_extra"]) > 0, F.concat(F.regexp_replace(base, r"\}$", ","), F.regexp_replace(extra, r"^\{", ""))).otherwise(base)


def similarity(a: Column, b: Column) -> Column:
    """Distance of two shapes; repeatability counts on a log scale. 0 is the same shape."""
    log = lambda h: F.log1p(h["shape"]["repeatability"]) / math.log(1 + MOST_REPEATED)
    parts = [a["shape"][n] - b["shape"][n] for n in ("cardinality_ratio", "discreteness")] + [log(a) - log(b)]
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def to_wire(histogram: Column) -> Column:
    """JSON text of a histogram, version 2, with its set in the portable format."""
    fields = ["shape", "steps", "total_distinct_range_rows", "total_equal_rows", "total_range_rows", "total_rows"]
    return F.to_json(F.struct(to_base64(bitmap(histogram)).alias("bitmap"), *[histogram[f].alias(f) for f in fields], F.lit(2).alias("v"), histogram["weights"].alias("weights"), histogram["zero_range_steps"].alias("zero_range_steps")))


WIRE = "shape struct<cardinality_ratio:double,discreteness:double,range_density:double,repeatability:double>, cardinality_ratio double, discreteness double, range_density double, repeatability double, steps bigint, total_rows double, total_equal_rows double, total_range_rows double, total_distinct_range_rows double, zero_range_steps bigint, weights map<string,double>"


def from_wire(text: Column) -> Column:
    """The histogram of JSON text of version 2 or of the older flat one; null if it cannot be read.

    Without total_equal_rows they are the sum of the weights.
    """
    j = F.from_json(text, WIRE)
    weights = F.transform_keys(F.coalesce(j["weights"], F.create_map().cast("map<string,double>")), lambda k, _: k.cast("bigint"))
    zero = F.lit(0.0)
    total = F.aggregate(F.map_values(weights), zero, lambda a, x: a + x)
    shape = F.struct(*[F.coalesce(j["shape"][n], j[n], zero).alias(n) for n in SHAPE])
    number = lambda n: F.coalesce(j[n], zero)
    return F.when(
        j["weights"].isNotNull() | j["steps"].isNotNull() | j["shape"].isNotNull(),
        F.struct(
            F.coalesce(j["steps"], F.lit(0).cast("long")).alias("steps"),
            number("total_rows").alias("total_rows"),
            F.when(number("total_equal_rows") == 0, total).otherwise(number("total_equal_rows")).alias("total_equal_rows"),
            number("total_range_rows").alias("total_range_rows"),
            number("total_distinct_range_rows").alias("total_distinct_range_rows"),
            F.coalesce(j["zero_range_steps"], F.lit(0).cast("long")).alias("zero_range_steps"),
            shape.alias("shape"),
            F.create_map().cast("map<string,string>").alias("shape_extra"),
            weights.alias("weights"),
        ),
    )
